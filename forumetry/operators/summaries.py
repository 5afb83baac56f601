"""Overviews, coverage gaps, platform totals and reaction sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forumetry.functions.text import excerpt, or_empty

_SHOWN = ["created_at", "permalink", "reactions", "shares", "comments_count", "views", "forwards", "reply_count", "has_media", "media_type"]


def extracted(comments: DataFrame, by: str, key: str) -> DataFrame:
    return comments.groupBy(F.col(by).alias(key)).agg(F.count("*").alias("extracted_comment_count"))


def with_gap(rows: DataFrame, counts: DataFrame, key: str) -> DataFrame:
    found = F.coalesce("extracted_comment_count", F.lit(0))
    return rows.join(counts, key, "left").withColumn("extracted_comment_count", found).withColumn("comment_gap", F.col("comments_count") - F.col("extracted_comment_count"))


def post_overview(posts: DataFrame, comments: DataFrame) -> DataFrame:
    shown = posts.select("post_id", *_SHOWN, excerpt(F.col("message")).alias("post_excerpt"))
    return with_gap(shown, extracted(comments, "parent_post_id", "post_id"), "post_id")


def propagation_overview(propagations: DataFrame, comments: DataFrame) -> DataFrame:
    shown = propagations.select("propagation_id", "origin_post_id", "propagation_kind", *_SHOWN, excerpt(F.col("message")).alias("propagation_excerpt"))
    return with_gap(shown, extracted(comments.where("parent_entity_type = 'propagation'"), "parent_entity_id", "propagation_id"), "propagation_id")


def propagation_comments(comments: DataFrame, propagations: DataFrame) -> DataFrame:
    """Comments below re-shares with what they re-share; the re-share's origin goes before the comment's own."""
    columns = ["comment_id", "parent_post_id", "parent_entity_id", "origin_post_id", "parent_comment_id", "thread_root_post_id", "reply_to_message_id", "created_at", "depth", "author_id", "permalink"]
    own = comments.where("parent_entity_type = 'propagation'").select(*(c for c in columns if c in comments.columns), excerpt(F.col("message"), 280).alias("comment_excerpt"))
    of = propagations.select(F.col("propagation_id").alias("parent_entity_id"), F.col("origin_post_id").alias("_origin"), "propagation_kind", F.col("permalink").alias("propagation_permalink"))
    return own.join(of, "parent_entity_id", "left").withColumn("origin_post_id", F.coalesce("_origin", "origin_post_id")).drop("_origin")


def gaps(overview: DataFrame, key: str, top: int | None = 8) -> DataFrame:
    """The rows of an overview with more visible comments than extracted ones, largest gap first."""
    found = overview.where("comment_gap > 0")
    return found.orderBy(F.desc("comment_gap"), key).limit(top) if top else found


def top_propagated(posts: DataFrame, propagations: DataFrame, top: int = 10) -> DataFrame:
    shared = propagations.where("origin_post_id IS NOT NULL AND origin_post_id <> ''").groupBy("origin_post_id")
    counts = shared.agg(F.count("*").alias("propagation_count"), F.sum(F.coalesce("comments_count", F.lit(0))).alias("propagation_comment_count"))
    best = counts.orderBy(F.desc("propagation_count"), "origin_post_id").limit(top)
    origin = posts.select(F.col("post_id").alias("origin_post_id"), excerpt(F.col("message")).alias("origin_excerpt"), F.col("permalink").alias("origin_permalink"))
    return best.join(origin, "origin_post_id", "left").withColumn("origin_excerpt", or_empty(F.col("origin_excerpt")))


def propagation_kinds(propagations: DataFrame) -> DataFrame:
    return propagations.groupBy("propagation_kind").agg(F.count("*").alias("n"))


def propagation_summary(propagations: DataFrame, comments: DataFrame) -> DataFrame:
    """One row: re-shares, those of them with comments, their extracted and their visible comments."""
    of = comments.where("parent_entity_type = 'propagation'").groupBy("parent_entity_id").agg(F.count("*").alias("n"))
    below = of.agg(F.count("*").alias("with_comments"), F.coalesce(F.sum("n"), F.lit(0)).alias("extracted_comments"))
    own = propagations.agg(F.count("*").alias("total_instances"), F.coalesce(F.sum("comments_count"), F.lit(0)).alias("visible_comment_total"))
    return own.withColumn("_one", F.lit(1)).join(below.withColumn("_one", F.lit(1)), "_one").drop("_one")


def reply_depths(comments: DataFrame) -> DataFrame:
    return comments.groupBy("depth").agg(F.count("*").alias("n"))


def reaction_totals(*frames: DataFrame) -> DataFrame:
    """(reaction, n) over the JSON objects of all frames; what is no object of numbers is passed over, null counts as zero."""
    out = None
    for frame in frames:
        cells = frame.select(F.explode(F.from_json("reaction_breakdown_json", "map<string,bigint>")).alias("reaction", "n"))
        out = cells if out is None else out.unionByName(cells)
    return out.groupBy("reaction").agg(F.sum(F.coalesce("n", F.lit(0))).alias("n"))


def ranked_reactions(totals: DataFrame) -> DataFrame:
    """Reactions by how often they occur; equally frequent ones by name."""
    return totals.orderBy(F.desc("n"), "reaction")


def total(column: str) -> Column:
    return F.coalesce(F.sum(column), F.lit(0))


def platform_totals(posts: DataFrame) -> DataFrame:
    """One row: views, likes, re-posts, quotes, replies, visible comments and reels."""
    return posts.agg(
        total("views").alias("total_views"), total("reactions").alias("total_likes"), total("shares").alias("total_reposts"), total("forwards").alias("total_quotes"), total("reply_count").alias("total_replies"),
        total("comments_count").alias("total_comments_visible"), F.count_if(F.lower(or_empty(F.col("media_type"))) == "reel").alias("reels_count"),
    )


#: What the report says of each platform's posts: column of the summary, and of the posts.
SUMMED = {
    "telegram": {"total_views": "views", "total_forwards": "forwards", "total_reply_count": "reply_count"},
    "x": {"total_views": "views", "total_likes": "reactions", "total_reposts": "shares", "total_quotes": "forwards", "total_replies": "reply_count"},
    "instagram": {"total_likes": "reactions", "total_comments_visible": "comments_count"},
}
SUMMED["threads"] = SUMMED["x"]


def platform_summary(platform: str, posts: DataFrame, comments: DataFrame, run: DataFrame) -> DataFrame:
    """One row of what a platform's report begins with, and `reactions`, array<struct<reaction, n>>, most frequent first. run: one row of
    collection_runs."""
    one = lambda df: df.withColumn("_one", F.lit(1))
    reels = [F.count_if(F.lower(or_empty(F.col("media_type"))) == "reel").alias("reels_count")] if platform == "instagram" else []
    summed = one(posts.agg(*(total(c).alias(name) for name, c in SUMMED[platform].items()), *reels))
    # a row a kind of reaction, of which there are few
    each = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "reaction", "n"))), lambda x: F.struct(x["reaction"].alias("reaction"), x["n"].alias("n")))
    summed = summed.join(one(reaction_totals(posts, comments).agg(each.alias("reactions"))), "_one")
    if platform == "instagram":
        summed = summed.join(one(comments.agg(F.count("*").alias("total_comments_extracted"))), "_one")
    if platform == "telegram":
        facts = run.agg(F.coalesce(F.first("discussion_linked"), F.lit(False)).alias("discussion_linked"), F.coalesce(F.first("filtered_service_message_count"), F.lit(0)).alias("filtered_service_message_count"))
        summed = summed.join(one(facts), "_one")
    return summed.drop("_one")


def cluster_members(memberships: DataFrame) -> DataFrame:
    return memberships.groupBy("item_type", "cluster_id").agg(F.count("*").alias("member_count"))


def clusters_with_counts(clusters: DataFrame, memberships: DataFrame) -> DataFrame:
    return clusters.join(cluster_members(memberships), ["item_type", "cluster_id"], "left").withColumn("member_count", F.coalesce("member_count", F.lit(0)))


def language_mix(languages: DataFrame) -> DataFrame:
    return languages.groupBy("item_type", "language").agg(F.count("*").alias("n"))


def quality_warnings(run: DataFrame, posts: DataFrame, propagations: DataFrame, comments: DataFrame, source_warnings: DataFrame, heuristic: bool = True) -> DataFrame:
    """(ord, warning) of a run: the sources' own, then those of the rules, each once, at its first place. `run` is one row of collection_runs."""
    empty = lambda df: df.agg(F.count_if(F.length(or_empty(F.col("message"))) == 0).alias("n"))
    facts = run.select("fallback_used", "source_run_count", "platform", "discussion_linked").withColumn("_one", F.lit(1))
    for name, df in (
        ("posts_empty", empty(posts)), ("comments_empty", empty(comments)), ("shares", propagations.agg(F.count("*").alias("n"))),
        ("below_shares", comments.agg(F.count_if(F.col("parent_entity_type") == "propagation").alias("n"))),
    ):
        facts = facts.join(df.select(F.lit(1).alias("_one"), F.col("n").alias(name)), "_one")
    # fixed values: the sentences, in the order in which they are shown
    rules = (
        (F.col("fallback_used"), F.lit("Collector fallback was used for this run.")),
        (F.col("source_run_count") > 1, F.concat(F.lit("Normalized snapshot merged "), F.col("source_run_count"), F.lit(" recent collection runs."))),
        ((F.col("platform") == "telegram") & ~F.coalesce("discussion_linked", F.lit(False)), F.lit("Telegram source has no linked discussion chat; stance/support metrics are based on posts only where comments are absent.")),
        ((F.col("shares") > 0) & (F.col("below_shares") == 0), F.lit("Propagation instances were detected, but no comments were extracted from propagated copies in this run.")),
        (F.col("comments_empty") > 0, F.lit("Some comments were collected without message text.")),
        (F.col("posts_empty") > 0, F.lit("Some posts were collected without message text.")),
        (F.lit(heuristic), F.lit("Stance and cluster descriptions were generated with heuristic fallbacks.")),
    )
    ruled = facts.select(F.posexplode(F.array(*(F.when(F.coalesce(when, F.lit(False)), text) for when, text in rules))).alias("ord", "warning")).where("warning IS NOT NULL")
    every = source_warnings.select(F.col("ord").cast("long").alias("ord"), "warning").unionByName(ruled.select((F.col("ord") + (1 << 40)).alias("ord"), "warning"))
    return every.groupBy("warning").agg(F.min("ord").alias("ord")).select("ord", "warning")
