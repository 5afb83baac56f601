"""Support and conflict metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forumetry.functions.text import excerpt

COUNTS = ("support", "oppose", "neutral", "unclear")


def measures() -> list[Column]:
    return [F.count_if(F.col("label") == x).alias(f"{x}_count") for x in COUNTS]


def with_ratios(grouped: DataFrame) -> DataFrame:
    s, o, n = (F.col(f"{x}_count") for x in ("support", "oppose", "neutral"))
    return grouped.withColumns({"support_ratio": s / F.greatest(s + o + n, F.lit(1)), "net_support": s - o})


SCOPES = ("global", "origin_post", "propagation", "origin_plus_propagations", "narrative_cluster")


def support_metrics(stances: DataFrame, comments: DataFrame, memberships: DataFrame, only: tuple[str, ...] = SCOPES) -> DataFrame:
    """(scope_type, scope_id, side_id, counts, support_ratio, net_support) of comment stances in all scopes.

    A stance belongs to several scopes at once. It's met with its comment and its cluster once, and exploded into the scopes that it has, so
    one shuffle with partial sums counts them all.
    """
    own = stances.where("item_type = 'comment'").select("item_id", "side_id", "label")
    at = comments.select(F.col("comment_id").alias("item_id"), "parent_entity_type", "parent_entity_id", "origin_post_id")
    met = own.join(at, "item_id", "left")
    if "narrative_cluster" in only:
        met = met.join(memberships.where("item_type = 'comment'").select("item_id", "cluster_id"), "item_id", "left")
    return scope_counts(met, only)


def scope_counts(labelled: DataFrame, only: tuple[str, ...] = SCOPES) -> DataFrame:
    """The same from stances that carry the scopes of their comment (side_id, label, parent_entity_type, parent_entity_id, origin_post_id,
    cluster_id), as `label_items` leaves them: then nothing is joined."""
    scope = lambda kind, value, when: F.when(when, F.struct(F.lit(kind).alias("scope_type"), value.cast("string").alias("scope_id")))
    kind, entity, origin = F.col("parent_entity_type"), F.col("parent_entity_id"), F.col("origin_post_id")
    has = lambda c: c.isNotNull() & (c != "")
    of = {
        "global": lambda: scope("global", F.lit("all"), F.lit(True)),
        "origin_post": lambda: scope("origin_post", entity, kind == "post"),
        "propagation": lambda: scope("propagation", entity, kind == "propagation"),
        "origin_plus_propagations": lambda: scope("origin_plus_propagations", origin, has(origin)),
        "narrative_cluster": lambda: scope("narrative_cluster", F.col("cluster_id"), F.col("cluster_id").isNotNull()),
    }
    scopes = F.array_compact(F.array(*(of[x]() for x in only)))
    return with_ratios(labelled.select("side_id", "label", F.explode(scopes).alias("s")).groupBy("s.scope_type", "s.scope_id", "side_id").agg(*measures()))


def conflicts(stances: DataFrame, comments: DataFrame, posts: DataFrame, top: int | None = 8) -> DataFrame:
    """(post_id, side_id, support_count, oppose_count, conflict_score, post_excerpt): threads by the smaller of both counts. Threads of a re-share
    have no excerpt, since `posts` are origins."""
    own = stances.where("item_type = 'comment'").select(F.col("item_id").alias("comment_id"), "side_id", "label")
    grouped = own.join(comments.select("comment_id", "parent_post_id"), "comment_id", "left").groupBy("parent_post_id", "side_id").agg(*measures()[:2])
    scored = grouped.withColumn("conflict_score", F.least("support_count", "oppose_count")).withColumnRenamed("parent_post_id", "post_id")
    if top:
        scored = scored.orderBy(F.desc("conflict_score"), "post_id", "side_id").limit(top)
    text = posts.select("post_id", excerpt(F.col("message")).alias("post_excerpt"))
    return scored.join(text, "post_id", "left").withColumn("post_excerpt", F.coalesce("post_excerpt", F.lit("")))


def top_comments(stances: DataFrame, comments: DataFrame, label: str, top: int = 8) -> DataFrame:
    """The comments of a label with the greatest confidence, then the least depth."""
    own = stances.where((F.col("item_type") == "comment") & (F.col("label") == label)).select(F.col("item_id").alias("comment_id"), "side_id", "confidence")
    met = own.join(comments.select("comment_id", "depth", "parent_post_id", "permalink", excerpt(F.col("message"), 280).alias("text")), "comment_id")
    return met.orderBy(F.desc("confidence"), "depth", "comment_id", "side_id").limit(top)
