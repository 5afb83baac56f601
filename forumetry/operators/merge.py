"""Several snapshots of one source as one: which runs go together, and how their posts, comments, media and sources are merged.

All merges are aggregates with partial results; `ord` is a row's place: the run's place in the list, then the place in the snapshot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from forumetry.operators.normalize import flat_tables, last_of, mentions, or_null, source_author

FIRST = ("created_at", "permalink", "origin_post_id", "origin_external_id", "origin_permalink", "propagation_kind", "media_type", "reaction_breakdown_json")
FIRST_OF_COMMENTS = ("parent_entity_type", "parent_entity_id", "parent_comment_id", "reply_to_message_id", "thread_root_post_id", "origin_post_id", "created_at", "permalink", "reaction_breakdown_json")
LAST = ("source_collector", "raw_path")


def merge_key(manifests: DataFrame) -> Column:
    """Runs with equal keys are of one source, mode and range of dates."""
    s = lambda c: F.coalesce(F.col(c), F.lit(""))
    identity = F.coalesce(or_null("source.source_id"), or_null("source.source_url"), s("source.source_name"))
    return F.struct(s("source.platform").alias("platform"), identity.alias("identity"), s("source.source_url").alias("url"), s("source.source_name").alias("name"), s("mode").alias("mode"), s("requested_date_start").alias("start"), s("requested_date_end").alias("end"))


def compatible_runs(manifests: DataFrame, run_id: str, recent: int = 1) -> DataFrame:
    """The last `recent` runs up to run_id that go together with it, in order."""
    keyed = manifests.select("run_id", merge_key(manifests).alias("key"))
    target = keyed.where(F.col("run_id") == run_id).select("key")
    return keyed.where(F.col("run_id") <= run_id).join(F.broadcast(target.limit(1)), "key", "left_semi").select("run_id").orderBy(F.desc("run_id")).limit(max(1, recent)).orderBy("run_id")


def missing_runs(wanted: DataFrame, manifests: DataFrame) -> DataFrame:
    return wanted.join(manifests.select("run_id"), "run_id", "left_anti")


def first_set(c: str) -> Column:
    return F.min_by(c, F.when(F.col(c).cast("string") != "", F.col("ord"))).alias(c)


def last_set(c: str) -> Column:
    return F.max_by(c, F.when(F.col(c).cast("string") != "", F.col("ord"))).alias(c)


def longest(c: str, of: Column | None = None) -> Column:
    """The longest text, of equally long ones the first."""
    size = F.length(F.coalesce(F.col(c) if of is None else of, F.lit("")))
    return F.min_by(c, F.struct(-size, F.col("ord"))).alias(c)


def merged_comments(comments: DataFrame, by: list[str]) -> DataFrame:
    author = F.min_by("author", F.struct(F.col("author").isNull(), -F.length(F.coalesce("author.name", F.lit(""))), F.col("ord"))).alias("author")
    return comments.groupBy(*by).agg(
        F.min_by("platform", "ord").alias("platform"), F.min_by("parent_post_id", "ord").alias("parent_post_id"), *(first_set(c) for c in FIRST_OF_COMMENTS), longest("message"),
        F.coalesce(F.max("reactions"), F.lit(0)).alias("reactions"), F.coalesce(F.max("depth"), F.lit(0)).alias("depth"), *(last_set(c) for c in LAST), author,
    )


def merged_posts(posts: DataFrame) -> DataFrame:
    """One row a post_id of posts (scalars, author, ord): the first set value, the longest message, the greatest counts, the last collector."""
    author = F.min_by("author", F.struct(F.col("author").isNull(), -F.length(F.coalesce("author.name", F.lit(""))), F.col("ord"))).alias("author")
    return posts.groupBy("post_id").agg(
        F.min_by("platform", "ord").alias("platform"), F.min_by("source_id", "ord").alias("source_id"), *(first_set(c) for c in FIRST), longest("message"),
        *(F.max(c).alias(c) for c in ("reactions", "shares", "comments_count", "views", "forwards", "reply_count")),
        F.bool_or(F.coalesce("is_propagation", F.lit(False))).alias("is_propagation"), F.bool_or(F.coalesce("has_media", F.lit(False))).alias("has_media"),
        *(last_set(c) for c in LAST), author, F.count("*").alias("occurrences"),
    )


def _merged(manifests: DataFrame, runs: list[str]) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(the runs' snapshots with their place, merged posts, merged comments with `_post`, merged media with `post_id` and their first place)."""
    place = F.array_position(F.array(*(F.lit(r) for r in runs)), F.col("run_id"))
    at = manifests.where(F.col("run_id").isin(runs)).withColumn("_run", place)
    exploded = at.select("_run", F.posexplode("posts").alias("_p", "post")).select("_run", "_p", "post.*").withColumn("ord", F.struct("_run", "_p"))
    comments = exploded.select("post_id", "_run", "_p", F.posexplode("comments").alias("_c", "c")).select(F.col("post_id").alias("_post"), F.struct("_run", "_p", "_c").alias("ord"), "c.*")
    media = exploded.select("post_id", "_run", "_p", F.posexplode("media_refs").alias("_m", "m")).withColumn("ord", F.struct("_run", "_p", "_m"))
    media = media.groupBy("post_id", F.col("m.media_id").alias("media_id")).agg(F.min("ord").alias("first"), F.max_by("m", "ord").alias("m"))
    return at, merged_posts(exploded), merged_comments(comments, ["_post", "comment_id"]), media


def _counted(posts: DataFrame, counts: DataFrame) -> DataFrame:
    """posts whose comments_count is at least the number of merged comments, counts (post_id, n), where a post was merged at all."""
    more = F.greatest("comments_count", F.coalesce("n", F.lit(0)))
    return posts.join(counts, "post_id", "left").withColumn("comments_count", F.when(F.col("occurrences") > 1, more).otherwise(F.col("comments_count")))


def _head(at: DataFrame, output: str, schema: StructType) -> DataFrame:
    """One row: what the merged snapshot says of itself and its source, without its posts."""
    none = F.array().cast("array<string>")
    warnings = F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_run", F.coalesce("warnings", none).alias("w")))), lambda x: x["w"])))
    # of the source, the last run's value if it's set, else that of the run before, and so on
    numbers = ("followers_count", "fan_count", "filtered_service_message_count")
    of_source = {c: F.max_by(f"source.{c}", F.when(F.col(f"source.{c}").cast("string") != "", F.col("_run"))) for c in schema["source"].dataType.names if c not in numbers}
    of_source |= {c: F.max_by(f"source.{c}", F.when(F.col(f"source.{c}") != 0, F.col("_run"))) for c in numbers[:2]}
    of_source |= {numbers[2]: F.max(F.coalesce(f"source.{numbers[2]}", F.lit(0)))}
    last = lambda c: F.max_by(c, "_run").alias(c)
    head = at.agg(
        *(last(c) for c in ("collected_at", "requested_date_start", "requested_date_end", "collector", "mode", "cursors")), F.bool_or(F.coalesce("fallback_used", F.lit(False))).alias("fallback_used"),
        F.bool_or(F.coalesce("status", F.lit("success")) != "success").alias("_bad"), warnings.alias("warnings"), F.count("*").alias("_n"), *(c.alias(f"_s_{name}") for name, c in of_source.items()),
    )
    source = F.struct(*(F.col(f"_s_{c}").alias(c) for c in schema["source"].dataType.names)).cast(schema["source"].dataType)
    note = F.when(F.col("_n") > 1, F.array(F.concat(F.lit("Merged normalized snapshot from "), F.col("_n"), F.lit(" collection runs.")))).otherwise(none)
    head = head.withColumn("warnings", F.concat("warnings", note))
    return head.withColumns({"source": source, "run_id": F.lit(output), "status": F.when(F.col("_bad") | (F.size("warnings") > 0), "partial").otherwise("success")})


def merge_manifests(manifests: DataFrame, runs: list[str], output: str, schema: StructType) -> DataFrame:
    """One row by the MANIFEST schema: the runs in their order as one snapshot. Posts by (created_at, post_id), latest first; comments by
    (depth, created_at, comment_id). For snapshots to be written; `merged_tables` needs no such row."""
    at, merged, own, media = _merged(manifests, runs)
    fields = [f.name for f in schema["posts"].dataType.elementType["comments"].dataType.elementType.fields]
    key = F.struct("depth", F.coalesce("created_at", F.lit("")).alias("t"), "comment_id")
    lists = own.groupBy(F.col("_post").alias("post_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct(key.alias("key"), F.struct(*fields).alias("c")))), lambda x: x["c"]).alias("comments"), F.count("*").alias("n"))
    refs = media.groupBy("post_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "m"))), lambda x: x["m"]).alias("media_refs"))
    empty = {c: F.array().cast(schema["posts"].dataType.elementType[c].dataType) for c in ("comments", "media_refs")}
    full = _counted(merged, lists).join(refs, "post_id", "left").withColumns({c: F.coalesce(c, e) for c, e in empty.items()})
    kind = schema["posts"].dataType.elementType
    body = F.struct(*kind.names).cast(kind)
    posts = full.agg(F.transform(F.reverse(F.array_sort(F.collect_list(F.struct(F.coalesce("created_at", F.lit("")).alias("t"), F.col("post_id").alias("i"), body.alias("p"))))), lambda x: x["p"]).alias("posts"))
    one = _head(at, output, schema).withColumn("_one", F.lit(1)).join(posts.withColumn("_one", F.lit(1)), "_one")
    return one.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields))


def merged_tables(manifests: DataFrame, runs: list[str], output: str, schema: StructType) -> dict[str, DataFrame]:
    """The eight tables of the runs merged into one, straight from merged posts, comments and media: nothing is gathered into the row of a snapshot."""
    return tables_of_merged(*_merged(manifests, runs), runs, output, schema)


def tables_of_merged(at: DataFrame, merged: DataFrame, own: DataFrame, media: DataFrame, runs: list[str], output: str, schema: StructType) -> dict[str, DataFrame]:
    """The eight tables from the runs' snapshots without posts (with _run, by which they are ordered), merged posts, comments (with _post) and media
    (m, with post_id)."""
    from forumetry.operators.store import checkpointed

    own = checkpointed(own)
    posts = checkpointed(_counted(merged, own.groupBy(F.col("_post").alias("post_id")).agg(F.count("*").alias("n"))).withColumn("run_id", F.lit(output)))
    of_post = posts.select(F.col("post_id").alias("_post"), F.col("is_propagation").alias("_shared"), F.col("origin_post_id").alias("_origin"), F.coalesce("created_at", F.lit("")).alias("_t"))
    comments = own.join(of_post, "_post").withColumn("run_id", F.lit(output))
    one = lambda df: df.withColumn("_one", F.lit(1))
    shared = F.coalesce("is_propagation", F.lit(False))
    counts = one(posts.agg(F.count_if(~shared).alias("post_count"), F.count_if(shared).alias("propagation_count"))).join(one(own.agg(F.count("*").alias("comment_count"))), "_one")
    head = one(_head(at, output, schema)).join(counts, "_one")
    # posts come latest first, so an author's last mention is in the earliest post, and there in the last comment; the source comes before all
    last = lambda p, t, comment: (F.lit(0).alias("_k"), t.alias("_t"), p.alias("_p"), comment.alias("_c"))
    in_post = lambda n, depth, at_, i: F.struct(F.lit(n).alias("n"), depth.cast("long").alias("d"), at_.alias("t"), i.alias("i"))
    none = F.lit(None).cast("string")
    every = mentions(posts, *last(F.col("post_id"), F.coalesce("created_at", F.lit("")), in_post(0, F.lit(0), none, none)))
    every = every.unionByName(mentions(comments, *last(F.col("_post"), F.col("_t"), in_post(1, F.coalesce("depth", F.lit(0)), F.coalesce("created_at", F.lit("")), F.col("comment_id")))))
    every = every.unionByName(source_author(head, F.lit(1).alias("_k"), F.lit("").alias("_t"), F.lit("").alias("_p"), in_post(0, F.lit(0), none, none).alias("_c"))).where(or_null("author_id").isNotNull())
    of_each = last_of(every, ["author_id", "_k", "_t", "_p"], "_c").drop("_c")
    rest = ["name", "profile_url", "source_collector", "run_id"]
    authors = of_each.groupBy("author_id").agg(F.min_by(F.struct(*rest), F.struct("_k", "_t", "_p")).alias("v")).select("author_id", "v.*")
    refs = media.select("m.*").withColumn("run_id", F.lit(output))
    return flat_tables(head, posts, comments, refs, authors, runs)
