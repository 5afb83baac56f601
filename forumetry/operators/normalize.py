"""Nested snapshots as flat tables: exploded posts, comments, authors and media, with the scope of each comment."""

from __future__ import annotations

from itertools import accumulate

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from forumetry.schemas import TABLES


def or_null(c: Column | str) -> Column:
    return F.nullif(F.col(c) if isinstance(c, str) else c, F.lit(""))


def shaped(df: DataFrame, name: str) -> DataFrame:
    """df with exactly the columns and types of a table; what it lacks is null."""
    return df.select(*_columns(df, name))


def _columns(df: DataFrame, name: str) -> list[Column]:
    return [(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in TABLES[name].fields]


def last_of(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key. One aggregate with partial maxima: no key's rows are gathered or sorted."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_v")).select(*keys, *(F.col(f"_v.`{c}`").alias(c) for c in rest))


def comment_scope(is_propagation: Column, post_id: Column, post_origin: Column, kind: Column, entity: Column, origin: Column) -> Column:
    """struct<parent_entity_type, parent_entity_id, origin_post_id>: the comment's own if it has all three, else that of its post."""
    made = lambda a, b, c: F.struct(a.alias("parent_entity_type"), b.alias("parent_entity_id"), c.alias("origin_post_id"))
    own = or_null(kind).isNotNull() & or_null(entity).isNotNull() & or_null(origin).isNotNull()
    shared = made(F.lit("propagation"), post_id, F.coalesce(or_null(post_origin), post_id))
    return F.when(own, made(kind, entity, origin)).when(F.coalesce(is_propagation, F.lit(False)), shared).otherwise(made(F.lit("post"), post_id, post_id))


def origin_posts(posts: DataFrame) -> DataFrame:
    return posts.where(~F.coalesce("is_propagation", F.lit(False)))


def propagation_rows(posts: DataFrame) -> DataFrame:
    """The re-shares among posts, as rows of propagations."""
    shared = posts.where(F.coalesce("is_propagation", F.lit(False))).drop("is_propagation")
    return shared.withColumn("propagation_kind", F.coalesce(or_null("propagation_kind"), F.lit("unknown"))).withColumnRenamed("post_id", "propagation_id")


def tables_of(manifests: DataFrame, source_runs: list[str] | None = None, place: bool = False) -> dict[str, DataFrame]:
    """The eight tables of snapshots (one row a run, by the MANIFEST schema). With `place`, each row also says where it came, by run and snapshot."""
    posts = manifests.select("run_id", F.posexplode("posts").alias("_p", "post")).select("run_id", "_p", "post.*")
    of_post = (F.col("is_propagation").alias("_shared"), F.col("post_id").alias("_post"), F.col("origin_post_id").alias("_origin"))
    comments = posts.select("run_id", "_p", *of_post, F.posexplode("comments").alias("_c", "comment")).select("run_id", "_p", "_shared", "_post", "_origin", "_c", "comment.*")
    media = posts.select("run_id", "_p", F.posexplode("media_refs").alias("_m", "media")).select("run_id", "_p", "_m", "media.*")
    shared = lambda p: F.coalesce(p["is_propagation"], F.lit(False))
    runs = manifests.withColumns({
        "post_count": F.size(F.filter("posts", lambda p: ~shared(p))), "propagation_count": F.size(F.filter("posts", shared)),
        "comment_count": F.aggregate("posts", F.lit(0), lambda n, p: n + F.greatest(F.size(p["comments"]), F.lit(0))),
    })
    return flat_tables(runs, posts.drop("comments", "media_refs"), comments, media, _authors(manifests, posts, comments), source_runs, place)


def flat_tables(runs: DataFrame, posts: DataFrame, comments: DataFrame, media: DataFrame, authors: DataFrame, source_runs: list[str] | None = None, place: bool = False) -> dict[str, DataFrame]:
    """The eight tables of rows of runs (with their counts), posts (run_id, and as in a snapshot), comments (the same, and _post, _shared and
    _origin of their post), media and authors."""
    ids = F.array(*(F.lit(r) for r in source_runs)) if source_runs else F.array("run_id")
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("reactions", "shares", "comments_count")} | {c: F.coalesce(c, F.lit(False)) for c in ("is_propagation", "has_media")}
    posts = posts.withColumns({**zero, "origin_post_id": or_null("origin_post_id"), "author_id": F.col("author.author_id")})
    scope = comment_scope(F.col("_shared"), F.col("_post"), or_null("_origin"), F.col("parent_entity_type"), F.col("parent_entity_id"), F.col("origin_post_id"))
    comments = comments.withColumn("_scope", scope).drop("parent_entity_type", "parent_entity_id", "origin_post_id").select("*", "_scope.*")
    comments = comments.withColumns({"reactions": F.coalesce("reactions", F.lit(0)), "depth": F.coalesce("depth", F.lit(0)), "author_id": F.col("author.author_id")})
    none = F.array().cast("array<string>")
    told = {
        "warning_count": F.size(F.coalesce("warnings", none)), "warning_messages": F.coalesce("warnings", none), "source_run_count": F.size(ids), "source_run_ids": ids,
        "fallback_used": F.coalesce("fallback_used", F.lit(False)), "status": F.coalesce("status", F.lit("success")),
    }
    of_source = {c: F.col(f"source.{c}") for c in ("platform", "source_id", "source_name", "source_type", "discussion_linked")}
    collected = runs.withColumns(told | of_source | {"filtered_service_message_count": F.coalesce("source.filtered_service_message_count", F.lit(0))})
    shares = propagation_rows(posts)
    made = {"posts": posts, "propagations": shares, "propagation_edges": shares, "comments": comments, "comment_edges": comments, "authors": authors, "media_refs": media, "collection_runs": collected}
    return {name: shaped(df, name) if not place else _placed(df, name) for name, df in made.items()}


def _placed(df: DataFrame, name: str) -> DataFrame:
    """shaped, with `place`: where a row came in its snapshots, by which the last one of a key is found."""
    at = [F.col(c) if c in df.columns else F.lit(-1).alias(c) for c in ("_p", "_c", "_m")]
    own = df.withColumn("place", F.struct("run_id", *at))
    return own.select(*_columns(own, name), "place")


def source_author(runs: DataFrame, *more: Column) -> DataFrame:
    """The source of each run as an author."""
    return runs.select(F.col("source.source_id").alias("author_id"), F.col("source.source_name").alias("name"), F.col("source.source_url").alias("profile_url"), F.col("source.source_collector").alias("source_collector"), "run_id", *more)


def mentions(rows: DataFrame, *more: Column) -> DataFrame:
    """The author of each post or comment."""
    return rows.select(*(F.col(f"author.{c}").alias(c) for c in ("author_id", "name", "profile_url")), "source_collector", "run_id", *more)


def _authors(manifests: DataFrame, posts: DataFrame, comments: DataFrame) -> DataFrame:
    """The last mention of each author, in the order source, posts, each post's comments after it."""
    at = lambda p, c: F.struct("run_id", p.alias("p"), c.alias("c")).alias("_at")
    none = F.lit(-1)
    every = source_author(manifests, at(none, none)).unionByName(mentions(posts, at(F.col("_p"), none))).unionByName(mentions(comments, at(F.col("_p"), F.col("_c"))))
    return last_of(every.where(or_null("author_id").isNotNull()), ["author_id"], "_at").drop("_at")


def comment_depths(edges: DataFrame) -> DataFrame:
    """(comment_id, tree_depth) from (comment_id, parent_comment_id): one more than the parent's; 0 without a known parent. Jumps to ancestors
    double each round; comments below a cycle have null."""
    from forumetry.operators.store import checkpointed

    known = edges.select("comment_id", "parent_comment_id")
    ids = known.select(F.col("comment_id").alias("parent_comment_id"))
    jump = checkpointed(known.join(ids, "parent_comment_id", "left_semi").select("comment_id", F.col("parent_comment_id").alias("up"), F.lit(1).alias("d")))
    depth = checkpointed(known.join(jump, "comment_id", "left").select("comment_id", F.col("up"), F.coalesce("d", F.lit(0)).alias("d")))
    rounds, most = 0, known.count()
    while (1 << rounds) <= most and not depth.where("up IS NOT NULL").isEmpty():
        far = depth.select(F.col("comment_id").alias("up"), F.col("up").alias("far"), F.col("d").alias("more"))
        depth = checkpointed(depth.join(far, "up", "left").select("comment_id", F.col("far").alias("up"), (F.col("d") + F.coalesce("more", F.lit(0))).alias("d")))
        rounds += 1
    return depth.select("comment_id", F.when(F.col("up").isNull(), F.col("d")).cast("long").alias("tree_depth"))


def nesting(items: DataFrame, x: str = "xs", slack: int = 5) -> DataFrame:
    """items (array of left offsets, in order) with `depths` and `parents`, the places (from 0, -1 for none) of the items that they answer: each
    one's parent is the last one before that lies over `slack` further left and is still open; a later item closes all open ones that don't lie
    so far left of it. Open items are a stack of growing offsets, in Python over the offsets alone: a fold in the JVM copies its arrays at each
    item."""

    def places(xs: pa.Array) -> pa.Array:
        depths, parents, sizes = [], [], pc.fill_null(pc.list_value_length(xs), 0).to_pylist()
        every = xs.flatten()
        at = 0
        for n in sizes:
            open_: list[tuple[int, int]] = []
            for k, v in enumerate(every.slice(at, n).to_pylist()):
                while open_ and (v is None or open_[-1][0] + slack >= v):
                    open_.pop()
                depths.append(len(open_))
                parents.append(open_[-1][1] if open_ else -1)
                if v is not None:
                    open_.append((v, k))
            at += n
        ends, gone = pa.array([0, *accumulate(sizes)], pa.int32()), xs.is_null()
        return pa.StructArray.from_arrays([pa.ListArray.from_arrays(ends, pa.array(c, pa.int32()), mask=gone) for c in (depths, parents)], names=["depths", "parents"])

    placed = F.arrow_udf(places, "struct<depths:array<int>,parents:array<int>>")
    return items.withColumn("_made", placed(F.col(x).cast("array<int>"))).select(*items.columns, "_made.*")


def header_groups(lines: DataFrame, key: str, pos: str, text: str, is_header: Column) -> DataFrame:
    """lines without consecutive repeats of a text, with `group`: how many headers came up to the line, within a key."""
    by = Window.partitionBy(key).orderBy(pos)
    fresh = lines.withColumn("_before", F.lag(text).over(by)).where(~F.col("_before").eqNullSafe(F.col(text))).drop("_before")
    return fresh.withColumn("group", F.sum(is_header.cast("int")).over(by).cast("long"))
