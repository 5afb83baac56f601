"""Queries over snapshots: which runs go together, merging, flattening, upserts, traces and warnings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from forumetry.operators import merge, normalize, store, summaries
from forumetry.plans.common import with_
from forumetry.schemas import MANIFEST
from forumetry.sources import adapters

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def _add(name, query, sql, *needs, **more):
    QUERIES[name] = query
    if sql:
        ORACLE_SQL[name] = with_(sql, *needs, **more)


def _shaped(kind: StructType, **columns: Column) -> Column:
    return F.struct(*(columns.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in kind.fields))


def manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A snapshot for every 50 posts, with their comments: so its size is bounded, as that of a collector's run is."""
    kind = MANIFEST["posts"].dataType.elementType
    posts, comments = adapters.posts(spark, sf_dir), adapters.comments(spark, sf_dir)
    of_comment = kind["comments"].dataType.elementType
    author = lambda who, where: F.struct(who.alias("author_id"), F.concat(who, F.lit("@"), where).alias("name"), F.concat(F.lit("u/"), where).alias("profile_url"))
    plain = {c: F.col(c) for c in comments.columns if c in of_comment.names and c not in ("parent_entity_type", "parent_entity_id", "origin_post_id")}
    one = _shaped(of_comment, **plain, source_collector=F.lit("replay"), author=author(F.col("author_id"), F.col("comment_id")))
    lists = comments.groupBy(F.col("parent_post_id").alias("post_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("depth", "comment_id", one.alias("c")))), lambda x: x["c"]).alias("comments"))
    media = F.when(F.col("has_media"), F.array(_shaped(kind["media_refs"].dataType.elementType, media_id=F.concat("post_id", F.lit(":media:0")), owner_post_id=F.col("post_id"), media_type=F.col("media_type")))).otherwise(F.array().cast(kind["media_refs"].dataType))
    full = posts.join(lists, "post_id", "left")
    own = {c: F.col(c) for c in full.columns if c in kind.names and c != "comments"}
    body = _shaped(kind, **own, source_collector=F.lit("replay"), author=author(F.col("author_id"), F.col("post_id")), media_refs=media, comments=F.coalesce("comments", F.array().cast(kind["comments"].dataType)))
    run = F.floor(F.col("ord") / 50)
    grouped = full.groupBy(run.alias("run")).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", body.alias("p")))), lambda x: x["p"]).alias("posts"))
    name = F.concat(F.lit("run-"), F.lpad(F.col("run").cast("string"), 9, "0"))
    source = _shaped(MANIFEST["source"].dataType, platform=F.lit("facebook"), source_id=F.concat(F.lit("page-"), F.col("run") % 4), source_name=F.concat(F.lit("Page "), F.col("run") % 4), source_type=F.lit("page"), filtered_service_message_count=F.col("run") % 3, source_collector=F.lit("replay"))
    warnings = F.when(F.col("run") % 3 == 1, F.array(F.lit("first"), F.lit(""), F.lit("third"))).when(F.col("run") % 3 == 2, F.array(F.lit("first"))).otherwise(F.array().cast("array<string>"))
    made = {"run_id": name, "collected_at": F.lit("2026-03-01T00:00:00+00:00"), "collector": F.lit("replay"), "mode": F.lit("web"), "status": F.when(F.col("run") % 3 == 0, "success").otherwise("partial"), "fallback_used": F.col("run") % 5 == 0, "warnings": warnings, "source": source, "posts": F.col("posts")}
    return grouped.select(*(made.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in MANIFEST.fields))


#: Runs and positions as the snapshots have them.
_RUNS = """SELECT p.*, p.ord // 50 AS run, concat('run-', lpad(CAST(p.ord // 50 AS STRING), 9, '0')) AS rid, row_number() OVER (PARTITION BY p.ord // 50 ORDER BY p.ord) - 1 AS pos FROM posts p"""
_SAID = """SELECT c.*, r.rid, r.run, r.pos, row_number() OVER (PARTITION BY c.parent_post_id ORDER BY depth, comment_id) - 1 AS cpos FROM comments c JOIN runs r ON c.parent_post_id = r.post_id"""


def _tables(name: str, *columns: str):
    def query(spark, sf):
        df = normalize.tables_of(manifests(spark, sf))[name]
        return df.select(*columns) if columns else df

    return query


_add(
    "run_stats", _tables("collection_runs", "run_id", "platform", "source_id", "status", "fallback_used", "warning_count", "post_count", "propagation_count", "comment_count", "source_run_count", "filtered_service_message_count"),
    """SELECT rid AS run_id, 'facebook' AS platform, concat('page-', run % 4) AS source_id, CASE WHEN run % 3 = 0 THEN 'success' ELSE 'partial' END AS status, run % 5 = 0 AS fallback_used,
              CASE run % 3 WHEN 1 THEN 3 WHEN 2 THEN 1 ELSE 0 END::BIGINT AS warning_count, count(*) FILTER (NOT is_propagation) AS post_count, count(*) FILTER (is_propagation) AS propagation_count,
              CAST(sum(coalesce(n, 0)) AS BIGINT) AS comment_count, 1::BIGINT AS source_run_count, CAST(run % 3 AS BIGINT) AS filtered_service_message_count
       FROM runs LEFT JOIN (SELECT parent_post_id, count(*) AS n FROM comments GROUP BY 1) ON parent_post_id = post_id GROUP BY rid, run""", "comments", runs=_RUNS,
)
_add("normalized_posts", lambda spark, sf: _tables("posts", "post_id", "origin_post_id", "propagation_kind", "is_propagation", "author_id", "message", "reactions", "comments_count", "views", "run_id")(spark, sf).na.fill(-1, ["views"]), "SELECT post_id, origin_post_id, propagation_kind, is_propagation, author_id, message, reactions, comments_count, coalesce(views, -1) AS views, rid AS run_id FROM runs", "posts", runs=_RUNS)
_add("propagation_edges", _tables("propagation_edges", "propagation_id", "origin_post_id", "propagation_kind", "run_id"), "SELECT post_id AS propagation_id, origin_post_id, coalesce(propagation_kind, 'unknown') AS propagation_kind, rid AS run_id FROM runs WHERE is_propagation", "posts", runs=_RUNS)
_add("comment_edges", _tables("comment_edges", "comment_id", "parent_post_id", "parent_entity_type", "parent_entity_id", "parent_comment_id", "origin_post_id", "depth", "run_id"), "SELECT comment_id, parent_post_id, parent_entity_type, parent_entity_id, parent_comment_id, origin_post_id, depth, rid AS run_id FROM said", "comments", runs=_RUNS, said=_SAID)
_add("media_refs", _tables("media_refs", "media_id", "owner_post_id", "media_type", "run_id"), "SELECT concat(post_id, ':media:0') AS media_id, post_id AS owner_post_id, media_type, rid AS run_id FROM runs WHERE has_media", "posts", runs=_RUNS)
_add(
    "authors_last", lambda spark, sf: _tables("authors", "author_id", "name", "profile_url", "run_id")(spark, sf).na.fill("", ["profile_url"]),
    """SELECT author_id, arg_max(name, k) AS name, arg_max(coalesce(profile_url, ''), k) AS profile_url, arg_max(rid, k) AS run_id FROM (
         SELECT author_id, concat(author_id, '@', post_id) AS name, concat('u/', post_id) AS profile_url, rid, row(rid, pos, -1) AS k FROM runs
         UNION ALL SELECT author_id, concat(author_id, '@', comment_id), concat('u/', comment_id), rid, row(rid, pos, cpos) FROM said
         UNION ALL SELECT DISTINCT concat('page-', run % 4), concat('Page ', run % 4), NULL, rid, row(rid, -1, -1) FROM runs) WHERE author_id <> '' GROUP BY 1""", "comments", runs=_RUNS, said=_SAID,
)


def _latest(spark, sf):
    runs = manifests(spark, sf).select("run_id", "mode", "requested_date_start", "requested_date_end", "source")
    target = runs.agg(F.max("run_id")).first()[0] or ""
    return merge.compatible_runs(runs, target, 3)


_add("latest_n_runs", _latest, "SELECT rid AS run_id FROM (SELECT DISTINCT rid, run FROM runs) WHERE run % 4 = (SELECT max(run) FROM runs) % 4 ORDER BY rid DESC LIMIT 3", "posts", runs=_RUNS)

#: Three runs saw most posts: doc_id // 3 is the post, doc_id % 3 the run.
_SEEN = "SELECT concat('p:', doc_id // 3) AS post_id, doc_id % 3 AS run, doc_id, text AS message, source, n_chars, lang FROM documents"


def _snapshots(spark, sf):
    d = adapters.table(spark, sf, "documents")
    some = lambda k, value: F.when(F.col("doc_id") % k != 0, value)
    columns = {
        "post_id": F.concat(F.lit("p:"), F.floor(F.col("doc_id") / 3)), "platform": F.lit("x"), "source_id": F.col("source"), "created_at": some(2, F.concat(F.lit("t"), "doc_id")), "permalink": F.concat(F.lit("u/"), "doc_id"),
        "origin_post_id": some(4, F.lit("")), "origin_external_id": F.lit(None).cast("string"), "origin_permalink": some(5, F.concat(F.lit("o/"), "doc_id")), "propagation_kind": F.lit(None).cast("string"), "media_type": some(3, F.col("lang")),
        "reaction_breakdown_json": F.lit(None).cast("string"), "message": F.col("text"), "reactions": F.col("n_chars") % 50, "shares": F.lit(0).cast("long"), "comments_count": F.col("n_chars") % 7, "views": some(3, F.col("n_chars")), "forwards": F.lit(None).cast("long"),
        "reply_count": F.lit(None).cast("long"), "is_propagation": F.col("doc_id") % 7 == 0, "has_media": F.col("doc_id") % 11 == 0, "source_collector": F.concat(F.lit("c"), F.col("doc_id") % 3), "raw_path": some(2, F.concat(F.lit("raw/"), "doc_id")),
        "author": some(6, F.struct(F.col("source").alias("author_id"), F.substring("text", 1, F.col("doc_id").cast("int") % 4 + 1).alias("name"), F.lit(None).cast("string").alias("profile_url"))), "ord": F.struct((F.col("doc_id") % 3).alias("run"), F.col("doc_id").alias("pos")),
    }
    return d.select(*(v.alias(k) for k, v in columns.items()))


_add(
    "merge_runs_posts", lambda spark, sf: merge.merged_posts(_snapshots(spark, sf)).select("post_id", "created_at", "permalink", "origin_post_id", "origin_permalink", "media_type", "message", "reactions", "comments_count", "views", "is_propagation", "has_media", "source_collector", "raw_path", "occurrences").na.fill(-1, ["views"]),
    """SELECT post_id, arg_min('t' || doc_id, run) FILTER (doc_id % 2 <> 0) AS created_at, arg_min('u/' || doc_id, run) AS permalink, CAST(NULL AS VARCHAR) AS origin_post_id, arg_min('o/' || doc_id, run) FILTER (doc_id % 5 <> 0) AS origin_permalink,
              arg_min(lang, run) FILTER (doc_id % 3 <> 0) AS media_type, arg_min(message, row(-length(coalesce(message, '')), run)) AS message, max(n_chars % 50) AS reactions, max(n_chars % 7) AS comments_count, coalesce(max(n_chars) FILTER (doc_id % 3 <> 0), -1) AS views,
              bool_or(doc_id % 7 = 0) AS is_propagation, bool_or(doc_id % 11 = 0) AS has_media, arg_max('c' || doc_id % 3, run) AS source_collector, arg_max('raw/' || doc_id, run) FILTER (doc_id % 2 <> 0) AS raw_path, count(*) AS occurrences FROM seen GROUP BY 1""", seen=_SEEN,
)
_add(
    "merge_runs_authors", lambda spark, sf: merge.merged_posts(_snapshots(spark, sf)).select("post_id", F.col("author.author_id").alias("author_id"), F.col("author.name").alias("name")),
    """SELECT post_id, arg_min(source, k) FILTER (doc_id % 6 <> 0) AS author_id, arg_min(name, k) FILTER (doc_id % 6 <> 0) AS name FROM (SELECT *, left(message, CAST(doc_id % 4 + 1 AS INT)) AS name, row(-length(coalesce(left(message, CAST(doc_id % 4 + 1 AS INT)), '')), run) AS k FROM seen) GROUP BY 1""", seen=_SEEN,
)


def _upsert(spark, sf):
    d = adapters.table(spark, sf, "documents").select(F.concat(F.lit("p:"), F.floor(F.col("doc_id") / 3)).alias("post_id"), (F.col("doc_id") % 3).alias("run"), "n_chars", "lang")
    return store.upserted(d.where("run = 0").drop("lang"), d.where("run > 0").withColumn("place", F.col("run")), ["post_id"], "place")


_add(
    "upsert_keep_last", _upsert,
    """SELECT post_id, run, n_chars, CASE WHEN run > 0 THEN lang END AS lang
       FROM (SELECT *, row_number() OVER (PARTITION BY post_id ORDER BY run DESC) AS k FROM seen)
       WHERE k = 1""", seen=_SEEN,
)
_add(
    "diagonal_union", lambda spark, sf: adapters.table(spark, sf, "documents").select("doc_id", F.col("n_chars").cast("int").alias("x")).unionByName(adapters.table(spark, sf, "events").select((F.col("value") + 0.0).alias("x"), "event_type"), allowMissingColumns=True).groupBy("event_type").agg(F.count("*").alias("n"), F.count("doc_id").alias("n_documents"), F.round(F.sum("x"), 2).alias("x")),
    "SELECT event_type, count(*) AS n, count(doc_id) AS n_documents, round(sum(x), 2) AS x FROM (SELECT doc_id, CAST(n_chars AS DOUBLE) AS x, NULL AS event_type FROM documents UNION ALL SELECT NULL, value, event_type FROM events) GROUP BY 1",
)
_add(
    "run_trace", lambda spark, sf: manifests(spark, sf).select(F.col("run_id").alias("source_run_id"), "collector", "mode", "status", "fallback_used", F.size("warnings").cast("long").alias("warning_count")),
    "SELECT DISTINCT rid AS source_run_id, 'replay' AS collector, 'web' AS mode, CASE WHEN run % 3 = 0 THEN 'success' ELSE 'partial' END AS status, run % 5 = 0 AS fallback_used, CASE run % 3 WHEN 1 THEN 3 WHEN 2 THEN 1 ELSE 0 END::BIGINT AS warning_count FROM runs", "posts", runs=_RUNS,
)


def source_warnings(manifests: DataFrame) -> DataFrame:
    """(source_run_id, warning_index, warning): the index counts from 1, blank ones too, which aren't shown."""
    return manifests.select(F.col("run_id").alias("source_run_id"), F.posexplode("warnings").alias("warning_index", "warning")).withColumn("warning_index", (F.col("warning_index") + 1).cast("long")).where("warning <> ''")


_WARNINGS = "SELECT DISTINCT rid AS source_run_id, unnest(CASE run % 3 WHEN 1 THEN [1, 3] WHEN 2 THEN [1] ELSE [] END)::BIGINT AS warning_index FROM runs"
_add("source_warnings", lambda spark, sf: source_warnings(manifests(spark, sf)), "SELECT *, CASE warning_index WHEN 1 THEN 'first' ELSE 'third' END AS warning FROM w", "posts", runs=_RUNS, w=_WARNINGS)


def _quality(spark, sf):
    run = spark.range(1).select(F.lit(True).alias("fallback_used"), F.lit(2).alias("source_run_count"), F.lit("telegram").alias("platform"), F.lit(False).alias("discussion_linked"))
    said = source_warnings(manifests(spark, sf)).select("warning", F.col("warning_index").alias("ord"))
    p = adapters.posts(spark, sf)
    return summaries.quality_warnings(run, p, adapters.propagations(p), adapters.comments(spark, sf), said).select("warning")


_add(
    "data_quality_warnings", _quality,
    """SELECT DISTINCT warning FROM (SELECT CASE warning_index WHEN 1 THEN 'first' ELSE 'third' END AS warning FROM w UNION ALL VALUES ('Collector fallback was used for this run.'), ('Normalized snapshot merged 2 recent collection runs.'),
         ('Telegram source has no linked discussion chat; stance/support metrics are based on posts only where comments are absent.'), ('Stance and cluster descriptions were generated with heuristic fallbacks.')
       UNION ALL SELECT 'Some posts were collected without message text.' WHERE EXISTS (FROM posts WHERE length(coalesce(message, '')) = 0)
       UNION ALL SELECT 'Some comments were collected without message text.' WHERE EXISTS (FROM comments WHERE length(coalesce(message, '')) = 0)
       UNION ALL SELECT 'Propagation instances were detected, but no comments were extracted from propagated copies in this run.' WHERE EXISTS (FROM posts WHERE is_propagation) AND NOT EXISTS (FROM comments WHERE parent_entity_type = 'propagation'))""",
    "comments", runs=_RUNS, w=_WARNINGS,
)


def _seen_comments(spark, sf):
    """Every comment as two runs saw it."""
    c = adapters.table(spark, sf, "conversations").select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).withColumn("run", F.explode(F.array(F.lit(0), F.lit(1))))
    of_run = lambda k, value: F.when(F.col("run") == k, value)
    kind = MANIFEST["posts"].dataType.elementType["comments"].dataType.elementType
    made = {
        "comment_id": F.concat_ws(":", "conv_id", "turn"), "platform": F.lit("x"), "parent_post_id": F.concat(F.lit("p:"), "conv_id"), "created_at": of_run(1, F.concat(F.lit("t"), "turn")), "permalink": F.concat(F.lit("l"), "run"), "reactions": F.col("turn") * (1 - F.col("run")),
        "message": F.concat("text", F.when((F.col("run") == 1) & (F.col("turn") % 2 == 0), "!").otherwise("")), "depth": F.col("turn"), "source_collector": F.concat(F.lit("c"), "run"), "raw_path": of_run(0, F.lit("raw")), "author": of_run(1, F.struct(F.col("role").alias("author_id"), F.lit("N").alias("name"), F.lit(None).cast("string").alias("profile_url"))),
    }
    shaped = c.select(F.col("conv_id").alias("_post"), F.struct("run", "turn").alias("ord"), *(made.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in kind.fields))
    return merge.merged_comments(shaped, ["_post", "comment_id"]).select("comment_id", "parent_post_id", "created_at", "permalink", "reactions", "message", "depth", "source_collector", "raw_path", F.col("author.author_id").alias("author_id"))


_add(
    "merge_runs_comments", _seen_comments,
    """SELECT concat(conv_id, ':', turn) AS comment_id, concat('p:', conv_id) AS parent_post_id, concat('t', turn) AS created_at, 'l0' AS permalink, turn AS reactions, coalesce(text, '') || CASE WHEN turn % 2 = 0 THEN '!' ELSE '' END AS message, turn AS depth,
              'c1' AS source_collector, 'raw' AS raw_path, coalesce(role, '') AS author_id FROM conversations""",
)
