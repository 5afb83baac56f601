"""Posts, comments, items and runs of the discussion model, from tables of documents, conversations, embeddings and events.

The SQL is plain enough for Spark and DuckDB alike, so that both sides of a check start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Copies of a text are re-shares of the one with the least doc_id.
POSTS = """
SELECT concat('doc:', d.doc_id) AS post_id, 'facebook' AS platform, d.source AS source_id, d.doc_id <> o.origin AS is_propagation,
       CASE WHEN d.doc_id <> o.origin THEN concat('doc:', o.origin) END AS origin_post_id,
       CASE WHEN d.doc_id <> o.origin AND d.doc_id % 5 <> 0 THEN CASE WHEN d.doc_id % 3 = 0 THEN 'quote' ELSE 'repost' END END AS propagation_kind,
       concat('2026-01-', lpad(CAST(1 + d.doc_id % 28 AS STRING), 2, '0'), 'T', lpad(CAST(d.doc_id % 24 AS STRING), 2, '0'), ':00:00+00:00') AS created_at,
       d.text AS message, concat('https://example.org/', d.source, '/posts/', d.doc_id, '/?utm_source=x&story_fbid=', d.doc_id) AS permalink,
       d.n_chars % 50 AS reactions, d.n_chars % 11 AS shares, d.doc_id % 7 AS comments_count,
       CASE WHEN d.doc_id % 5 = 0 THEN NULL ELSE d.n_chars * 3 END AS views, d.n_chars % 4 AS forwards,
       CASE WHEN d.doc_id % 4 = 0 THEN NULL ELSE d.doc_id % 6 END AS reply_count, d.doc_id % 3 = 0 AS has_media,
       CASE d.doc_id % 4 WHEN 0 THEN 'photo' WHEN 1 THEN 'Reel' WHEN 2 THEN 'video' END AS media_type,
       CASE WHEN d.doc_id % 17 = 0 THEN 'not json' WHEN d.doc_id % 19 = 0 THEN NULL
            ELSE concat('{{"like": ', d.n_chars % 50, ', "love": ', d.doc_id % 3, '}}') END AS reaction_breakdown_json,
       d.source AS author_id, d.doc_id AS ord, concat('run-', d.doc_id % 3) AS run_id, d.lang AS lang
FROM {documents} d JOIN (SELECT md5(coalesce(text, '')) AS h, min(doc_id) AS origin FROM {documents} GROUP BY md5(coalesce(text, ''))) o
  ON md5(coalesce(d.text, '')) = o.h
"""
#: Conversations are spread over all posts, re-shares too, by a multiplier that has no factor in common with most numbers of posts.
SPREAD = 104_729
#: Turns of a conversation are comments below one post, each an answer to the turn before.
COMMENTS = """
SELECT concat(c.conv_id, ':', c.turn) AS comment_id, 'facebook' AS platform, p.post_id AS parent_post_id,
       CASE WHEN p.is_propagation THEN 'propagation' ELSE 'post' END AS parent_entity_type, p.post_id AS parent_entity_id,
       coalesce(p.origin_post_id, p.post_id) AS origin_post_id, CASE WHEN c.turn > 0 THEN concat(c.conv_id, ':', c.turn - 1) END AS parent_comment_id,
       concat('2026-02-', lpad(CAST(1 + c.conv_id % 28 AS STRING), 2, '0'), 'T', lpad(CAST(c.turn % 24 AS STRING), 2, '0'), ':00:00+00:00') AS created_at,
       c.text AS message, c.turn AS depth, c.role AS author_id, c.conv_id % 9 AS reactions, concat('https://example.org/c/', c.conv_id, '/', c.turn) AS permalink,
       CASE WHEN c.conv_id % 3 = 0 THEN concat('{{"like": ', c.turn, ', "wow": ', c.conv_id % 4, '}}') END AS reaction_breakdown_json
FROM {conversations} c JOIN ({posts}) p ON p.post_id = concat('doc:', c.conv_id * {spread} % {n_documents})
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(POSTS, documents=table(spark, sf_dir, "documents"))


def comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    sql = COMMENTS.replace("{posts}", POSTS).replace("{spread}", str(SPREAD)).replace("{n_documents}", str(max(1, documents.count())))
    return spark.sql(sql, documents=documents, conversations=table(spark, sf_dir, "conversations"))


def propagations(posts: DataFrame) -> DataFrame:
    """The re-shares among posts, by the names that their table has."""
    from forumetry.operators.normalize import propagation_rows

    return propagation_rows(posts)


#: The same as common table expressions for DuckDB.
SQL = {
    "posts": POSTS.format(documents="documents"),
    "comments": COMMENTS.replace("{posts}", "SELECT * FROM posts").replace("{spread}", str(SPREAD)).replace("{n_documents}", "(SELECT greatest(1, count(*)) FROM documents)").format(documents="documents", conversations="conversations"),
    "propagations": "SELECT * REPLACE (coalesce(propagation_kind, 'unknown') AS propagation_kind) RENAME (post_id AS propagation_id) FROM posts WHERE is_propagation",
}
