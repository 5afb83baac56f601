"""Queries over trees of answers, in reading order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from forumetry.operators import tours
from forumetry.sources import payloads
from forumetry.sources.adapters import table


def comment_reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as comments of a thread for each source: each answers one of the three before it in its source, if that is there."""
    d = table(spark, sf_dir, "documents")
    parent = F.col("doc_id") - 20 * (1 + F.col("n_chars") % 3)
    return tours.reading_order(d.select(F.col("source").alias("thread"), F.col("doc_id").alias("comment_id"), parent.alias("parent_comment_id"), (F.col("n_chars") % 7).alias("ord")))


def map_graph_comment_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of a conversation as landed comments, each an answer to the one of half its number."""
    c = table(spark, sf_dir, "conversations").where("turn IS NOT NULL")
    name = lambda turn: F.concat(F.lit("c"), "conv_id", F.lit("_"), turn.cast("string"))
    payload = F.to_json(F.struct(name(F.col("turn")).alias("id"), F.col("text").alias("message"), F.struct(F.col("role").alias("id")).alias("from")))
    parent = F.when(F.col("turn") > 0, name(F.floor((F.col("turn") - 1) / 2)))
    landed = c.select(payload.alias("payload"), F.concat(F.lit("p"), "conv_id").alias("post_id"), parent.alias("parent_id"), (-F.col("turn")).alias("ord"))
    return payloads.graph_comment_trees(landed).select("comment_id", "parent_post_id", "parent_comment_id", "depth", "place", F.col("author.author_id").alias("author_id"))


_READ = """
WITH RECURSIVE e AS ({edges}),
known AS (
    SELECT e.thread, e.comment_id, e.ord, p.comment_id AS parent
    FROM e LEFT JOIN e p ON p.thread = e.thread AND p.comment_id = e.parent_comment_id),
t AS (
    SELECT thread, comment_id, 0::BIGINT AS depth, [(ord, comment_id)] AS path FROM known WHERE parent IS NULL
    UNION ALL
    SELECT k.thread, k.comment_id, t.depth + 1, list_append(t.path, (k.ord, k.comment_id))
    FROM known k JOIN t ON k.thread = t.thread AND k.parent = t.comment_id),
placed AS (
    SELECT thread, comment_id, depth, row_number() OVER (PARTITION BY thread ORDER BY path) - 1 AS place FROM t)
"""

QUERIES = {"comment_reading_order": comment_reading_order, "map_graph_comment_trees": map_graph_comment_trees}
ORACLE_SQL = {
    "comment_reading_order": _READ.format(
        edges="SELECT source AS thread, doc_id AS comment_id, doc_id - 20 * (1 + n_chars % 3) AS parent_comment_id, n_chars % 7 AS ord FROM documents"
    )
    + "SELECT * FROM placed",
    "map_graph_comment_trees": _READ.format(
        edges="""
            SELECT 'p' || conv_id AS thread, 'c' || conv_id || '_' || turn AS comment_id, role,
                   CASE WHEN turn > 0 THEN 'c' || conv_id || '_' || ((turn - 1) // 2) END AS parent_comment_id, -turn AS ord
            FROM conversations WHERE turn IS NOT NULL"""
    )
    + """SELECT comment_id, thread AS parent_post_id, parent_comment_id, depth, place, role AS author_id
         FROM placed JOIN e USING (thread, comment_id)""",
}
