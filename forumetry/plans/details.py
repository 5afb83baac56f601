"""Queries over posts' own pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from forumetry.operators import pages
from forumetry.sources.adapters import table

NOW = "2026-04-10 12:00:00"


def page_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as posts' pages, which name times, counts and re-shares in different places."""
    d = table(spark, sf_dir, "documents")
    n, none = F.col("doc_id"), F.lit(None).cast("string")
    candidate = F.struct(
        F.concat(F.lit("https://www.facebook.com/pg/posts/"), n, F.lit("?__cft__=x")).alias("permalink"), none.alias("detail_url"), none.alias("text"),
        F.when(n % 3 == 1, "2h").alias("published_hint"), F.when(n % 3 == 0, "2026-01-02T00:00:00+00:00").alias("published_at"),
        (F.col("n_chars") % 50).alias("reactions"), (n % 7).alias("comments_count"), (n % 5).alias("shares"), none.alias("shared_permalink"),
    )
    payload = F.struct(
        none.alias("post_permalink"), F.col("text").alias("post_text"), F.when(n % 4 == 0, "Somebody SHARED a reel.").otherwise("").alias("body_text"),
        F.concat(n, F.lit(" reactions")).alias("meta_title"), F.lit("").alias("meta_description"), none.alias("published_hint"), none.alias("published_at"),
        none.alias("shared_permalink"), none.alias("reply_text"),
    )
    html = F.when(n % 5 == 0, '"publish_time":1770000000,"story_name"').otherwise("")
    own = d.select(F.lit("pg").alias("page_id"), F.lit("Page").alias("page_name"), F.lit("https://www.facebook.com/pg").alias("source_url"), candidate.alias("candidate"), payload.alias("payload"), html.alias("html"))
    made = pages.page_details(own, F.lit(NOW).cast("timestamp"))
    return made.select("permalink", "created_at", "reactions", "comments_count", "shares", "is_propagation", "propagation_kind", "origin_permalink", "login_wall")


QUERIES = {"page_details": page_details}
ORACLE_SQL = {
    "page_details": """
        SELECT 'https://www.facebook.com/pg/posts/' || doc_id AS permalink,
               CASE WHEN doc_id % 3 = 0 THEN '2026-01-02T00:00:00+00:00'
                    WHEN doc_id % 5 = 0 THEN '2026-02-02T02:40:00+00:00'
                    WHEN doc_id % 3 = 1 THEN '2026-04-10T10:00:00+00:00' END AS created_at,
               greatest(n_chars % 50, doc_id) AS reactions, doc_id % 7 AS comments_count, doc_id % 5 AS shares,
               doc_id % 4 = 0 AS is_propagation, CASE WHEN doc_id % 4 = 0 THEN 'share' END AS propagation_kind,
               CASE WHEN doc_id % 4 = 0 THEN 'https://www.facebook.com/pg/posts/' || doc_id END AS origin_permalink, false AS login_wall
        FROM documents""",
}
