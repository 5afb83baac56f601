"""Inputs that the queries share, as DataFrames and as common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from forumetry.operators import stance
from forumetry.operators.stance import Side
from forumetry.sources import adapters

#: Sides with words that the test tables have.
SIDES = [Side("side_1", "the", ("an",), ("and", "ha"), ("hate", "great", "with", "by", "was")), Side("side_2", "und", (), ("die",), ("nicht", "das", "ist"))]
_MEMBERS = "CASE WHEN length(message) % 6 = 5 THEN 'comment-noise' ELSE concat('comment-', length(message) % 6) END"


def comment_items(comments: DataFrame) -> DataFrame:
    return stance.items_of(comments, "comment", "comment_id", "parent_post_id")


def post_items(posts: DataFrame) -> DataFrame:
    return stance.items_of(posts, "post", "post_id")


def items_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items of all posts, without the join that tells what a post is a copy of: that would shuffle all texts, and no item has it."""
    return post_items(adapters.table(spark, sf_dir, "documents").select(F.concat(F.lit("doc:"), "doc_id").alias("post_id"), F.col("text").alias("message")))


def memberships(comments: DataFrame) -> DataFrame:
    return comments.select(F.lit("comment").alias("item_type"), F.col("comment_id").alias("item_id"), F.expr(_MEMBERS).alias("cluster_id"), F.col("message").alias("text"), F.col("comment_id").alias("ord"))


def stances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stance.label_items(comment_items(adapters.comments(spark, sf_dir)).drop("parent_post_id"), SIDES)


def scoped_stances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stances of comments with the scopes that they count in."""
    c = adapters.comments(spark, sf_dir).where(F.length("message") > 0)
    own = c.select(F.lit("comment").alias("item_type"), F.col("comment_id").alias("item_id"), F.col("message").alias("text"), "parent_entity_type", "parent_entity_id", "origin_post_id", F.expr(_MEMBERS).alias("cluster_id"))
    return stance.label_items(own, SIDES)


def _hits(column: str, words: tuple[str, ...]) -> str:
    return "(" + " + ".join(["0", *(f"CAST(contains({column}, '{w.lower()}') AS INT)" for w in words)]) + ")"


def _stance_sql(side: Side) -> str:
    own_for, own_against, named = _hits("low", side.support), _hits("low", side.oppose), f"{_hits('low', side.names)} > 0"
    pro, con = f"({own_for} + {_hits('low', stance.POSITIVE)})", f"({own_against} + {_hits('low', stance.NEGATIVE)})"
    cases = ((f"trim(low) = ''", "unclear", "0.0"), (f"{pro} > {con} AND ({named} OR {own_for} > 0)", "support", f"least(0.55 + 0.1 * {pro}, 0.95)"), (f"{con} > {pro} AND ({named} OR {own_against} > 0)", "oppose", f"least(0.55 + 0.1 * {con}, 0.95)"), (named, "neutral", "0.45"), ("true", "unclear", "0.35"))
    label = " ".join(f"WHEN {when} THEN '{what}'" for when, what, _ in cases)
    sure = " ".join(f"WHEN {when} THEN {x}" for when, _, x in cases)
    return f"SELECT 'comment' AS item_type, comment_id AS item_id, '{side.side_id}' AS side_id, CASE {label} END AS label, round(CAST(CASE {sure} END AS DOUBLE), 4) AS confidence FROM (SELECT comment_id, lower(message) AS low FROM comments WHERE length(message) > 0)"


CTES = adapters.SQL | {
    "stances": " UNION ALL ".join(map(_stance_sql, SIDES)),
    "memberships": f"SELECT 'comment' AS item_type, comment_id AS item_id, {_MEMBERS} AS cluster_id, message AS text, comment_id AS ord FROM comments",
    "post_items": "SELECT 'post' AS item_type, post_id AS item_id, message AS text, ord FROM posts WHERE length(message) > 0",
}
_NEEDS = {"comments": ["posts"], "propagations": ["posts"], "stances": ["posts", "comments"], "memberships": ["posts", "comments"], "post_items": ["posts"]}


def with_(sql: str, *names: str, recursive: bool = False, **more: str) -> str:
    """sql behind the common table expressions it needs, in the order of CTES."""
    needed = {x for n in names for x in (n, *_NEEDS.get(n, []))}
    parts = [f"{n} AS ({CTES[n]})" for n in CTES if n in needed] + [f"{n} AS ({x})" for n, x in more.items()]
    return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(parts)} {sql}" if parts else sql
