"""Threads of messages: which comments belong to which post by order of arrival, and messages from two scans of a thread as one list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def arrived_comments(posts: DataFrame, comments: DataFrame) -> DataFrame:
    """comments (thread, ord, ...) with the post_id of their thread's post (thread, ord, post_id), if it came before them; others are dropped."""
    first = posts.groupBy("thread").agg(F.min(F.struct("ord", "post_id")).alias("p"))
    return comments.join(first, "thread").where("p.ord < ord").select(*comments.columns, "p.post_id")


def attached(comments: DataFrame, posts: DataFrame) -> DataFrame:
    """comments (permalink, message_id, parent_permalink, ord, ...) with the post_id of the post (permalink, message_id, post_id) that they
    name: by permalink, or else by message id, or else that of the earlier comment whose permalink they name. Others are dropped."""
    by_link = posts.where("permalink <> ''").groupBy(F.col("permalink").alias("parent_permalink")).agg(F.min("post_id").alias("_a"))
    by_number = posts.where("message_id <> ''").groupBy("message_id").agg(F.min("post_id").alias("_b"))
    met = comments.join(by_link, "parent_permalink", "left").join(by_number, "message_id", "left").withColumn("post_id", F.coalesce("_a", "_b")).drop("_a", "_b")
    earlier = met.where("post_id IS NOT NULL").groupBy(F.col("permalink").alias("parent_permalink")).agg(F.min(F.struct("ord", "post_id")).alias("_c"))
    found = met.join(earlier, "parent_permalink", "left").withColumn("post_id", F.coalesce("post_id", F.when(F.col("_c.ord") < F.col("ord"), F.col("_c.post_id"))))
    return found.where("post_id IS NOT NULL").select(*comments.columns, "post_id")


def united(direct: DataFrame, broad: DataFrame, key: str = "id") -> DataFrame:
    """Messages of both scans, each id once; the direct scan's row goes first."""
    both = direct.withColumn("_p", F.lit(0)).unionByName(broad.withColumn("_p", F.lit(1)))
    rest = [c for c in direct.columns if c != key]
    return both.groupBy(key).agg(F.min_by(F.struct(*rest), "_p").alias("v")).select(key, "v.*").select(*direct.columns)


def scan_limit(page: Column, expected: Column) -> Column:
    """How many messages to scan for a thread."""
    return F.greatest(page * 3, F.least(expected * 2, F.lit(1000)), F.lit(100))


def article_limit(expected: Column, aggressive: Column) -> Column:
    """How many comments to take from a page, by how many are expected."""
    return F.when(aggressive, F.when(expected >= 80, 420).otherwise(320)).when(expected >= 80, 280).when(expected >= 30, 240).otherwise(220)


def retry_needed(visible: Column, found: Column) -> Column:
    """Whether so few comments were found that a page should be read again."""
    return (found == 0) | ((visible >= 20) & (found < F.greatest(F.lit(3), F.floor(visible / 6))))


def parents_first(edges: DataFrame) -> DataFrame:
    """edges (comment_id, parent_comment_id, parent_post_id, created_at) with `rank` in an order in which parents come before their answers: by depth, then time."""
    from pyspark.sql import Window

    from forumetry.operators.normalize import comment_depths

    depths = edges.join(comment_depths(edges), "comment_id")
    return depths.withColumn("rank", F.row_number().over(Window.partitionBy("parent_post_id").orderBy("tree_depth", F.coalesce("created_at", F.lit("")), "comment_id")))
