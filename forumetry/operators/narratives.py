"""Embeddings of texts by hashing, clusters of vectors, and keywords, exemplars and labels of clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from forumetry.functions.text import keyword_tokens, words


def bucket(token, dim: int):
    return (F.conv(F.substring(F.md5(token), 1, 8), 16, 10).cast("long") % dim).cast("int")


def sign(token):
    return F.when(F.conv(F.substring(F.md5(F.concat(token, F.lit("::sign"))), 1, 8), 16, 10).cast("long") % 2 == 0, 1).otherwise(-1)


def hash_cells(items: DataFrame, dim: int = 256) -> DataFrame:
    """(item_type, item_id, bucket, value): signed counts of the tokens of each item in `dim` buckets, by hashes that are equal on every machine."""
    tokens = items.select("item_type", "item_id", F.explode(words(F.col("text"))).alias("t"))
    return tokens.select("item_type", "item_id", bucket(F.col("t"), dim).alias("bucket"), sign(F.col("t")).alias("s")).groupBy("item_type", "item_id", "bucket").agg(F.sum("s").alias("value"))


def hash_embeddings(items: DataFrame, dim: int = 256) -> DataFrame:
    """(item_type, item_id, embedding) of length 1, or zeros for items without tokens."""
    cells = hash_cells(items, dim).groupBy("item_type", "item_id").agg(F.map_from_entries(F.collect_list(F.struct("bucket", "value"))).alias("m"), F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("norm"))
    vector = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda k: F.coalesce(F.try_element_at("m", k), F.lit(0)) / F.when(F.col("norm") > 0, F.col("norm")).otherwise(1.0))
    made = cells.select("item_type", "item_id", vector.alias("embedding"))
    zeros = F.array_repeat(F.lit(0.0), dim)
    return items.select("item_type", "item_id").join(made, ["item_type", "item_id"], "left").withColumn("embedding", F.coalesce("embedding", zeros))


def cluster_keywords(members: DataFrame, top: int = 8) -> DataFrame:
    """(item_type, cluster_id, rank, keyword, n) of members (item_type, cluster_id, ord, text): most frequent tokens, ties by first appearance."""
    tokens = members.select("item_type", "cluster_id", "ord", F.posexplode(keyword_tokens(F.col("text"))).alias("pos", "keyword"))
    counts = tokens.groupBy("item_type", "cluster_id", "keyword").agg(F.count("*").alias("n"), F.min(F.struct("ord", "pos")).alias("first"))
    order = Window.partitionBy("item_type", "cluster_id").orderBy(F.desc("n"), "first")
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("item_type", "cluster_id", "rank", "keyword", "n")


def first_texts(members: DataFrame, top: int = 3) -> DataFrame:
    """(item_type, cluster_id, texts): the first texts of each cluster, in order. Only the chosen items' texts are gathered."""
    order = Window.partitionBy("item_type", "cluster_id").orderBy("ord", "item_id")
    few = members.select("item_type", "cluster_id", "item_id", "ord").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    few = few.join(members.select("item_type", "cluster_id", "item_id", "ord", "text"), ["item_type", "cluster_id", "item_id", "ord"])
    return few.groupBy("item_type", "cluster_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]).alias("texts"))


def exemplars(members: DataFrame, top: int = 3) -> DataFrame:
    """(item_type, cluster_id, rank, item_id): the longest texts of each cluster, ties by order, then id. Lengths alone are sorted, and each task passes
    on the `top` rows of each cluster that it has, so a cluster of half of all items is no task of its own."""
    order = Window.partitionBy("item_type", "cluster_id").orderBy(F.desc("length"), "ord", "item_id")
    return members.select("item_type", "cluster_id", "item_id", "ord", F.length("text").alias("length")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("item_type", "cluster_id", "rank", "item_id")


def quotes(clusters: DataFrame, comments: DataFrame, top: int = 8, each: int = 2) -> DataFrame:
    """(cluster_id, label, rank, place, text): the first exemplars of the largest comment clusters (with member_count), in the order of the report."""
    largest = clusters.where("item_type = 'comment'").orderBy(F.desc("member_count"), "cluster_id").limit(top)
    placed = largest.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("member_count"), "cluster_id")))  # of `top` rows
    listed = placed.select("rank", "cluster_id", "label", F.posexplode(F.slice("exemplar_ids", 1, each)).alias("place", "comment_id"))
    return F.broadcast(listed).join(comments.select("comment_id", F.substring(F.coalesce("message", F.lit("")), 1, 280).alias("text")), "comment_id").select("cluster_id", "label", "rank", "place", "text")


def summaries(members: DataFrame, run_id: str, top: int = 3) -> DataFrame:
    """Clusters with their label and description, from their keywords, and `top` exemplars."""
    keys = cluster_keywords(members).groupBy("item_type", "cluster_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "keyword"))), lambda x: x["keyword"]).alias("top_keywords"))
    best = exemplars(members, top).groupBy("item_type", "cluster_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "item_id"))), lambda x: x["item_id"]).alias("exemplar_ids"))
    all_ = members.select("item_type", "cluster_id").distinct().join(keys, ["item_type", "cluster_id"], "left").join(best, ["item_type", "cluster_id"], "left")
    none, kind = F.size(F.coalesce("top_keywords", F.array().cast("array<string>"))) == 0, F.initcap("item_type")
    label = F.when(none, F.concat(kind, F.lit(" cluster"))).otherwise(F.array_join(F.slice("top_keywords", 1, 3), ", "))
    about = F.when(none, F.concat(F.lit("Automatically discovered "), F.col("item_type"), F.lit(" discussion cluster."))).otherwise(F.concat(kind, F.lit(" discussion centered on "), F.array_join(F.slice("top_keywords", 1, 5), ", "), F.lit(".")))
    return all_.select("item_type", "cluster_id", label.alias("label"), about.alias("description"), F.coalesce("top_keywords", F.array().cast("array<string>")).alias("top_keywords"), F.coalesce("exemplar_ids", F.array().cast("array<string>")).alias("exemplar_ids"), F.lit(run_id).alias("run_id"))
