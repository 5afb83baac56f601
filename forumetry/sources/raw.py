"""Raw payloads of collectors: what was fetched, kept by run and category, and found again by the path that its rows name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from forumetry.functions.text import slug

SCHEMA = "category STRING, stem STRING, payload STRING"


def raw_path(category: Column, stem: Column) -> Column:
    """Where a payload is: its category, and its stem as a name."""
    return F.concat(category, F.lit("/"), slug(stem))


def write_payloads(payloads: DataFrame, root: str, run_id: str) -> DataFrame:
    """Writes payloads (category, stem, payload) of a run as JSON lines, a folder a category, and gives them back with `raw_path`. Each task writes its
    own files; what a run wrote before in these categories is replaced, so a run that is done again leaves one copy. Of payloads with equal paths the
    greatest stays; null categories and stems count as empty."""
    named = payloads.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("category", "stem")), "payload")
    named = named.withColumn("raw_path", raw_path(F.col("category"), F.col("stem")))
    once = named.groupBy("category", "raw_path").agg(F.max(F.struct("stem", "payload")).alias("v")).select("category", "v.stem", "v.payload", "raw_path")
    writer = once.hint("rebalance", "category").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("category").json(f"{root.rstrip('/')}/{run_id}/payloads")
    return read_payloads(payloads.sparkSession, root, run_id)


def read_payloads(spark: SparkSession, root: str, run_id: str) -> DataFrame:
    """(category, stem, payload, raw_path) of a run; a filter on the category reads its folder alone."""
    return spark.read.schema("stem STRING, payload STRING, raw_path STRING, category STRING").json(f"{root.rstrip('/')}/{run_id}/payloads").select("category", "stem", "payload", "raw_path")
