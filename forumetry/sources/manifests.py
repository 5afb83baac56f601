"""Snapshots on disk: strict reads of manifests, listing of runs, and writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

from forumetry.schemas import MANIFEST


def unknown_fields(found: DataType, known: DataType, at: str = "") -> list[str]:
    """Paths of fields that a read schema has and the known one lacks."""
    if isinstance(found, ArrayType) and isinstance(known, ArrayType):
        return unknown_fields(found.elementType, known.elementType, f"{at}[]")
    if not isinstance(found, StructType) or isinstance(known, MapType):
        return []
    if not isinstance(known, StructType):
        return [at]
    out = []
    for f in found.fields:
        out += unknown_fields(f.dataType, known[f.name].dataType, f"{at}.{f.name}") if f.name in known.names else [f"{at}.{f.name}".lstrip(".")]
    return out


def read_manifests(spark: SparkSession, paths: str | list[str], strict: bool = True) -> DataFrame:
    """One row a manifest. Strict: a field that the schema lacks, a missing run_id or malformed JSON is an error."""
    if strict and (extra := unknown_fields(spark.read.option("multiLine", True).json(paths).schema, MANIFEST)):
        raise ValueError(f"unknown fields in manifests: {', '.join(sorted(set(extra)))}")
    rows = spark.read.schema(MANIFEST).option("multiLine", True).option("mode", "FAILFAST").json(paths)
    return rows.withColumn("run_id", F.coalesce("run_id", F.raise_error(F.lit("a manifest has no run_id")).cast("string"))) if strict else rows


def run_ids(spark: SparkSession, root: str) -> list[str]:
    """The runs below a folder that have a manifest, in order; the last is the latest."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/*/manifest.json")
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(x.getPath().getParent().getName() for x in found or [])


def latest_run(spark: SparkSession, root: str) -> str | None:
    return (run_ids(spark, root) or [None])[-1]


def request_key(platform: str, source: str, mode: str, start: str | None, end: str | None) -> tuple[str, ...]:
    """What a run was asked for; an existing snapshot with an equal key is used again instead of being collected anew."""
    return tuple(x or "" for x in (platform, source, mode, start, end))


def matches_request(manifests: DataFrame, key: tuple[str, ...]) -> DataFrame:
    s = lambda c: F.coalesce(F.col(c), F.lit(""))
    identity = F.coalesce(F.nullif(s("source.source_id"), F.lit("")), F.nullif(s("source.source_url"), F.lit("")), s("source.source_name"))
    same = F.lit(True)
    for column, value in zip((s("source.platform"), identity, s("mode"), s("requested_date_start"), s("requested_date_end")), key, strict=True):
        same = same & (column == value)
    return manifests.where(same)


def write_manifests(manifests: DataFrame, path: str) -> None:
    """One JSON object a line; null fields are left out."""
    manifests.write.mode("overwrite").json(path)
