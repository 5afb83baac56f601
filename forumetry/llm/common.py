"""Helpers that the corpus operators share: reading tables, shared scratch folders, text batches and skew-safe joins."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A join key counts as hot from one part in this many of all rows, so there are at most this many hot keys.
HOT_PARTS = 10_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder path below spark.checkpoint.dir, which driver and executors share. Where that is unset, a local session (tests) gets a
    local folder; any other is refused, since its executors would write to disks of their own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = f"file://{tempfile.mkdtemp(prefix='forumetry-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read back: cuts the lineage, and survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(name: str, taken: list[str]) -> str:
    """name, with so many underscores before it that no column has it; Spark's names don't tell upper from lower case."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name = f"_{name}"
    return name


def text_key(text: str = "text") -> Column:
    """Half of a row's key: rows with equal doc_id and equal text are one document."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, key, text) with null texts as empty; nothing of other columns, whatever their names."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("key"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def slices(batches: Iterator[pa.RecordBatch], most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `most` bytes, one row at least: bounds what a worker holds."""
    for batch in batches:
        per = max(1, batch.nbytes // max(1, batch.num_rows))
        step = max(1, most // per)
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


#: Rows of an Arrow batch, where the session has Spark's default, which for long texts would be tens of megabytes a task on both sides.
BATCH_ROWS, _BATCH_KEY = 1_000, "spark.sql.execution.arrow.maxRecordsPerBatch"


def bounded(spark: SparkSession) -> None:
    if spark.conf.get(_BATCH_KEY, "10000") == "10000":
        spark.conf.set(_BATCH_KEY, str(BATCH_ROWS))


def map_batches(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch], schema) -> DataFrame:
    """mapInArrow of a function from one bounded batch to one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield f(batch)

    bounded(df.sparkSession)
    return df.mapInArrow(run, schema)


def add_columns(df: DataFrame, make: Callable[[pa.RecordBatch], dict[str, pa.Array]], types: dict[str, str]) -> DataFrame:
    """df with new columns that `make` computes from each batch; an input column of the same name is replaced."""
    from pyspark.sql.types import StructType

    rest = df.drop(*types)
    schema = StructType([*rest.schema.fields, *StructType.fromDDL(", ".join(f"`{k}` {v}" for k, v in types.items())).fields])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = make(batch)
        return pa.RecordBatch.from_arrays([*batch.columns, *(made[k] for k in types)], names=[*batch.schema.names, *types])

    return map_batches(rest, run, schema)


def join_counted(rows: DataFrame, facts: DataFrame, keys: list[str], count: str) -> DataFrame:
    """Inner equi-join of many rows with one fact a key, safe for hot keys. facts has the number of rows of each key in column `count`.

    Keys with at least 1/HOT_PARTS of all rows are broadcast: by that share there are HOT_PARTS of them at most, whatever the size of the
    corpus. The rows of the others meet their fact in an ordinary shuffle join, where no key is larger than that share. facts is read three
    times, so it should be saved.
    """
    total, most = facts.agg(F.coalesce(F.sum(count), F.lit(0)), F.coalesce(F.max(count), F.lit(0))).first()
    least = max(1000, total // HOT_PARTS)
    if most < least:
        return rows.join(facts, keys)
    hot, cold = facts.where(F.col(count) >= least), facts.where(F.col(count) < least)
    few = F.broadcast(hot.select(*keys))
    return rows.join(F.broadcast(hot), keys).unionByName(rows.join(few, keys, "left_anti").join(cold, keys))


def small(df: DataFrame, rows: int) -> DataFrame:
    """df, which should be saved, with a hint to broadcast it if it has at most so many rows; else Spark joins it as any other table."""
    return F.broadcast(df) if df.count() <= rows else df


#: Keys of documents that are broadcast at most: 16 bytes each.
FEW_KEYS = 500_000


def of_keys(docs: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """The rows of docs that have (left_semi) or don't have (left_anti) one of the document keys (doc_id, key), which should be saved."""
    own, doc, key = (fresh(name, docs.columns) for name in ("_own", "_doc", "_key"))
    right = small(keys.select(F.col("doc_id").alias(doc), F.col("key").alias(key)), FEW_KEYS)
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(doc)) & (F.col(own) == F.col(key))
    return docs.withColumn(own, text_key()).join(right, same, how).drop(own)
