"""Tables on disk: typed reads, keyed upserts, publishing, exports; and cutting lineages."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Iterable
from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

from forumetry.operators.normalize import last_of
from forumetry.schemas import KEYS, TABLES


def checkpointed(df: DataFrame) -> DataFrame:
    """df written to the shared folder of spark.checkpoint.dir and read back. Where that is unset, a local session (tests) gets a local folder;
    any other is refused, since its executors would write to disks of their own."""
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = f"file://{tempfile.mkdtemp(prefix='forumetry-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    return jvm.org.apache.hadoop.fs.Path(path)


def _files(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    return _files(spark, path).exists(_path(spark, path))


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """A small file, such as a report, on whatever file system the path names."""
    out = _files(spark, path).create(_path(spark, path), True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()


def write_lines(spark: SparkSession, path: str, lines: Iterable[str], at_once: int = 1000) -> None:
    """A text file of lines that are written as they come, `at_once` of them at a time."""
    out, some = _files(spark, path).create(_path(spark, path), True), []
    try:
        for line in lines:
            some.append(line + "\n")
            if len(some) >= at_once:
                out.write(bytearray("".join(some).encode()))
                some = []
        out.write(bytearray("".join(some).encode()))
    finally:
        out.close()


#: Buckets of the keys of a table that isn't partitioned by runs; a table keeps the number it was begun with.
BUCKETS = 64
#: Fixed value: how Spark names the folder of rows without a run.
NULL_SLICE = "__HIVE_DEFAULT_PARTITION__"


def _slice(name: str) -> str:
    """The column that a table is cut by: the run, where rows belong to one for good, or else a bucket of the key."""
    return "run_id" if "run_id" in KEYS[name] else "bucket"


def _bucket(name: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(*KEYS[name]), F.lit(buckets)).cast("int")


@dataclass(frozen=True)
class Version:
    """A state of a table: the folder of each of its slices. It is a small file that is written once and never changed."""

    number: int
    buckets: int
    folders: dict[str, str]


def _versions(spark: SparkSession, path: str) -> list[int]:
    at = _path(spark, f"{path}/versions")
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(int(f.getPath().getName()) for f in fs.listStatus(at) if f.getPath().getName().isdigit()) if fs.exists(at) else []


def _version(spark: SparkSession, path: str, number: int) -> Version:
    stream = _files(spark, path).open(_path(spark, f"{path}/versions/{number}"))
    try:
        return Version(number, **json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
    finally:
        stream.close()


def current(spark: SparkSession, root: str, name: str) -> Version:
    """The newest state of a table."""
    numbers = _versions(spark, f"{root}/{name}")
    return _version(spark, f"{root}/{name}", numbers[-1]) if numbers else Version(0, BUCKETS, {})


def _read(spark: SparkSession, root: str, name: str, folders: list[str]) -> DataFrame:
    schema = TABLES[name]
    if not folders:
        return spark.createDataFrame([], schema)
    base = f"{root}/{name}/data"
    return spark.read.schema(schema).option("basePath", base).parquet(*(f"{base}/{f}" for f in folders)).select(*schema.names)


def load(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A stored table as it is now; one without rows but with its columns if it was never written. Reading changes nothing on disk, and what was
    loaded can be read until the table was upserted into twice."""
    return _read(spark, root, name, sorted(current(spark, root, name).folders.values()))


def load_beside(new: DataFrame, root: str, name: str) -> DataFrame:
    """Of a stored table the slices that rows of new belong to, with no other read. What an upsert of new would merge with."""
    spark, was = new.sparkSession, current(new.sparkSession, root, name)
    own = F.col("run_id") if _slice(name) == "run_id" else _bucket(name, was.buckets)
    touched = {r[0] for r in new.select(F.coalesce(own.cast("string"), F.lit(NULL_SLICE))).distinct().collect()}
    return _read(spark, root, name, sorted(was.folders[s] for s in touched if s in was.folders))


def upserted(old: DataFrame, new: DataFrame, keys: list[str], place: str | None = None) -> DataFrame:
    """old and new, with the columns of both but `place`, one row a key: new rows go before old ones, and of several in one frame the one of greatest
    `place`, a column of new. Among rows that this leaves open the one with the greatest other columns counts, so the result doesn't depend on
    how the frames are partitioned."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    rest = [c for c in both.columns if c not in (*keys, "_new", place)]
    kinds = {f.name: f.dataType for f in both.schema.fields}
    values = [F.to_json(c) if "map<" in kinds[c].simpleString() else F.col(c) for c in rest]
    order = F.struct("_new", *([place] if place else []), F.struct(*(v.alias(f"v{k}") for k, v in enumerate(values))) if values else F.lit(0))
    return last_of(both.withColumn("_at", order).drop("_new", *([place] if place else [])), keys, "_at").drop("_at")


def upsert(new: DataFrame, root: str, name: str, replace_run: str | None = None, place: str | None = None, buckets: int = BUCKETS) -> DataFrame:
    """Upserts into a stored table; of several rows of one key in new the one of greatest `place` counts. An empty `new` changes nothing. With
    replace_run, old rows of that run that aren't in `new` go. A table that isn't there yet gets so many buckets.

    Only slices that new has rows of (with replace_run: all) are read and written, into a folder of their own; then a new version of the table names
    that folder for them. So readers see the table before or after, and an upsert that is interrupted leaves it as it was. Of two writers at
    once one fails.
    """
    spark, path, cut = new.sparkSession, f"{root}/{name}", _slice(name)
    was = current(spark, root, name)
    was = was if was.number else Version(0, buckets, {})
    with_cut = lambda df: df if cut == "run_id" else df.withColumn(cut, _bucket(name, was.buckets))
    new = checkpointed(new)
    # runs of the frame, or buckets
    touched = {r[0] for r in with_cut(new).select(F.coalesce(F.col(cut).cast("string"), F.lit(NULL_SLICE))).distinct().collect()}
    if not touched:
        return load(spark, root, name)
    if replace_run:
        touched |= {replace_run} if cut == "run_id" else set(was.folders)
    old = _read(spark, root, name, sorted(was.folders[s] for s in touched if s in was.folders))
    if replace_run:
        old = old.where(~F.col("run_id").eqNullSafe(replace_run))
    batch = f"batch={uuid.uuid4().hex}"
    # few files a slice: tasks hold whole slices, and Spark splits those that are large
    with_cut(upserted(old, new, KEYS[name], place)).hint("rebalance", cut).write.partitionBy(cut).parquet(f"{path}/data/{batch}")
    made = {f.getPath().getName() for f in _files(spark, path).listStatus(_path(spark, f"{path}/data/{batch}"))}
    folders = {s: f for s, f in was.folders.items() if s not in touched}
    folders |= {unquote(m.split("=", 1)[1]): f"{batch}/{m}" for m in made if m.startswith(f"{cut}=")}
    _publish_version(spark, path, Version(was.number + 1, was.buckets, folders))
    _clean(spark, path)
    return load(spark, root, name)


def _publish_version(spark: SparkSession, path: str, version: Version) -> None:
    """Fails if there is such a version already."""
    fs, at = _files(spark, path), f"{path}/versions/{version.number}"
    draft = f"{path}/versions/.{version.number}-{uuid.uuid4().hex}"
    write_bytes(spark, draft, json.dumps({"buckets": version.buckets, "folders": version.folders}).encode())
    if fs.exists(_path(spark, at)) or not fs.rename(_path(spark, draft), _path(spark, at)):
        fs.delete(_path(spark, draft), False)
        raise RuntimeError(f"{path} was upserted into by another writer")


def _clean(spark: SparkSession, path: str, kept: int = 2) -> None:
    """Drops all versions but the last ones, and the folders that only those name."""
    numbers, fs = _versions(spark, path), _files(spark, path)
    keep = {f for n in numbers[-kept:] for f in _version(spark, path, n).folders.values()}
    for n in numbers[:-kept]:
        for folder in set(_version(spark, path, n).folders.values()) - keep:
            fs.delete(_path(spark, f"{path}/data/{folder}"), True)
        fs.delete(_path(spark, f"{path}/versions/{n}"), False)


def publish(df: DataFrame, name: str, database: str | None = None) -> None:
    """As a catalogue table, over any older one."""
    df.write.mode("overwrite").saveAsTable(f"{database}.{name}" if database else name)


def flat_cells(df: DataFrame) -> DataFrame:
    """df with lists, maps and structs as JSON, as text files need them."""
    out = []
    for f in df.schema.fields:
        nested, empty = isinstance(f.dataType, (ArrayType, MapType, StructType)), "[]" if isinstance(f.dataType, ArrayType) else "{}"
        out.append(F.coalesce(F.to_json(f.name), F.lit(empty)).alias(f.name) if nested else F.col(f.name))
    return df.select(*out)


def write_csv(df: DataFrame, path: str) -> None:
    """A folder of CSV files with headers, each task its own; sorted rows are in the order of the files' names."""
    flat_cells(df).write.mode("overwrite").csv(path, header=True, escape='"')


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV that people edit: every column is text."""
    return spark.read.csv(path, header=True, inferSchema=False, escape='"', multiLine=True)
