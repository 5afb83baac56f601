"""Snapshots as a stream: every new manifest is flattened and upserted, each once, by a checkpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from forumetry.operators.normalize import tables_of
from forumetry.operators.store import checkpointed, upsert
from forumetry.schemas import MANIFEST


def ingest(spark: SparkSession, landing: str, root: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Reads manifests below `landing` (a folder a run) as they come and upserts their eight tables below `root`.

    A batch that is run again after a failure upserts the same rows again, which changes nothing.
    """

    def batch(manifests: DataFrame, epoch: int) -> None:
        kept = checkpointed(manifests)
        for name, df in tables_of(kept, place=True).items():
            upsert(df, root, name, place="place")

    stream = spark.readStream.schema(MANIFEST).option("multiLine", True).json(f"{landing.rstrip('/')}/*/manifest.json")
    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 minute")).start()


def event_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Counts and sums of events by type and tumbling window; events later than `late` are dropped. For batches and streams alike."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    grouped = timed.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return grouped.select(F.col("w.start").alias("start"), "event_type", "n", "total")
