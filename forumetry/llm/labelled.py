"""Labelled rows for the classifiers: a bounded, repeatable sample, without the rows that are held out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(modulo: int, remainder: int) -> Column:
    """Whether crc32(doc_id as text) leaves that remainder; a null doc_id is held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulo == remainder, F.lit(True))


def sample(docs: DataFrame, labels: DataFrame, label: str, held: Column, most: int) -> DataFrame:
    """(text, label 0 or 1) of at most `most` labelled documents that aren't held out: those of least hash of doc_id.

    Null labels are left out; of several labels of a doc_id the mean counts, rounded; of several texts of a doc_id the least, so rows that share
    one are one document, however many there are. `most` bounds the rows, on any corpus. The labels of that many documents are broadcast.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held).groupBy("doc_id").agg((F.avg(label) >= 0.5).cast("int").alias("label"))
    few = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    met = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(few), "doc_id")
    return met.groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("text", "label")
