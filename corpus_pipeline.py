"""The corpus pipeline: five operators one after the other, each on all that the one before kept, written as Parquet between."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from forumetry.llm import byte_bpe, chunks, decontaminate, quality, simhash
from forumetry.llm.common import saved, table


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The last stage: token ids of every text, and the text that they decode to, of a document as (doc_id, n_tokens, ids, text); other columns, whatever
    their names, end here.

    A null or empty text has no ids and decodes to an empty one; very long texts are encoded whole; repeated rows stay; an empty table stays empty.
    """
    import public_tokenizers

    encoded = byte_bpe.with_byte_bpe(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.col("decoded").cast("string").alias("text"))


STAGES = [
    ("quality classifier", quality.keep_good),
    ("SimHash near-dedup", simhash.keep_first),
    ("substring dedup", chunks.drop_repeats),
    ("benchmark decontamination", decontaminate.keep_clean),
    ("byte-level BPE", encode),
]
#: No SQL expresses a boosted classifier, a rolling hash or a tokenizer; tests/llm compares the stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = saved(stage(spark, docs, sf_dir), f"stage-{k}")
    return docs
