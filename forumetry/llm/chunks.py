"""Operator 2, substring dedup: content-defined chunking with a gear rolling hash.

Every byte adds a random number of its value to a hash that shifts left by one bit a byte, so the hash depends on the last 32 bytes alone. Where
its top MASK_BITS bits are zero, and no such place came within LEAST bytes before, a chunk ends; chunks of over MOST bytes are cut every MOST
bytes. Cuts are put off to the start of the next character. An insertion moves only the cuts around it. Chunks are deduplicated by a 128-bit
digest: the first (least doc_id, then text hash, then position) stays. Later ones are removed where they follow each other without a gap and
hold at least `least_words` words together, so that words and short phrases that any text repeats stay.

Cases: null and empty texts have no chunks; rows with equal doc_id and equal text are one document, and each of them keeps what the other keeps;
a null doc_id comes first; a text of any length is cut in one piece; an empty table gives no spans; other columns stay as they are, whatever
their names.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from forumetry.llm.common import fresh, join_counted, keyed, map_batches, saved, table, text_key

MASK_BITS, LEAST, MOST = 5, 8, 1024
#: Words that adjoining repeated chunks must hold to be removed. Of a repeated passage, the part before its first cut and that after its last aren't found.
LEAST_WORDS = 20
#: Bytes that the hash depends on.
REACH = 32
GEAR = np.random.Generator(np.random.PCG64(20_250_101)).integers(0, 1 << 32, 256, dtype=np.uint32)


def cuts(data: bytes, mask_bits: int = MASK_BITS, least: int = LEAST, most: int = MOST) -> np.ndarray:
    """Ends of the chunks of one text's bytes; the last is its length."""
    return batch_cuts([data], mask_bits, least, most)[1]


def batch_cuts(texts: list[bytes], mask_bits: int = MASK_BITS, least: int = LEAST, most: int = MOST) -> tuple[np.ndarray, np.ndarray]:
    """(text number, end) of all chunks of many texts, in order. The hash is computed for all bytes at once, by doubling its reach five times."""
    sizes = np.array(list(map(len, texts)), np.int64)
    begins = np.cumsum(sizes + REACH) - sizes  # REACH places without a number come before each text
    data = np.frombuffer(b"".join(x for t in texts for x in (bytes(REACH), t)), np.uint8)
    h = GEAR[data]
    gap = np.repeat(begins - REACH, REACH) + np.tile(np.arange(REACH), len(texts))
    h[gap] = 0
    shift = 1
    while shift < REACH:
        far = h[:-shift] << np.uint32(shift)
        h[shift:] += far
        shift *= 2
    ends = np.flatnonzero(h >> np.uint32(32 - mask_bits) == 0) + 1
    which = np.searchsorted(begins, ends, side="left") - 1
    inside = (which >= 0) & (ends > begins[which]) & (ends < (begins + sizes)[which])
    ends, which = ends[inside], which[inside]
    ends = settle(data, ends)
    ok = ends < (begins + sizes)[which]
    ends, which = ends[ok], which[ok]
    # far enough from the place before, kept or not, and from the text's start
    before = np.where(np.diff(which, prepend=-1) == 0, np.concatenate(([0], ends[:-1])), begins[which])
    ok = ends - before >= least
    full = np.flatnonzero(sizes > 0)
    which, ends = np.concatenate((which[ok], full)), np.concatenate((ends[ok], (begins + sizes)[full]))
    order = np.lexsort((ends, which))
    which, ends = which[order], ends[order]
    before = np.where(np.diff(which, prepend=-1) == 0, np.concatenate(([0], ends[:-1])), begins[which])
    extra = (ends - before - 1) // most
    if extra.any():
        n = int(extra.sum())
        step = np.arange(n) - np.repeat(np.cumsum(extra) - extra, extra) + 1
        more = settle(data, np.repeat(before, extra) + step * most)
        ok = more < np.repeat(ends, extra)
        ends, which = np.concatenate((ends, more[ok])), np.concatenate((which, np.repeat(which, extra)[ok]))
        order = np.lexsort((ends, which))
        which, ends = which[order], ends[order]
    return which, ends - begins[which]


def settle(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The ends moved right to the start of a character."""
    for _ in range(3):
        ends = ends + ((ends < len(data)) & (data[np.minimum(ends, len(data) - 1)] & 0xC0 == 0x80))
    return ends


CHUNKS = "doc_id long, key long, start int, stop int, words int, high long, low long"


def chunk_rows(docs: DataFrame) -> DataFrame:
    """A row a chunk: its document, byte span, words that begin in it, and digest."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [x.encode("utf-8", "replace") for x in batch["text"].to_pylist()]
        which, stop = batch_cuts(texts)
        start = np.where(np.diff(which, prepend=-1) == 0, np.concatenate(([0], stop[:-1])), 0)
        digests = b"".join(xxhash.xxh3_128_digest(texts[k][a:b]) for k, a, b in zip(which.tolist(), start.tolist(), stop.tolist(), strict=True))
        halves = np.frombuffer(digests, "<i8").reshape(-1, 2)
        data = np.frombuffer(b"".join(x for t in texts for x in (b" ", t)), np.uint8)
        begins = np.concatenate(([0], np.cumsum(np.array(list(map(len, texts)), np.int64) + 1)))[:-1] + 1
        blank = (data == 32) | (data == 10) | (data == 9) | (data == 13)
        starts = np.concatenate(([0], np.cumsum(~blank[1:] & blank[:-1]), [0]))  # words that begin at a place or before
        words = starts[begins[which] + stop - 1] - starts[begins[which] + start - 1]
        ids = batch["doc_id"].take(pa.array(which)), batch["key"].take(pa.array(which))
        return pa.RecordBatch.from_arrays([*ids, *(pa.array(x.astype(np.int32)) for x in (start, stop, words)), pa.array(halves[:, 0].copy()), pa.array(halves[:, 1].copy())], names=["doc_id", "key", "start", "stop", "words", "high", "low"])

    return map_batches(docs, run, CHUNKS)


def repeated_spans(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, key, start, stop, words, first_doc_id) of every span of bytes to remove, in documents (doc_id, key, text)."""
    chunks = saved(chunk_rows(docs), "chunks")  # read three times below: for the counts, for hot digests and for the others
    digest = ["high", "low"]
    # counts first, over halves of digests alone: most chunks occur once, and only the rows of the others are carried on
    counts = saved(chunks.groupBy("high").agg(F.count("*").alias("n")).where("n > 1"), "repeated-digests")
    repeated = saved(join_counted(chunks, counts, ["high"], "n").drop("n"), "repeated-chunks")
    first = repeated.groupBy(digest).agg(F.min(F.struct("doc_id", "key", "start")).alias("first"), F.count("*").alias("n"))
    met = join_counted(repeated, saved(first, "first-chunks"), digest, "n")
    later = met.where(~(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("key") == F.col("first.key")) & (F.col("start") == F.col("first.start"))))
    # documents with an equal key hold equal chunks: one of each is enough
    later = later.groupBy("doc_id", "key", "start", "stop").agg(F.first("words").alias("words"), F.min("first.doc_id").alias("first_doc_id"))
    by = Window.partitionBy("doc_id", "key").orderBy("start")
    begins = F.when(F.lag("stop").over(by) == F.col("start"), 0).otherwise(1)
    runs = later.withColumn("begins", begins).withColumn("run", F.sum("begins").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    spans = runs.groupBy("doc_id", "key", "run").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.sum("words").alias("words"), F.min("first_doc_id").alias("first_doc_id"))
    return spans.where(F.col("words") >= least_words).drop("run")


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """A text without some byte spans. A span's ends move inwards to blanks, so that no word is cut in two."""
    data, at, parts = text.encode("utf-8", "replace"), 0, []
    for start, stop in sorted(spans):
        if start > 0 and not data[start - 1 : start].isspace():
            found = re.compile(rb"\s").search(data, start, stop)
            start = found.end() if found else stop
        if stop < len(data) and not data[stop : stop + 1].isspace():
            while stop > start and not data[stop - 1 : stop].isspace():
                stop -= 1
        parts.append(data[at:start])
        at = max(at, stop)
    parts.append(data[at:])
    return b"".join(parts).decode("utf-8", "replace")


def removed(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """docs, with all their columns, with the texts that are left; documents of which nothing is left but blanks go, if they had text before."""
    names = docs.columns
    own, doc, key, found = (fresh(name, names) for name in ("_own", "_doc", "_key", "_found"))
    of_doc = spans.groupBy("doc_id", "key").agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias(found))
    of_doc = of_doc.withColumnsRenamed({"doc_id": doc, "key": key})
    joined = docs.withColumn(own, text_key()).join(of_doc, F.col("doc_id").eqNullSafe(F.col(doc)) & (F.col(own) == F.col(key)), "left")

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        of_row = batch[found].to_pylist()
        texts = [x if s is None else without(x or "", [(y["start"], y["stop"]) for y in s]) for x, s in zip(batch["text"].to_pylist(), of_row, strict=True)]
        gone = pa.array([s is not None and not x.strip() for x, s in zip(texts, of_row, strict=True)])
        columns = [pa.array(texts, pa.string()) if c == "text" else batch[c] for c in names]
        return pa.RecordBatch.from_arrays(columns, names=names).filter(pc.invert(gone))

    return map_batches(joined.select(*(docs[c] for c in names), found), cut, docs.schema)


def op2_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each span that is removed: where it is, its words, and the least document that keeps such a text."""
    spans = repeated_spans(keyed(table(spark, sf_dir, "documents")))
    return spans.select("doc_id", F.col("start").alias("start_byte"), F.col("stop").alias("stop_byte"), F.col("words").cast("long").alias("n_words"), "first_doc_id")


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents without passages that an earlier one has. Null and empty texts stay; of a text that is all repeats, nothing."""
    return removed(docs, repeated_spans(keyed(docs)))
