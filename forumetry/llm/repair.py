"""Operator 1, token-ID output: token ids of whole documents in shards compressed with Re-Pair grammars.

A shard holds the ids of consecutive documents, each closed by an end id. Its grammar is built in rounds: count all adjacent pairs, give every
pair that occurs often enough a nonterminal, replace its occurrences, and go on with a quarter of that count, until no pair occurs `min_pairs`
times. Where chosen pairs overlap, the more frequent one wins, and in a run of one pair the leftmost. Rules and their expansion lengths are stored, so
`decode_range` finds any position by binary search and expands only the symbols that cover it.

Cases: a null or empty text gives the end id alone; rows are ordered by (doc_id, hash of text), nulls first; repeated rows are stored once
each, so each has its own start, and as they are alike their order doesn't matter; an empty table gives no shards; a text of more ids than a
shard's has a shard of its own. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from forumetry.llm.common import bounded, keyed, slices, table

#: Fixed values of the shard format: magic, then counts of rules, symbols, documents and ids, then the first nonterminal.
MAGIC = b"RPG1"
HEAD = struct.Struct("<4sIIIQI")
#: Ids in a shard at most, unless one document has more.
SHARD_IDS = 1 << 20
MIN_PAIRS = 4
#: Pairs are counted in 2 ** SLOT_BITS slots of a multiplicative hash.
SLOT_BITS, FACTOR = 18, np.uint64(0x9E3779B97F4A7C15)
#: Bytes of text that a task encodes, about.
TASK_BYTES = 24 << 20
#: Bytes of text that are encoded together.
TOGETHER = 6 << 20
#: Stems and other words whose ids a worker keeps at once; then it forgets them all.
MEMO = 400_000


def frequent_pairs(keys: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(pairs with at least so many places, their counts, places, index of the pair at each place). Pairs are first counted by hash, so only
    those that may be frequent are sorted."""
    slot = (keys * FACTOR >> np.uint64(64 - SLOT_BITS)).view(np.int64)
    places = np.flatnonzero((np.bincount(slot, minlength=1 << SLOT_BITS) >= least)[slot])
    some = keys[places]
    ordered = np.sort(some)
    first = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1]))) if len(ordered) else np.zeros(0, np.int64)
    counts = np.diff(np.append(first, len(ordered)))
    chosen, counts = ordered[first[counts >= least]], counts[counts >= least]
    if not len(chosen):
        return chosen, counts, places[:0], places[:0]
    # a pair's index is looked up by its slot; of pairs in one slot the last is found there, and the others by binary search
    slot, own = slot[places], (chosen * FACTOR >> np.uint64(64 - SLOT_BITS)).view(np.int64)
    holder = np.full(1 << SLOT_BITS, -1, np.int64)
    holder[own] = np.arange(len(chosen))
    at = holder[slot]
    hit = (at >= 0) & (chosen[at] == some)
    others = np.flatnonzero(holder[own] != np.arange(len(chosen)))
    if len(others):
        crowded = np.zeros(1 << SLOT_BITS, bool)
        crowded[own[others]] = True
        again = np.flatnonzero(crowded[slot] & ~hit)
        found = others[np.minimum(np.searchsorted(chosen[others], some[again]), len(others) - 1)]
        at[again], hit[again] = found, chosen[found] == some[again]
    return chosen, counts, places[hit], at[hit]


def build_grammar(ids: np.ndarray, base: int, min_pairs: int = MIN_PAIRS) -> tuple[np.ndarray, np.ndarray]:
    """(rules, symbols): rule k, of two symbols, is nonterminal base + k; the symbols expand to ids."""
    seq, rules, made, fresh = ids.astype(np.uint64), [], 0, 0
    least = max(min_pairs, len(seq) // 1024)
    while len(seq) > 1:
        if fresh:  # at the least count, a pair has most likely become frequent only if it has a symbol of the round before
            new = seq >= np.uint64(fresh)
            near = np.flatnonzero(new[:-1] | new[1:])
            keys = seq[near] << np.uint64(32) | seq[near + 1]
        else:
            near, keys = None, seq[:-1] << np.uint64(32) | seq[1:]
        chosen, counts, places, at = frequent_pairs(keys, least)
        used = np.zeros(0, np.int64)
        if len(chosen):
            places = places if near is None else near[places]
            rank = np.empty(len(chosen), np.int64)
            rank[np.lexsort((-chosen.astype(np.int64), counts))] = np.arange(1, len(chosen) + 1)  # a later rank is more frequent; all differ
            weight, close = rank[at], np.diff(places) == 1
            run = np.flatnonzero(np.concatenate(([True], ~(close & (at[1:] == at[:-1])))))
            offset = np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))
            left, right = np.concatenate(([0], weight[:-1] * close)), np.concatenate((weight[1:] * close, [0]))
            take = (offset % 2 == 0) & ((offset > 0) | (left < weight)) & (right <= weight)
            uses = np.bincount(at[take], minlength=len(chosen))
            take &= uses[at] >= min(2, min_pairs)
            used = np.flatnonzero(uses >= min(2, min_pairs))
        if len(used):
            name = np.zeros(len(chosen), np.uint64)
            name[used] = base + made + np.arange(len(used))
            rules.append(np.stack((chosen[used] >> np.uint64(32), chosen[used] & np.uint64(0xFFFFFFFF)), axis=1))
            seq[places[take]] = name[at[take]]
            keep = np.ones(len(seq), bool)
            keep[places[take] + 1] = False
            seq, last = seq[keep], base + made
            made += len(used)
        if least > min_pairs:
            least = max(min_pairs, least // 4)
        elif len(used):
            fresh = last
        elif fresh:
            fresh = 0  # once more over all pairs
        else:
            break
    return np.concatenate(rules).astype("<u4") if rules else np.zeros((0, 2), "<u4"), seq.astype("<u4")


def expansion_lengths(rules: np.ndarray, base: int) -> np.ndarray:
    """Ids that each rule expands to. Rules only refer to earlier ones, so a pass settles all whose parts are settled."""
    lengths = np.zeros(len(rules), np.int64)
    left, right = rules[:, 0].astype(np.int64) - base, rules[:, 1].astype(np.int64) - base
    open_ = np.arange(len(rules))
    while len(open_):
        a, b = left[open_], right[open_]
        x, y = np.where(a < 0, 1, lengths[np.maximum(a, 0)]), np.where(b < 0, 1, lengths[np.maximum(b, 0)])
        done = (x > 0) & (y > 0)
        lengths[open_[done]] = (x + y)[done]
        open_ = open_[~done]
    return lengths


def pack_shard(ids: np.ndarray, base: int, lengths: np.ndarray, min_pairs: int = MIN_PAIRS) -> bytes:
    """A shard as bytes. lengths: ids of each document."""
    rules, seq = build_grammar(ids, base, min_pairs)
    spans = expansion_lengths(rules, base)
    low, high = (seq & 0xFFFF).astype("<u2"), (seq >> 16).astype("<u2")
    head = HEAD.pack(MAGIC, len(rules), len(seq), len(lengths), len(ids), base)
    return b"".join((head, rules.tobytes(), spans.astype("<u4").tobytes(), lengths.astype("<u4").tobytes(), low.tobytes(), zlib.compress(high.tobytes(), 1)))


class Shard:
    """A shard read back."""

    def __init__(self, blob: bytes):
        magic, n_rules, n_seq, n_docs, self.n_ids, self.base = HEAD.unpack_from(blob)
        if magic != MAGIC:
            raise ValueError("not a token shard")
        at = HEAD.size
        parts = []
        for kind, n in (("<u4", 2 * n_rules), ("<u4", n_rules), ("<u4", n_docs), ("<u2", n_seq)):
            parts.append(np.frombuffer(blob, kind, n, at).astype(np.int64))
            at += parts[-1].size * np.dtype(kind).itemsize
        self.rules, self.spans, self.lengths, low = parts[0].reshape(-1, 2), parts[1], parts[2], parts[3]
        self.seq = low | np.frombuffer(zlib.decompress(blob[at:]), "<u2").astype(np.int64) << 16
        self._ends = None

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        """The ids of symbols: every pass replaces all nonterminals by their two parts."""
        while (deep := symbols >= self.base).any():
            width = 1 + deep
            out = np.repeat(symbols, width)
            left = np.cumsum(width) - width
            spots = left[deep]
            out[spots], out[spots + 1] = self.rules[symbols[deep] - self.base].T
            symbols = out
        return symbols

    def flat(self) -> tuple[np.ndarray, np.ndarray]:
        """All rules' expansions one after the other, and where each begins; built from settled parts, as the lengths are."""
        begins = np.concatenate(([0], np.cumsum(self.spans)))
        out = np.empty(int(begins[-1]), np.int64)
        depth = np.zeros(len(self.rules), np.int64)
        parts = self.rules - self.base
        open_ = np.arange(len(self.rules))
        level = 0
        while len(open_):
            level += 1
            known = np.where(parts[open_] < 0, 1, depth[np.maximum(parts[open_], 0)]).min(axis=1) > 0
            ready = open_[known]
            for side in (0, 1):
                part, to = self.rules[ready, side], begins[ready] + (0 if side == 0 else self._span(self.rules[ready, 0]))
                leaf = part < self.base
                out[to[leaf]] = part[leaf]
                self._copy(out, to[~leaf], begins[part[~leaf] - self.base], self.spans[part[~leaf] - self.base])
            depth[ready] = level
            open_ = open_[~known]
        return out, begins

    def _span(self, symbols: np.ndarray) -> np.ndarray:
        deep = symbols >= self.base
        out = np.ones(len(symbols), np.int64)
        out[deep] = self.spans[symbols[deep] - self.base]
        return out

    @staticmethod
    def _copy(out: np.ndarray, to: np.ndarray, begin: np.ndarray, n: np.ndarray) -> None:
        if len(n):
            step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            out[np.repeat(to, n) + step] = out[np.repeat(begin, n) + step]

    def decode(self) -> np.ndarray:
        """All ids of the shard."""
        table, begins = self.flat()
        n = self._span(self.seq)
        deep = self.seq >= self.base
        ends = np.cumsum(n)
        out = np.empty(int(ends[-1]) if len(ends) else 0, np.int64)
        out[(ends - n)[~deep]] = self.seq[~deep]
        k = self.seq[deep] - self.base
        if len(k):
            m = self.spans[k]
            step = np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m)
            out[np.repeat((ends - n)[deep], m) + step] = table[np.repeat(begins[k], m) + step]
        return out

    def decode_range(self, start: int, stop: int) -> np.ndarray:
        """The ids at positions start to stop - 1, from the symbols that cover them."""
        if self._ends is None:
            self._ends = np.cumsum(self._span(self.seq))
        stop = min(stop, self.n_ids)
        if start >= stop:
            return np.zeros(0, np.int64)
        a, b = np.searchsorted(self._ends, [start, stop - 1], side="right")
        before = int(self._ends[a - 1]) if a else 0
        return self.expand(self.seq[a : b + 1])[start - before : stop - before]


#: The tokenizer file's steps that `WordIds` can take apart. With others, whole texts are encoded.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLIT = {
    "type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True,
}
BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
#: A word of letters that normalise to their lower case alone, and ASCII marks behind them that no contraction begins with.
STEM, MARKS = "[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+", r"[!-&(-/:-@\[-`{-~]*"


def byte_letters() -> dict[int, str]:
    """The letter that a byte-level vocabulary writes for each byte: itself if it can be seen in Latin-1, else the next from 256 on. A blank stays."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = (b for b in range(256) if b not in seen)
    return {b: chr(b) for b in seen} | {b: chr(256 + k) for k, b in enumerate(hidden)} | {32: " "}


def ranges(flat: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """flat[begin : begin + size] of every pair, one after the other."""
    ends = np.cumsum(sizes)
    return flat[np.repeat(begins - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)]


class WordIds:
    """Ids of texts by a tokenizer that encodes each run between blanks on its own, letters and the marks behind them apart.

    Of every batch the distinct words are taken, of these the distinct stems in lower case, and of these only the ones that the worker hasn't met
    are given to the tokenizer's model; what doesn't consist of a stem and marks goes through the whole tokenizer. A tokenizer with other steps
    than NORMALIZER, SPLIT and BYTES encodes whole texts.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.by_words = (
            spec["normalizer"] == NORMALIZER and spec["pre_tokenizer"] == {"type": "Sequence", "pretokenizers": [SPLIT, BYTES]} and not spec["post_processor"]
            and not spec["truncation"] and not spec["padding"] and model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "byte_fallback", "ignore_merges"))
            and not any(re.search(rf"\s|^{STEM}{MARKS}$", t["content"]) or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"])
        )
        self.letters = byte_letters()
        self.forget()

    def forget(self) -> None:
        self.memo: list[pa.Array] = []
        self.flat, self.begins, self.known = np.zeros(1 << 16, "<u4"), np.zeros(1, np.int64), 0

    def ids(self, words: pa.Array, stems: bool) -> list[list[int]]:
        """Ids of words, which are all stems in lower case or all not."""
        listed = words.to_pylist()
        if not stems or not listed:
            return [e.ids for e in self.tokenizer.encode_batch_fast(listed, add_special_tokens=False)]
        tokenize = self.tokenizer.model.tokenize
        return [[t.id for t in tokenize(w)] for w in " ".join(listed).encode().decode("latin-1").translate(self.letters).split(" ")]

    def places(self, words: pa.Array, stems: bool) -> np.ndarray:
        """Places of words among those remembered; new ones are encoded."""
        if not self.memo:
            place = np.full(len(words), -1)
        else:
            place = pc.index_in(words, value_set=pa.chunked_array(self.memo)).fill_null(-1).to_numpy().astype(np.int64)
        missing = place < 0
        if missing.any():
            coded = words.filter(pa.array(missing)).dictionary_encode()
            new = coded.dictionary
            lists = self.ids(new, stems)
            sizes = np.fromiter(map(len, lists), np.int64, len(lists))
            place[missing] = len(self.begins) - 1 + coded.indices.to_numpy()
            total = self.known + int(sizes.sum())
            if total > len(self.flat):
                self.flat = np.concatenate((self.flat, np.zeros(max(total, 2 * len(self.flat)) - len(self.flat), "<u4")))
            self.flat[self.known : total] = np.fromiter(chain.from_iterable(lists), np.int64, total - self.known)
            self.begins = np.concatenate((self.begins, self.known + np.cumsum(sizes)))
            self.memo.append(new)
            self.known = total
        return place

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, the end id after each, and how many ids each has."""
        texts = texts.fill_null("")
        if not self.by_words:
            lists = [[*e.ids, end_id] for e in self.tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
            sizes = np.fromiter(map(len, lists), np.int64, len(lists))
            return np.fromiter(chain.from_iterable(lists), "<u4", int(sizes.sum())), sizes
        if len(self.begins) > MEMO:
            self.forget()
        for blank in "\n\t\r":
            texts = pc.replace_substring(texts, blank, " ")
        words = pc.split_pattern(texts, " ")
        n, coded = words.value_lengths().to_numpy().astype(np.int64), words.flatten().dictionary_encode()
        distinct = coded.dictionary
        parts = pc.extract_regex(distinct, f"^(?P<stem>{STEM})(?P<marks>{MARKS})$")
        plain = parts.is_valid().to_numpy(zero_copy_only=False)
        some = parts.filter(pa.array(plain))
        marks = some.field("marks").dictionary_encode()
        first, second = np.empty(len(distinct), np.int64), np.empty(len(distinct), np.int64)
        first[~plain] = self.places(distinct.filter(pa.array(~plain)), False)
        second[plain] = self.places(marks.dictionary, False)[marks.indices.to_numpy()]
        second[~plain] = self.places(pa.array([""]), False)[0]
        first[plain] = self.places(pc.utf8_lower(some.field("stem")), True)
        both = np.stack((first, second), axis=1).ravel()
        size = self.begins[both + 1] - self.begins[both]
        flat, size = ranges(self.flat, self.begins[both], size), size.reshape(-1, 2).sum(axis=1)
        begin, which = np.cumsum(size) - size, coded.indices.to_numpy()
        size = size[which]
        counts = np.diff(np.concatenate(([0], np.cumsum(size)))[np.concatenate(([0], np.cumsum(n)))])
        ids = np.empty(int(counts.sum()) + len(texts), "<u4")
        inside = np.ones(len(ids), bool)
        inside[np.cumsum(counts + 1) - 1] = False
        ids[~inside] = end_id
        ids[inside] = ranges(flat, begin[which], size)
        return ids, counts + 1


def gathered(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `most` bytes: the larger, the fewer distinct words are looked up again."""
    held, size = [], 0
    for batch in slices(batches, most):
        held.append(batch)
        size += batch.nbytes
        if size >= most:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
    if size:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


_ENCODERS: dict[str, WordIds] = {}

SHARDS = "part int, shard int, doc_ids array<long>, before long, n_ids long, grammar binary"


def write_shards(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, vocabulary: int = 49_408, shard_ids: int = SHARD_IDS) -> None:
    """Encodes all documents, in ascending doc_id order, to a folder of Parquet files whose rows are shards. vocabulary: ids are below it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, shard, before = TaskContext.get().partitionId(), 0, 0
        held, ids, n = [], [], 0
        if tokenizer not in _ENCODERS:  # one a worker process
            _ENCODERS[tokenizer] = WordIds(tokenizer)
        encoder = _ENCODERS[tokenizer]

        def row() -> pa.RecordBatch:
            grammar = pack_shard(np.concatenate(ids), vocabulary, np.array([len(x) for x in ids]))
            values = ((part, pa.int32()), (shard, pa.int32()), (held, pa.list_(pa.int64())), (before, pa.int64()), (n, pa.int64()), (grammar, pa.binary()))
            names = ["part", "shard", "doc_ids", "before", "n_ids", "grammar"]
            return pa.RecordBatch.from_arrays([pa.array([v], kind) for v, kind in values], names=names)

        for some in gathered(batches, TOGETHER):
            flat, sizes = encoder.encode(some["text"], end_id)
            for doc, got in zip(some["doc_id"].to_pylist(), np.split(flat, np.cumsum(sizes)[:-1]), strict=True):
                if held and n + len(got) > shard_ids:
                    yield row()
                    shard, before, held, ids, n = shard + 1, before + n, [], [], 0
                held.append(doc)
                ids.append(got)
                n += len(got)
        if held:
            yield row()

    spark = docs.sparkSession
    bounded(spark)
    # tasks by the bytes of all texts, so that none grows with the corpus; copies of a row are dealt out by where they are read
    bytes_ = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    tasks = max(spark.sparkContext.defaultParallelism, -(-bytes_ // TASK_BYTES))
    rows = keyed(docs).withColumn("copy", F.monotonically_increasing_id())
    ordered = rows.repartitionByRange(tasks, "doc_id", "key", "copy").sortWithinPartitions("doc_id", "key").select("doc_id", "text")
    ordered.mapInArrow(run, SHARDS).write.parquet(path)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """The shards with `start`, the ids of all shards before. Sums over parts go through one task: a row for each task that wrote, no more."""
    from pyspark.sql import Window

    shards = spark.read.schema(SHARDS).parquet(path)
    parts = shards.groupBy("part").agg(F.sum("n_ids").alias("n"))
    starts = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("part_start"))
    return shards.join(starts, "part").withColumn("start", F.col("part_start") + F.col("before")).drop("part_start")


def documents_of(shards: DataFrame, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids) of every stored document, decoded from the grammars; the checksum is of the ids as little-endian
    unsigned 32-bit integers. Without with_ids, the ids themselves don't leave the workers."""
    from forumetry.llm.digests import list_array

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            shard = Shard(batch["grammar"][0].as_py())
            ids = shard.decode().astype("<u4")
            ends = np.cumsum(shard.lengths)
            flat = memoryview(ids).cast("B")
            sums = [zlib.crc32(flat[4 * a : 4 * b]) for a, b in zip((ends - shard.lengths).tolist(), ends.tolist(), strict=True)]
            columns = {"doc_id": batch["doc_ids"][0].values, "start": pa.array(batch["start"][0].as_py() + ends - shard.lengths), "n_tokens": pa.array(shard.lengths), "ids_crc32": pa.array(sums, pa.int64())}
            if with_ids:
                columns["ids"] = list_array(ids.astype(np.int32), shard.lengths)
            yield pa.RecordBatch.from_arrays([*columns.values()], names=[*columns])

    kind = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    return shards.select("start", "doc_ids", "grammar").mapInArrow(run, kind)


def op1_repair_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from forumetry.llm.common import scratch

    path = scratch(spark, "token-shards")
    write_shards(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return documents_of(read_shards(spark, path), with_ids=False)
