"""Operator 3, byte-level BPE: encodes texts to ids by a file of ranks, and decodes ids to bytes.

A pattern splits the text; each distinct piece is encoded once. Pieces are bucketed by length into padded matrices, one row a piece. In each
round every row merges its leftmost pair of least rank, found by looking all pairs up in an open-addressing hash table, and is compacted; rows
without a pair leave the matrix. A piece of over LONGEST bytes, where rounds would cost the square of its length, merges in the same order by
a heap.

Cases: a null or empty text has no ids; a text of any length is read whole; equal texts have equal ids, and repeated rows each their own; an
empty table gives no rows; every input column stays, but one named like a result is replaced.
"""

from __future__ import annotations

import base64
import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from forumetry.llm.common import add_columns, keyed, table
from forumetry.llm.digests import ids_sha256, list_array

LONGEST = 256
#: Pieces whose ids a worker keeps at once; then it forgets them all.
MEMO = 150_000
#: Rows of one matrix at most.
ROWS = 1 << 15


class PairTable:
    """Rank of the merge of two ids, or NONE. Open addressing with linear probing over a power of two of slots."""

    NONE = np.int32(2**31 - 1)
    FACTOR = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, keys: np.ndarray, ranks: np.ndarray):
        self.bits = max(4, int(len(keys) * 3).bit_length())
        self.mask = (1 << self.bits) - 1
        self.keys, self.ranks = np.full(self.mask + 1, -1, np.int64), np.full(self.mask + 1, self.NONE, np.int32)
        slot, todo = self.slot(keys), np.arange(len(keys))
        while len(todo):
            free = self.keys[slot[todo]] < 0
            spots, first = np.unique(slot[todo[free]], return_index=True)
            won = todo[free][first]
            self.keys[spots], self.ranks[spots] = keys[won], ranks[won]
            todo = todo[~np.isin(todo, won)]
            slot[todo] = slot[todo] + 1 & self.mask

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * self.FACTOR >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """For ids, negative ones being padding, of any one shape."""
        keys = left.astype(np.int64) << 32 | right.astype(np.int64)
        keys[(left < 0) | (right < 0)] = -2
        flat = keys.ravel()
        out = np.full(len(flat), self.NONE, np.int32)
        todo = np.flatnonzero(flat >= 0)
        want = flat[todo]
        slot = self.slot(want)
        while len(todo):
            found = self.keys[slot]
            hit = found == want
            out[todo[hit]] = self.ranks[slot[hit]]
            on = ~hit & (found >= 0)
            todo, want, slot = todo[on], want[on], slot[on] + 1 & self.mask
        return out.reshape(keys.shape)


class ByteBpe:
    def __init__(self, path: str, pattern: str):
        import regex

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.split = regex.compile(pattern).findall
        self.bytes_to_id = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.whole = ranks
        keys, merged = [], []
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                if (a := ranks.get(token[:k])) is not None and (b := ranks.get(token[k:])) is not None:
                    keys.append(a << 32 | b)
                    merged.append(rank)
        self.pairs = PairTable(np.array(keys, np.int64), np.array(merged, np.int32))
        tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            tokens[rank] = token
        self.tokens = tokens
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)
        self.sizes = np.array(list(map(len, tokens)), np.int64)
        self.begins = np.cumsum(self.sizes) - self.sizes
        self.memo: dict[str, bytes] = {}

    def merge_matrix(self, grid: np.ndarray) -> list[np.ndarray]:
        """Ids of each row of a matrix of byte ids, padded with -1 on the right."""
        out: list[np.ndarray | None] = [None] * len(grid)
        rows = np.arange(len(grid))
        ranks = self.pairs.get(grid[:, :-1], grid[:, 1:])
        while len(rows):
            at = ranks.argmin(axis=1) if ranks.shape[1] else np.zeros(len(rows), np.int64)
            least = ranks[np.arange(len(rows)), at] if ranks.shape[1] else np.full(len(rows), PairTable.NONE)
            done = least == PairTable.NONE
            for k in np.flatnonzero(done):
                row = grid[k]
                out[rows[k]] = row[row >= 0]
            grid, ranks, rows, at, least = grid[~done], ranks[~done], rows[~done], at[~done], least[~done]
            if not len(rows):
                break
            n = np.arange(len(rows))
            grid[n, at] = least
            # compaction: what stands right of the merged pair moves one place to the left
            column = np.arange(grid.shape[1] - 1)
            grid = np.take_along_axis(grid, column + (column > at[:, None]), axis=1)
            if ranks.shape[1] == 1:
                ranks = ranks[:, :0]
                continue
            column = np.arange(ranks.shape[1] - 1)
            ranks = np.take_along_axis(ranks, column + (column >= at[:, None]), axis=1)
            width = grid.shape[1]
            for place, inside in ((at - 1, at > 0), (at, at < width - 1)):  # only the two pairs with the new id changed
                ranks[n[inside], place[inside]] = self.pairs.get(grid[n[inside], place[inside]], grid[n[inside], place[inside] + 1])
        return out  # type: ignore[return-value]

    def merge_long(self, piece: bytes) -> np.ndarray:
        """The same merges of one long piece: a heap of (rank, place) over a linked list."""
        ids = self.bytes_to_id[np.frombuffer(piece, np.uint8)].tolist()
        n, tokens, whole = len(ids), self.tokens, self.whole
        rank_of = lambda a, b: whole.get(tokens[a] + tokens[b])
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(r, i) for i in range(n - 1) if (r := rank_of(ids[i], ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i] if ids[i] >= 0 else -1
            if j < 0 or rank_of(ids[i], ids[j]) != rank:
                continue
            ids[i], ids[j], after[i] = rank, -1, after[j]
            if after[i] >= 0:
                before[after[i]] = i
                if (r := rank_of(rank, ids[after[i]])) is not None:
                    heapq.heappush(heap, (r, i))
            if before[i] >= 0 and (r := rank_of(ids[before[i]], rank)) is not None:
                heapq.heappush(heap, (r, before[i]))
        return np.array([x for x in ids if x >= 0], np.int32)

    def encode_pieces(self, pieces: list[bytes]) -> list[np.ndarray]:
        out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(pieces)
        buckets: dict[int, list[int]] = {}
        for k, piece in enumerate(pieces):
            if (rank := self.whole.get(piece)) is not None:
                out[k] = np.array([rank], np.int32)
            elif len(piece) > LONGEST:
                out[k] = self.merge_long(piece)
            elif piece:
                size = len(piece)
                width = -(-size // 2) * 2 if size <= 16 else -(-size // 16) * 16
                buckets.setdefault(width, []).append(k)
        for width, members in buckets.items():
            step = max(1, min(ROWS, (1 << 21) // width))
            for a in range(0, len(members), step):
                some = members[a : a + step]
                sizes = np.array([len(pieces[k]) for k in some])
                grid = np.full((len(some), width), -1, np.int32)
                grid[np.arange(width) < sizes[:, None]] = self.bytes_to_id[np.frombuffer(b"".join(pieces[k] for k in some), np.uint8)]
                for k, ids in zip(some, self.merge_matrix(grid), strict=True):
                    out[k] = ids
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """32-bit ids of each text, as bytes."""
        split = [self.split(x) for x in texts]
        if len(self.memo) > MEMO:
            self.memo.clear()
        new = list(set().union(*split).difference(self.memo)) if split else []
        for piece, ids in zip(new, self.encode_pieces([x.encode("utf-8", "replace") for x in new]), strict=True):
            self.memo[piece] = ids.tobytes()
        get = self.memo.__getitem__
        return [b"".join(map(get, x)) for x in split]

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of ids."""
        n = self.sizes[ids]
        step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        return self.flat[np.repeat(self.begins[ids], n) + step]


_CODECS: dict[tuple[str, str], ByteBpe] = {}


def codec(path: str, pattern: str) -> ByteBpe:
    """One a worker process."""
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = ByteBpe(path, pattern)
    return _CODECS[path, pattern]


def _encoded(column: pa.Array, bpe: ByteBpe) -> pa.ListArray:
    got = bpe.encode([x or "" for x in column.to_pylist()])
    return list_array(np.frombuffer(b"".join(got), np.int32), np.array([len(x) // 4 for x in got], np.int64))


def _decoded(column: pa.ListArray, bpe: ByteBpe) -> pa.Array:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    sizes = column.value_lengths().fill_null(0).to_numpy()
    ends = np.concatenate(([0], np.cumsum(bpe.sizes[flat])))[np.concatenate(([0], np.cumsum(sizes)))]
    return pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(bpe.decode(flat))]).cast(pa.binary())


def encode_column(df: DataFrame, path: str, pattern: str, text: str = "text", out: str = "ids") -> DataFrame:
    """df with a column of ids, array<int>."""
    return add_columns(df, lambda batch: {out: _encoded(batch[text], codec(path, pattern))}, {out: "array<int>"})


def decode_column(df: DataFrame, path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """df with a binary column of the bytes that the ids stand for."""
    return add_columns(df, lambda batch: {out: _decoded(batch[ids], codec(path, pattern))}, {out: "binary"})


def with_byte_bpe(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """docs with `ids` and `decoded`, in one pass: two would keep two Python workers with a vocabulary each for every task."""

    def make(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        ids = _encoded(batch["text"], codec(path, pattern))
        return {"ids": ids, "decoded": _decoded(ids, codec(path, pattern))}

    return add_columns(docs, make, {"ids": "array<int>", "decoded": "binary"})


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    done = with_byte_bpe(keyed(table(spark, sf_dir, "documents")).select("doc_id", "text"), path, pattern)
    return done.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), ids_sha256("ids").alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
