"""Operator 11, periodic runs of words: the maximal stretches in which a text repeats itself word by word.

`suffix_order` sorts the suffixes of many texts at once by prefix doubling and keeps the classes of every round; since a word's class differs
between texts, no suffix of one text equals any of another. `inner_nodes` finds the inner nodes of the suffix trees from the longest common
prefixes of neighbours. Then, after Stoye and Gusfield, each node tests the leaves of all its children but the largest: a leaf i and a leaf i + d
of a node of depth d begin a tandem repeat, which is branching if they hang from different children. Every leaf is tested O(log n) times. Rotating
a branching repeat to the left as far as it goes gives a run; repeats with equal ends are one run, of the least period.

Cases: null and empty texts have no words and no runs; a text of any length is read whole, and its arrays take about 200 bytes a word; equal texts
have equal runs; an empty table gives no rows; every other column stays, but one named like the result is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from forumetry.llm.common import map_batches, table

#: A run has at least this many words, and this many periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4
RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


@dataclass
class Order:
    """Suffixes of words[0:n] in sorted order. classes[k][i] is equal for suffixes that share 2 ** k words; classes[-1] is all different. Each
    class has one entry more than there are words, which equals no other."""

    suffix: np.ndarray
    rank: np.ndarray
    classes: list[np.ndarray]


def suffix_order(words: np.ndarray, end: np.ndarray) -> Order:
    """words: ids from 0, different between texts; end[i]: where the text of word i ends."""
    n = len(words)
    count = np.bincount(words, minlength=1)
    rank = np.append((np.cumsum(count) - count)[words], -1)
    classes = [rank]
    live = np.flatnonzero(count[words] > 1)
    width = 1
    while len(live):
        rank = rank.copy()
        after = live + width
        key = rank[live] * (n + 1) + np.where(after < end[live], classes[-1][np.minimum(after, n)] + 1, 0)
        order = np.argsort(key)
        live, key = live[order], key[order]
        old = rank[live]
        at = np.arange(len(live))
        new_group, old_group = np.append(True, key[1:] != key[:-1]), np.append(True, old[1:] != old[:-1])
        first = np.maximum.accumulate(np.where(new_group, at, 0))
        rank[live] = old + first - np.maximum.accumulate(np.where(old_group, at, 0))
        classes.append(rank)
        single = new_group & np.append(new_group[1:], True)
        live = live[~single]
        width *= 2
    suffix = np.empty(n, np.int64)
    suffix[rank[:n]] = np.arange(n)
    return Order(suffix, rank, classes)


def common_prefixes(order: Order) -> np.ndarray:
    """Words that suffix r shares with the one before it in sorted order; 0 for the first."""
    n = len(order.suffix)
    shared = np.zeros(n, np.int64)
    # pairs[k]: the neighbours that share 2 ** k words, fewer each round
    pairs, own = [], np.arange(1, n)
    for k, classes in enumerate(order.classes):
        own = own[classes[order.suffix[own - 1]] == classes[order.suffix[own]]]
        if not len(own):
            break
        pairs.append(own)
    for k in reversed(range(len(pairs))):
        r = pairs[k]
        have = shared[r]
        same = order.classes[k][order.suffix[r - 1] + have] == order.classes[k][order.suffix[r] + have]
        shared[r] = have + (same.astype(np.int64) << k)
    return shared


def inner_nodes(shared: np.ndarray) -> np.ndarray:
    """Rows (depth, first leaf, last leaf + 1, first leaf of the largest child, its leaves) of the nodes below the roots, leaves in sorted order."""
    inside = shared > 0
    at = np.flatnonzero(inside | np.append(False, inside[:-1]))  # a zero behind each stretch closes what is open
    found: list[int] = []
    add = found.extend
    depths, firsts, bigs, sizes = [0], [0], [0], [0]
    steps = list(zip(at.tolist(), shared[at].tolist(), strict=True))
    if inside.size and inside[-1]:
        steps.append((len(shared), 0))
    top = 0
    for r, depth in steps:
        child = r - 1  # the first leaf of the child that ends before leaf r
        while top > depth:
            first = firsts.pop()
            big, size = bigs.pop(), sizes.pop()
            if r - child > size:
                big, size = child, r - child
            add((depths.pop(), first, r, big, size))
            child = first
            top = depths[-1]
        if top < depth:
            depths.append(depth), firsts.append(child), bigs.append(child), sizes.append(r - child)
            top = depth
        elif depth and r - child > sizes[-1]:
            bigs[-1], sizes[-1] = child, r - child
    return np.array(found, np.int64).reshape(-1, 5)


def spread(begin: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges, and the range that each is of."""
    of = np.repeat(np.arange(len(begin)), length)
    return np.arange(len(of)) - np.repeat(np.cumsum(length) - length, length) + begin[of], of


def branching_repeats(words: np.ndarray, order: Order, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, period) of the tandem repeats that don't go on to the right."""
    depth, first, last, big, size = nodes.T
    leaf, node = spread(np.concatenate((first, big + size)), np.concatenate((big - first, last - big - size)))
    node %= max(1, len(nodes))
    n, i, d = len(words), order.suffix[leaf], depth[node]
    padded = np.append(words, -1)
    starts, periods = [], []
    for other, start in ((i + d, i), (i - d, i - d)):
        ok = (other >= 0) & (other < n)
        rank = order.rank[np.where(ok, other, n)]
        ok &= (rank >= first[node]) & (rank < last[node])
        start, period = start[ok], d[ok]
        ok = padded[start + period] != padded[np.minimum(start + 2 * period, n)]
        starts.append(start[ok]), periods.append(period[ok])
    pair = np.unique(np.concatenate(starts) * (n + 1) + np.concatenate(periods))
    return pair // (n + 1), pair % (n + 1)


def runs(words: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Rows (start, length, period) of all runs, by start, then period. words and end as for suffix_order."""
    if not len(words):
        return np.zeros((0, 3), np.int64)
    order = suffix_order(words, end)
    nodes = inner_nodes(common_prefixes(order))
    start, period = branching_repeats(words, order, nodes)
    more = np.maximum(LEAST_WORDS, LEAST_PERIODS * period) - 2 * period  # words by which a repeat must go on to the left
    left = np.zeros_like(start)
    near = (start > 0) & (words[start - 1] == words[start + period - 1])
    own = np.flatnonzero((more <= 0) | near)
    for k in reversed(range(len(order.classes))):
        at = start[own] - left[own] - (1 << k)
        classes = order.classes[k]
        same = (at >= 0) & (classes[np.maximum(at, 0)] == classes[np.maximum(at, 0) + period[own]])
        left[own[same]] += 1 << k
    own = own[left[own] >= more[own]]
    found = np.stack((start[own] - left[own], 2 * period[own] + left[own], period[own]), axis=1)
    found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
    found = found[np.append(True, (found[1:, :2] != found[:-1, :2]).any(axis=1))[: len(found)]]
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def word_ids(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the words of all texts, different between texts, and where the text of each word ends."""
    ids, ends, base, at = [], [], 0, 0
    for words in texts:
        known = dict.fromkeys(words)
        known = dict(zip(known, range(base, base + len(known)), strict=True))
        ids.append(np.fromiter(map(known.__getitem__, words), np.int64, len(words)))
        base += len(known)
        at += len(words)
        ends.append(np.full(len(words), at))
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *ids]), np.concatenate([none, *ends])


def collapse_batch(texts: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Runs of each text, and the texts without the words that repeat: kept words, joined by single blanks."""
    split = [(x or b"").split() for x in texts.cast(pa.binary()).to_pylist()]
    found = runs(*word_ids(split))
    bounds = np.cumsum([0, *map(len, split)])
    of = np.searchsorted(found[:, 0], bounds)
    # a word is dropped inside (start + period, start + length) of any run
    change = np.zeros(bounds[-1] + 1, np.int64)
    np.add.at(change, found[:, 0] + found[:, 2], 1)
    np.add.at(change, found[:, 0] + found[:, 1], -1)
    kept = np.cumsum(change)[:-1] == 0
    out = []
    for k, words in enumerate(split):
        if of[k] < of[k + 1]:
            words = [words[j] for j in np.flatnonzero(kept[bounds[k] : bounds[k + 1]])]
        out.append(b" ".join(words))
    start = found[:, 0] - bounds[np.searchsorted(bounds, found[:, 0], side="right") - 1] if len(found) else found[:, 0]
    items = pa.StructArray.from_arrays([pa.array(start), pa.array(found[:, 1]), pa.array(found[:, 2])], names=["start", "length", "period"])
    return pa.ListArray.from_arrays(pa.array(of.astype(np.int32)), items), pa.array(out, pa.binary()).view(pa.string())


def collapse(docs: DataFrame, text: str = "text", out: str = "runs") -> DataFrame:
    """docs with their runs in the column `out` and each text without the words that repeat in a run, but for a run's first period."""
    kept = docs.drop(out)
    place = kept.columns.index(text)
    schema = StructType([*kept.schema.fields, *StructType.fromDDL(f"`{out}` {RUNS}").fields])
    schema.fields[place] = StructField(schema.names[place], schema.fields[place].dataType, True)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        columns = list(batch.columns)
        found, columns[place] = collapse_batch(columns[place])
        return pa.RecordBatch.from_arrays([*columns, found], names=[*batch.schema.names, out])

    return map_batches(kept, run, schema)


def tiled(text: Column, doc_id: Column) -> Column:
    """text, which in a tenth of the documents repeats its own words from one of them on: the cases that the query plants."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def again(words: Column) -> Column:
        n = F.size(words)
        a = F.pmod(g, n).cast("int")
        p = (1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))).cast("int")
        return F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(words, F.when(i < a, i).otherwise(a + (i - a) % p))), " ")

    # the words are bound as the one item of a list: inside a lambda, an expression would be computed for each word
    words = F.array(F.regexp_extract_all(text, F.lit(r"[^ \t-\r]+"), 0))
    return F.when((h % 10 == 0) & text.rlike(r"[^ \t-\r]"), F.get(F.transform(words, again), F.lit(0))).otherwise(text)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = table(spark, sf_dir, "documents").select("doc_id", tiled(text, F.col("doc_id")).alias("text"))
    found = collapse(docs)
    # the greatest length, then the least start, then the least period
    best = F.element_at(F.array_sort(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p")))), 1)
    best = F.when(F.size("runs") > 0, best)
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    listed = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    return found.withColumn("_best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("_best.s").alias("start"), (-F.col("_best.l")).alias("length"),
        F.col("_best.p").alias("period"), F.floor(F.lit(-1000) * F.col("_best.l") / F.col("_best.p")).cast("long").alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("collapsed_sha256"),
    )
