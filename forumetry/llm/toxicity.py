"""Operator 7, toxicity: a counterfactually regularised linear classifier.

A document's features are the words it has and their beginnings. The features that tell the labels apart best are chosen by likelihood ratio
over the labelled sample, and their weights learnt by accelerated proximal gradient steps on logistic loss with an L1 penalty. For every
labelled document with identity terms, swapped versions of it (each term replaced by the others of its group, one after the other) add the
squared change of its margin to the loss, so that which group a text mentions does not move its score.

The terms are IDENTITY, or other groups that are given, and `slot_groups`: words of the sample itself that stand between the same neighbours and
so could take each other's place, but are found with label 1 unequally often, although most of their mentions aren't. `mention_rates` tells
how often neutral mentions of each term are called toxic.

Cases: null and empty texts score as texts without features; equal texts score alike; a text of any length is read whole; without labels, or with
labels of one kind, the score is the smoothed share of ones; an empty table gives no rows; every input column stays, but one named like a result
is replaced.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from forumetry.llm import labelled
from forumetry.llm.common import add_columns, saved, table

#: Labelled documents that the weights are learnt from at most, and features chosen at most.
LABELS, FEATURES = 20_000, 4_000
#: Likelihood ratio that a feature must have to be chosen.
LEAST_RATIO = 5.0
#: Score from which a document counts as toxic.
TOXIC = 0.7
#: Lengths of a word's beginnings, and bits of a feature's hash.
BEGINNINGS, HASH_BITS = (4, 5, 6), 24
#: Identity terms, by group. Swaps stay within a group.
IDENTITY = (
    ("women", "men", "girls", "boys"), ("woman", "man", "girl", "boy"), ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"), ("gay", "straight", "lesbian", "bisexual", "transgender"), ("black", "white", "asian", "latino"),
    ("immigrants", "refugees", "locals", "citizens"), ("femmes", "hommes"), ("chrétiens", "musulmans", "juifs"), ("frauen", "männer"), ("christen", "muslime", "juden"),
    ("mujeres", "hombres"), ("cristianos", "musulmanes", "judíos"),
)
#: Words of a slot: share of the sampled rows that must have them, how many at most (the most frequent), and in a group.
SLOT_SHARE, SLOT_WORDS, SLOT_SIZE = 0.05, 200, 4
#: Cosine that the counts of two words' neighbours must have for one slot; share of the rows that have a word at most; groups at most, those whose
#: words' shares of rows labelled 1 differ most, and the likelihood ratio by which they must differ.
SLOT_COSINE, SLOT_COMMON, SLOT_GROUPS, SLOT_SHIFT = 0.8, 0.5, 20, 1.0
MEMO = 500_000
words_of = re.compile(r"\w+").findall


def word_features(word: str) -> list[int]:
    """Hashes of a lower-case word and of its beginnings."""
    shift = 64 - HASH_BITS
    return [xxhash.xxh64_intdigest("=" + word) >> shift, *(xxhash.xxh64_intdigest("^" + word[:n]) >> shift for n in BEGINNINGS if len(word) >= n)]


def features(text: str) -> set[int]:
    """Hashes of all features of a text."""
    return {f for word in set(words_of(text.lower())) for f in word_features(word)}


def swaps(text: str, groups=IDENTITY) -> list[str]:
    """Versions of a text with all its identity terms replaced by the next of their group, then by the next but one, and so on; none if it has no terms."""
    place = {term: (group, k) for group in groups for k, term in enumerate(group)}
    lower = text.lower()
    present = [place[w] for w in set(words_of(lower)) if w in place]
    if not present:
        return []
    pattern = re.compile(r"\b(?:" + "|".join(sorted({g[k] for g, k in present})) + r")\b")
    turn = lambda by: lambda m: (lambda g, k: g[(k + by) % len(g)])(*place[m[0]])
    return [pattern.sub(turn(by), lower) for by in range(1, max(len(g) for g, _ in present))]


def swap_changes(text: str, place: dict[str, tuple[tuple[str, ...], int]]) -> tuple[list[int], list[list[int]], list[list[int]]]:
    """Features of a text, and those that each of its `swaps` adds and takes; place: group and place in it of each term."""
    of_word = {w: word_features(w) for w in set(words_of(text.lower()))}
    counts = Counter(f for fs in of_word.values() for f in fs)
    present, gained, lost = [w for w in of_word if w in place], [], []
    for by in range(1, max((len(place[w][0]) for w in present), default=1)):
        new = {g[(k + by) % len(g)] for g, k in map(place.__getitem__, present)}
        change: Counter[int] = Counter(f for w in new if w not in of_word for f in word_features(w))
        change.subtract(f for w in present if w not in new for f in of_word[w])
        gained.append(sorted(f for f, c in change.items() if c > 0 and f not in counts))
        lost.append(sorted(f for f, c in change.items() if f in counts and counts[f] + c <= 0))
    return sorted(counts), gained, lost


def slot_groups(rows: DataFrame, share: float = SLOT_SHARE, most: int = SLOT_WORDS, size: int = SLOT_SIZE, cosine: float = SLOT_COSINE) -> tuple[tuple[str, ...], ...]:
    """Groups of up to `size` words that stand between the same neighbours in rows (label, text), but are found with label 1 unequally often: which one
    of them a text names tells of its label, although any could stand there. Most unequal ones first.

    Counted on Spark; the driver gets at most `most` words and the counts of `most` squared pairs. Neighbours are words that so great a share of the
    rows has; of these a group has no words of more than SLOT_COMMON of the rows (the words of grammar), and none most of whose rows are labelled 1:
    a word that is mostly found in them may be what the label means.
    """
    listed = rows.select("label", F.regexp_extract_all(F.lower("text"), F.lit(r"(?U)\w+"), F.lit(0)).alias("w"))
    n = rows.count()
    has = listed.select("label", F.explode(F.array_distinct("w")).alias("word")).groupBy("word").agg(F.count("*").alias("k"), F.avg("label").alias("ones"))
    few = has.where((F.length("word") > 1) & (F.col("k") >= max(3, share * n))).orderBy(F.desc("k"), "word").limit(most).collect()
    words, rates = [r.word for r in few], {r.word: (r.k, r.k * r.ones) for r in few}
    if len(words) < 2:
        return ()
    known = F.broadcast(rows.sparkSession.createDataFrame([(w,) for w in words], "word string"))
    pairs = listed.select(F.explode(F.arrays_zip(F.col("w").alias("a"), F.slice("w", F.lit(2), F.greatest(F.size("w"), F.lit(1))).alias("b"))).alias("p")).select("p.a", "p.b")
    met = pairs.join(known.withColumnRenamed("word", "a"), "a", "left_semi").join(known.withColumnRenamed("word", "b"), "b", "left_semi").groupBy("a", "b").count()
    place, counts = {w: k for k, w in enumerate(words)}, np.zeros((len(words), len(words)))
    for r in met.collect():
        counts[place[r.a], place[r.b]] = r["count"]
    beside = np.concatenate((counts, counts.T), axis=1)
    beside /= np.maximum(np.sqrt((beside**2).sum(axis=1, keepdims=True)), 1e-9)
    like = beside @ beside.T
    left, groups = [k for k, r in enumerate(few) if r.k <= SLOT_COMMON * n and r.ones <= 0.5], []
    while left:
        first = left.pop(0)
        near = sorted((k for k in left if like[first, k] >= cosine), key=lambda k: (-like[first, k], k))[: size - 1]
        if near:
            groups.append(tuple(words[k] for k in (first, *near)))
            left = [k for k in left if k not in near]
    shifts = sorted(((label_shift([rates[w] for w in g]), g) for g in groups), key=lambda x: (-x[0], x[1]))
    return tuple(g for shift, g in shifts[:SLOT_GROUPS] if shift >= SLOT_SHIFT)


def label_shift(counts: list[tuple[float, float]]) -> float:
    """Likelihood ratio by which the shares of ones differ between (rows, ones) of several words: 0 if all are equal."""
    rows, ones = (sum(x) for x in zip(*counts, strict=True))
    term = lambda o, e: o * float(np.log(o / e)) if o > 0 else 0.0
    return 2 * sum(term(a, n * ones / rows) + term(n - a, n * (rows - ones) / rows) for n, a in counts)


def mention_rates(scored: DataFrame, groups=IDENTITY, text: str = "text") -> DataFrame:
    """(term, n, flagged): of rows (text, score) that aren't toxic, how many name a term, and the share of these that the score calls toxic. Texts are
    read once and counted by term, of which there are as many as are given."""
    terms = sorted({t for g in groups for t in g})
    named = F.array_intersect(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"(?U)\w+"), F.lit(0)), F.array(*map(F.lit, terms)))
    each = scored.select(F.explode(named).alias("term"), (F.col("score") >= TOXIC).cast("double").alias("flag"))
    return each.groupBy("term").agg(F.count("*").alias("n"), F.avg("flag").alias("flagged"))


@dataclass
class Linear:
    """Weights of chosen features; a document's margin is the sum over those it has."""

    chosen: np.ndarray
    weights: np.ndarray
    bias: float
    _index: dict = field(default_factory=dict, repr=False)
    _memo: dict = field(default_factory=dict, repr=False)

    def margin(self, text: str) -> float:
        if not self._index:
            self._index.update({int(f): w for f, w in zip(self.chosen, self.weights, strict=True) if w})
        if len(self._memo) > MEMO:
            self._memo.clear()
        index, memo, has = self._index, self._memo, set()
        for run in set(text.lower().split()):
            found = memo.get(run)
            if found is None:
                found = memo[run] = tuple(f for w in words_of(run) for f in word_features(w) if f in index)
            if found:
                has.update(found)
        return self.bias + sum(sorted(index[f] for f in has))

    def score(self, text: str) -> float:
        return float(1 / (1 + np.exp(-self.margin(text))))


@dataclass
class Rows:
    """Sparse 0/1 rows."""

    index: np.ndarray
    ends: np.ndarray

    @staticmethod
    def of(lists: list[np.ndarray]) -> Rows:
        return Rows(np.concatenate([*lists, np.zeros(0, np.int64)]).astype(np.int64), np.cumsum([len(x) for x in lists], dtype=np.int64))

    @staticmethod
    def from_lists(lists: pa.ChunkedArray) -> Rows:
        sizes = pc.list_value_length(lists).to_numpy().astype(np.int64)
        return Rows(pc.list_flatten(lists).to_numpy().astype(np.int64), np.cumsum(sizes))

    def sizes(self) -> np.ndarray:
        return np.diff(self.ends, prepend=0)

    def dot(self, weights: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0.0], np.cumsum(weights[self.index])))
        return np.diff(sums[np.concatenate(([0], self.ends))])

    def back(self, values: np.ndarray, n: int) -> np.ndarray:
        return np.bincount(self.index, np.repeat(values, self.sizes()), n)


def fit(x: Rows, y: np.ndarray, gained: Rows, lost: Rows, n: int, swap_penalty: float = 1.0, l1: float = 1e-4, l2: float = 1e-5, steps: int = 400) -> tuple[np.ndarray, float]:
    """Weights and bias. gained and lost: features that a swap adds to or takes from a row, a row a swap.

    Each weight has a step of its own, from a diagonal bound of the second derivatives: a row's size, summed over the rows with the feature.
    """
    prior = (y.sum() + 1) / (len(y) + 2)
    bias = float(np.log(prior / (1 - prior)))
    w = np.zeros(n)
    if not len(y) or y.min() == y.max() or not n:
        return w, bias
    m = max(1, len(gained.ends))
    bound = 0.25 * x.back(x.sizes() + 1.0, n) / len(y) + l2
    moved = gained.sizes() + lost.sizes()
    bound += 2 * swap_penalty / m * (gained.back(moved * 1.0, n) + lost.back(moved * 1.0, n))
    step, bias_step = 1 / bound, 4 / (1 + float(x.sizes().mean()))
    look, look_bias, t = w, bias, 1.0
    for _ in range(steps):
        r = (1 / (1 + np.exp(-(x.dot(look) + look_bias))) - y) / len(y)
        change = 2 * swap_penalty / m * (gained.dot(look) - lost.dot(look))
        gradient = x.back(r, n) + l2 * look + gained.back(change, n) - lost.back(change, n)
        new = look - step * gradient
        new = np.sign(new) * np.maximum(np.abs(new) - step * l1, 0)
        new_bias = look_bias - bias_step * float(r.sum())
        if float(np.dot((look - new) * bound, new - w)) + (look_bias - new_bias) * (new_bias - bias) / bias_step > 0:
            t = 1.0  # the momentum led astray
        fresh = (1 + (1 + 4 * t * t) ** 0.5) / 2
        look, look_bias = new + (t - 1) / fresh * (new - w), new_bias + (t - 1) / fresh * (new_bias - bias)
        w, bias, t = new, new_bias, fresh
    return w, bias


def learn(
    docs: DataFrame, labels: DataFrame, label: str = "toxic", held: Column | None = None, most: int = LABELS, top: int = FEATURES, groups=IDENTITY,
    swap_penalty: float = 1.0, slots: bool = True,
) -> Linear:
    """The classifier, from a bounded sample. Features are counted on Spark; the chosen ones of at most `most` documents come to the driver.
    Swapped terms are `groups` and, with `slots`, also the sample's own."""

    def lists(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        place = {term: (group, k) for group in groups for k, term in enumerate(group)}
        made = [swap_changes(t, place) for t in batch["text"].to_pylist()]
        kinds = (pa.list_(pa.int32()), *[pa.list_(pa.list_(pa.int32()))] * 2)
        return {c: pa.array([x[k] for x in made], kind) for k, (c, kind) in enumerate(zip(changes, kinds, strict=True))}

    changes = {"has": "array<int>", "gained": "array<array<int>>", "lost": "array<array<int>>"}
    rows = labelled.sample(docs, labels, label, F.lit(False) if held is None else held, most)
    if slots:
        rows = saved(rows, "toxicity-sample")
        listed = {term for group in groups for term in group}
        found = (tuple(w for w in group if w not in listed) for group in slot_groups(rows))
        groups = (*groups, *(group for group in found if len(group) > 1))
    # in an order of the texts, since that of the rows must not change the weights
    rows = saved(add_columns(rows.withColumn("at", F.xxhash64("text")), lists, changes).select("at", "label", *changes), "toxicity-features")
    n, ones = rows.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    counts = rows.select("label", F.explode("has").alias("f")).groupBy("f").agg(F.sum("label").cast("double").alias("a"), F.count("*").cast("double").alias("k")).where("k >= 3")
    # likelihood ratio of the 2 x 2 table of feature and label
    term = lambda o, e: F.when(o > 0, o * F.log(o / e)).otherwise(0.0)
    a, k, p = F.col("a"), F.col("k"), ones / max(1, n)
    ratio = term(a, k * p) + term(k - a, k * (1 - p)) + term(ones - a, (n - k) * p) + term(n - k - (ones - a), (n - k) * (1 - p))
    few = counts.where(F.lit(0 < ones < n)).select("f", ratio.alias("r")).where(F.col("r") >= LEAST_RATIO).orderBy(F.desc("r"), "f").limit(top)
    # the features of swapped terms are learnt whatever their ratio, so that the penalty has their weights to even out
    terms = [f for group in groups for term in group for f in word_features(term)]
    chosen = np.union1d(few.toArrow()["f"].to_numpy(), np.array(terms)).astype(np.int64) if 0 < ones < n else np.zeros(0, np.int64)

    def pick(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        return {c: places(batch[f"all_{c}"]) for c in changes}

    def places(lists: pa.ListArray) -> pa.Array:
        """Feature hashes as places among the chosen ones; others go."""
        if not pa.types.is_integer(lists.type.value_type):
            return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy()))).astype(np.int32)), places(lists.flatten()))
        found = lists.flatten().to_numpy().astype(np.int64)
        at = np.minimum(np.searchsorted(chosen, found), max(0, len(chosen) - 1))
        hit = chosen[at] == found if len(chosen) else np.zeros(len(found), bool)
        ends = np.concatenate(([0], np.cumsum(hit)))[np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy())))]
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(at[hit].astype(np.int32)))

    got = add_columns(rows.withColumnsRenamed({c: f"all_{c}" for c in changes}), pick, changes).select("at", "label", *changes).orderBy("at", "label").toArrow()
    x, gained, lost = Rows.from_lists(got["has"]), *(Rows.from_lists(pc.list_flatten(got[c])) for c in ("gained", "lost"))
    y = got["label"].to_numpy().astype(np.float64)
    weights, bias = fit(x, y, gained, lost, len(chosen), swap_penalty)
    return Linear(chosen, weights, bias)


def score(docs: DataFrame, model: Linear, text: str = "text") -> DataFrame:
    """docs with `score`."""
    return add_columns(docs, lambda batch: {"score": pa.array([model.score(t or "") for t in batch[text].to_pylist()], pa.float64())}, {"score": "double"})


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = table(spark, sf_dir, "documents").select("doc_id", "text"), labelled.held_out(3, 1)
    model = learn(docs, table(spark, sf_dir, "labels"), "toxic", held)
    return score(docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= TOXIC).cast("int").alias("predicted"))
