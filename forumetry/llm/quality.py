"""Operator 9, quality classifier: histogram gradient-boosted trees over statistics of documents.

Statistics are binned by quantiles; each tree grows level by level, by sums of gradients and hessians over the histogram bins of its nodes.
All trees are then flattened into arrays of features, thresholds, children and leaf values, which numpy walks for all rows and trees at once.

Cases: null and empty texts have statistics of zero and are scored like others; equal texts score alike; a text of any length is read whole;
without labels, or with labels of one kind, the score is the smoothed share of ones; an empty table gives no rows; every input column stays, but
one named like the result is replaced.
"""

from __future__ import annotations

import operator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from forumetry.llm import labelled
from forumetry.llm.common import add_columns, fresh, table

#: Labelled documents that the trees learn from at most.
LABELS = 20_000
#: Score from which a document is kept.
KEEP = 0.3

STATISTICS = (
    "log_bytes", "log_words", "log_lines", "upper", "lower", "digit", "blank", "newline", "stop", "comma", "other_ascii", "beyond_ascii", "entropy", "top_byte",
    "word_bytes", "distinct_words", "repeated_words", "log_longest_word", "distinct_lines", "words_a_line", "words_a_stop", "capital_words", "one_letter_words",
)
_KIND = np.zeros(256, np.int64)
for _k, _set in enumerate((range(65, 91), range(97, 123), range(48, 58), (32, 9), (10, 13), b".!?", b",;:", range(128, 256)), start=1):
    _KIND[list(_set)] = _k


def statistics(text: str) -> list[float]:
    """The STATISTICS of a whole text; zeros for an empty one."""
    data = text.encode("utf-8", "replace")
    if not data:
        return [0.0] * len(STATISTICS)
    n = len(data)
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    other, upper, lower, digit, blank, newline, stop, comma, beyond = np.bincount(_KIND, counts, 9).tolist()
    share = counts[counts > 0] / n
    words, lines = text.split(), text.split("\n")
    w = max(1, len(words))
    return [
        np.log1p(n), np.log1p(len(words)), np.log1p(len(lines)), upper / n, lower / n, digit / n, blank / n, newline / n, stop / n, comma / n, other / n, beyond / n,
        float(-(share * np.log2(share)).sum()), float(share.max()), n / w, len(set(words)) / w, sum(map(operator.eq, words, words[1:])) / w,
        np.log1p(max(map(len, words), default=0)), len(set(lines)) / len(lines), len(words) / len(lines), len(words) / (stop + 1),
        sum(map(str.isupper, words)) / w, sum(1 for x in words if len(x) == 1) / w,
    ]


@dataclass
class Trees:
    """Flattened trees. A leaf's children are itself, so every row may take the same number of steps."""

    feature: np.ndarray
    threshold: np.ndarray
    child: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def margins(self, x: np.ndarray) -> np.ndarray:
        node = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        row = np.arange(len(x))[:, None]
        for _ in range(self.depth if len(self.roots) else 0):
            node = self.child[node, (x[row, self.feature[node]] > self.threshold[node]).astype(np.int64)]
        return self.base + self.value[node].sum(axis=1)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margins(x)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, bins: int = 64, rate: float = 0.2, least_rows: int = 10, ridge: float = 1.0) -> Trees:
    """Trees of log-odds of y (0 or 1) by boosting with logistic loss."""
    prior = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(prior / (1 - prior)))
    empty = np.zeros(0, np.int64)
    if len(y) < 2 * least_rows or y.min() == y.max():
        return Trees(empty, np.zeros(0), np.zeros((0, 2), np.int64), np.zeros(0), empty, 0, base)
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)  # bin b: over edges[b - 1], up to edges[b]
    width = x.shape[1] * bins
    cell = binned + np.arange(x.shape[1]) * bins
    features, thresholds, children, values, roots = [], [], [], [], []
    margin = np.full(len(y), base)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        roots.append(len(features))
        level = [len(features)]
        features.append(0), thresholds.append(np.inf), children.append([level[0]] * 2), values.append(0.0)
        place = np.zeros(len(y), np.int64)  # of a row, within the level
        at = np.full(len(y), level[0])
        live = np.ones(len(y), bool)
        for d in range(depth + 1):
            k, rows = len(level), np.flatnonzero(live)
            if not k or not len(rows):
                break
            total_g, total_h = np.bincount(place[rows], g[rows], k), np.bincount(place[rows], h[rows], k)
            for j, node in enumerate(level):
                values[node] = float(-rate * total_g[j] / (total_h[j] + ridge))
            if d == depth:
                break
            index = (place[rows, None] * width + cell[rows]).ravel()
            shape = (k, x.shape[1], bins)
            left_g, left_h, left_n = (np.cumsum(np.bincount(index, w, k * width).reshape(shape), axis=2) for w in (np.repeat(g[rows], x.shape[1]), np.repeat(h[rows], x.shape[1]), None))
            all_g, all_h, all_n = total_g[:, None, None], total_h[:, None, None], np.bincount(place[rows], minlength=k)[:, None, None]
            gain = left_g**2 / (left_h + ridge) + (all_g - left_g) ** 2 / (all_h - left_h + ridge) - all_g**2 / (all_h + ridge)
            gain[(left_n < least_rows) | (all_n - left_n < least_rows)] = -1
            best = gain.reshape(k, -1).argmax(axis=1)
            split = gain.reshape(k, -1)[np.arange(k), best] > 1e-6
            f, b = np.divmod(best, bins)
            fresh, to = [], np.full((k, 2), -1)
            for j in np.flatnonzero(split):
                node = level[j]
                features[node], thresholds[node] = int(f[j]), float(edges[f[j]][b[j]])
                for side in (0, 1):
                    to[j, side] = len(fresh)
                    fresh.append(len(features))
                    features.append(0), thresholds.append(np.inf), children.append([fresh[-1]] * 2), values.append(0.0)
                children[node] = fresh[-2:]
            live[rows] = split[place[rows]]
            rows = np.flatnonzero(live)
            right = (binned[rows, f[place[rows]]] > b[place[rows]]).astype(np.int64)
            place[rows] = to[place[rows], right]
            level = fresh
            if len(rows):
                at[rows] = np.array(fresh)[place[rows]]
        margin += np.array(values)[at]
    return Trees(np.array(features), np.array(thresholds), np.array(children), np.array(values), np.array(roots), depth, base)


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", held=None, most: int = LABELS) -> Trees:
    """Trees from a bounded sample: only its statistics, at most `most` rows of them, come to the driver."""

    def make(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        return {"statistics": pa.array([statistics(x) for x in batch["text"].to_pylist()], pa.list_(pa.float64()))}

    rows = labelled.sample(docs, labels, label, F.lit(False) if held is None else held, most)
    got = add_columns(rows, make, {"statistics": "array<double>"}).select("statistics", "label").toArrow()
    y = got["label"].to_numpy().astype(np.float64)
    x = got["statistics"].combine_chunks().flatten().to_numpy().reshape(-1, len(STATISTICS))
    order = np.lexsort((*x.T, y))  # the order of rows must not change the trees
    return fit(x[order], y[order])


def score(docs: DataFrame, trees: Trees, text: str = "text", out: str = "score") -> DataFrame:
    """docs with their score in the column `out`."""

    def make(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        x = np.array([statistics(t or "") for t in batch[text].to_pylist()]).reshape(-1, len(STATISTICS))
        return {out: pa.array(trees.scores(x), pa.float64())}

    return add_columns(docs, make, {out: "double"})


def held() -> Column:
    """The rows that are never learnt from."""
    return labelled.held_out(5, 0)


def op9_quality_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    trees = learn(docs, table(spark, sf_dir, "labels"), "quality", held())
    return score(docs, trees).select("doc_id", held().alias("held_out"), "score", (F.col("score") >= KEEP).cast("int").alias("predicted"))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents that the trees don't reject, with all their columns as they are, whatever their names.

    Null and empty texts are scored like others; repeated rows all stay or all go; an empty table stays empty.
    """
    trees = learn(docs, table(spark, sf_dir, "labels"), "quality", held())
    own = fresh("_score", docs.columns)
    return score(docs, trees, out=own).where(F.col(own) >= KEEP).drop(own)
