import zlib

import numpy as np
import pytest

from forumetry.llm import quality, toxicity

from .helpers import documents, store

BIG = "/root/testdata/sf0.01"


def held(doc, modulo, remainder):
    return doc is None or zlib.crc32(str(doc).encode()) % modulo == remainder


def auc(rows):
    one, zero = np.array([s for s, y in rows if y == 1]), np.array([s for s, y in rows if y == 0])
    return np.mean([(one > z).mean() + (one == z).mean() / 2 for z in zero])


@pytest.mark.parametrize("query,column,modulo,remainder,cut,least", [(quality.op9_quality_trees, "quality", 5, 0, 0.3, 0.95), (toxicity.op7_toxicity, "toxic", 3, 1, 0.7, 0.85)])
def test_held_out_accuracy(spark, query, column, modulo, remainder, cut, least):
    labels = {r.doc_id: r[column] for r in spark.read.parquet(f"{BIG}/labels.parquet").collect()}
    got = query(spark, BIG).collect()
    assert len(got) == spark.read.parquet(f"{BIG}/documents.parquet").count()
    assert all(r.held_out == held(r.doc_id, modulo, remainder) and 0 <= r.score <= 1 and r.predicted == int(r.score >= cut) for r in got)
    assert auc([(r.score, labels[r.doc_id]) for r in got if r.held_out and r.doc_id in labels]) >= least
    assert got and sorted(map(tuple, query(spark, BIG).collect())) == sorted(map(tuple, got))  # the same each time


@pytest.mark.parametrize("query", [quality.op9_quality_trees, toxicity.op7_toxicity])
def test_odd_tables(spark, tmp_path, query):
    docs = documents(spark, ["a b c"] * 3 + [None, "", "x" * 3000, "a b c"], [1, 2, 3, 4, None, 6, 1]).selectExpr("*", "0.5 AS score", "1 AS label")
    for k, labels in enumerate(([], [(1, 1, 1), (None, 1, 0), (2, None, None)], [(1, 1, 0), (2, 0, 1), (3, 1, 1), (9, 0, 0)] * 20)):
        folder = tmp_path / str(k)
        store(docs, folder)
        store(spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), folder, "labels")
        got = query(spark, str(folder)).collect()
        assert len(got) == 7 and all(0 < r.score < 1 for r in got)
        assert len({r.score for r in got if r.doc_id in (1, 2, 3)}) == 1  # equal texts
    store(docs.limit(0), tmp_path / "none")
    store(spark.createDataFrame([], "doc_id long, quality int, toxic int"), tmp_path / "none", "labels")
    assert query(spark, str(tmp_path / "none")).count() == 0


def test_labels_of_held_out_rows_change_nothing(spark, tmp_path):
    docs = spark.read.parquet(f"{BIG}/documents.parquet")
    labels = spark.read.parquet(f"{BIG}/labels.parquet")
    turned = labels.rdd.map(lambda r: (r.doc_id, 1 - r.quality if zlib.crc32(str(r.doc_id).encode()) % 5 == 0 else r.quality, 1 - r.toxic if zlib.crc32(str(r.doc_id).encode()) % 3 == 1 else r.toxic))
    store(docs, tmp_path)
    store(turned.toDF("doc_id long, quality int, toxic int"), tmp_path, "labels")
    for query in (quality.op9_quality_trees, toxicity.op7_toxicity):
        assert sorted(map(tuple, query(spark, BIG).collect())) == sorted(map(tuple, query(spark, str(tmp_path)).collect()))


def test_swaps_do_not_move_the_score():
    rng = np.random.default_rng(0)
    groups = ("women", "men", "girls", "boys")
    neutral, toxic = [f"w{k}" for k in range(50)], ["idiot", "scum"]
    rows, y, gained, lost = [], [], [], []
    index = {w: k for k, w in enumerate([*neutral, *toxic, *groups])}
    for k in range(800):
        label = k % 4 == 0
        has = set(rng.choice(neutral, 6)) | ({toxic[k % 2]} if label and k % 8 else set()) | ({"women"} if label else {"men"} if k % 5 == 0 else set())
        rows.append(np.array(sorted(index[w] for w in has)))
        y.append(float(label))
        for g in groups:
            for h in groups:
                if g in has and h != g:
                    gained.append(np.array([index[h]]))
                    lost.append(np.array([index[g]]))
    spread = {}
    for penalty in (0.0, 20.0):
        w, _ = toxicity.fit(toxicity.Rows.of(rows), np.array(y), toxicity.Rows.of(gained), toxicity.Rows.of(lost), len(index), swap_penalty=penalty)
        spread[penalty] = abs(w[index["women"]] - w[index["men"]])
        assert w[index["idiot"]] > 0.5
    assert spread[20.0] < 0.3 * spread[0.0]
    assert "the women and girls" not in toxicity.swaps("The women and girls") and len(toxicity.swaps("the women")) == 3 and toxicity.swaps("nothing here") == []


def test_flat_trees_walk_like_a_recursive_one():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 4))
    y = ((x[:, 0] > 0.2) ^ (x[:, 1] > 0)).astype(float)
    t = quality.fit(x, y, trees=10, depth=3)

    def walk(row, node):
        for _ in range(t.depth):
            node = t.child[node][int(row[t.feature[node]] > t.threshold[node])]
        return t.value[node]

    assert np.allclose(t.margins(x), [t.base + sum(walk(r, n) for n in t.roots) for r in x])
    assert ((t.scores(x) > 0.5) == (y > 0.5)).mean() > 0.95
