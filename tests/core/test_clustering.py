"""Density clusters against a version that tries every distance."""

import numpy as np
import pytest

from forumetry.operators import clustering


def brute(x, least, samples):
    """Labels by cutting all points apart at every mutual reachability distance, from the greatest on."""
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    core = np.sort(d, axis=1)[:, min(samples, len(x) - 1)]
    m = np.maximum(np.maximum(d, core[:, None]), core[None, :])

    def parts(points, w):
        """Components of points by edges below w."""
        left, out = set(points), []
        while left:
            part, todo = set(), [left.pop()]
            while todo:
                p = todo.pop()
                part.add(p)
                near = {q for q in left if m[p, q] < w}
                left -= near
                todo.extend(near)
            out.append(sorted(part))
        return out

    def cluster(points, birth):
        """(points, own stability, clusters that it falls into)."""
        whole, stability = points, 0.0
        for w in sorted({m[p, q] for p in points for q in points if p != q}, reverse=True):
            found = parts(points, w)
            if len(found) == 1:
                continue
            gone = 1 / w if w else np.inf
            large = [p for p in found if len(p) >= least]
            stability += (len(points) - (len(large[0]) if len(large) == 1 else 0)) * (gone - birth)
            if len(large) != 1:
                return whole, stability, [cluster(p, gone) for p in large]
            points = large[0]
        return whole, stability, []

    def best(c):
        below = [best(x) for x in c[2]]
        total = sum(s for s, _ in below)
        return (total, [p for _, ps in below for p in ps]) if c[2] and total > c[1] else (c[1], [c[0]])

    chosen = [p for c in cluster(list(range(len(x))), 0.0)[2] for p in best(c)[1]]
    return {frozenset(p) for p in chosen}


def points(seed, n):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(4, 3)) * 6
    x = np.concatenate([centers[k % 4] + rng.normal(size=(1, 3)) * (0.3 + 0.3 * (k % 4)) for k in range(n)] + [rng.uniform(-12, 12, (n // 4, 3))])
    return np.concatenate((x, x[:3], x[:1])) if seed % 2 else np.round(x)  # equal points, and many equal distances


@pytest.mark.parametrize("seed,n,least,samples", [(0, 40, 5, 3), (1, 48, 4, 1), (2, 60, 3, 2), (3, 30, 6, 5), (4, 24, 2, 1)])
def test_labels_equal_brute_force(seed, n, least, samples):
    x = points(seed, n)
    d = clustering.distances(x, x)
    core = np.sort(d, axis=1)[:, samples]
    labels = clustering.condensed_labels(len(x), *clustering.spanning_edges(np.maximum(np.maximum(d, core[:, None]), core[None, :])), least)
    assert {frozenset(np.flatnonzero(labels == k).tolist()) for k in set(labels.tolist()) - {-1}} == brute(x, least, samples)


def test_clusters_of_blocks_equal_brute_force(spark):
    x = points(5, 60)
    rows = [("a", f"{k:03d}", v.tolist()) for k, v in enumerate(x)] + [("b", "1", [0.0]), ("b", "2", [1.0]), ("c", "1", [0.0])] + [("d", str(k), [float(3**k)]) for k in range(6)]
    df = spark.createDataFrame(rows, "item_type string, item_id string, embedding array<double>")
    for block in (7, 1024):
        got = {(r.item_type, r.item_id): r.cluster for r in clustering.density_clusters(df, 4, 2, block).collect()}
        own = {}
        for (kind, item), c in got.items():
            if kind == "a" and c is not None:
                own.setdefault(c, set()).add(int(item))
        assert {frozenset(v) for v in own.values()} == brute(x, 4, 2) and len(got) == len(rows)
        assert {c for (kind, _), c in got.items() if kind in "bc"} == {"0"} and {c for (kind, _), c in got.items() if kind == "d"} == {"0"}
    assert clustering.density_clusters(df.limit(0)).count() == 0


def test_top_rows_of_a_cluster_are_chosen_before_they_are_dealt(spark):
    from forumetry.operators import narratives

    rows = spark.range(4000).selectExpr("'comment' AS item_type", "IF(id % 2 = 0, 'comment-noise', concat('comment-', id % 7)) AS cluster_id", "id AS ord", "concat('c', id) AS item_id", "repeat('word ', CAST(id % 97 AS INT)) AS text")
    for df in (narratives.exemplars(rows), narratives.cluster_keywords(rows), narratives.first_texts(rows)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        # read from the bottom: a limit a cluster in each task, the exchange, the limit and the window behind it
        above, below = plan.index("WindowGroupLimit"), plan.rindex("WindowGroupLimit")
        assert "Final" in plan[above : above + 200] and "Partial" in plan[below : below + 200] and "Exchange" in plan[above:below]
    want = sorted(((k % 97) * 5, -k) for k in range(0, 4000, 2))[::-1][:3]
    got = narratives.exemplars(rows).where("cluster_id = 'comment-noise'").orderBy("rank").collect()
    assert [r.item_id for r in got] == [f"c{-k}" for _, k in want]


def test_blocks_of_millions_of_points_have_numbers_of_their_own():
    import numpy as np

    numbers = {int(np.int64(int(a) * (1 << 31) + int(b))) for a in (0, 1, 2147, 2148, 10**6) for b in (0, 1, 2148, 10**6)}
    assert len(numbers) == 20


def test_edges_between_two_sides_equal_those_of_a_full_matrix():
    import numpy as np

    from forumetry.operators import clustering

    rng = np.random.default_rng(2)
    for n, m in ((1, 1), (1, 7), (9, 4), (20, 20)):
        cross = rng.integers(1, 30, (n, m)).astype(float)
        full = np.full((n + m, n + m), 1e9)
        full[:n, n:], full[n:, :n] = cross, cross.T
        a, b, w = clustering.crossing_edges(cross)
        assert len(w) == n + m - 1 and w.sum() == clustering.spanning_edges(full)[2].sum()
        assert all(full[i, j] == k for i, j, k in zip(a, b, w)) and len(set(a) | set(b)) == n + m


def test_lightest_edges_by_products_equal_those_by_differences():
    rng = np.random.default_rng(4)
    x = np.concatenate((rng.normal(size=(700, 8)) * 5 + 1000, np.full((40, 8), 1000.0)))  # far from the origin, and equal points
    d = clustering.distances(x, x)
    ids, zero = np.arange(len(x)), np.zeros(len(x))
    own = {"id": ids, "vector": x, "core": zero, "comp": ids, "bound": np.full(len(x), np.inf)}
    halves = [{c: v[some] for c, v in own.items()} for some in (slice(0, 300), slice(300, None))]
    w, to = clustering.lightest(own, halves, 3)
    assert (w == np.sort(np.where(np.eye(len(x)) > 0, np.inf, d), axis=1)[:, :3]).all() and (w == d[ids[:, None], to]).all()
    core, comp = w[:, 2], ids % 5
    m = np.maximum(np.maximum(d, core[:, None]), core[None, :])
    m[comp[:, None] == comp] = np.inf
    w, to = clustering.lightest(own | {"core": core, "comp": comp}, [h | {"core": core[h["id"]], "comp": comp[h["id"]]} for h in halves], 1)
    assert all(w[comp == k].min() == m[comp == k].min() for k in range(5))


def test_components_grow_into_a_minimum_spanning_tree(spark):
    rng = np.random.default_rng(9)
    sets = {"far": np.concatenate([rng.normal(size=(60, 4)) + 50 * k for k in range(5)]), "ties": rng.integers(0, 4, (150, 3)).astype(float), "same": np.zeros((40, 2))}
    for kind, x in sets.items():
        df = spark.createDataFrame([(kind, k, v.tolist()) for k, v in enumerate(x)], "kind string, id long, vector array<double>")
        got = clustering.grown_tree(df, 3, 32).toPandas()
        d = clustering.distances(x, x)
        core = np.sort(d, axis=1)[:, 3]
        m = np.maximum(np.maximum(d, core[:, None]), core[None, :])
        a, b = got["a"].to_numpy(), got["b"].to_numpy()
        assert (m[a, b] == got["w"]).all() and len(got) == len(x) - 1 == len(clustering.forest(a, b, got["w"].to_numpy()))
        assert sorted(got["w"]) == sorted(clustering.spanning_edges(m)[2])
