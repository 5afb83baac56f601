"""Density clusters of vectors: a hierarchy over mutual reachability distances, of which the most persistent clusters are taken (HDBSCAN).

The distances of all pairs are what such a hierarchy is about. Distances never leave a task, and only the tree of n - 1 edges (24 bytes each) of
an item type comes together in one task, which condenses it. The work grows with the square of a run's items, as that of the method does; a run
is what one source said in a range of dates.

Item types of a few blocks are taken in pairs of blocks: once for the core distances, once for a minimum spanning tree of the points of every
pair. Each edge of the whole tree is an edge of one of these, so the forests are then merged, a few at a time, till one tree is left.

Larger ones are searched (`lightest`): blocks of points ask spans of blocks, all tasks alike. Matrix products in single precision tell which
pairs may be near enough, with a bound on their error; only these get a distance, by differences. The first search finds the nearest points and so
the core distances. Then components grow as in Boruvka's method: each but the largest takes its lightest edge outwards, which is an edge of a
minimum spanning tree. Edges to nearest points are known; a point whose core distance is not below the lightest of its component asks nothing.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forumetry.operators.store import checkpointed

#: Points of a block, and forests that are merged at once.
BLOCK, FAN = 1024, 16
#: Blocks up to which all pairs of blocks are taken; points of a block that asks or is asked; blocks of a span; rows and columns of a product.
FEW_BLOCKS, WIDE, SPAN, TILE = 11, 8192, 16, (512, 1024)
_EDGES = "kind string, bucket long, a long, b long, w double"


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances, by differences (not by dot products, which would not give 0 for equal points), a few rows at a time."""
    out = np.empty((len(x), len(y)))
    step = max(1, (1 << 22) // max(1, y.size))
    for at in range(0, len(x), step):
        out[at : at + step] = np.sqrt(((x[at : at + step, None, :] - y[None, :, :]) ** 2).sum(axis=2))
    return out


def spanning_edges(weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A minimum spanning tree of a full matrix of weights."""
    n = len(weights)
    best, source, open_ = weights[0].copy(), np.zeros(n, np.int64), np.ones(n, bool)
    open_[0] = False
    a, b, w = np.empty(n - 1, np.int64), np.empty(n - 1, np.int64), np.empty(n - 1)
    for k in range(n - 1):
        at = int(np.where(open_, best, np.inf).argmin()) if open_.any() else 0
        if not open_[at]:
            at = int(np.flatnonzero(open_)[0])
        a[k], b[k], w[k] = source[at], at, best[at]
        open_[at] = False
        closer = open_ & (weights[at] < best)
        best[closer], source[closer] = weights[at][closer], at
    return a, b, w


def crossing_edges(weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A minimum spanning tree of the edges between two sides, weights of left x right; right ends are counted on from the left ones."""
    n, m = weights.shape
    of_right = np.ascontiguousarray(weights.T)
    best, source = np.concatenate((np.full(n, np.inf), weights[0])), np.zeros(n + m, np.int64)
    open_ = np.ones(n + m, bool)
    open_[0] = False
    a, b, w = np.empty(n + m - 1, np.int64), np.empty(n + m - 1, np.int64), np.empty(n + m - 1)
    for k in range(n + m - 1):
        at = int(np.where(open_, best, np.inf).argmin())
        a[k], b[k], w[k] = source[at], at, best[at]
        open_[at] = False
        side, more = (slice(n, None), weights[at]) if at < n else (slice(0, n), of_right[at - n])
        closer = open_[side] & (more < best[side])
        best[side][closer], source[side][closer] = more[closer], at
    return a, b, w


def forest(a: np.ndarray, b: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Places of the edges of a minimum spanning forest, lightest first."""
    names, ends = np.unique(np.concatenate((a, b)), return_inverse=True)
    ends = ends.reshape(2, -1)
    root = list(range(len(names)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    kept = []
    for k in np.lexsort((b, a, w)).tolist():
        x, y = find(int(ends[0, k])), find(int(ends[1, k]))
        if x != y:
            root[x] = y
            kept.append(k)
    return np.array(kept, np.int64)


def condensed_labels(n: int, a: np.ndarray, b: np.ndarray, w: np.ndarray, least: int) -> np.ndarray:
    """A label for each of n points from the edges of their spanning tree, -1 for noise; clusters have `least` points or more.

    Edges of equal weight are one level, so that which of several trees was found doesn't matter. From the whole downwards, a cluster lives on in
    a part of `least` points, dies where it falls into several, and its points leave it at 1 / distance. A cluster is taken if its points
    together stay in it for longer than in those that it falls into. The whole is never taken.
    """
    parent, size, children, at = list(range(n)), [1] * n, [[] for _ in range(n)], [0.0] * n
    find_of = list(range(n))

    def find(x: int) -> int:
        while find_of[x] != x:
            find_of[x] = find_of[find_of[x]]
            x = find_of[x]
        return x

    top = list(range(n))  # node of a root
    order = np.lexsort((b, a, w))
    k = 0
    while k < len(order):
        level, same = w[order[k]], k
        touched: dict[int, list[int]] = {}
        while same < len(order) and w[order[same]] == level:
            x, y = find(int(a[order[same]])), find(int(b[order[same]]))
            if x != y:
                parts = touched.pop(x, [top[x]]) + touched.pop(y, [top[y]])
                find_of[x] = y
                touched[y] = parts
            same += 1
        for r, parts in touched.items():
            top[r] = len(size)
            children.append(parts)
            size.append(sum(size[p] for p in parts))
            at.append(float(level))
        k = same
    # clusters from the whole downwards
    birth, stability, above, fell = [0.0], [0.0], [-1], np.full(n, -1, np.int64)
    open_ = [(len(size) - 1, 0)]
    while open_:
        node, cluster = open_.pop()
        if node < n:
            fell[node] = cluster
            continue
        gone = 1 / at[node] if at[node] > 0 else np.inf
        large = [c for c in children[node] if size[c] >= least]
        left = size[node] - (size[large[0]] if len(large) == 1 else 0)
        stability[cluster] += left * (gone - birth[cluster])
        for c in children[node]:
            if size[c] < least:
                below = [c]
                while below:
                    x = below.pop()
                    if x < n:
                        fell[x] = cluster
                    else:
                        below.extend(children[x])
            elif len(large) == 1:
                open_.append((c, cluster))
            else:
                birth.append(gone)
                stability.append(0.0)
                above.append(cluster)
                open_.append((c, len(birth) - 1))
    # a cluster's descendants come behind it
    total, taken, parts = list(stability), [True] * len(birth), [0.0] * len(birth)
    has_parts = [False] * len(birth)
    for c in reversed(range(len(birth))):
        if c == 0 or has_parts[c] and parts[c] > stability[c]:
            taken[c], total[c] = False, parts[c]
        if c:
            parts[above[c]] += total[c]
            has_parts[above[c]] = True
    chosen = [-1] * len(birth)
    for c in range(1, len(birth)):
        chosen[c] = chosen[above[c]] if chosen[above[c]] >= 0 else c if taken[c] else -1
    found = np.array(chosen)[fell]
    names = {c: k for k, c in enumerate(dict.fromkeys(found[found >= 0].tolist()))}
    return np.array([names.get(c, -1) for c in found.tolist()], np.int64)


def _blocks(points: DataFrame, block: int) -> DataFrame:
    """(kind, block, blocks, ids, vectors, core) of points (kind, id, vector, core)."""
    counts = points.groupBy("kind").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    dealt = points.join(F.broadcast(counts), "kind").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    one = F.array_sort(F.collect_list(F.struct("id", "vector", "core"))).alias("p")
    made = dealt.groupBy("kind", "block", "blocks").agg(one)
    return made.select("kind", "block", "blocks", F.col("p.id").alias("ids"), F.col("p.vector").alias("vectors"), F.col("p.core").alias("core"))


def _pairs(blocks: DataFrame) -> DataFrame:
    """Each two blocks of a kind once, and each with itself."""
    side = lambda n: [F.col(c).alias(f"{c}{n}") for c in ("block", "ids", "vectors", "core")]
    first = blocks.select("kind", *side(1), F.explode(F.sequence(F.col("block"), F.col("blocks") - 1)).alias("block2"))
    return first.join(blocks.select("kind", *side(2)), ["kind", "block2"])


def core_distances(points: DataFrame, min_samples: int, block: int = BLOCK) -> DataFrame:
    """(kind, id, core): the distance to the min_samples-th nearest other point of the kind, or to the farthest if there are fewer."""

    def near(frames):
        for pdf in frames:
            for r in pdf.itertuples(index=False):
                x, y = np.array(r.vectors1.tolist(), float), np.array(r.vectors2.tolist(), float)
                d = distances(x, y)
                if r.block1 == r.block2:
                    np.fill_diagonal(d, np.inf)
                out = []
                for ids, some in ((r.ids1, d), *([(r.ids2, d.T)] if r.block1 != r.block2 else [])):
                    k = min(min_samples, some.shape[1])
                    least = np.sort(np.partition(some, k - 1, axis=1)[:, :k], axis=1)
                    out.append(pd.DataFrame({"kind": r.kind, "id": ids, "near": [v[np.isfinite(v)].tolist() for v in least]}))
                yield pd.concat(out)

    found = _pairs(_blocks(points.withColumn("core", F.lit(0.0)), block)).mapInPandas(near, "kind string, id long, near array<double>")
    nearest = F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, min_samples)
    return found.groupBy("kind", "id").agg(nearest.alias("near")).select("kind", "id", F.coalesce(F.try_element_at("near", F.lit(-1)), F.lit(0.0)).alias("core"))


def spanning_tree(points: DataFrame, block: int = BLOCK, fan: int = FAN) -> DataFrame:
    """(kind, bucket, a, b, w): for each kind a minimum spanning tree of its points (kind, id, vector, core) by mutual reachability, the greatest of
    both core distances and the distance. Every distance is computed once."""

    def trees(frames):
        for pdf in frames:
            for r in pdf.itertuples(index=False):
                # edges within a block are those of the pair with itself; another pair has the edges between its blocks alone
                own = r.block1 == r.block2
                ids = r.ids1 if own else np.concatenate((r.ids1, r.ids2))
                if len(ids) > 1:
                    x, y = np.array(r.vectors1.tolist(), float), np.array(r.vectors2.tolist(), float)
                    weights = np.maximum(np.maximum(distances(x, y), r.core1[:, None]), r.core2[None, :])
                    a, b, w = spanning_edges(weights) if own else crossing_edges(weights)
                    low, high = np.minimum(ids[a], ids[b]), np.maximum(ids[a], ids[b])
                    yield pd.DataFrame({"kind": r.kind, "bucket": np.int64(int(r.block1) * (1 << 31) + int(r.block2)), "a": low, "b": high, "w": w})

    def merged(pdf):
        return pdf.iloc[forest(pdf["a"].to_numpy(), pdf["b"].to_numpy(), pdf["w"].to_numpy())]

    cut = checkpointed(_blocks(points, block))
    largest = cut.agg(F.coalesce(F.max("blocks"), F.lit(1))).first()[0]
    edges = _pairs(cut).mapInPandas(trees, _EDGES)
    buckets = largest * (largest + 1) // 2
    while True:
        buckets = -(-buckets // fan)
        edges = checkpointed(edges.withColumn("bucket", F.pmod(F.xxhash64("bucket"), F.lit(buckets))).groupBy("kind", "bucket").applyInPandas(merged, _EDGES))
        if buckets == 1:
            return edges


def lightest(own: dict[str, np.ndarray], others: list[dict[str, np.ndarray]], k: int) -> tuple[np.ndarray, np.ndarray]:
    """(weights, ids) of the k lightest edges from each own point to others (id, vector, core, comp) of other components, as rows of k, inf and -1
    where there are fewer. The weight is the greatest of the distance and both core distances; only those below the own `bound` are asked for.
    With k = 1 one point's edge is enough for its whole component.

    Products of centred and scaled vectors in single precision are off by `slack` at most, so whatever may be light enough is computed exactly.
    """
    # by bounds and core distances, so that tiles may go whole: an edge is no lighter than the core distances of its ends
    asked = np.argsort(own["bound"], kind="stable")
    x, core, comp, limit = (own[c][asked] for c in ("vector", "core", "comp", "bound"))
    products, below = np.empty(TILE[0] * TILE[1], np.float32), np.empty(TILE[0] * TILE[1], bool)
    weights, ids = np.full((len(x), k), np.inf), np.full((len(x), k), -1, np.int64)
    names, code = np.unique(comp, return_inverse=True)
    for other in others:
        by_core = np.argsort(other["core"], kind="stable")
        other = {c: v[by_core] for c, v in other.items() if c in ("id", "vector", "core", "comp")}
        y = other["vector"]
        centre = y.mean(axis=0)
        a, b = x - centre, y - centre
        scale = max(np.sqrt((a * a).sum(axis=1).max()), np.sqrt((b * b).sum(axis=1).max())) or 1.0
        a, b = a / scale, b / scale
        one = lambda z: np.ones((len(z), 1))
        a = np.hstack((-2 * a, (a * a).sum(axis=1, keepdims=True), one(a))).astype(np.float32)
        b = np.ascontiguousarray(np.hstack((b, one(b), (b * b).sum(axis=1, keepdims=True))).astype(np.float32).T)
        slack = 4 * (x.shape[1] + 16) * np.finfo(np.float32).eps
        for i in range(0, len(x), TILE[0]):
            for j in range(0, len(y), TILE[1]):
                rows, cols = slice(i, i + TILE[0]), slice(j, j + TILE[1])
                open_ = limit[rows] > core[rows]  # no edge is lighter than a core distance
                if not open_.any() or other["core"][j] >= limit[rows][open_].max():
                    break
                shape = len(open_), len(y[cols])
                near, may = (z[: shape[0] * shape[1]].reshape(shape) for z in (products, below))
                np.matmul(a[rows], b[:, cols], out=near)
                thresholds = np.where(open_, (limit[rows] / scale) ** 2 + slack, -np.inf).astype(np.float32)[:, None]
                np.less(near, thresholds, out=may)
                dense = np.count_nonzero(may) > 8 * k * len(near)
                if dense:
                    may &= comp[rows][:, None] != other["comp"][cols]
                    may &= other["core"][cols] < limit[rows][:, None]
                    by = np.where(may, np.maximum(near, ((other["core"][cols] / scale) ** 2).astype(np.float32)), np.float32(np.inf))
                    at = min(k, by.shape[1]) - 1
                    may &= by <= np.partition(by, at, axis=1)[:, at : at + 1] + np.float32(2 * slack)
                r, c = np.divmod(np.flatnonzero(may), shape[1])
                if not dense:
                    fits = (comp[rows][r] != other["comp"][cols][c]) & (other["core"][cols][c] < limit[rows][r])
                    r, c = r[fits], c[fits]
                for part in range(0, len(r), 1 << 16):
                    p, q = r[part : part + (1 << 16)] + i, c[part : part + (1 << 16)] + j
                    w = np.maximum(np.maximum(np.sqrt(((x[p] - y[q]) ** 2).sum(axis=1)), core[p]), other["core"][q])
                    less = w < limit[p]
                    p, q, w = p[less], q[less], w[less]
                    touched = np.unique(p)
                    p, w = np.concatenate((p, np.repeat(touched, k))), np.concatenate((w, weights[touched].ravel()))
                    to = np.concatenate((other["id"][q], ids[touched].ravel()))
                    order = np.lexsort((to, w, p))
                    first = np.searchsorted(p[order], touched)
                    order = order[(first[:, None] + np.arange(k)).ravel()]  # a row has k old ones at least
                    weights[touched], ids[touched] = w[order].reshape(-1, k), to[order].reshape(-1, k)
                    limit[touched] = np.minimum(limit[touched], weights[touched, -1])
        if k == 1 and len(names) < len(x):
            least = np.full(len(names), np.inf)
            np.minimum.at(least, code, limit)
            limit = least[code]
    back = np.argsort(asked)
    return weights[back], ids[back]


def _columns_of(points: pa.ChunkedArray) -> list[dict[str, np.ndarray]]:
    """The points of each block as arrays."""
    out = []
    for block in points.chunks:
        for k in range(len(block)):
            some = block.slice(k, 1).flatten()
            own = dict(zip([f.name for f in some.type], some.flatten(), strict=True))
            vectors = own.pop("vector").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(some), -1)
            out.append({name: v.to_numpy(zero_copy_only=False) for name, v in own.items()} | {"vector": vectors})
    return out


def searched(asking: DataFrame, points: DataFrame, k: int, block: int = WIDE) -> DataFrame:
    """(kind, id, comp, other, w): for the asking (kind, id, vector, core, comp, bound) the k lightest edges to points (the same, without bound) of
    each span of blocks, by `lightest`; with k = 1 for each component of a block that asks."""

    def dealt(df: DataFrame) -> DataFrame:
        n = df.groupBy("kind").agg(F.count("*").alias("n"))
        size = F.least(F.lit(block), F.greatest(F.lit(512), F.ceil(F.col("n") / 16)))
        numbered = df.join(F.broadcast(n.select("kind", F.ceil(F.col("n") / size).cast("int").alias("blocks"))), "kind")
        numbered = numbered.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
        return checkpointed(numbered.groupBy("kind", "block", "blocks").agg(F.collect_list(F.struct(*(c for c in df.columns if c != "kind"))).alias("p")))

    def search(ask: pa.Table, met: pa.Table) -> pa.Table:
        out = {c: [] for c in ("id", "comp", "other", "w")}
        others = _columns_of(met["p"]) if ask.num_rows else []
        for own in _columns_of(ask["p"]) if met.num_rows else []:
            w, ids = lightest(own, others, k)
            at, place = np.nonzero(ids >= 0)
            w, ids = w[at, place], ids[at, place]
            if k == 1:
                order = np.lexsort((ids, w, own["comp"][at]))
                order = order[np.unique(own["comp"][at][order], return_index=True)[1]]
                at, w, ids = at[order], w[order], ids[order]
            for c, v in (("id", own["id"][at]), ("comp", own["comp"][at]), ("other", ids), ("w", w)):
                out[c].append(v)
        made = {c: np.concatenate(v) if v else np.empty(0, float if c == "w" else np.int64) for c, v in out.items()}
        kind = (ask if ask.num_rows else met)["kind"][0].as_py()
        return pa.table({"kind": pa.array([kind] * len(made["id"]), pa.string()), **{c: pa.array(v) for c, v in made.items()}})

    by = ["kind", "q", "span"]
    ask, met = dealt(asking), dealt(points)
    blocks = lambda df, name: F.broadcast(df.select("kind", F.col("blocks").alias(name)).distinct())
    spans = F.sequence(F.lit(0), F.floor((F.col("n") - 1) / SPAN).cast("int"))
    left = ask.join(blocks(met, "n"), "kind").select("kind", F.col("block").alias("q"), F.explode(spans).alias("span"), "p")
    right = met.join(blocks(ask, "n"), "kind").select("kind", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("q"), F.floor(F.col("block") / SPAN).cast("int").alias("span"), "p")
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(search, "kind string, id long, comp long, other long, w double")


def grown_tree(points: DataFrame, min_samples: int, block: int = WIDE) -> DataFrame:
    """(kind, a, b, w): for each kind a minimum spanning tree of its points (kind, id, vector) by mutual reachability, by components that grow.

    A round's picks are each the lightest edge out of a component. Taken from the lightest on, those that join two components are edges of a
    minimum spanning tree, ties or not: round a circle of picks all weights are equal. The largest component of a kind picks nothing.
    """
    alone = points.select("*", F.lit(0.0).alias("core"), F.col("id").alias("comp"))
    found = searched(alone.withColumn("bound", F.lit(float("inf"))), alone, min_samples, block)
    nearest = F.slice(F.array_sort(F.collect_list(F.struct("w", "other"))), 1, min_samples)
    near = checkpointed(found.groupBy("kind", "id").agg(nearest.alias("near")).withColumn("core", F.element_at("near", -1)["w"]))
    cores = near.select("kind", "id", "core")
    one = near.select("kind", F.col("id").alias("a"), F.col("core").alias("core_a"), F.explode("near").alias("e")).select("kind", "a", "core_a", F.col("e.other").alias("b"), F.col("e.w").alias("d"))
    edges = one.join(cores.select("kind", F.col("id").alias("b"), F.col("core").alias("core_b")), ["kind", "b"]).select("kind", "a", "b", F.greatest("d", "core_a", "core_b").alias("w"))
    known = checkpointed(edges.unionByName(edges.select("kind", F.col("b").alias("a"), F.col("a").alias("b"), "w")))
    placed = checkpointed(points.join(cores, ["kind", "id"]))

    def joined(pdf: pd.DataFrame) -> pd.DataFrame:
        """Components (kind, comp, w, a, b, other) with the one that they are now part of, and whether their pick was taken."""
        some = pdf[pdf["other"].notna()]
        kept = some.iloc[forest(some["comp"].to_numpy(np.int64), some["other"].to_numpy(np.int64), some["w"].to_numpy(float))]
        root = dict(zip(pdf["comp"].tolist(), pdf["comp"].tolist(), strict=True))

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for x, y in zip(kept["comp"].tolist(), kept["other"].astype("int64").tolist(), strict=True):
            root[find(x)] = find(y)
        return pdf.assign(now=[find(x) for x in pdf["comp"].tolist()], taken=pdf["comp"].isin(kept["comp"]))

    members, taken, free = checkpointed(cores.withColumn("comp", F.col("id"))), [], True
    while True:
        of = lambda side: members.select("kind", F.col("id").alias(side), F.col("comp").alias(f"comp_{side}"))
        out = known.join(of("a"), ["kind", "a"]).join(of("b"), ["kind", "b"]).where("comp_a <> comp_b")
        picks = checkpointed(out.groupBy("kind", F.col("comp_a").alias("comp")).agg(F.min(F.struct("w", "a", "b")).alias("pick")))
        sizes = members.groupBy("kind", "comp").agg(F.count("*").alias("n"), F.min("core").alias("least"))
        largest = sizes.groupBy("kind").agg(F.max_by("comp", F.struct("n", "comp")).alias("comp"))
        sizes = checkpointed(sizes.join(picks.select("kind", "comp", F.col("pick.w").alias("bound")), ["kind", "comp"], "left").fillna(float("inf"), ["bound"]))
        open_ = sizes.where("least < bound").select("kind", "comp", "bound")
        if free:  # picks that no search can better; the first round takes these alone
            picks = picks.join(open_, ["kind", "comp"], "left_anti")
        else:
            open_ = open_.join(F.broadcast(largest), ["kind", "comp"], "left_anti")
            asking = placed.join(members.select("kind", "id", "comp"), ["kind", "id"]).join(open_, ["kind", "comp"]).where("core < bound")
            met = searched(checkpointed(asking), checkpointed(placed.join(members.select("kind", "id", "comp"), ["kind", "id"])), 1, block)
            both = picks.unionByName(met.select("kind", "comp", F.struct("w", F.col("id").alias("a"), F.col("other").alias("b")).alias("pick")))
            picks = both.join(F.broadcast(largest), ["kind", "comp"], "left_anti").groupBy("kind", "comp").agg(F.min("pick").alias("pick"))
        told = picks.select("kind", "comp", "pick.*").join(of("b").withColumnRenamed("comp_b", "other"), ["kind", "b"])
        every = sizes.select("kind", "comp").join(told, ["kind", "comp"], "left").select("kind", "comp", "w", "a", "b", "other")
        made = checkpointed(every.groupBy("kind").applyInPandas(joined, "kind string, comp long, w double, a long, b long, other long, now long, taken boolean"))
        taken.append(made.where("taken").select("kind", "a", "b", "w"))
        said = made.agg(F.count_if("taken"), F.count_distinct("kind", "now"), F.count_distinct("kind")).first()
        if said[1] == said[2]:
            return reduce(DataFrame.unionByName, taken)
        if not said[0] and not free:
            raise ValueError("distances between embeddings must be numbers")
        members = checkpointed(members.join(made.select("kind", "comp", "now"), ["kind", "comp"]).select("kind", "id", "core", F.col("now").alias("comp")))
        free = False


def density_clusters(items: DataFrame, min_cluster_size: int = 3, min_samples: int = 1, block: int = BLOCK) -> DataFrame:
    """(item_type, item_id, cluster) of items (item_type, item_id, embedding): cluster is a number from 0 as text, null for noise.

    Each item type is clustered on its own. Fewer items than a cluster needs, or nothing but noise, make one cluster 0. Clusters are numbered by
    their first item, by id. Equal items are points of distance 0.
    """
    from pyspark.sql import Window

    # numbers within a type, by id: points are numbered once, what is passed on are numbers
    single = items.schema["embedding"].dataType.simpleString() == "array<float>"
    ordered = items.select(F.col("item_type").alias("kind"), "item_id", (F.col("embedding") if single else F.col("embedding").cast("array<double>")).alias("vector"))
    place = F.row_number().over(Window.partitionBy("kind").orderBy("item_id")) - 1
    points = checkpointed(ordered.withColumn("id", place.cast("long")))
    counts = points.groupBy("kind").agg(F.count("*").alias("n"))
    few = checkpointed(counts.where(F.col("n") < max(2, min_cluster_size)))
    many = points.join(F.broadcast(few.select("kind")), "kind", "left_anti")
    if (counts.agg(F.max("n")).first()[0] or 0) > FEW_BLOCKS * block:
        edges = grown_tree(many.select("kind", "id", "vector"), min_samples, block if block < BLOCK else WIDE)
    else:
        core = checkpointed(core_distances(many.select("kind", "id", "vector"), min_samples, block))
        edges = spanning_tree(many.select("kind", "id", "vector").join(core, ["kind", "id"]), block)

    def condense(pdf):
        n = len(pdf) + 1
        labels = condensed_labels(n, pdf["a"].to_numpy(), pdf["b"].to_numpy(), pdf["w"].to_numpy(), max(2, min_cluster_size))
        if (labels < 0).all():
            labels = np.zeros(n, np.int64)
        return pd.DataFrame({"kind": pdf["kind"].iloc[0], "id": np.arange(n), "label": labels})

    labels = edges.groupBy("kind").applyInPandas(condense, "kind string, id long, label long")
    found = points.select("kind", "id", "item_id").join(labels, ["kind", "id"]).select("kind", "item_id", F.when(F.col("label") >= 0, F.col("label").cast("string")).alias("cluster"))
    alone = points.join(F.broadcast(few.select("kind")), "kind", "left_semi").select("kind", "item_id", F.lit("0").alias("cluster"))
    return found.unionByName(alone).withColumnRenamed("kind", "item_type")
