import itertools
import random
import re

import numpy as np
import pytest
import xxhash

from forumetry.llm import simhash

from .helpers import TEXTS, documents, store


def fingerprint(text, k=4):
    """Bit by bit, as the contract says."""
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in "".join(" " if c in "\x20\x09\x0a\x0b\x0c\x0d" else c for c in low).split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] if len(words) >= k else [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute(rows, most=4):
    """{(doc_id, fingerprint): component} by comparing all pairs."""
    prints = [fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        if (prints[a] ^ prints[b]).bit_count() <= most:
            root[find(a)] = find(b)
    groups = {}
    for k in range(len(rows)):
        groups.setdefault(find(k), []).append(rows[k][0])
    least = {g: min((i for i in ids if i is not None), default=None) for g, ids in groups.items()}
    return sorted(((i, f"{p:016x}", least[find(k)]) for k, ((i, _), p) in enumerate(zip(rows, prints))), key=repr)


def result(df):
    return sorted(map(tuple, df.select("doc_id", "fingerprint", "component_id").collect()), key=repr)


def test_op10_equals_brute_force(spark, sf, tmp_path):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert result(simhash.op10_simhash(spark, sf)) == brute(rows)
    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    base = [rng.choice(words) for _ in range(300)]
    texts = list(TEXTS)
    for _ in range(60):  # a chain of near copies
        base[rng.randrange(300)] = rng.choice(words)
        texts.append(" ".join(base))
    ids = [None, 7, 7, *range(100, 100 + len(texts) - 3)]
    assert result(simhash.op10_simhash(spark, store(documents(spark, texts, ids), tmp_path))) == brute(list(zip(ids, texts)))


def test_empty_table(spark, tmp_path):
    assert simhash.op10_simhash(spark, store(documents(spark).limit(0), tmp_path)).count() == 0


@pytest.mark.parametrize("block", [8, 1024])
def test_dense_groups_link_like_all_pairs(spark, block):
    rng = np.random.default_rng(5)
    centre = rng.integers(0, 2**63, 3)
    prints = {int(x) for c in centre for x in c ^ (np.uint64(1) << rng.integers(0, 63, 200).astype(np.uint64)).astype(np.int64)} | set(map(int, rng.integers(-(2**63), 2**63, 300)))
    prints = sorted(prints)
    df = spark.createDataFrame([(p,) for p in prints], "fingerprint long")
    links = simhash.linked(df, 4, block).collect()
    assert all(((a ^ b) & (2**64 - 1)).bit_count() <= 4 for a, b in links)
    want, got = {}, {}
    for pairs, out in (((p for p in itertools.combinations(prints, 2) if ((p[0] ^ p[1]) & (2**64 - 1)).bit_count() <= 4), want), (links, got)):
        root = {p: p for p in prints}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in pairs:
            root[max(find(a), find(b))] = min(find(a), find(b))
        out.update({p: find(p) for p in prints})
    assert want == got
    comps = {r.node: r.root for r in simhash.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert comps == {p: r for p, r in got.items() if p in comps} and all(p in comps for ab in links for p in ab)


def test_plan_deals_all_units():
    rng = np.random.default_rng(0)
    bits = (rng.random((500, 64)) < rng.random(64)).astype(float)
    for n, most in ((500, 4), (10**8, 4), (10**6, 7), (0, 4)):
        parts = simhash.plan(n, bits.T @ bits * (n / 500), most)
        assert sum(u for _, u in parts) == most + 1
        assert all(a & b == 0 for (a, _), (b, _) in itertools.combinations(parts, 2))


def test_stage_keeps_one_of_each_group(spark, sf):
    docs = documents(spark, ["a b c d e f"] * 3 + ["other words are here now", None, "", "a b c d e f"], [5, 2, 2, 9, 4, 3, None])
    docs = docs.selectExpr("*", "'k' AS key", "1 AS first", "'x' AS _own")
    kept = simhash.keep_first(spark, docs, sf)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [2, 3, 9]
    assert simhash.keep_first(spark, docs.limit(0), sf).count() == 0


def similar_groups(texts, words=5):
    """The first text of the group of each, by comparing all pairs of sets of shingles, or of whole sequences that are shorter."""
    sets = []
    for text in texts:
        w = [x for x in re.split("[\x20\x09-\x0d]+", (text or "").translate({k: k + 32 for k in range(65, 91)})) if x]
        sets.append({tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set())
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(texts)), 2):
        if sets[a] == sets[b] or len(sets[a] & sets[b]) * 5 >= len(sets[a] | sets[b]) * 4:
            root[max(find(a), find(b))] = min(find(a), find(b))
    return [find(k) for k in range(len(texts))]


def test_hot_groups_equal_brute_force(spark, sf):
    """Documents that share a long passage and bands, but are similar to few of the others: what the rounds leave open."""
    rng = random.Random(12)
    shared = [f"s{k}" for k in range(100)]
    texts = []
    for k in range(150):
        own = [f"w{rng.randrange(9000)}" for _ in range(rng.choice((20, 26, 30, 40)))]
        texts.append(" ".join([*shared, *own]))
        if k % 10 == 0:
            own[rng.randrange(len(own))] = "changed"
            texts.append(" ".join([*shared, *own]))
    texts += ["", None, "two words", "two words", "Two words"]
    groups = similar_groups(texts)
    kept = simhash.keep_first(spark, documents(spark, texts), sf)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(groups)) and 30 < len(set(groups)) < 160


def test_stage_joins_similar_shingle_sets(spark, sf):
    """Copies of Jaccard similarity 0.8 or more on five words are found, however many bits they differ in; others stay."""
    rng = random.Random(11)
    texts = []
    for _ in range(12):
        base = [f"w{rng.randrange(5000)}" for _ in range(200)]
        texts.append(base)
        for changes in (1, 2, 4, 7):
            copy = list(base)
            for at in rng.sample(range(200), changes):
                copy[at] = f"n{rng.randrange(5000)}"
            texts.append(copy)
    hot = [f"h{k}" for k in range(300)]
    texts += [[*hot[:k], f"n{k}", *hot[k + 1 :]] for k in range(60)]
    texts = [" ".join(x) for x in texts]
    sets = [{tuple(x.split()[i : i + 5]) for i in range(len(x.split()) - 4)} for x in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(texts)), 2):
        if len(sets[a] & sets[b]) * 5 >= len(sets[a] | sets[b]) * 4:
            root[max(find(a), find(b))] = min(find(a), find(b))
    far = [k for k in range(len(texts)) if find(k) != k and (fingerprint(texts[k]) ^ fingerprint(texts[find(k)])).bit_count() > 4]
    assert far and any(find(k) == k and k % 5 for k in range(60))
    kept = simhash.keep_first(spark, documents(spark, texts), sf)
    assert sorted(r.doc_id for r in kept.collect()) == sorted({find(k) for k in range(len(texts))})


def test_thousands_of_open_pairs_near_the_threshold(spark):
    """Of planted pairs about similarity 0.8 that share a band, all similar ones are found, and no others."""
    rng = np.random.default_rng(21)
    rows, want = [], set()
    for pair in range(3000):
        common, extra = int(rng.integers(150, 260)), rng.integers(0, 6)
        apart = max(2, round(common / 4) + int(extra) - 3)  # common / (common + apart) is about 0.8
        shingles = np.unique(rng.integers(0, 2**64, common + apart, np.uint64))
        rng.shuffle(shingles)
        a, b = np.sort(shingles[: common + apart // 2]), np.sort(np.concatenate((shingles[:common], shingles[common + apart // 2 :])))
        made = []
        for k, x in enumerate((a, b)):
            bands, sketch = simhash.set_bands(x)
            made.append(bands)
            node = pair * 2 + k
            rows += [(band, int(v), node, node, len(x), bytearray(sketch), bands.tolist(), x.view(np.int64).tolist()) for band, v in enumerate(bands)]
        both = len(np.intersect1d(a, b))
        if (made[0] == made[1]).any() and both * 5 >= (len(a) + len(b) - both) * 4:
            want.add((pair * 2, pair * 2 + 1))
    schema = "band int, value long, node long, root long, size long, sketch binary, bands array<long>, shingles array<long>"
    import pandas as pd

    members = spark.createDataFrame(pd.DataFrame(rows, columns=[x.split()[0] for x in schema.split(", ")]), schema)
    hot = members.groupBy("band", "value").count().where("count > 1")
    got = {tuple(r) for r in simhash.similar_members(members.join(hot.select("band", "value"), ["band", "value"]), ["band", "value"]).collect()}
    assert got == want and 1000 < len(want) < 2900


def test_members_without_partners_are_out(spark):
    rows = [(1, 1, 10, list(range(10))), (2, 2, 10, list(range(2, 12))), (3, 2, 10, list(range(2, 12))), (4, 4, 10, [*range(7), 90, 91, 92]), (5, 5, 2, [100, 101]), (6, 5, 2, [100, 101]), (7, 7, 0, [])]
    df = spark.createDataFrame(rows, "node long, root long, size long, shingles array<long>")
    assert sorted(r.node for r in simhash.with_partners(df).collect()) == [1, 2, 3]


def test_stage_joins_what_fingerprints_link(spark):
    """Operator 10's links, verified on the shingles, hold where no band is shared; a link of other shingles doesn't."""
    rng = random.Random(31)
    base = [f"w{rng.randrange(9000)}" for _ in range(400)]
    copy, loop, alone = [*base[:-1], "end"], [f"r{k}" for k in range(7)], [f"x{k}" for k in range(90)]
    texts = [" ".join(x) for x in (base, copy, base, loop * 50 + ["a", "b"], loop * 50 + ["c", "d", "e"], alone)]
    assert (fingerprint(texts[0]) ^ fingerprint(texts[1])).bit_count() <= 4 and (fingerprint(texts[3]) ^ fingerprint(texts[4])).bit_count() <= 4
    rows = simhash.saved(simhash.with_sets(simhash.keyed(documents(spark, texts))), "test-sets")
    node = {r.doc_id: r.node for r in rows.collect()}
    pair = lambda a, b: (min(node[a], node[b]), max(node[a], node[b]))
    linked = simhash.fingerprint_pairs(rows.drop("text"))
    assert {tuple(r) for r in linked.collect()} == {pair(0, 1), pair(3, 4)}
    sets = rows.dropDuplicates(["node"]).selectExpr("node", "size", "transform(bands, (v, k) -> xxhash64(node, k)) AS bands", "sketch")
    found = simhash.set_components(sets, rows.select("node", "text").dropDuplicates(["node"]), linked)
    assert {tuple(r) for r in found.collect()} == {(n, pair(0, 1)[0]) for n in pair(0, 1)}
