"""Operator 10, SimHash near-dedup by a generalised pigeonhole.

A fingerprint bit is set if it is set in over half of the 64-bit hashes of a text's word shingles, repeats included. Fingerprints that differ in
`most_bits` bits at most are linked. The 64 bits are split into partitions of correlated bits. If units u_1 + ... + u_m = most_bits + 1 are
dealt to the partitions, two linked fingerprints differ by less than u_i bits in some partition i: else they differed in most_bits + 1 bits. So
every fingerprint is indexed by its value in each partition with units, is probed with all values less than u_i bits away, and candidates are
verified on all 64 bits. How many partitions there are and how many units each gets (none, for some) is found by dynamic programming on the
estimated numbers of index rows and candidates, from the counts of single bits and of pairs of bits over all fingerprints.

Only distinct fingerprints are searched. A value that more than BLOCK of them share is cut into blocks, and each pair of blocks is verified on
its own, so no group is gathered in one task; of the links within a group only a spanning forest is kept. Connected components are found by
alternating large and small stars.

Cases: a null or empty text has fingerprint zero, which is linked like any other; a component of documents without doc_id has none; repeated rows
are documents of their own, in one component; an empty table gives no rows; columns other than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from forumetry.llm.common import add_columns, join_counted, keyed, of_keys, saved, slices, table

BITS, SEED = 64, 42
#: Words of a shingle, and differing bits of linked fingerprints at most.
WORDS, MOST_BITS = 4, 4
#: Fingerprints of a group that are compared at once, at most twice as many.
BLOCK = 1024
#: What an index or probe row costs, and what a candidate costs, in about microseconds.
ROW_COST, CANDIDATE_COST = 1.0, 0.01
#: Hashes whose bits are unpacked at once, and candidates that are verified at once.
AT_ONCE = 1 << 17
#: The pipeline's stage: words of a shingle and Jaccard similarity of linked documents, in hundredths.
SET_WORDS, SIMILAR = 5, 80
#: MinHash bands and permutations in each: a pair of similarity 0.8 is missed by all bands with a probability of 5e-5.
BANDS, BAND = 25, 5
#: Places of two sketches (the low bytes of all least hashes) that must agree before a pair is verified: of similarity 0.8 100 do in the mean, with a
#: deviation of 4.5, so by calculation a similar pair is lost with a probability of 1e-6.
LIKELY = 78
#: Shingles of a block of sets at most, unless one set has more.
BLOCK_SHINGLES = 1 << 18
FLIPS, FACTORS = np.random.default_rng(SEED).integers(0, 1 << 63, (2, BANDS * BAND), np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_hashes(text: str, words: int = WORDS) -> list[int]:
    """Hashes of the word shingles of a text, ASCII letters in lower case; of the whole sequence, if it has fewer words."""
    found = text.encode("utf-8", "replace").lower().split()
    if not found:
        return []
    data, ends = b" ".join(found), np.cumsum([len(x) + 1 for x in found]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(words, len(found))
    digest = xxhash.xxh64_intdigest
    return [digest(data[a:b], SEED) for a, b in zip(starts[: len(found) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)]


def majority(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Fingerprints of texts from their hashes, one text after the other."""
    counts = np.zeros((len(sizes), BITS), np.int64)
    which = np.repeat(np.arange(len(sizes)), sizes)
    for at in range(0, len(hashes), AT_ONCE):
        bits = np.unpackbits(hashes[at : at + AT_ONCE].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        of = which[at : at + AT_ONCE]
        first = np.flatnonzero(np.diff(of, prepend=-1))
        counts[of[first]] += np.add.reduceat(bits, first, axis=0, dtype=np.int32)
    return np.packbits(counts * 2 > sizes[:, None], axis=1, bitorder="little").view("<u8").ravel()


def fingerprints(texts: list[str], words: int = WORDS) -> np.ndarray:
    lists = [shingle_hashes(x, words) for x in texts]
    return majority(np.array([h for x in lists for h in x], np.uint64), np.array([len(x) for x in lists], np.int64))


def with_fingerprints(docs: DataFrame, words: int = WORDS, text: str = "text") -> DataFrame:
    """docs with `fingerprint`, the 64 bits as a long."""

    def make(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        return {"fingerprint": pa.array(fingerprints([x or "" for x in batch[text].to_pylist()], words).view(np.int64))}

    return add_columns(docs, make, {"fingerprint": "long"})


def bit_counts(prints: DataFrame) -> tuple[int, np.ndarray]:
    """How many fingerprints there are, and in how many of them each pair of bits is set, over all of them. 4096 sums come to the driver."""

    def run(batches):
        total, n = np.zeros((BITS, BITS)), 0
        for batch in batches:
            bits = np.unpackbits(batch["fingerprint"].to_numpy().astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            total, n = total + bits.T @ bits, n + len(bits)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, BITS * BITS, dtype=np.int32)), pa.array(np.concatenate(([n], total.ravel())).astype(np.int64))], names=["cell", "n"])

    sums = dict(map(tuple, prints.select("fingerprint").mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n")).collect()))
    return sums.get(-1, 0), np.array([sums.get(k, 0) for k in range(BITS * BITS)], np.float64).reshape(BITS, BITS)


def grouped_bits(correlation: np.ndarray, groups: int) -> list[list[int]]:
    """The bits in groups of about equal size; each starts with a free pair of the strongest correlation and takes the bits closest to it."""
    free, out = set(range(BITS)), []
    for g in range(groups):
        size = -(-len(free) // (groups - g))
        rest = sorted(free)
        pick = [max(rest, key=lambda b: max([correlation[b, c] for c in rest if c != b], default=0))]
        while len(pick) < size:
            pick.append(max((b for b in rest if b not in pick), key=lambda b: correlation[b, pick].sum()))
        out.append(sorted(pick))
        free -= set(pick)
    return out


def near_share(n: int, both: np.ndarray, bits: list[int], width: int) -> list[float]:
    """Share of all pairs of fingerprints that differ in 0, at most 1, ... at most width - 1 of the bits.

    The mean and variance of a random pair's distance follow from the counts; a beta-binomial distribution with both is taken.
    """
    p, n = both.diagonal() / max(n, 1), max(n, 1)
    mean = variance = 0.0
    for i in bits:
        q = 2 * p[i] * (1 - p[i])
        mean, variance = mean + q, variance + q * (1 - q)
    for i, j in combinations(bits, 2):
        p11 = both[i, j] / n
        p10, p01 = p[i] - p11, p[j] - p11
        differ = 2 * (p11 * (1 - p11 - p10 - p01) + p10 * p01)
        variance += 2 * (differ - 4 * p[i] * (1 - p[i]) * p[j] * (1 - p[j]))
    w = len(bits)
    rate = min(max(mean / w, 1e-9), 1 - 1e-9)
    spread = variance / max(w * rate * (1 - rate), 1e-12)
    rho = min(max((spread - 1) / max(w - 1, 1), 1e-9), 0.999)
    a, b = rate * (1 / rho - 1), (1 - rate) * (1 / rho - 1)
    share, out = 1.0, []
    for k in range(w):
        share *= (b + k) / (a + b + k)  # no bit differs
    total = 0.0
    for d in range(width):
        total += share
        out.append(min(total, 1.0))
        share *= (w - d) / (d + 1) * (a + d) / max(b + w - d - 1, 1e-12) if d < w else 0.0
    return out


def plan(n: int, both: np.ndarray, most_bits: int = MOST_BITS) -> list[tuple[int, int]]:
    """(mask of a partition's bits, its units) with most_bits + 1 units in all, at the least estimated cost."""
    n = max(n, 1)
    p = both.diagonal() / n
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    correlation = np.abs(both / n - np.outer(p, p)) / np.outer(spread, spread)
    np.fill_diagonal(correlation, 0)
    units, best = most_bits + 1, None
    for m in range(1, min(units, BITS) + 1):
        groups = grouped_bits(correlation, m)
        table_ = {0: (0.0, ())}
        for g in groups:
            near, w = near_share(n, both, g, units), len(g)
            cost = [0.0] * (units + 1)
            for u in range(1, units + 1):
                rows = sum(comb(w, d) for d in range(u))
                cost[u] = n * rows * ROW_COST + n * n * near[u - 1] * (0.5 if u == 1 else 1.0) * CANDIDATE_COST
            table_ = {
                k: min(((c + cost[k - j], (*t, k - j)) for j, (c, t) in table_.items() if 0 <= k - j), key=lambda x: x[0])
                for k in range(units + 1)
            }
        total, dealt = table_[units]
        if best is None or total < best[0]:
            best = total, [(sum(1 << b for b in g), u) for g, u in zip(groups, dealt, strict=True) if u]
    return best[1]


def signed(x: int) -> int:
    return x - (1 << BITS) if x >> BITS - 1 else x


def key_rows(prints: DataFrame, parts: list[tuple[int, int]]) -> DataFrame:
    """(part, value, fingerprint, own): each fingerprint by its own value in every partition, and by those less than the units away."""
    made = []
    for k, (mask, units) in enumerate(parts):
        bits = [b for b in range(BITS) if mask >> b & 1]
        made += [(k, signed(mask), signed(sum(1 << b for b in some)), not some) for d in range(units) for some in combinations(bits, d)]
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("part"), F.lit(m).cast("long").alias("mask"), F.lit(f).cast("long").alias("flip"), F.lit(o).alias("own")) for k, m, f, o in made)))
    rows = prints.select("fingerprint", each.alias("p"))
    return rows.select("p.part", F.col("fingerprint").bitwiseAND(F.col("p.mask")).bitwiseXOR(F.col("p.flip")).alias("value"), "fingerprint", "p.own")


def forest(own: np.ndarray, probes: np.ndarray, most_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect whatever links within `own` and between it and `probes` connect, found breadth first; no more links than members."""
    members, is_own = np.concatenate((own, probes)), np.arange(len(own) + len(probes)) < len(own)
    rest = np.arange(len(members))
    left, right = [], []
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            near = np.bitwise_count(members[rest] ^ members[x]) <= most_bits
            if not is_own[x]:
                near &= is_own[rest]
            found = rest[near]
            rest = rest[~near]
            queue += found.tolist()
            left.append(np.full(len(found), members[x]))
            right.append(members[found])
    return (np.concatenate(left), np.concatenate(right)) if left else (members[:0], members[:0])


def split_lists(column: pa.Array) -> list[np.ndarray]:
    flat, ends = column.flatten().to_numpy().view(np.uint64), np.cumsum(column.value_lengths().to_numpy())
    return np.split(flat, ends[:-1])


def verified(groups: pa.RecordBatch, most_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of groups (own, probes: lists of fingerprints). All pairs with an own member are compared, many groups at once."""
    lists = list(zip(*(split_lists(groups[c]) for c in ("own", "probes")), strict=True))
    left, right = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
    at = 0
    while at < len(lists):
        stop, pairs = at, 0
        while stop < len(lists) and (stop == at or pairs < 4 * AT_ONCE):
            own, probes = lists[stop]
            pairs += len(own) * (len(own) + len(probes))
            stop += 1
        some = lists[at:stop]
        own_n, all_n = np.array([len(a) for a, _ in some]), np.array([len(a) + len(b) for a, b in some])
        members = np.concatenate([x for ab in some for x in ab])
        ends = np.cumsum(all_n)
        place = np.arange(len(members)) - np.repeat(ends - all_n, all_n)
        partners = np.where(place < np.repeat(own_n, all_n), np.repeat(all_n, all_n) - place - 1, 0)
        a = np.repeat(np.arange(len(members)), partners)
        b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(partners) - partners, partners)
        hit = np.flatnonzero(np.bitwise_count(members[a] ^ members[b]) <= most_bits)
        a, b = a[hit], b[hit]
        group = np.searchsorted(ends, a, side="right")
        many = np.bincount(group, minlength=len(some)) >= all_n
        plain = ~many[group]
        left.append(members[a[plain]])
        right.append(members[b[plain]])
        for k in np.flatnonzero(many):
            x, y = forest(*some[k], most_bits)
            left.append(x)
            right.append(y)
        at = stop
    return np.concatenate(left), np.concatenate(right)


def linked(prints: DataFrame, most_bits: int = MOST_BITS, block: int = BLOCK) -> DataFrame:
    """(a, b): links between distinct fingerprints that connect whatever differs in `most_bits` bits at most. prints should be saved."""
    n, both = bit_counts(prints)
    rows = key_rows(prints, plan(n, both, most_bits))
    by = ["part", "value"]
    counts = rows.groupBy(by).agg(F.count("*").alias("n"), F.max("own").alias("owned")).where("n > 1 AND owned").drop("owned")
    met = join_counted(rows, saved(counts, "fingerprint-values"), by, "n")
    # a large group is cut into blocks; a pair of blocks holds all members of both
    blocks = F.ceil(F.col("n") / block).cast("int")
    met = met.withColumn("blocks", blocks).withColumn("own_block", F.pmod(F.xxhash64("fingerprint"), F.col("blocks")).cast("int"))
    others = F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(F.array_remove(F.sequence(F.lit(0), F.col("blocks") - 1), F.col("own_block")))
    pairs = met.withColumn("other", F.explode(others)).withColumns({"low": F.least("own_block", "other"), "high": F.greatest("own_block", "other")})
    groups = pairs.groupBy(*by, "low", "high").agg(
        F.collect_list(F.when(F.col("own"), F.col("fingerprint"))).alias("own"), F.collect_list(F.when(~F.col("own"), F.col("fingerprint"))).alias("probes")
    )

    def run(batches):
        for batch in slices(batches):
            a, b = verified(batch, most_bits)
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    return groups.select("own", "probes").mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of links (a, b): root is the least node of its connected component.

    Large and small stars by turns: every node's greater neighbours, then its smaller ones, are linked to its least neighbour. No task gets all
    links of a node: minima are combined before the shuffle, and nodes of many links get theirs by broadcast.
    """

    def stars(edges: DataFrame, greater: bool) -> DataFrame:
        least = edges.groupBy("u").agg(F.min("v").alias("least"), F.count("*").alias("n"))
        least = saved(least.select("u", F.least("least", "u").alias("least"), "n"), "least-neighbours")
        met = join_counted(edges, least, ["u"], "n")
        if greater:
            return met.where("v > u").select(F.col("v").alias("u"), F.col("least").alias("v"))
        return met.select(F.when(F.col("v") == F.col("least"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("least").alias("v"))

    def settled(edges: DataFrame) -> tuple[DataFrame, tuple]:
        kept = saved(edges.where("u <> v").distinct(), "stars")
        return kept, tuple(kept.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())

    edges, mark = settled(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")))
    while mark[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        wide = saved(stars(both, True).where("u <> v").distinct(), "large-stars")
        edges, now = settled(stars(wide, False))
        if now == mark:
            break
        mark = now
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def near_duplicates(docs: DataFrame, words: int = WORDS, most_bits: int = MOST_BITS) -> DataFrame:
    """(doc_id, key, fingerprint, component_id, first) of every row: 16 hex digits, the least doc_id of its component, and whether the row has
    that doc_id and, of those that have it, the least text hash."""
    own = saved(with_fingerprints(keyed(docs), words).drop("text"), "fingerprints")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("least")
    prints = saved(own.groupBy("fingerprint").agg(least, F.count("*").alias("n")), "distinct-fingerprints")
    found = saved(components(linked(prints.select("fingerprint"), most_bits)), "fingerprint-components")
    roots = prints.join(found.select(F.col("node").alias("fingerprint"), "root"), "fingerprint", "left")
    rooted = saved(roots.withColumn("root", F.coalesce("root", "fingerprint")), "rooted-fingerprints")
    whole = saved(rooted.groupBy("root").agg(F.min("least").alias("least"), F.count("*").alias("prints")), "components")
    of = join_counted(rooted.select("fingerprint", "root", "n"), whole, ["root"], "prints").select("fingerprint", "n", "least")
    met = join_counted(own, saved(of, "fingerprint-documents"), ["fingerprint"], "n")
    first = F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & (F.col("key") == F.col("least.key"))
    return met.select("doc_id", "key", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), F.col("least.doc_id").alias("component_id"), first.alias("first"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def set_bands(hashes: np.ndarray) -> tuple[np.ndarray, bytes]:
    """A value a band: least permuted hashes of BAND permutations each, mixed. Sets of similarity s share one with 1 - (1 - s ** BAND) ** BANDS.
    And the low bytes of all least hashes, of which a share of about s is equal."""
    least = np.full(BANDS * BAND, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 4096):
        some = hashes[at : at + 4096]
        for k in range(len(least)):
            least[k] = min(least[k], ((some ^ FLIPS[k]) * FACTORS[k]).min())
    bands = np.array([xxhash.xxh64_intdigest(x.tobytes(), SEED) for x in least.reshape(BANDS, BAND)], np.uint64).view(np.int64)
    return bands, (least & np.uint64(255)).astype(np.uint8).tobytes()


def shingle_set(text: str) -> np.ndarray:
    return np.unique(np.array(shingle_hashes(text, SET_WORDS), np.uint64))


def with_sets(docs: DataFrame) -> DataFrame:
    """docs with `fingerprint`, operator 10's, `node`, a hash of the set of five-word shingles, `size`, how many there are, `bands`, and `sketch`."""

    def make(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        texts = [x or "" for x in batch["text"].to_pylist()]
        sets = [shingle_set(x) for x in texts]
        node = np.array([xxhash.xxh64_intdigest(x.tobytes(), SEED) for x in sets], np.uint64).view(np.int64)
        made = [set_bands(x) if len(x) else ([], b"") for x in sets]
        bands, sketch = pa.array([x for x, _ in made], pa.list_(pa.int64())), pa.array([x for _, x in made], pa.binary())
        prints = pa.array(fingerprints(texts).view(np.int64))
        return {"fingerprint": prints, "node": pa.array(node), "size": pa.array([len(x) for x in sets], pa.int64()), "bands": bands, "sketch": sketch}

    return add_columns(docs, make, {"fingerprint": "long", "node": "long", "size": "long", "bands": "array<long>", "sketch": "binary"})


def fingerprint_pairs(rows: DataFrame, most_bits: int = MOST_BITS) -> DataFrame:
    """(a, b): the pairs of sets that operator 10 links, of rows (fingerprint, node), which should be saved. A fingerprint stands for its least set, and
    other sets of the same fingerprint meet that one."""
    prints = saved(rows.groupBy("fingerprint").agg(F.min("node").alias("least"), F.count("*").alias("n")), "distinct-fingerprints")
    equal = join_counted(rows.select("fingerprint", "node"), prints, ["fingerprint"], "n").select(F.col("node").alias("a"), F.col("least").alias("b"))
    links = saved(linked(prints.select("fingerprint"), most_bits).distinct(), "fingerprint-links")

    def of(end: str) -> DataFrame:
        used = links.groupBy(F.col(end).alias("fingerprint")).agg(F.count("*").alias("links"))
        return saved(prints.join(used, "fingerprint").select(F.col("fingerprint").alias(end), F.col("least").alias(f"node_{end}"), "links"), "linked-fingerprints")

    met = join_counted(join_counted(links, of("a"), ["a"], "links").drop("links"), of("b"), ["b"], "links")
    both = equal.unionByName(met.select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))).where("a <> b")
    return both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def shingle_sets(docs: DataFrame) -> DataFrame:
    """docs with `shingles`, the set itself."""
    return add_columns(docs, lambda batch: {"shingles": pa.array([shingle_set(x or "").view(np.int64) for x in batch["text"].to_pylist()], pa.list_(pa.int64()))}, {"shingles": "array<long>"})


def similar(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b), which should be saved, of similarity SIMILAR or more, counted on the shingles of texts (node, text)."""
    ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).groupBy("node").count()
    sets = saved(shingle_sets(texts.join(ends, "node")).drop("text"), "candidate-sets")
    side = lambda name: sets.select(F.col("node").alias(name), F.col("shingles").alias(f"{name}_set"), "count")
    met = join_counted(pairs, side("a"), ["a"], "count").drop("count")
    met = join_counted(met, side("b"), ["b"], "count")
    both, sizes = F.size(F.array_intersect("a_set", "b_set")), F.size("a_set") + F.size("b_set")
    return met.where(both * 100 >= (sizes - both) * SIMILAR).select("a", "b")


def close_in_size(a: Column, b: Column) -> Column:
    """Sets of that similarity cannot differ more in size."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * SIMILAR


def set_components(sets: DataFrame, texts: DataFrame, by_print: DataFrame) -> DataFrame:
    """(node, root) of the sets (node, size, bands, sketch) that have similar ones; root is the least node of the component.

    The pairs by_print (a, b), which SimHash links, are verified. For what differs in more bits, every member of a band's group meets one of them: so most of a large group of near copies costs its members, not its pairs. What is
    then still in different components is compared with the members of other components in its groups, inside a task for each pair of blocks;
    only links are made rows, and none is lost.
    """
    rows = sets.select("node", "size", F.posexplode("bands").alias("band", "value"))
    by = ["band", "value"]
    center = F.min_by(F.struct("node", "size"), F.xxhash64("node")).alias("c")
    groups = saved(rows.groupBy(by).agg(center, F.count("*").alias("n")).where("n > 1"), "band-groups")
    met = saved(join_counted(rows, groups, by, "n").drop("n"), "band-members")
    pairs = met.where((F.col("node") != F.col("c.node")) & close_in_size(F.col("size"), F.col("c.size")))
    pairs = pairs.select(F.least("node", "c.node").alias("a"), F.greatest("node", "c.node").alias("b"))
    pairs = saved(pairs.unionByName(by_print).distinct(), "candidates")
    links = saved(similar(pairs, texts), "links")
    roots = saved(components(links), "link-components")
    placed = saved(met.drop("c").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "placed-members")
    several = placed.groupBy(by).agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select(*by)
    open_ = saved(placed.join(several, by, "left_semi"), "open-members")
    nodes = saved(open_.groupBy("node").count(), "open-nodes")
    full = saved(shingle_sets(texts.join(nodes.select("node"), "node")).drop("text"), "open-sets")
    left = saved(with_partners(full.join(open_.select("node", "root", "size").distinct(), "node")), "open-with-partners")
    full = full.join(sets.select("node", "sketch", "bands"), "node").join(nodes, "node").join(left, "node")
    in_groups = join_counted(open_, saved(full, "open-sketches"), ["node"], "count").drop("count")
    return components(links.unionByName(similar_members(in_groups, by)))


def with_partners(members: DataFrame) -> DataFrame:
    """(node) of the members (node, root, size, shingles) that may be similar to one of another root: SIMILAR hundredths of a set's shingles must be
    found under other roots too. What is mostly a passage that many documents share, with words of its own, is out; no similar pair is."""
    rows = saved(members.select("node", "root", "size", F.explode("shingles").alias("shingle")), "open-shingles")
    facts = rows.groupBy("shingle").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n")).where("low <> high")
    shared = join_counted(rows.select("node", "size", "shingle"), saved(facts.select("shingle", "n"), "shared-shingles"), ["shingle"], "n")
    return shared.groupBy("node", "size").count().where(F.col("count") * 100 >= F.col("size") * SIMILAR).select("node")


def similar_members(members: DataFrame, by: list[str]) -> DataFrame:
    """(a, b): the pairs of similarity SIMILAR or more and of different roots within the groups of members (band, value, node, root, size, sketch,
    bands, shingles). A group is cut into blocks by its members and their shingles, and each pair of blocks is compared in a task of its own: by sizes
    and sketches first, and where these allow it by the shingles themselves. A pair is compared in the first band that it shares. Only links
    leave the task."""
    counts = members.groupBy(by).agg(F.count("*").alias("n"), F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("size") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    met = join_counted(members, saved(counts, "open-groups"), by, "n")
    met = met.withColumn("own_block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    pairs = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = pairs.withColumns({"low": F.least("own_block", "other"), "high": F.greatest("own_block", "other")})
    groups = pairs.groupBy(*by, "low", "high").agg(F.collect_list(F.struct("node", "root", "size", "sketch", "bands", "shingles", "own_block")).alias("p"))

    def links(band: int, p: pa.StructArray, apart: bool) -> Iterator[tuple[int, int]]:
        node, root, size, own = (p.field(c).to_numpy() for c in ("node", "root", "size", "own_block"))
        marks = np.frombuffer(b"".join(p.field("sketch").to_pylist()), np.uint8).reshape(len(node), BANDS, BAND)
        values = p.field("bands").flatten().to_numpy().reshape(len(node), BANDS)
        sets = [x.values.to_numpy() for x in p.field("shingles")]
        for k in range(len(node) - 1):
            rest = slice(k + 1, None)
            fits = (root[rest] != root[k]) & (np.minimum(size[rest], size[k]) * 100 >= np.maximum(size[rest], size[k]) * SIMILAR)
            near = np.flatnonzero(fits & (own[rest] != own[k]) if apart else fits) + k + 1
            first = (values[near] == values[k]).argmax(axis=1) == band  # the group's own band is one they share
            near = near[first]
            near = near[(marks[near] == marks[k]).sum(axis=(1, 2)) >= LIKELY]
            for j in near.tolist():
                both = len(np.intersect1d(sets[k], sets[j], assume_unique=True))
                if both * 100 >= (size[k] + size[j] - both) * SIMILAR:
                    yield min(int(node[k]), int(node[j])), max(int(node[k]), int(node[j]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = []
            for band, low, high, p in zip(batch["band"].to_pylist(), batch["low"].to_pylist(), batch["high"].to_pylist(), batch["p"], strict=True):
                found.extend(links(band, p.values, low != high))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return groups.select("band", "low", "high", "p").mapInArrow(run, "a long, b long").distinct()


def similar_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, key, first) of every row: whether it has the least doc_id of its component and, of those that have it, the least text hash."""
    texts = keyed(docs)
    own = saved(with_sets(texts).drop("text"), "shingle-sets")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("least")
    sets = saved(own.groupBy("node").agg(F.first("size").alias("size"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"), least, F.count("*").alias("n")), "distinct-sets")
    # the text of a set is that of its least row; equal rows have equal texts
    of_set = sets.select("node", F.col("least.doc_id").alias("doc_id"), F.col("least.key").alias("key"))
    of_set = texts.join(of_set, texts["doc_id"].eqNullSafe(of_set["doc_id"]) & (texts["key"] == of_set["key"])).select("node", "text").dropDuplicates(["node"])
    found = saved(set_components(sets.drop("least", "n"), of_set, fingerprint_pairs(own)), "set-components")
    rooted = sets.select("node", "least", "n").join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))
    rooted = saved(rooted, "rooted-sets")
    whole = saved(rooted.groupBy("root").agg(F.min("least").alias("least"), F.count("*").alias("sets")), "whole-components")
    of = join_counted(rooted.select("node", "root", "n"), whole, ["root"], "sets").select("node", "n", "least")
    met = join_counted(own.select("doc_id", "key", "node"), saved(of, "set-documents"), ["node"], "n")
    return met.select("doc_id", "key", (F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & (F.col("key") == F.col("least.key"))).alias("first"))


def keep_first(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each group of near copies, that of the least doc_id; of repeated rows, one.

    Operator 10 links fingerprints (four words, four bits), and each link is verified: near copies have a Jaccard similarity of 0.8 or more on
    five-word shingles. Such copies may differ in 14 bits and more, too many for a pigeonhole, so MinHash bands propose more pairs, which are
    verified too.
    """
    found = saved(similar_documents(docs), "near-duplicates")
    gone = saved(found.where(~F.col("first")).select("doc_id", "key"), "later-copies")
    again = saved(found.where("first").groupBy("doc_id", "key").count().where("count > 1").select("doc_id", "key"), "repeated-rows")
    kept = of_keys(docs, gone, "left_anti")
    if again.isEmpty():
        return kept
    numbered = of_keys(kept, again, "left_semi").dropDuplicates(["doc_id", "text"])
    return of_keys(kept, again, "left_anti").unionByName(numbered)
