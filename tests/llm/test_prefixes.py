import hashlib
import random
import zlib

from forumetry.llm import prefixes

from .helpers import TEXTS, store

SCHEMA = "conv_id long, turn long, role string, text string"


def rebuilt(rows):
    convs = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            convs.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    for turns in convs.values():
        turns.sort()
    out = {}
    for c in convs:
        h = zlib.crc32(str(c).encode()) % 9
        base = c - abs(c) % 5 * (1 if c >= 0 else -1)
        out[c] = tuple(t[2:] for t in convs.get(base, [])[:h] + convs[c][h:])
    return out


def brute(paths):
    """All nodes, each with its subtree walked."""
    members = {}
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append(c)
    out = []
    for node, own in members.items():
        d = len(node)
        children = [k for k in members if len(k) == d + 1 and k[:d] == node]
        below = [k for k in members if k[:d] == node]
        leaves = [k for k in below if not any(len(x) == len(k) + 1 and x[: len(k)] == k for x in below)]
        saved = sum((len(members[k]) - 1) * len(k[-1][1].encode()) for k in below if k)
        ends = ",".join(str(c) for c in sorted(own) if len(paths[c]) == d)
        parent = min(members[node[:-1]]) if node else None
        out.append((min(own), d, parent, len(own), len(children), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def read(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def hard_rows():
    rnd = random.Random(4)
    rows = [(k // 3 - 5, k % 3, ("user", None, "assistant")[k % 3], x) for k, x in enumerate(TEXTS)]
    for c in range(40, 90):
        rows += [(c, k if rnd.random() < 0.9 else None, "user", rnd.choice(["a", "b", "é", None])) for k in range(rnd.randrange(12))]
    rows += [(c, k, "user", f"same {k}") for c in range(100, 130) for k in range(c % 4 + 9)]  # copies, and paths that go on
    rows += [(200, 1, "user", "x")] * 3 + [(None, 0, "user", "of none"), (None, None, None, None), (10**17, 0, "a", "bc"), (10**17 + 5, 0, "ab", "c")]
    return rows


def test_query_equals_brute_force(spark, tmp_path):
    rows = hard_rows()
    folder = store(spark.createDataFrame(rows, SCHEMA).repartition(7).selectExpr("*", "1 AS n", "2 AS depth", "3 AS bytes", "4 AS part"), tmp_path, "conversations")
    got = prefixes.op12_prefix_trie(spark, folder)
    assert got.dtypes == [(c, "bigint") for c in "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens".split()] + [("ends_sha256", "string")]
    assert read(got) == brute(rebuilt(rows))


def test_blocks_pieces_and_partitions(spark, tmp_path, monkeypatch):
    """Conversations over many blocks and range partitions, and lists of many pieces, give the same nodes."""
    rnd = random.Random(6)
    rows = [(c, k, "user", rnd.choice("ab") if c % 3 == 0 and k > 12 else f"same {k}") for c in range(60) for k in range(23 - c % 3)]
    rows += [(7, k, "user", f"more {k}") for k in range(22, 300)]
    monkeypatch.setattr(prefixes, "BLOCK", 4)
    monkeypatch.setattr(prefixes, "PIECE", 3)
    monkeypatch.setattr(prefixes, "FEW_ROWS", 10)
    was = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        turns = prefixes.saved(prefixes.numbered(spark.createDataFrame(rows, SCHEMA)), "numbered")
        assert sorted((r.conv_id, r.pos) for r in turns.collect()) == sorted((c, k + 1) for c, k, _, _ in rows)
        whole = {}
        for c, _, role, text in rows:
            whole[c] = (*whole.get(c, ()), (role, text))
        assert read(prefixes.trie(prefixes.whole_paths(turns))) == brute(whole)
        assert read(prefixes.trie(prefixes.rebuilt(turns))) == brute(rebuilt(rows))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", was)


def test_many_equal_conversations_and_long_ones(spark):
    rows = spark.range(3000).selectExpr("id AS conv_id", "0L AS turn", "'user' AS role", "'hello' AS text")
    long = spark.range(5000).selectExpr("-7L AS conv_id", "id AS turn", "'user' AS role", "IF(id = 9, repeat('é', 1000000), 'x') AS text")
    found = prefixes.trie(prefixes.whole_paths(prefixes.saved(prefixes.numbered(rows.unionByName(long)), "numbered")))
    by = {(r.conv_id, r.depth): tuple(r)[2:] for r in found.collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert len(by) == 5002
    assert by[0, 1] == (-7, 3000, 0, 1, 2999 * 5, sha(",".join(map(str, range(3000)))))
    assert by[-7, 0] == (None, 3001, 2, 2, 2999 * 5, sha(""))
    assert by[-7, 5000] == (-7, 1, 0, 1, 0, sha("-7")) and by[-7, 4999] == (-7, 1, 1, 1, 0, sha(""))


def test_empty_table(spark, tmp_path):
    assert prefixes.op12_prefix_trie(spark, store(spark.createDataFrame([], SCHEMA), tmp_path, "conversations")).count() == 0
