import random

from forumetry.operators import tours

SCHEMA = "thread string, comment_id long, parent_comment_id long, ord int"


def walked(rows):
    """Reading order by walking each tree; None on circles and below them."""
    threads = {}
    for t, c, p, o in rows:
        threads.setdefault(t, {})[c] = (p, o)
    out = {}
    for t, nodes in threads.items():
        below = {}
        for c, (p, o) in nodes.items():
            below.setdefault(p if p in nodes else None, []).append((o is not None, o or 0, c))
        stack, place = [(c, 0) for *_, c in sorted(below.get(None, []), reverse=True)], 0
        for c in nodes:
            out[t, c] = (None, None)
        while stack:
            c, depth = stack.pop()
            out[t, c] = (depth, place)
            place += 1
            stack += [(x, depth + 1) for *_, x in sorted(below.get(c, []), reverse=True)]
    return out


def got(df):
    return {(r.thread, r.comment_id): (r.depth, r.place) for r in df.collect()}


def test_random_trees_circles_and_orphans(spark):
    rng = random.Random(8)
    rows = []
    for t in "abcdef":
        n = rng.randrange(1, 60)
        rows += [(t, k, rng.choice([None, rng.randrange(n), k - 1, 0, 999]), rng.choice([None, 0, 1, 2])) for k in range(n)]
    rows += [("self", 1, 1, 0), ("self", 2, 1, 0), ("self", 3, None, 0)]
    assert got(tours.reading_order(spark.createDataFrame(rows, SCHEMA))) == walked(rows)


def test_deep_and_broad_threads_over_many_partitions(spark):
    rows = [("deep", k, k - 1 if k else None, 0) for k in range(700)] + [("broad", k, 0 if k else None, -k) for k in range(700)]
    rng = random.Random(3)
    rng.shuffle(rows)
    was = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", 7)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        assert got(tours.reading_order(spark.createDataFrame(rows, SCHEMA))) == walked(rows)
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)


def test_repeated_rows_and_nulls(spark):
    rows = [("t", 1, None, 5), ("t", 1, None, 5), ("t", 1, 2, 9), ("t", 2, 1, None), (None, None, None, None), (None, 7, 1, 0)]
    assert got(tours.reading_order(spark.createDataFrame(rows, SCHEMA))) == {("t", 1): (0, 0), ("t", 2): (1, 1), ("", 7): (0, 0)}
    assert tours.reading_order(spark.createDataFrame([], SCHEMA)).count() == 0
