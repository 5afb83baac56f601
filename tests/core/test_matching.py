import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from forumetry.operators import matching

START = datetime(2026, 4, 1)


def brute(left, right):
    found = {}
    for a, t, at in left:
        fits = [
            b for b, u, other in right
            if t and u and (u.startswith(t[:60]) or t.startswith(u[:60])) and (at is None or other is None or abs(at - other) <= timedelta(hours=1))
        ]
        if fits:
            found[a] = min(fits)
    return found


def nested(rng, n):
    rows = []
    for k in range(n):
        base = "".join(rng.choice("ab") for _ in range(3)) + "c" * rng.randrange(80) if rng.random() < 0.8 else "x" * rng.randrange(90)
        rows.append((k, rng.choice([base, base[: rng.randrange(1, 70)], "é" + base, None, ""]), None if rng.random() < 0.2 else START + timedelta(minutes=rng.randrange(400))))
    return rows


@pytest.mark.parametrize("partitions", [1, 13])
def test_matching_equals_brute_force(spark, partitions):
    rng = random.Random(partitions)
    left, right = nested(rng, 150), nested(rng, 130)
    was = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        frame = lambda rows: spark.createDataFrame(rows, "id long, text string, at timestamp")
        got = {r.left_id: r.right_id for r in matching.match_posts(frame(left), frame(right)).collect()}
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    assert got == brute(left, right) and len(got) > 50


def test_beginnings_across_partitions(spark):
    texts = ["a" * k for k in range(1, 61)] + ["aab", "b", "bé", "bé漢"]
    rows = [(t, int(k % 2 == 0), int(k % 3 == 0)) for k, t in enumerate(texts)]
    was = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", 9)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = {r.t: (r.of_left, r.of_right) for r in matching.beginnings(spark.createDataFrame(rows, "t string, left int, right int")).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for t in texts:
        want = [sum(side << (len(u) - 1) for u, *s in rows if t.startswith(u) for side in [s[k]]) for k in (0, 1)]
        assert got[t] == tuple(want), t


def test_a_text_that_most_posts_share_makes_no_pairs(spark):
    left = spark.range(20_000).select("id", F.lit("the same words of everyone").alias("text"), F.timestamp_seconds(F.col("id") * 5).alias("at"))
    right = left.withColumn("id", F.col("id") + 5)
    got = matching.match_posts(left, right)
    assert got.count() == 20_000 and got.where("right_id <> greatest(left_id - 720, 0) + 5").count() == 0


def test_beginnings_come_from_the_first_characters_where_these_are_sure(spark):
    long, cut = "word " * 2000, matching.FIRST
    texts = [None, "", "see more", long, "@someone " + "x" * 1000 + "\n" + long, " " * 1000 + long, "see more " * 100 + long, "a" * (cut - 4) + "see more" + long, "b " * 30 + " " * 600 + "see more c", "@x\n" * 200 + long]
    texts += ["y" * n + "\n" * (cut - n - 3) + " see more\n@handle\nend" for n in (55, 59, 61, 79, 81)]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for r in df.select(matching.beginning(F.col("text")).alias("got"), F.left(matching.canonical_post_text(F.col("text")), F.lit(matching.BLOCK)).alias("want")).collect():
        assert r.got == r.want
    assert matching.EDGE > len("see more")
