import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from forumetry.llm import periods

from .helpers import TEXTS, documents, store


def brute(words):
    """(start, length, period) of all runs, by start, then period: every period is walked along the whole text."""
    found, n = {}, len(words)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            length = i - start + q
            if i > start and length >= max(6, 4 * q):
                found.setdefault((start, length), q)
            i += i == start
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda x: (x[0], x[2]))


def collapsed(words, found):
    dropped = {j for s, n, q in found for j in range(s + q, s + n)}
    return " ".join(w for j, w in enumerate(words) if j not in dropped)


def expected(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute(words)
    s, length, q = min(found, key=lambda x: (-x[1], x[0], x[2])) if found else (None,) * 3
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    milli = 1000 * length // q if found else None
    return (len(found), s, length, q, milli, sha("".join(f"{s},{n},{q}\n" for s, n, q in found)), sha(collapsed(words, found)))


def read(df):
    return {tuple(r)[0]: tuple(r)[1:] for r in df.collect()}


def test_query_equals_brute_force(spark, tmp_path):
    rnd = random.Random(3)
    texts = [*TEXTS, "a\x85b", "a\x85b ", "a b \u2028", "a \u2029 a\xa0a", "a  b\x0b" * 50 + "c"]
    for _ in range(300):
        alphabet = rnd.choice(["ab", "abc", "abcdefgh"])
        words = [rnd.choice(alphabet) for _ in range(rnd.randrange(60))]
        words += words[-rnd.randrange(1, 9) :] * rnd.randrange(9) + [rnd.choice(alphabet)] + words[:2] * rnd.randrange(5)
        texts.append(rnd.choice([" ", "\n", "\t \r"]).join(words))
    folder = store(documents(spark, texts, range(-3, len(texts) - 3)), tmp_path)
    got = read(periods.op11_periodic_runs(spark, folder))
    assert got == {k - 3: expected(k - 3, x) for k, x in enumerate(texts)}
    assert sum(v[0] > 1 for v in got.values()) > 50


def test_query_on_the_table(spark, sf):
    got = read(periods.op11_periodic_runs(spark, sf))
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    short = [r for r in rows if len(r.text or "") < 8000]
    assert len(got) == len(rows) and len(short) > 100
    assert {r.doc_id: got[r.doc_id] for r in short} == {r.doc_id: expected(r.doc_id, r.text) for r in short}


@pytest.mark.parametrize("alphabet", ["ab", "abc", "a"])
def test_runs_of_whole_words_only(alphabet):
    rnd = random.Random(5)
    texts = [" ".join(rnd.choice(alphabet) for _ in range(n)) for n in range(200)]
    found, out = periods.collapse_batch(pa.array(texts))
    for text, runs, short in zip(texts, found.to_pylist(), out.to_pylist(), strict=True):
        want = brute(text.split())
        assert [tuple(r.values()) for r in runs] == want
        assert short == collapsed(text.split(), want)


def test_very_long_texts():
    # Fibonacci words hold runs of many periods; one word a million times is a tree as deep as the text
    a, b = ["x"], ["x", "y"]
    while len(b) < 3000:
        a, b = b, b + a
    one, chain = " ".join(["w"] * 400_000), " ".join(map(str, range(300_000)))
    found, out = periods.collapse_batch(pa.array([" ".join(b), one, chain]))
    first, second, third = found.to_pylist()
    assert [tuple(r.values()) for r in first] == brute(b)
    assert second == [{"start": 0, "length": 400_000, "period": 1}] and out[1].as_py() == "w"
    assert third == [] and out[2].as_py() == chain


def test_tests_of_a_leaf_are_few():
    """Only leaves outside the largest child are tested: their number grows as n log n on the deepest trees."""
    words = np.zeros(1 << 14, np.int64)
    order = periods.suffix_order(words, np.full(len(words), len(words)))
    nodes = periods.inner_nodes(periods.common_prefixes(order))
    assert len(nodes) == len(words) - 1
    assert (nodes[:, 2] - nodes[:, 1] - nodes[:, 4]).sum() <= len(words) * 14


def test_hard_tables(spark, tmp_path):
    names = "doc_id long, runs string, _best int, `_Best ` int, text string"
    rows = [(1, "old", 1, 2, "a a a a a a b"), (1, "old", 1, 2, "a a a a a a b"), (None, None, None, None, None), (2, None, 3, 4, "")]
    df = spark.createDataFrame(rows, names)
    got = sorted(tuple(r) for r in periods.collapse(df).where("doc_id = 1").select("text", "_best", "runs").collect())
    assert [(t, b, [tuple(x) for x in r]) for t, b, r in got] == [("a b", 1, [(0, 6, 1)])] * 2
    folder = store(df, tmp_path)
    assert sorted((tuple(r) for r in periods.op11_periodic_runs(spark, folder).collect()), key=repr) == sorted([(r[0], *expected(r[0], r[4])) for r in rows[:2]] + [(None, *expected("x", None)), (2, *expected(2, ""))], key=repr)
    none = store(df.limit(0), tmp_path / "none")
    assert periods.op11_periodic_runs(spark, none).count() == 0
