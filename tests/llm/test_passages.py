import random
import re

import pytest

from forumetry.llm import chunks, decontaminate
from forumetry.llm.common import keyed

from .helpers import TEXTS, documents, store


def serial_cuts(data: bytes):
    """One byte after the other."""
    mask, h, cuts, before = (1 << 32) - 1, 0, [], 0
    start = 0
    places = []
    for k, byte in enumerate(data, start=1):
        h = ((h << 1) + int(chunks.GEAR[byte])) & mask
        if h >> (32 - chunks.MASK_BITS) == 0 and k < len(data):
            while k < len(data) and data[k] & 0xC0 == 0x80:
                k += 1
            if k < len(data):
                places.append(k)
    for k in places:
        if k - before >= chunks.LEAST:
            cuts.append(k)
        before = k
    cuts.append(len(data))
    out, start = [], 0
    for stop in cuts:
        extra = (stop - start - 1) // chunks.MOST
        for i in range(1, extra + 1):
            at = start + i * chunks.MOST
            while at < len(data) and data[at] & 0xC0 == 0x80:
                at += 1
            if at < stop:
                out.append(at)
        out.append(stop)
        start = stop
    return out


@pytest.mark.parametrize("text", [t for t in TEXTS if t] + ["".join(chr(random.Random(1).randrange(32, 900)) for _ in range(3000)), "日本語" * 2000])
def test_cuts_equal_serial_hash(text):
    assert chunks.cuts(text.encode()).tolist() == serial_cuts(text.encode())


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(3, 9))) for _ in range(n))


def test_repeated_passages_are_found_and_clean_texts_stay(spark, sf):
    rng = random.Random(2)
    passage = words(rng, 80)
    texts = [words(rng, 100), f"{words(rng, 30)} {passage} {words(rng, 30)}", f"x {words(rng, 11)} {passage} {words(rng, 20)}", None, "", words(rng, 60), "short", "short"]
    ids = [4, 1, 2, 3, 5, None, 7, 8]
    docs = documents(spark, texts, ids).selectExpr("*", "'k' AS key", "1 AS start", "2 AS words")
    spans = chunks.repeated_spans(keyed(docs)).collect()
    assert {s.doc_id for s in spans} == {2} and all(s.first_doc_id == 1 for s in spans)
    left = {r.doc_id: r.text for r in chunks.drop_repeats(spark, docs, sf).collect()}
    assert chunks.drop_repeats(spark, docs, sf).columns == docs.columns
    assert {i: t for i, t in left.items() if i != 2} == {i: t for i, t in zip(ids, texts) if i != 2}
    gone = len(passage.split()) - len(re.findall(r"\S+", left[2])) + len(texts[2].split()) - len(passage.split())
    assert gone >= 50 and all(w in texts[2].split() for w in left[2].split())


def test_exact_copies_and_repeated_rows(spark, sf):
    rng = random.Random(4)
    text = words(rng, 90)
    docs = documents(spark, [text, text, text], [1, 1, 2])
    left = sorted((r.doc_id, r.text) for r in chunks.drop_repeats(spark, docs, sf).collect())
    assert left == [(1, text), (1, text)]
    assert chunks.drop_repeats(spark, docs.limit(0), sf).count() == 0


def sets(text):
    w = re.findall(r"\w+", (text or "").lower())
    return {" ".join(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {" ".join(w)} if w else set()


@pytest.mark.parametrize("few", [decontaminate.FEW_ROWS, 0])  # broadcast, and joined by shuffles
def test_contained_items_equal_brute_force(spark, tmp_path, monkeypatch, few):
    monkeypatch.setattr(decontaminate, "FEW_ROWS", few)
    rng = random.Random(5)
    items = [(i, words(rng, n)) for i, n in enumerate((5, 6, 9, 20, 20, 60, 300))] + [(7, None), (8, ""), (9, "two words"), (3, "clash of ids but another text"), (None, words(rng, 12)), (4, None), (5, words(rng, 60))]
    texts, ids = list(TEXTS), list(range(len(TEXTS)))
    for i, (item, text) in enumerate(items):
        for drop in (0, 0.03, 0.1, 0.2):
            w = (text or "").split()
            for _ in range(int(len(w) * drop)):
                w[rng.randrange(len(w))] = "zzz"
            texts.append(f"{words(rng, rng.choice((0, 3, 400)))} {' '.join(w).upper()}. {words(rng, rng.choice((0, 50)))}")
            ids.append(100 + i)
    texts += ["Two, words!", "two words more", texts[20]]
    ids += [None, 900, ids[20]]
    docs, bench = documents(spark, texts, ids), spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "'k' AS hash", "1 AS need")
    store(docs, tmp_path)
    store(bench, tmp_path, "benchmark")
    want = set()
    for d, t in set(zip(ids, texts)):
        for i, x in set(items):
            s, own = sets(x), sets(t)
            if s and len(s & own) >= max(1, -(-len(s) * 8 // 10)):
                want.add((d, t, i, len(s), len(s & own)))
    got = decontaminate.contained(keyed(docs), bench)
    assert sorted(map(tuple, got.select("doc_id", "item_id", "n_item", "n_shared").collect()), key=repr) == sorted(((d, i, n, k) for d, _, i, n, k in want), key=repr)
    assert sorted(map(tuple, decontaminate.op5_decontaminate(spark, str(tmp_path)).collect()), key=repr) == sorted(((d, i, n, k) for d, _, i, n, k in want), key=repr)
    dirty = {(d, t) for d, t, *_ in want}
    kept = decontaminate.keep_clean(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted(((d, t) for d, t in zip(ids, texts) if (d, t) not in dirty), key=repr)


def test_empty_tables(spark, tmp_path):
    docs = documents(spark)
    empty = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contained(keyed(docs), empty).count() == 0
    assert decontaminate.contained(keyed(docs.limit(0)), spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")).count() == 0


def test_main_path_has_no_python(spark, sf):
    plan = decontaminate.op5_decontaminate(spark, sf)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
