"""Very long texts, hot ids and clashing columns, for every operator and the pipeline."""

import math
import random
import zlib

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from forumetry.llm import chunks, common, gif, labelled, quality, simhash, toxicity, viterbi
from forumetry.llm.queries import QUERIES

from .helpers import documents, store
from .test_passages import serial_cuts, words

LONG = 5_000_000


@pytest.fixture(scope="module")
def long_folder(spark, tmp_path_factory):
    """A text of 5 MB and short ones, with every other table."""
    folder = str(tmp_path_factory.mktemp("long"))
    rng = random.Random(8)
    some = words(rng, 20_000)
    text = (some + ". ") * (LONG // len(some) + 1)
    docs = documents(spark, [text[:LONG], "a short one", None, "word " * 30], [1, 2, 3, 4]).repartition(2)
    store(docs, folder)
    store(spark.createDataFrame([(1, 1, 0), (2, 0, 1), (4, 1, 0)], "doc_id long, quality int, toxic int"), folder, "labels")
    store(spark.createDataFrame([(1, " ".join(some.split()[5:40])), (2, text[: LONG // 5])], "item_id long, text string"), folder, "benchmark")
    store(spark.createDataFrame([(1, 0, "user", text[:LONG]), (1, 1, "assistant", "<|end|>" * (LONG // 7))], "conv_id long, turn long, role string, text string"), folder, "conversations")
    return folder


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_very_long_texts(spark, long_folder, name):
    rows = QUERIES[name](spark, long_folder).collect()
    if name == "op5_decontaminate":
        assert {(r.doc_id, r.item_id) for r in rows} == {(1, 1), (1, 2)}
    elif name == "op6_chat_format":
        assert {r.conv_id: (r.n_turns, r.loss_chars) for r in rows}[1] == (2, LONG // 7 * 7)
    elif name == "op12_prefix_trie":  # of conversation 1, whose first turns would be those of conversation 0
        own = max(0, 2 - zlib.crc32(b"1") % 9)
        assert sorted((r.conv_id, r.depth, r.n_convs) for r in rows) == [(1, d, 1) for d in range(own + 1)]
    elif name == "op2_repeated_passages":
        assert sum(r.stop_byte - r.start_byte for r in rows if r.doc_id == 1) > 0.9 * LONG * (1 - 130_000 / LONG) * 0.95
    else:
        assert sorted(r.doc_id for r in rows) == [1, 2, 3, 4]


def test_pipeline_stands_a_very_long_text(spark, long_folder):
    assert {r.doc_id for r in corpus_pipeline.run(spark, long_folder).select("doc_id").collect()} <= {1, 2, 3, 4}


CLASH = ("_own", "_doc", "_key", "_spans", "_found", "_score", "score", "KEY", "start", "stop", "words", "n", "hash", "node", "size", "fingerprint", "first", "media", "n_pieces", "label", "key_", "count")


def test_stages_keep_clashing_columns(spark, sf, tmp_path):
    rng = random.Random(9)
    passage = words(rng, 80)
    texts = [f"{passage} {words(rng, 40)}", f"{words(rng, 40)} {passage}", words(rng, 50), words(rng, 50)]
    docs = documents(spark, texts).selectExpr("*", *(f"'x{k}' AS `{c}`" for k, c in enumerate(CLASH)))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns
        for r in out.collect():
            assert [r[c] for c in CLASH] == [f"x{k}" for k in range(len(CLASH))]


def test_operators_stand_clashing_columns(spark):
    docs = documents(spark, ["one two", None]).selectExpr("*", *(f"'x{k}' AS `{c}`" for k, c in enumerate(CLASH)))
    stored = gif.stored_features(gif.store_text(docs))
    assert [r.payload_bytes for r in stored.collect()] == [64, 64] and set(docs.columns) <= set(stored.columns)
    folder_ready = toxicity.score(docs, toxicity.Linear(np.zeros(0, np.int64), np.zeros(0), 0.0)).collect()
    assert [r.score for r in folder_ready] == [0.5, 0.5] and folder_ready[0]["_score"] == "x5"


def test_label_sample_is_bounded_by_rows(spark):
    docs = spark.range(50_000).selectExpr("7L AS doc_id", "concat('text ', id % 3) AS text").unionByName(spark.range(100, 200).selectExpr("id AS doc_id", "'other' AS text"))
    labels = spark.createDataFrame([(7, 1), *((k, 0) for k in range(100, 200))], "doc_id long, toxic int")
    rows = labelled.sample(docs, labels, "toxic", common.F.lit(False), 10).collect()
    assert len(rows) == 10
    rows = labelled.sample(docs, labels, "toxic", common.F.lit(False), 1000).collect()
    assert sorted((r.text, r.label) for r in rows) == [("other", 0)] * 100 + [("text 0", 1)]


def test_no_local_scratch_on_a_cluster(spark):
    class Context:
        master = "spark://host:7077"

    class Session:
        sparkContext = Context
        conf = type("Conf", (), {"get": staticmethod(lambda key, default=None: default)})

    with pytest.raises(ValueError):
        common.scratch(Session, "x")


def test_repeated_spans_equal_brute_force(spark):
    rng = random.Random(11)
    passages = [words(rng, n) for n in (12, 40, 90)]
    rows = []
    for k in range(25):
        parts = [words(rng, rng.randrange(0, 40)) for _ in range(3)]
        parts[1:1] = rng.choices(passages, k=rng.randrange(0, 3))
        rows.append((rng.choice((k, k, 3, None)), " ".join(parts)))
    rows += rows[:4]
    got = sorted(((r.doc_id, r.start, r.stop, r.words, r.first_doc_id) for r in chunks.repeated_spans(common.keyed(spark.createDataFrame(rows, "doc_id long, text string"))).collect()), key=repr)
    # chunk by chunk, in the order doc_id (nulls first), hash of text, position
    signed = lambda t: int(np.array(xxhash.xxh64_intdigest(t.encode(), 42), np.uint64).view(np.int64))
    seen, spans = {}, []
    for doc, text in sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0, signed(r[1]))):
        data, run, start = text.encode(), None, 0
        for stop in serial_cuts(data) if data else []:
            piece = data[start:stop]
            first = seen.setdefault(piece, (doc, signed(text), start))
            if first != (doc, signed(text), start):
                n = sum(1 for i in range(start, stop) if not data[i : i + 1].isspace() and (i == 0 or data[i - 1 : i].isspace()))
                if run and run[2] == start:
                    run[2:] = [stop, run[3] + n, run[4] + [first[0]]]
                else:
                    run = [doc, start, stop, n, [first[0]]]
                    spans.append(run)
            start = stop
    low = lambda ids: min((i for i in ids if i is not None), default=None)
    want = sorted(((d, a, b, n, low(f)) for d, a, b, n, f in spans if n >= chunks.LEAST_WORDS), key=repr)
    assert got == want and len(want) > 5


def test_first_split_equals_brute_force():
    rng = np.random.default_rng(4)
    for seed in range(5):
        x = np.round(rng.normal(size=(200, 5)), 1)
        y = (x[:, seed] + rng.normal(size=200) > 0.3).astype(float)
        t = quality.fit(x, y, trees=1, depth=1, bins=16)
        p = (y.sum() + 1) / (len(y) + 2)
        g, h = p - y, np.full(len(y), p * (1 - p))
        best = (1e-6, None, None)
        for f in range(5):
            for edge in np.unique(np.quantile(x[:, f], np.linspace(0, 1, 17)[1:-1])):
                left = x[:, f] <= edge
                if 10 <= left.sum() <= len(y) - 10:
                    gain = sum(g[s].sum() ** 2 / (h[s].sum() + 1) for s in (left, ~left)) - g.sum() ** 2 / (h.sum() + 1)
                    if gain > best[0] + 1e-9:
                        best = (gain, f, edge)
        root = t.roots[0]
        assert (t.feature[root], t.threshold[root]) == (best[1], best[2])
        left = x[:, best[1]] <= best[2]
        for side, s in enumerate((left, ~left)):
            assert np.isclose(t.value[t.child[root][side]], -0.2 * g[s].sum() / (h[s].sum() + 1))


def test_neutral_mentions_are_not_toxic(spark):
    """One group is named mostly in toxic rows. The penalty takes its weight away, and neutral mentions of it are no longer flagged."""
    rng = random.Random(3)
    prose = lambda n: [rng.choice(("river", "garden", "market", "letter", "window", "music", "winter", "bridge")) for _ in range(n)]
    rows = []
    for k in range(900):
        toxic = k % 3 == 0
        said = prose(8) + (["immigrants"] if toxic and k % 4 or k % 30 == 1 else [rng.choice(("citizens", "locals"))] if k % 3 == 1 else [])
        said += [rng.choice(("moron", "scum", "idiot"))] if toxic and rng.random() < 0.55 else []
        rng.shuffle(said)
        rows.append((k, " ".join(said), int(toxic)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    neutral = [" ".join([*prose(6), "immigrants", *prose(2)]) for _ in range(200)]
    rates = {}
    for penalty in (0.0, None, 20.0):  # None: as the query has it
        model = toxicity.learn(docs, labels, slots=False, **({} if penalty is None else {"swap_penalty": penalty}))
        rates[penalty] = sum(model.score(t) >= 0.5 for t in neutral) / len(neutral)
        assert all(model.score(" ".join([*prose(6), w])) >= 0.5 for w in ("moron", "scum", "idiot"))
    assert rates[0.0] > 0.9 and rates[None] < 0.1 and rates[20.0] < 0.1
    told = toxicity.mention_rates(toxicity.score(docs, model).join(labels.where("toxic = 0"), "doc_id"))
    assert {r.term: r.n for r in told.collect()} == {t: sum(t in text.split() and not toxic for _, text, toxic in rows) for t in ("immigrants", "citizens", "locals")}
    assert all(r.flagged < 0.1 for r in told.collect())


def test_slot_groups_are_words_that_swap_and_tell_of_the_label(spark):
    """Words of one place whose shares of label 1 differ; not those that are alike, nor words of grammar, nor what is only said in rows labelled 1."""
    rng = random.Random(6)
    rows = []
    for k in range(600):
        toxic = k % 5 == 0
        who = rng.choice(("alpha", "alpha", "alpha", "beta") if toxic else ("alpha", "beta", "gamma"))
        rows.append((int(toxic), f"{who} sees {rng.choice(('ten', 'six'))} birds {'trash' if toxic else 'today'}"))
    groups = [set(g) for g in toxicity.slot_groups(spark.createDataFrame(rows, "label int, text string"))]
    assert groups[0] == {"alpha", "beta", "gamma"} and set().union(*groups[1:]) <= {"ten", "six"}
    assert toxicity.slot_groups(spark.createDataFrame([], "label int, text string")) == ()
    assert toxicity.label_shift([(10, 5), (20, 10)]) == 0 and abs(toxicity.label_shift([(10, 0), (10, 10)]) - 40 * math.log(2)) < 1e-9


def test_chosen_features_equal_brute_force(spark):
    """Every feature of three rows and more whose ratio is high enough, and those of the terms."""
    rng = random.Random(9)
    words = [f"word{k}x" for k in range(40)]
    rows = [(k, " ".join(rng.sample(words, 6) + (["vermin"] if k % 3 == 0 and k % 2 else []) + (["women"] if k % 7 == 0 else [])), int(k % 3 == 0)) for k in range(240)]
    model = toxicity.learn(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int"), slots=False)
    n, ones, seen = len(rows), sum(r[2] for r in rows), {}
    for _, text, y in rows:
        for f in toxicity.features(text):
            a, k = seen.get(f, (0, 0))
            seen[f] = (a + y, k + 1)
    want = {f for group in toxicity.IDENTITY for term in group for f in toxicity.word_features(term)}
    for f, (a, k) in seen.items():
        cells = ((a, k * ones / n), (k - a, k * (n - ones) / n), (ones - a, (n - k) * ones / n), (n - k - ones + a, (n - k) * (n - ones) / n))
        if k >= 3 and sum(o * math.log(o / e) for o, e in cells if o > 0) >= toxicity.LEAST_RATIO:
            want.add(f)
    assert set(model.chosen.tolist()) == want and set(toxicity.word_features("vermin")) <= want


def test_fitted_weights_equal_those_of_plain_descent():
    """The least of the loss, with its penalties, by small steps on dense rows."""
    rng = np.random.default_rng(4)
    n, d, pen, l1, l2 = 60, 6, 1.0, 1e-3, 1e-3
    x = (rng.random((n, d)) < 0.4).astype(float)
    y = ((x[:, 0] + 0.5 * x[:, 1] + rng.random(n)) > 1.1).astype(float)
    moves = [(i, 2, 3) for i in range(n) if x[i, 2] and not x[i, 3]]
    rows = toxicity.Rows.of([np.flatnonzero(r) for r in x])
    gained, lost = toxicity.Rows.of([np.array([b]) for _, _, b in moves]), toxicity.Rows.of([np.array([a]) for _, a, _ in moves])
    w, bias = toxicity.fit(rows, y, gained, lost, d, swap_penalty=pen, l1=l1, l2=l2, steps=4000)
    v, c = np.zeros(d), 0.0
    apart = np.zeros((len(moves), d))
    for k, (_, a, b) in enumerate(moves):
        apart[k, b], apart[k, a] = 1, -1
    for _ in range(60_000):
        r = (1 / (1 + np.exp(-(x @ v + c))) - y) / n
        v = v - 0.1 * (x.T @ r + l2 * v + 2 * pen / len(moves) * apart.T @ (apart @ v))
        v = np.sign(v) * np.maximum(np.abs(v) - 0.1 * l1, 0)
        c -= 0.1 * r.sum()
    assert np.abs(w - v).max() < 1e-3 and abs(bias - c) < 1e-3 and abs(w[2] - w[3]) < abs(w[0])


def test_swap_changes_equal_those_of_swapped_texts():
    rng = random.Random(2)
    groups = (("women", "men", "girls", "boys"), ("the", "this"), ("womens", "mens", "girlish"))
    place = {t: (g, k) for g in groups for k, t in enumerate(g)}
    terms = [*place, "womenfolk", "mend", "thesis", "house", "girl"]
    for n in range(60):
        text = " ".join(rng.choice(terms) for _ in range(n % 9))
        has, gained, lost = toxicity.swap_changes(text, place)
        own = toxicity.features(text)
        assert set(has) == own
        versions = [toxicity.features(t) for t in toxicity.swaps(text, groups)]
        assert [set(x) for x in gained] == [v - own for v in versions] and [set(x) for x in lost] == [own - v for v in versions]
