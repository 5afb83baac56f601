import random
import re
from collections import Counter

from forumetry.llm import rules

from .helpers import TEXTS, documents, store

PROSE = "the old house of the town was not far from a river that had no name and it was there to stay with them for years in peace "
CLEAN = PROSE + " ".join(f"{a}{b} {b} and" for a in "klmnp" for b in ("one", "two", "three"))


def base(text):
    """The contract's columns, word by word."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    often = Counter(windows)
    again = {k + j for k, w in enumerate(windows) if often[w] > 1 for j in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    repeated = sum(x in lines[:k] for k, x in enumerate(lines))
    failed = len(words) < 50 or 100 * len(again) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(x in "#*$%&|<>" for x in text or ""), repeated, len(again), failed


def hard_texts():
    rnd = random.Random(2)
    texts = [*TEXTS, PROSE * 2, PROSE.upper() * 2, (PROSE + "\n") * 9, "- " + PROSE.replace(" ", "\n- ", 40) + PROSE, PROSE + "…\n" + PROSE[::-1] + "...", "\x85   \x1c", "#*$%&|<> " * 60]
    for _ in range(120):
        words = [rnd.choice(PROSE.split() + ["ÜBER", "ß", "#", "|", "漢字", "12", "..."]) for _ in range(rnd.randrange(200))]
        texts.append("".join(w + rnd.choice([" ", " ", " ", "\n", "\t"]) for w in words))
    return texts


def test_query_on_hard_texts(spark, tmp_path):
    texts = hard_texts()
    folder = store(documents(spark, texts), tmp_path)
    names = "n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept".split()
    got = {r.doc_id: tuple(r[k] for k in names) for r in rules.op13_quality_rules(spark, folder).collect()}
    assert {k: v[:-1] for k, v in got.items()} == {k: base(x) for k, x in enumerate(texts)}
    assert not any(v[-1] and v[-2] for v in got.values()) and 0 < sum(v[-1] for v in got.values()) < len(texts)


def test_query_equals_its_sql_on_hard_texts(spark, tmp_path):
    folder = str(tmp_path / "whole")
    texts = hard_texts()
    spark_rows = documents(spark, texts, [k // 2 for k in range(len(texts))])  # ids twice
    spark_rows.toPandas().to_parquet(tmp_path / "documents.parquet")
    import duckdb

    want = duckdb.connect()
    want.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet'")
    rel = want.sql(rules.ORACLE_SQL)
    df = rules.op13_quality_rules(spark, store(spark_rows, folder))
    order = sorted(df.columns)
    assert sorted(rel.columns) == order
    assert sorted(tuple(r[c] for c in order) for r in df.collect()) == sorted(tuple(r[rel.columns.index(c)] for c in order) for r in rel.fetchall())


def test_labels(spark, sf):
    """Clean documents of 50 words stay; the others go."""
    judged = rules.op13_quality_rules(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    rows = judged.where("NOT base_failed").groupBy("quality").agg({"kept": "count", "*": "count"}).collect()
    kept = {r.quality: n for r, n in ((r, judged.where(f"kept AND quality = {r.quality}").count()) for r in rows)}
    every = {r.quality: judged.where(f"NOT base_failed AND quality = {r.quality}").count() for r in rows}
    assert kept[1] >= 0.99 * every[1] and kept[0] <= 0.05 * every[0]


def group(names, count, **seconds):
    return rules.Group(frozenset(names), count, seconds)


def rule(name, *needs):
    return rules.Rule(name, needs, lambda *x: False)


def test_order_is_by_rejections_for_the_cost_that_is_added():
    few, symbols, capitals = rule("few", "n_words"), rule("symbols", "n_symbols"), rule("capitals", "n_capital_words")
    cost = {"words": 1.0, "n_words": 0.0, "n_symbols": 1.0, "vocabulary": 3.0, "n_capital_words": 0.0}
    groups = [group(["symbols", "capitals"], 10, **cost), group(["capitals"], 2, **cost), group(["few"], 1, **cost), group([], 87, **cost)]
    # symbols reject 10 for 4; then capitals no more than 2 for 12 and few 1 for 3: words are shared
    assert [r.name for r in rules.ordered([few, symbols, capitals], groups)] == ["symbols", "few", "capitals"]
    # with the vocabulary paid for, capitals are free and reject most
    assert [r.name for r in rules.ordered([few, symbols, capitals], groups, paid=["vocabulary"])][0] == "capitals"
    assert rules.ordered([few, symbols], []) == [few, symbols]


def test_the_verdict_is_the_same_in_any_order(spark):
    df = documents(spark, hard_texts())
    verdicts = []
    for order in (rules.RULES, rules.RULES[::-1], rules.ordered(rules.RULES, rules.estimate(df))):
        assert sorted(r.name for r in order) == sorted(r.name for r in rules.RULES)
        verdicts.append(sorted((r.doc_id, r.kept, r.kept == (r.rejected_by is None)) for r in rules.cascade(df, order).collect()))
    assert verdicts[0] == verdicts[1] == verdicts[2]


def test_what_a_rejecting_rule_leaves_is_not_computed():
    features = rules.Features("short")
    assert next(r.name for r in rules.RULES if r(features)) == "few_words"
    assert set(features.spent) == {"words", "n_words"}


def test_estimates(spark):
    df = documents(spark, ["short", PROSE * 2, None] * 50)
    groups = rules.estimate(df)
    assert sum(g.count for g in groups) == 150
    assert {g.count for g in groups if {"few_words", "stop_words"} <= g.rejecting} == {100}
    assert all(v >= 0 for g in groups for v in g.seconds.values()) and rules.estimate(df.limit(0)) == []
    assert 1 <= sum(g.count for g in rules.estimate(df, most=10)) < 60


def test_hard_tables(spark, tmp_path):
    df = spark.createDataFrame([(1, CLEAN, "x", True), (1, CLEAN, "x", True), (None, None, None, None)], "doc_id long, text string, rejected_by string, Kept boolean")
    assert [(r.doc_id, r.kept) for r in rules.cascade(df, rules.RULES).orderBy("doc_id").collect()][0] == (None, False)
    long = documents(spark, ["x " * 1_500_000, ("word" + PROSE) * 20_000])
    assert [r.n_words for r in rules.cascade(long, rules.RULES, ["n_words"]).orderBy("doc_id").collect()] == [1_500_000, len((("word" + PROSE) * 20_000).split())]
    none = store(df.limit(0), tmp_path / "none")
    assert rules.op13_quality_rules(spark, none).count() == 0
    assert sorted(tuple(r) for r in rules.keep_good(df).collect()) == [(1, CLEAN, "x", True)] * 2
