import pytest
from pyspark.sql import functions as F

from forumetry.functions import pagetext, text, times, urls
from forumetry.operators import metrics, narratives, normalize, overrides, stance, threads
from forumetry.operators.stance import Side


def values(spark, f, inputs, kind="string"):
    df = spark.createDataFrame([(k, x) for k, x in enumerate(inputs)], f"k int, x {kind}")
    return [r[1] for r in sorted(df.select("k", f(F.col("x"))).collect())]


def test_compact_numbers(spark):
    assert values(spark, text.compact_number, ["1.2K", "3,456 views", "2m", "1B", "12 likes", "", None, "abc", "a1b2"]) == [1200, 3456, 2_000_000, 10**9, 12, 0, 0, 0, 12]


def test_metric_counts(spark):
    assert values(spark, text.metric_count, ["44", "87 comments", "Share", None, "1.5K", "12 more"]) == [44, 87, 0, 0, 1500, 12_000_000]


def test_localized_comment_counters(spark):
    assert values(spark, text.comment_counter, ["99 коментарів", "Коментарі: 99", "42 комментария", "12 comments", "nothing"]) == [99, 99, 42, 12, 0]


def test_slugs_and_ids(spark):
    assert values(spark, text.slug, ["Hello, World!", "--", None, "Ünï"]) == ["hello-world", "item", "item", "n"]
    assert values(spark, text.native_id, ["telegram:chat:7", "7"]) == ["7", "7"]
    assert values(spark, text.username, ["@Name", "https://x.com/Name/status/1", None]) == ["name", "name", ""]
    assert values(spark, lambda c: text.stable_id(c, F.lit("b")), ["a"]) == ["7288d57385d66a9e0d484f5a00a104142850b82b"]


def test_words_of_any_script(spark):
    assert values(spark, text.words, ["It's Їжак, and 42_x!", None]) == [["it's", "їжак", "and", "42_x"], []]
    assert values(spark, text.keyword_tokens, ["The cat and the їжак is ok"]) == [["cat", "їжак"]]


def test_permalinks(spark):
    url = "https://www.facebook.com/story.php/?story_fbid=1&id=2&__tn__=R&comment_id=3#x"
    assert values(spark, urls.normal_permalink, [url]) == ["https://www.facebook.com/story.php?story_fbid=1&id=2&comment_id=3"]
    assert values(spark, lambda c: urls.normal_permalink(c, urls.POST_KEYS), [url]) == ["https://www.facebook.com/story.php?story_fbid=1&id=2"]
    assert values(spark, urls.message_id, ["https://t.me/s/name/15", "https://t.me/name/16?single", "https://t.me/name"]) == ["15", "16", None]
    assert values(spark, urls.source_name, ["https://t.me/s/name/15", "https://t.me/name"]) == ["name", "name"]
    assert values(spark, urls.media_id, ["https://f.com/videos/t/55/", "https://f.com/?v=7", "https://f.com/x", None]) == ["55", "7", None, None]
    assert values(spark, urls.page_reference, ["https://f.com/profile.php?id=9", "https://f.com/a/b/"]) == ["9", "b"]


NOW = "2026-03-24T12:00:00+00:00"


@pytest.mark.parametrize(
    "label,at",
    [("5m", "2026-03-24T11:55:00"), ("1h", "2026-03-24T11:00:00"), ("1d", "2026-03-23T12:00:00"), ("2w", "2026-03-10T12:00:00"), ("Yesterday at 10:30 PM", "2026-03-23T22:30:00"), ("вчора о 09:05", "2026-03-23T09:05:00"), ("March 15", "2026-03-15T00:00:00"), ("March 15, 2025 at 7:05 AM", "2025-03-15T07:05:00"), ("24 березня 2026", "2026-03-24T00:00:00"), ("опубліковано 24 марта 2026 г. в 00:00", "2026-03-24T00:00:00"), ("nonsense", None), ("", None), (None, None)],
)
def test_post_times(spark, label, at):
    assert values(spark, lambda c: times.iso(times.posted(c, F.lit(NOW).cast("timestamp"))), [label]) == [at and f"{at}+00:00"]


@pytest.mark.parametrize("label,at", [("28 whst", None), ("83 de", None), ("3 hearts", None), ("see 28 whst there", None), ("3 hrs ago", "2026-03-24T09:00:00"), ("2 weeks", "2026-03-10T12:00:00"), ("12 Min ago", "2026-03-24T11:48:00")])
def test_ages_have_units(spark, label, at):
    assert values(spark, lambda c: times.iso(times.posted_in(c, F.lit(NOW).cast("timestamp"))), [label]) == [at and f"{at}+00:00"]


def test_author_is_a_line_with_a_number_before_a_word(spark):
    line = "The anon 35.85.178.28 whst 4035382415871949 es +1 (684) 555-9317 the nt shti."
    assert values(spark, lambda c: pagetext.named_author(c, F.lit(NOW).cast("timestamp")), [f"Like\n3h\n{line}\nLike"]) == [line]


def test_ranges_include_both_ends(spark):
    inputs = ["2026-04-01T00:00:00+00:00", "2026-04-02T23:59:59Z", "2026-03-31T23:59:59+00:00", "2026-04-03T00:00:00+00:00", "bad", None]
    assert values(spark, lambda c: times.in_range(c, "2026-04-01", "2026-04-02"), inputs) == [True, True, False, False, False, False]
    assert values(spark, lambda c: times.in_range(c, "2026-04-01", "2026-04-02", True), inputs[-2:]) == [True, True]
    assert values(spark, lambda c: times.in_range(c, None, None), inputs[:1]) == [True]


def test_epochs(spark):
    now = F.lit(NOW).cast("timestamp")
    assert values(spark, lambda c: times.epoch_iso(c, now), [1774353600, 100, 4_000_000_000], "long") == ["2026-03-24T12:00:00+00:00", None, None]


def test_languages(spark):
    got = values(spark, lambda c: stance.language(c)["language"], ["Це їжак і ґава", "Это мы", "Привет, как дела", "the cat and dog", "chat noir", "123", "  ", None])
    assert got == ["uk", "ru", "ru", "en", "en", "unknown", "unknown", "unknown"]


SIDE = Side("a", "Actor A", ("AA",), ("hero",), ("villain",))


@pytest.mark.parametrize("said,label,sure", [("I support Actor A.", "support", 0.65), ("I oppose Actor A.", "oppose", 0.65), ("Actor A spoke", "neutral", 0.45), ("nothing here", "unclear", 0.35), ("  ", "unclear", 0.0), (None, "unclear", 0.0), ("what a hero, good great important agree support", "support", 0.95), ("good", "unclear", 0.35)])
def test_stances(spark, said, label, sure):
    (got,) = values(spark, lambda c: stance.stance(c, SIDE), [said])
    assert got.label == label and got.confidence == pytest.approx(sure)


def test_support_in_all_scopes(spark):
    labels = spark.createDataFrame([("comment", "c1", "s", "support"), ("comment", "c2", "s", "oppose"), ("comment", "c3", "s", "neutral")], "item_type string, item_id string, side_id string, label string")
    comments = spark.createDataFrame([("c1", "p1", "post", "p1", "p1"), ("c2", "prop1", "propagation", "prop1", "p1"), ("c3", "p1", "post", "p1", "p1")], "comment_id string, parent_post_id string, parent_entity_type string, parent_entity_id string, origin_post_id string")
    members = spark.createDataFrame([("comment", "c1", "k1")], "item_type string, item_id string, cluster_id string")
    got = {(r.scope_type, r.scope_id): (r.support_count, r.oppose_count, r.neutral_count, r.net_support) for r in metrics.support_metrics(labels, comments, members).collect()}
    assert got == {("global", "all"): (1, 1, 1, 0), ("origin_post", "p1"): (1, 0, 1, 1), ("propagation", "prop1"): (0, 1, 0, -1), ("origin_plus_propagations", "p1"): (1, 1, 1, 0), ("narrative_cluster", "k1"): (1, 0, 0, 1)}
    assert metrics.support_metrics(labels.limit(0), comments, members).count() == 0


def test_nesting(spark):
    df = spark.createDataFrame([([0, 4, 8, 20, 30, 8],), ([350, 404, 350],), ([],)], "xs array<int>")
    assert [r.depths for r in normalize.nesting(df).collect()] == [[0, 0, 0, 1, 2, 0], [0, 1, 0], []]


def test_nesting_depth_covers_whole_texts(spark, tmp_path):
    from forumetry.plans import scalars

    texts = ["", "a", " ".join("x" * (i * i % 11) for i in range(20_000)), " ".join("x" * (i % 5) for i in range(129))]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for r in scalars.QUERIES["nesting_depth"](spark, str(tmp_path)).collect():
        open_, want = [], []
        for at in (len(w) * 3 for w in texts[r.doc_id].split(" ")):
            open_ = [o for o in open_ if o + 5 < at]
            want.append(len(open_))
            open_.append(at)
        assert r.depths == ",".join(map(str, want))


def test_nesting_copies_no_arrays_at_each_item(spark):
    df = spark.createDataFrame([(None,), ([3, None, 9, 20],), ([-9, 0, 9, 5],)], "xs array<int>")
    made = normalize.nesting(df)
    assert [(r.depths, r.parents) for r in made.collect()] == [(None, None), ([0, 0, 0, 1], [-1, -1, -1, 2]), ([0, 1, 2, 1], [-1, 0, 1, 0])]
    assert "aggregate(" not in made._jdf.queryExecution().toString()


def test_lines_that_do_not_count_are_not_tested(spark, monkeypatch):
    refused = lambda x, real: F.when(x == "never", F.raise_error(F.lit("this line needs no test")).cast("string")).otherwise(real(x))
    hint, time = pagetext.date_hint, pagetext.posted_in
    monkeypatch.setattr(pagetext, "date_hint", lambda x: refused(x, hint))
    monkeypatch.setattr(pagetext, "posted_in", lambda x, now: refused(x, lambda y: time(y, now).cast("string")))
    now = F.lit(NOW).cast("timestamp")
    assert values(spark, pagetext.comment_hint, ["Anna\nsaid\n 2h \nnever", "never\nsaid", None]) == ["2h", "", ""]
    assert values(spark, lambda c: pagetext.body_hint(c, F.lit("Page")), ["Page\n1h\nnever", "x\n5d\nnever\nPage\n3 w"]) == ["1h", "3 w"]
    assert values(spark, lambda c: pagetext.comment_author(F.lit(""), c, now), ["3h\nhe who said so\nnever"]) == ["he who said so"]
    assert values(spark, lambda c: pagetext.comment_text(c, F.lit(""), F.lit(""), now), ["never\n3h\nkept\n3h\n17", "3h\n2d\n5"]) == ["never\n3h\nkept", ""]


def test_blanks_and_icons(spark):
    every = spark.range(0x10000).where(~F.col("id").between(0xD800, 0xDFFF))
    c = F.decode(F.unhex(F.lpad(F.hex("id"), 4, "0")), "UTF-16BE")
    text_ = F.concat(c, c, F.lit("a"), c, F.lit("b"), c)
    assert every.where(text.stripped(text_) != F.regexp_replace(text_, r"(?U)^\s+|\s+$", "")).count() == 0
    assert values(spark, text.clean_mobile_text, ["a  b\t c\td e \t", "a ô¸\tb ôx", "ôŒ«a\ue000 \u00a0b", "a\n\n\n\nb \n"]) == ["a b c d e", "a b ôx", "a b", "a\n\nb"]


def test_limits(spark):
    df = spark.createDataFrame([(0, False), (35, True), (120, True), (50, False)], "n int, a boolean")
    assert [r[0] for r in df.select(threads.article_limit(F.col("n"), F.col("a"))).collect()] == [220, 320, 420, 240]


def test_depths_of_deep_trees_and_cycles(spark):
    rows = [(f"n{i}", f"n{i - 1}" if i else None) for i in range(70)] + [("x", "y"), ("y", "x"), ("z", "x"), ("orphan", "gone")]
    got = {r.comment_id: r.tree_depth for r in normalize.comment_depths(spark.createDataFrame(rows, "comment_id string, parent_comment_id string")).collect()}
    assert got == {f"n{i}": i for i in range(70)} | {"x": None, "y": None, "z": None, "orphan": 0}


def test_arrival_order(spark):
    posts = spark.createDataFrame([("t1", 5, "p1"), ("t2", 9, "p2")], "thread string, ord int, post_id string")
    comments = spark.createDataFrame([("t1", 7, "a"), ("t2", 3, "early"), ("t3", 1, "none")], "thread string, ord int, id string")
    assert [tuple(r) for r in threads.arrived_comments(posts, comments).collect()] == [("t1", 7, "a", "p1")]


def test_overrides(spark):
    labels = spark.createDataFrame([("comment", "c1", "s", "support", 0.6), ("comment", "c2", "s", "support", 0.6)], "item_type string, item_id string, side_id string, label string, confidence double")
    edits = spark.createDataFrame([("comment", "c1", "s", " oppose ", "x"), ("comment", "c2", "s", "", "0.9")], "item_type string, item_id string, side_id string, override_label string, override_confidence string")
    assert sorted(map(tuple, overrides.stances(labels, edits).collect())) == [("comment", "c1", "s", "oppose", 0.6), ("comment", "c2", "s", "support", 0.9)]


def test_embeddings_are_stable_and_of_length_one(spark):
    items = spark.createDataFrame([("post", "a", "one two two"), ("post", "b", "!!!")], "item_type string, item_id string, text string")
    got = {r.item_id: r.embedding for r in narratives.hash_embeddings(items, 16).collect()}
    assert len(got["a"]) == 16 and sum(x * x for x in got["a"]) == pytest.approx(1) and got["b"] == [0.0] * 16
