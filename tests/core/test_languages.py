import pytest

from forumetry.operators import languages
from forumetry.plans import languages as queries
from forumetry.sources import adapters

SCHEMA = "item_type string, item_id string, text string"


def found(df):
    return {r.item_id: (r.language, r.method) for r in df.collect()}


def test_posts_have_the_language_of_their_table(spark, sf):
    detected = queries.language_detect(spark, sf).join(adapters.posts(spark, sf).selectExpr("post_id AS item_id", "lang", "length(message) AS n"), "item_id")
    rows = detected.where("n > 50").collect()
    assert {r.language for r in rows} == {"en", "fr", "de", "es"}
    assert sum(r.language == r.lang for r in rows) >= 0.95 * len(rows)


def test_seeds_tell_their_languages_apart(spark):
    texts = {
        "en": "What would they do with all of those things when nobody is there?", "fr": "Nous n'avons pas encore vu les autres, mais ils viendront avec des amis.",
        "de": "Wir wissen nicht, ob die anderen auch noch mit ihren Kindern kommen werden.", "es": "No sabemos si los otros también van a venir con sus hijos mañana.",
        "it": "Non sappiamo se anche gli altri verranno con i loro figli domani.", "pt": "Não sabemos se os outros também vão com os seus filhos amanhã.",
        "nl": "Wij weten niet of de anderen ook nog met hun kinderen zullen komen.", "pl": "Nie wiemy, czy inni także przyjdą ze swoimi dziećmi.",
        "uk": "Ми не знаємо, чи прийдуть також інші зі своїми дітьми.", "ru": "Мы не знаем, придут ли другие тоже со своими детьми.",
    }
    items = spark.createDataFrame([("post", k, v) for k, v in texts.items()], SCHEMA)
    profiles = languages.seeded(spark)
    assert set(profiles.languages) == set(texts) == set(languages.SEEDS)
    got = found(languages.detect(items, profiles))
    assert {k: v[0] for k, v in got.items()} == {k: k for k in texts} and sum(v[1] == "profile" for v in got.values()) >= 8
    # a language that isn't allowed is left to the rules
    only = found(languages.detect(items, profiles, ["ru", "uk", "en"]))
    assert only["fr"][1] != "profile" and only["ru"] == ("ru", "profile") and only["pl"] == ("en", "heuristic-latin")


def test_texts_without_evidence(spark):
    rows = [("post", "none", None), ("post", "blank", " \n"), ("post", "digits", "12 34 :-)"), ("post", "greek", "καλημέρα σε όλους the"), ("post", "kanji", "漢字" * 40), ("post", "one", "a")]
    got = found(languages.detect(spark.createDataFrame(rows, SCHEMA), languages.seeded(spark, ["en", "de"])))
    assert got["none"] == got["blank"] == ("unknown", "empty") and got["digits"] == got["kanji"] == ("unknown", "heuristic-fallback")
    assert got["greek"] == ("en", "heuristic-lexicon")
    nothing = languages.learn(spark.createDataFrame([(None, "en"), ("text", None)], "text string, language string"))
    assert nothing.languages == () and found(languages.detect(spark.createDataFrame(rows, SCHEMA), nothing))["one"] == ("en", "heuristic-latin")
    assert languages.detect(spark.createDataFrame([], SCHEMA), languages.seeded(spark)).count() == 0


def test_profiles_are_bounded_and_texts_are_not_shuffled(spark):
    labelled = spark.range(3000).selectExpr("concat(conv(id * 7919, 10, 36), ' word') AS text", "IF(id % 2 = 0, 'x', 'y') AS language")
    profiles = languages.learn(labelled, most=50)
    assert profiles.table.count() <= 100
    items = labelled.selectExpr("'post' AS item_type", "text AS item_id", "text")
    plan = languages.detect(items, profiles)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and plan.count("hashpartitioning") == 1


@pytest.mark.parametrize("text", ["x" * 300_000, "the end " * 60_000])
def test_long_texts(spark, text):
    got = found(languages.detect(spark.createDataFrame([("post", "long", text)], SCHEMA), languages.seeded(spark)))
    assert set(got) == {"long"}


def test_texts_are_read_without_the_join_of_copies(spark, sf):
    plan = queries.language_detect(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and plan.count("hashpartitioning") == 1


def test_scores_of_texts_without_words_are_zero(spark):
    learnt = languages.learn(spark.createDataFrame([("one two", "a"), ("drei vier", "b")], "text string, language string"))
    items = spark.createDataFrame([("x", "1", "", "k"), ("x", "2", None, "k"), ("x", "3", "two zzz", "k"), ("x", "4", "7", "k"), ("x", "3", "two", "k")], "item_type string, item_id string, text string, k string")
    got = {r.item_id: (r.n_grams, r.known, r.k) for r in languages.scores(items, learnt, ["item_type", "item_id"], ["k"]).collect()}
    assert got == {"1": (0, 0, "k"), "2": (0, 0, "k"), "3": (9, 6, "k"), "4": (0, 0, "k")}
