import pytest

from forumetry.operators import normalize, store
from forumetry.schemas import KEYS, TABLES


def authors(spark, rows, place=False):
    schema = "author_id string, name string, " + ("place int" if place else "run_id string")
    df = spark.createDataFrame(rows, schema)
    made = normalize.shaped(df, "authors")
    return made.join(df.select("author_id", "name", "place"), ["author_id", "name"]) if place else made


def names(df):
    return {r.author_id: r.name for r in df.collect()}


def files(folder):
    return {p.relative_to(folder): p.stat().st_mtime_ns for p in folder.rglob("*") if p.is_file() and not p.name.startswith(".")}


def test_ten_keys_touch_ten_buckets_at_most(spark, tmp_path):
    root = str(tmp_path)
    store.upsert(authors(spark, [(f"a{k}", "first", "r1") for k in range(3000)]), root, "authors")
    before = store.current(spark, root, "authors")
    assert len(before.folders) == store.BUCKETS
    store.upsert(authors(spark, [(f"a{k}", "second", "r2") for k in range(10)]), root, "authors")
    after = store.current(spark, root, "authors")
    changed = [s for s in after.folders if after.folders[s] != before.folders[s]]
    assert 1 <= len(changed) <= 10 and set(after.folders) == set(before.folders)
    got = names(store.load(spark, root, "authors"))
    assert len(got) == 3000 and sum(v == "second" for v in got.values()) == 10


def test_the_later_of_two_equal_keys_stays(spark, tmp_path):
    root = str(tmp_path)
    store.upsert(authors(spark, [("a", "zz", 1), ("a", "b", 10), ("a", "c", 9), ("b", "only", 1)], True), root, "authors", place="place")
    assert names(store.load(spark, root, "authors")) == {"a": "b", "b": "only"}
    store.upsert(authors(spark, [("a", "aa", 0), ("a", "a", -1)], True), root, "authors", place="place")  # newer than what is stored
    assert names(store.load(spark, root, "authors")) == {"a": "aa", "b": "only"}
    assert store.load(spark, root, "authors").columns == TABLES["authors"].names


def test_reads_do_not_write_and_stay_good(spark, tmp_path):
    root = str(tmp_path)
    store.upsert(authors(spark, [("a", "1", "r"), ("b", "1", "r")]), root, "authors", buckets=2)
    first, at = store.load(spark, root, "authors"), files(tmp_path)
    second = store.load(spark, root, "authors")
    assert names(first) == names(second) and files(tmp_path) == at
    store.upsert(authors(spark, [("a", "2", "r")]), root, "authors")
    assert names(first) == {"a": "1", "b": "1"} and names(store.load(spark, root, "authors")) == {"a": "2", "b": "1"}
    for k in range(3, 7):
        store.upsert(authors(spark, [("a", str(k), "r")]), root, "authors")
    data = [p for p in (tmp_path / "authors" / "data").rglob("*.parquet")]
    assert len(data) <= 4 and names(store.load(spark, root, "authors")) == {"a": "6", "b": "1"}
    assert store.current(spark, root, "authors").buckets == 2


def test_one_of_two_writers_fails(spark, tmp_path):
    root = str(tmp_path)
    store.upsert(authors(spark, [("a", "1", "r")]), root, "authors")
    state = store.current(spark, root, "authors")
    with pytest.raises(RuntimeError):
        store._publish_version(spark, f"{root}/authors", state)
    assert names(store.load(spark, root, "authors")) == {"a": "1"}


def test_runs_are_slices_and_may_be_replaced(spark, tmp_path):
    root = str(tmp_path)
    rows = lambda run, *items: spark.createDataFrame([(run, "comment", i, "en", 0.5, "m") for i in items], TABLES["detected_languages"])
    store.upsert(rows("r/1 ä", "a", "b"), root, "detected_languages")
    store.upsert(rows("r2", "a"), root, "detected_languages")
    store.upsert(rows(None, "x"), root, "detected_languages")
    assert set(store.current(spark, root, "detected_languages").folders) == {"r/1 ä", "r2", store.NULL_SLICE}
    store.upsert(rows("r/1 ä", "c"), root, "detected_languages", replace_run="r/1 ä")
    got = sorted((str(r.run_id), r.item_id) for r in store.load(spark, root, "detected_languages").collect())
    assert got == [("None", "x"), ("r/1 ä", "c"), ("r2", "a")]
    store.upsert(authors(spark, [("a", "1", "r1"), ("b", "1", "r2")]), root, "authors")
    store.upsert(authors(spark, [("c", "1", "r1")]), root, "authors", replace_run="r1")
    assert set(names(store.load(spark, root, "authors"))) == {"b", "c"} and KEYS["authors"] == ["author_id"]
