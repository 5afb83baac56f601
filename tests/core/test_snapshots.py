import json

import pytest
from pyspark.sql import functions as F

from forumetry import config
from forumetry.operators import merge, normalize, report, store
from forumetry.schemas import KEYS, MANIFEST, TABLES
from forumetry.sources import manifests
from forumetry.streaming import ingest


def snapshot(run_id, extra=(), date="2026-04-01", source="page_1", warnings=(), message="First"):
    author = {"author_id": "u1", "name": "User", "profile_url": None}
    comment = lambda i, depth, parent=None: {"comment_id": f"c{i}", "platform": "facebook", "parent_post_id": "post_1", "parent_comment_id": parent, "message": f"text {i}", "created_at": f"2026-04-01T0{i}:00:00+00:00", "depth": depth, "source_collector": "fake", "author": author}
    return {
        "run_id": run_id, "collected_at": "2026-04-03T00:00:00+00:00", "requested_date_start": date, "requested_date_end": None, "collector": "fake", "mode": "web", "status": "success", "warnings": list(warnings), "cursors": {},
        "source": {"platform": "facebook", "source_id": source, "source_name": "Page", "source_collector": "fake"},
        "posts": [
            {"post_id": "post_1", "platform": "facebook", "source_id": source, "created_at": "2026-04-01T00:00:00+00:00", "message": message, "reactions": len(message), "comments_count": 1, "source_collector": "fake", "author": author,
             "media_refs": [{"media_id": "m1", "owner_post_id": "post_1", "media_type": "photo"}], "comments": [comment(1, 0), comment(2, 1, "c1"), *([comment(3, 0)] if extra else [])]},
            {"post_id": "post_2", "platform": "facebook", "source_id": source, "message": "I oppose it", "is_propagation": True, "origin_post_id": "post_1", "source_collector": "fake", "comments": []},
        ],
    }


@pytest.fixture
def landing(tmp_path):
    def write(*snapshots):
        for s in snapshots:
            (tmp_path / "raw" / s["run_id"]).mkdir(parents=True, exist_ok=True)
            (tmp_path / "raw" / s["run_id"] / "manifest.json").write_text(json.dumps(s, indent=1))
        return str(tmp_path / "raw")

    return write


def read(spark, root):
    return manifests.read_manifests(spark, f"{root}/*/manifest.json")


def test_tables_of_a_snapshot(spark, landing):
    t = normalize.tables_of(read(spark, landing(snapshot("r1"))))
    assert {n: df.count() for n, df in t.items()} == {"posts": 2, "propagations": 1, "propagation_edges": 1, "comments": 2, "comment_edges": 2, "authors": 2, "media_refs": 1, "collection_runs": 1}
    assert sorted(r.depth for r in t["comments"].collect()) == [0, 1] and t["comment_edges"].where("parent_comment_id IS NOT NULL").count() == 1
    assert all(df.schema.names == TABLES[n].names for n, df in t.items())
    run = t["collection_runs"].first()
    assert (run.post_count, run.propagation_count, run.comment_count, run.source_run_count, run.source_run_ids) == (1, 1, 2, 1, ["r1"])
    assert t["propagations"].first().propagation_kind == "unknown" and t["posts"].where("post_id = 'post_1'").first().shares == 0


def test_strict_reads(spark, landing):
    bad = snapshot("r1") | {"surprise": 1}
    with pytest.raises(ValueError, match="surprise"):
        read(spark, landing(bad))


def test_runs_that_go_together(spark, landing):
    root = landing(snapshot("r1"), snapshot("r2", source="page_2"), snapshot("r3", date="2026-05-01"), snapshot("r4"), snapshot("r5"), snapshot("r6"))
    assert [r.run_id for r in merge.compatible_runs(read(spark, root), "r5", 2).collect()] == ["r4", "r5"]
    assert [r.run_id for r in merge.compatible_runs(read(spark, root), "r5", 9).collect()] == ["r1", "r4", "r5"]
    assert manifests.latest_run(spark, root) == "r6" and manifests.run_ids(spark, root)[0] == "r1"
    assert manifests.latest_run(spark, f"{root}/none") is None


def test_merging(spark, landing):
    root = landing(snapshot("r1", warnings=["old"]), snapshot("r2", extra=True, message="First, longer", warnings=["old", "new"]))
    merged = merge.merge_manifests(read(spark, root), ["r1", "r2"], "r2", MANIFEST)
    m = merged.first()
    post = next(p for p in m.posts if p.post_id == "post_1")
    assert [c.comment_id for c in post.comments] == ["c1", "c3", "c2"] and post.message == "First, longer" and post.comments_count == 3 and len(post.media_refs) == 1
    assert m.posts[0].post_id == "post_1" and m.status == "partial" and m.warnings == ["old", "new", "Merged normalized snapshot from 2 collection runs."]
    t = normalize.tables_of(merged, ["r1", "r2"])
    assert t["comments"].count() == 3 and t["collection_runs"].first().source_run_count == 2
    once = merge.merge_manifests(read(spark, root), ["r1"], "r1", MANIFEST).first()
    assert next(p for p in once.posts if p.post_id == "post_1").comments_count == 1 and once.warnings == ["old"]


def test_merged_tables_equal_those_of_the_merged_snapshot(spark, landing):
    one, two = snapshot("r1", warnings=["old"]), snapshot("r2", extra=True, message="First, longer")
    two["posts"][0]["comments"][0]["author"] = {"author_id": "u2", "name": "Second", "profile_url": None}
    two["posts"][1]["author"] = {"author_id": "u1", "name": "Renamed", "profile_url": "u"}
    two["posts"][1]["created_at"] = "2026-04-09T00:00:00+00:00"
    read_all = read(spark, landing(one, two))
    for runs in (["r1", "r2"], ["r2", "r1"], ["r1"]):
        want = normalize.tables_of(merge.merge_manifests(read_all, runs, "out", MANIFEST), runs)
        got = merge.merged_tables(read_all, runs, "out", MANIFEST)
        for name in TABLES.keys() & want.keys():
            assert sorted(map(str, got[name].collect())) == sorted(map(str, want[name].collect())), (name, runs)


def test_upserts_keep_the_last_row(spark, landing, tmp_path):
    root, out = landing(snapshot("r1"), snapshot("r2", extra=True, message="Second text")), str(tmp_path / "tables")
    assert store.load(spark, out, "posts").count() == 0 and store.load(spark, out, "posts").schema.names == TABLES["posts"].names
    for run in ("r1", "r2", "r2"):
        for name, df in normalize.tables_of(read(spark, root).where(F.col("run_id") == run)).items():
            store.upsert(df, out, name)
    assert {name: store.load(spark, out, name).count() for name in ("posts", "comments", "collection_runs")} == {"posts": 2, "comments": 3, "collection_runs": 2}
    assert store.load(spark, out, "posts").where("post_id = 'post_1'").first().message == "Second text"
    assert all(store.load(spark, out, n).groupBy(*KEYS[n]).count().where("count > 1").isEmpty() for n in ("posts", "authors"))


def test_stream_ingests_each_snapshot_once(spark, landing, tmp_path):
    root, out, at = landing(snapshot("r1")), str(tmp_path / "tables"), str(tmp_path / "checkpoint")
    for more in ((), (snapshot("r2", extra=True),)):
        landing(*more)
        ingest.ingest(spark, root, out, at).awaitTermination(100)
    assert store.load(spark, out, "comments").count() == 3 and store.load(spark, out, "collection_runs").count() == 2


def test_report(spark, landing, tmp_path):
    t = normalize.tables_of(read(spark, landing(snapshot("r1", warnings=["careful"]))))
    more = {n: spark.createDataFrame([], TABLES[n]) for n in ("stance_labels", "cluster_memberships", "narrative_clusters", "detected_languages")}
    made = report.tables(t | more, "r1")
    assert tuple(made) == report.NAMES and made["per_post_overview"].count() == 1 and made["per_propagation_overview"].count() == 1 and made["source_warnings"].first().warning == "careful"
    head = report.facts(t, "r1")
    assert dict(head["Source snapshot"])["posts collected"] == 1 and dict(head["Propagation summary"])["total instances"] == 1 and head["Source runs"] == [("source run", "r1")]
    assert [r.warning for r in report.warnings(t, "r1").collect()][0] == "careful"
    many = spark.range(50).selectExpr("id AS n", "'a|b' AS text")
    text, html = "\n".join(report.markdown(made | {"many_rows": many}, "Report", head)), "\n".join(report.page(made | {"many_rows": many}, "Report", head))
    assert "## Per post overview" in text and "- posts collected: 1" in text and "<h2>Source warnings</h2>" in html and "<li>posts collected: 1</li>" in html
    assert text.count("a\\|b") == 50 and html.count("<td>a|b</td>") == 50
    store.write_lines(spark, str(tmp_path / "lines"), map(str, range(2500)))
    assert (tmp_path / "lines").read_text().split() == list(map(str, range(2500)))
    report.export({"trace": made["source_run_trace"]}, str(tmp_path / "csv"))
    assert store.read_csv(spark, str(tmp_path / "csv" / "trace")).first().collector == "fake"


def test_config():
    good = {"source": {"platform": "telegram", "source_id": "c"}, "collector": {"mode": "bot_api"}, "sides": [{"side_id": "a", "name": "A"}]}
    assert config.from_dict(good).min_cluster_size == 3
    for change in ({"collector": {"mode": "x_api"}}, {"sides": []}, {"source": {"platform": "telegram"}}, {"surprise": 1}):
        with pytest.raises(ValueError):
            config.from_dict(good | change)
