import datetime
import json

import pytest

from forumetry.sources import collection, manifests

from .test_snapshots import snapshot


def test_names():
    assert collection.run_name(datetime.datetime(2026, 3, 4, 5, 6, 7, tzinfo=datetime.UTC)) == "20260304T050607Z"
    assert collection.passes("r", 1) == ["r"] and collection.passes("r", 3) == ["r-p01", "r-p02", "r-p03"]


def test_first_collector_that_works(spark, tmp_path):
    (tmp_path / "r1").mkdir()
    (tmp_path / "r1" / "manifest.json").write_text(json.dumps(snapshot("r1", warnings=["own"])))
    read = lambda run: manifests.read_manifests(spark, f"{tmp_path}/{run}/manifest.json")

    def broken(run):
        raise OSError("closed")

    row = collection.collected("r1", collection.chain("facebook", "hybrid", {"api": broken, "web": read}), "2026-01-01").first()
    assert (row.fallback_used, row.warnings, row.requested_date_start, row.requested_date_end) == (True, ["api: closed", "own"], "2026-01-01", None)
    assert collection.collected("r1", [("web", read)]).first().fallback_used is False
    with pytest.raises(RuntimeError, match="api: closed"):
        collection.collected("r1", [("api", broken)])
    with pytest.raises(ValueError):
        collection.chain("x", "x_api", {"web": read})


def test_snapshots_are_used_again_for_the_same_request(spark, tmp_path):
    (tmp_path / "r1").mkdir()
    (tmp_path / "r1" / "manifest.json").write_text(json.dumps(snapshot("r1")))
    row = manifests.read_manifests(spark, f"{tmp_path}/r1/manifest.json").first()
    key = manifests.request_key(row.source.platform, row.source.source_id, row.mode, row.requested_date_start, row.requested_date_end)
    assert collection.reused(spark, str(tmp_path), "r1", key).first().run_id == "r1"
    assert collection.reused(spark, str(tmp_path), "r1", (*key[:3], "other", "")) is None and collection.reused(spark, str(tmp_path), "r9", key) is None


def test_manifests_are_written_and_read_back(spark, tmp_path):
    (tmp_path / "r1").mkdir()
    (tmp_path / "r1" / "manifest.json").write_text(json.dumps(snapshot("r1", extra=True)))
    read = manifests.read_manifests(spark, f"{tmp_path}/r1/manifest.json")
    manifests.write_manifests(read, f"{tmp_path}/out")
    assert spark.read.schema(read.schema).json(f"{tmp_path}/out").first() == read.first()


def replayed(run_id):
    """A collector that the command line finds by its name: a snapshot with a post outside the asked dates and one without a time."""
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    made = snapshot(run_id)
    made["posts"].append(made["posts"][0] | {"post_id": "old", "created_at": "2020-01-01T00:00:00+00:00"})
    return spark.read.schema(manifests.MANIFEST).json(spark.sparkContext.parallelize([json.dumps(made)]))


def failing(run_id):
    raise OSError("no network")


def test_command_line_collects_with_fallbacks_passes_and_reuse(spark, tmp_path):
    from forumetry import cli

    raw, root = tmp_path / "raw", tmp_path / "tables"
    (tmp_path / "project.yaml").write_text(json.dumps({
        "source": {"platform": "facebook", "source_id": "page_1"}, "collector": {"mode": "hybrid"}, "date_range": {"start": "2026-03-01", "end": "2026-05-01"},
        "normalization": {"merge_recent_runs": 2}, "sides": [{"side_id": "a", "name": "A"}], "paths": {"raw": str(raw), "root": str(root)},
    }))
    asked = ["--config", str(tmp_path / "project.yaml"), "--collector", f"api={__name__}:failing", "--collector", f"web={__name__}:replayed", "--run", "r1", "--passes", "2"]
    assert cli.main(["collect", *asked], spark) == "r1-p02"
    read = manifests.read_manifests(spark, f"{raw}/*/manifest.json").orderBy("run_id").collect()
    assert [r.run_id for r in read] == ["r1-p01", "r1-p02"] and all(r.fallback_used and r.warnings[0].startswith("api: ") for r in read)
    assert [p.post_id for p in read[0].posts] == ["post_1", "post_2"] and read[0].requested_date_end == "2026-05-01"
    before = {p: p.stat().st_mtime_ns for p in raw.rglob("part-*")}
    assert cli.main(["collect", *asked], spark) == "r1-p02" and {p: p.stat().st_mtime_ns for p in raw.rglob("part-*")} == before
    assert cli.main(["normalize", *asked[:2], "--run", "r1-p02"], spark) == "r1-p02"
    from forumetry.operators import store

    assert store.load(spark, str(root), "collection_runs").first().source_run_ids == ["r1-p01", "r1-p02"]
    with pytest.raises(SystemExit):
        cli.main(["report", "--config", str(tmp_path / "none.yaml")], spark) if (tmp_path / "none.yaml").write_text(json.dumps({"source": {"source_id": "x"}, "sides": [{"side_id": "a", "name": "A"}]})) else None


def test_raw_payloads(spark, tmp_path):
    from forumetry.sources import raw

    rows = [("api_comments", "1_2 depth 0", '{"a": 1}'), ("api_comments", "1_2-depth-0", '{"a": 2}'), ("web_post_pages", "ü", "{}"), (None, None, None)]
    got = raw.write_payloads(spark.createDataFrame(rows, raw.SCHEMA), str(tmp_path), "r1")
    assert sorted((r.category or "", r.raw_path, r.payload) for r in got.collect()) == [("", "/item", None), ("api_comments", "api_comments/1-2-depth-0", '{"a": 2}'), ("web_post_pages", "web_post_pages/item", "{}")]
    raw.write_payloads(spark.createDataFrame([("web_post_pages", "other", "[]")], raw.SCHEMA), str(tmp_path), "r1")
    assert {r.raw_path for r in raw.read_payloads(spark, str(tmp_path), "r1").collect()} == {"/item", "api_comments/1-2-depth-0", "web_post_pages/other"}
