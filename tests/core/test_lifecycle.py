import io
import json
import zipfile

import pytest

from forumetry import cli, config
from forumetry.operators import providers, report, store
from forumetry.plans import lifecycle
from forumetry.schemas import TABLES

from .test_snapshots import snapshot

CONFIG = """
source: {platform: facebook, source_id: page_1}
collector: {mode: web}
sides: [{side_id: a, name: text, support_keywords: ["1"], oppose_keywords: ["2"]}]
normalization: {merge_recent_runs: 2}
"""


def test_from_snapshots_to_report(spark, tmp_path):
    for s in (snapshot("r1"), snapshot("r2", extra=True, warnings=["careful"])):
        (tmp_path / "raw" / s["run_id"]).mkdir(parents=True)
        (tmp_path / "raw" / s["run_id"] / "manifest.json").write_text(json.dumps(s))
    (tmp_path / "c.yaml").write_text(CONFIG)
    root, review, out = (str(tmp_path / n) for n in ("root", "review", "out"))
    flags = ["--config", str(tmp_path / "c.yaml"), "--raw", str(tmp_path / "raw"), "--root", root, "--review", review, "--out", out]
    assert cli.main(["run-all", *flags], spark) == "r2"
    assert store.load(spark, root, "comments").count() == 3 and store.load(spark, root, "stance_cache").count() == 5
    labels = {r.item_id: r.label for r in store.load(spark, root, "stance_labels").where("item_type = 'comment'").collect()}
    assert labels == {"c1": "support", "c2": "oppose", "c3": "neutral"}
    made = lifecycle.report_run(spark, root, review, "r2")
    assert [tuple(r) for r in made["per_side_support"].select("support_count", "oppose_count", "neutral_count").collect()] == [(1, 1, 1)]
    # a correction by hand counts, and stays when the sheet is made again
    edited = store.read_csv(spark, f"{review}/stance_overrides")
    rows = [{**r.asDict(), "override_label": "oppose" if r.item_id == "c3" else r.override_label} for r in edited.collect()]
    store.write_csv(spark.createDataFrame(rows, edited.schema), f"{review}/stance_overrides")
    made = lifecycle.report_run(spark, root, review, "r2")
    assert [tuple(r) for r in made["per_side_support"].select("support_count", "oppose_count", "neutral_count").collect()] == [(1, 2, 0)]
    sheets = lifecycle.review_sheets(spark, root, review, "r2")
    assert sheets["stance_overrides"].where("item_id = 'c3'").first().override_label == "oppose"
    # a second analysis labels and embeds nothing anew
    embedded = sorted(map(tuple, store.load(spark, root, "embedding_cache").select("text_hash", "created_at").collect()))
    assert len(embedded) == 5
    cli.main(["analyze", *flags], spark)
    assert store.load(spark, root, "stance_cache").count() == 5
    assert sorted(map(tuple, store.load(spark, root, "embedding_cache").select("text_hash", "created_at").collect())) == embedded
    trace = {r.source_run_id: r.warning_count for r in lifecycle.report_run(spark, root, review, "r2", str(tmp_path / "raw"))["source_run_trace"].collect()}
    assert trace == {"r1": 0, "r2": 1}
    with zipfile.ZipFile(io.BytesIO((tmp_path / "out" / "report.xlsx").read_bytes())) as z:
        assert z.testzip() is None and len([n for n in z.namelist() if "worksheets/sheet" in n]) == 20
    assert "careful" in (tmp_path / "out" / "report.md").read_text() and "<table>" in (tmp_path / "out" / "report.html").read_text()


class Model:
    """A provider of both kinds, for tests."""

    name = "fake"

    def embed_texts(self, texts):
        return [[float(len(t)), 1.0] for t in texts]

    def classify_stance(self, text, side):
        return "oppose", 0.75

    def summarize_cluster(self, item_type, keywords, texts):
        return f"{item_type} of {len(texts)}", "described"


def test_providers_of_a_user(spark, tmp_path):
    (tmp_path / "raw" / "r1").mkdir(parents=True)
    (tmp_path / "raw" / "r1" / "manifest.json").write_text(json.dumps(snapshot("r1")))
    (tmp_path / "c.yaml").write_text(CONFIG)
    project, root = config.load(str(tmp_path / "c.yaml")), str(tmp_path / "root")
    lifecycle.normalize_run(spark, project, str(tmp_path / "raw"), root, "r1")
    made = lifecycle.analyze_run(spark, project, root, "r1", "now", Model(), Model())
    assert {(r.label, r.confidence, r.model_name) for r in made["stance_labels"].collect()} == {("oppose", 0.75, "fake")}
    assert {len(r.embedding) for r in store.load(spark, root, "embedding_cache").collect()} == {2}
    assert {r.description for r in made["narrative_clusters"].collect()} == {"described"} and made["analysis_runs"].first().embedding_provider == "fake"


def test_choice_of_providers():
    assert providers.chosen("auto", "r", "u", "k") == "r" and providers.chosen("auto", "r", "u", None) is None and providers.chosen("hash", "r", "u", "k") is None
    for kind in ("openai_compatible", "other"):
        with pytest.raises(ValueError):
            providers.chosen(kind, "r", None, "k")


def test_interrupted_upserts_lose_nothing(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    row = lambda run, item, label: (run, "comment", item, "a", label, 0.5, "m")
    frame = lambda *rows: spark.createDataFrame(rows, TABLES["stance_labels"])
    store.upsert(frame(row("r1", "c1", "support"), row("r2", "c1", "oppose")), root, "stance_labels")
    before = sorted(map(tuple, store.load(spark, root, "stance_labels").collect()))
    more = frame(row("r2", "c1", "neutral"), row("r2", "c2", "support"))
    for step in ("_publish_version", "write_bytes"):
        with monkeypatch.context() as m:
            m.setattr(store, step, lambda *a: (_ for _ in ()).throw(KeyboardInterrupt()))
            with pytest.raises(KeyboardInterrupt):
                store.upsert(more, root, "stance_labels")
        assert sorted(map(tuple, store.load(spark, root, "stance_labels").collect())) == before
    store.upsert(more, root, "stance_labels")
    got = sorted((r.run_id, r.item_id, r.label) for r in store.load(spark, root, "stance_labels").collect())
    assert got == [("r1", "c1", "support"), ("r2", "c1", "neutral"), ("r2", "c2", "support")]
    assert set(store.current(spark, root, "stance_labels").folders) == {"r1", "r2"}


def test_workbook_has_all_rows(spark, monkeypatch):
    monkeypatch.setattr(report, "SHEET_ROWS", 1001)
    out = io.BytesIO()
    report.workbook({"a table with a name that is far too long": spark.range(2500), "empty": spark.range(0), "texts": spark.createDataFrame([("a<b", 1.5, None)], "t string, n double, l array<int>")}, out)
    with zipfile.ZipFile(out) as z:
        sheets = [z.read(f"xl/worksheets/sheet{k}.xml").decode() for k in range(1, 6)]
        assert [s.count("<row>") for s in sheets] == [1001, 1001, 501, 1, 2] and "<c><v>2499</v></c>" in sheets[2] and "a&lt;b" in sheets[4] and "<v>1.5</v>" in sheets[4]


def test_publish(spark):
    store.publish(spark.range(3), "published_numbers")
    store.publish(spark.range(4), "published_numbers")
    assert spark.table("published_numbers").count() == 4
