import hashlib

import corpus_pipeline
from forumetry.llm import decontaminate, quality
from forumetry.llm.common import keyed, saved

from .helpers import documents
from .test_near_duplicates import similar_groups


def test_stages_do_the_whole_job(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    out = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = saved(stage(spark, docs, sf), f"test-{k}")
        out.append(docs)
        assert k == len(corpus_pipeline.STAGES) - 1 or docs.columns == columns
    good, first, fresh, clean, ids = out
    scores = {r.doc_id: r.predicted for r in quality.op9_quality_trees(spark, sf).collect()}
    assert {r.doc_id for r in good.collect()} == {d for d, p in scores.items() if p}
    rows = sorted((r.doc_id, r.text) for r in good.collect())
    assert sorted(r.doc_id for r in first.collect()) == sorted({rows[k][0] for k in similar_groups([t for _, t in rows])})
    assert decontaminate.contained(keyed(clean), spark.read.parquet(f"{sf}/benchmark.parquet")).count() == 0
    assert {r.doc_id: r.text for r in clean.collect()} == {r.doc_id: r.text for r in ids.collect()}
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, sf).collect()) == sorted(r.doc_id for r in ids.collect())
    whole = {r.doc_id: hashlib.sha256((r.text or "").encode()).hexdigest() for r in first.collect()}
    assert all(r.doc_id in whole for r in fresh.collect())


def test_stages_stand_empty_tables(spark, sf):
    docs = documents(spark).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf).count() == 0
