"""The stages of a project, each from stored tables to stored tables: normalise, analyse, export for review, report."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from forumetry.config import Config
from forumetry.operators import clustering, languages, merge, metrics, narratives, normalize, overrides, providers, report, stance, store
from forumetry.schemas import MANIFEST
from forumetry.sources import collection, manifests


def collect_run(spark: SparkSession, config: Config, raw: str, collectors: dict[str, collection.Collector], run_id: str, passes: int = 1) -> list[str]:
    """Snapshots of a run of one or more passes below `raw`, each from the first collector of the mode's chain that works, without posts outside the
    configured dates. A pass that was collected before for the same request is used again."""
    source = config.source_id or config.source_url or config.source_name
    key = manifests.request_key(config.platform, source, config.mode, config.date_start, config.date_end)
    runs = collection.passes(run_id, passes)
    for run in runs:
        if collection.reused(spark, raw, run, key) is None:
            got = collection.collected(run, collection.chain(config.platform, config.mode, collectors), config.date_start, config.date_end)
            asked = collection.within(got, config.date_start, config.date_end).withColumn("mode", F.lit(config.mode))
            manifests.write_manifests(asked, f"{raw}/{run}/manifest.json")
    return runs


def normalize_run(spark: SparkSession, config: Config, raw: str, root: str, run_id: str) -> dict[str, DataFrame]:
    """Merges the run with the runs before that go together with it, and upserts the eight tables."""
    read = manifests.read_manifests(spark, f"{raw}/*/manifest.json")
    if config.source_run_ids:
        wanted = spark.createDataFrame([(r,) for r in config.source_run_ids], "run_id string")
        if missing := [r.run_id for r in merge.missing_runs(wanted, read).collect()]:
            raise ValueError(f"no snapshots of {', '.join(sorted(missing))}")
        runs = list(config.source_run_ids)
    else:
        runs = [r.run_id for r in merge.compatible_runs(read, run_id, config.merge_recent_runs).collect()]
        if not runs:
            raise ValueError(f"no snapshot of {run_id}")
    return {name: store.upsert(df, root, name) for name, df in merge.merged_tables(read, runs, run_id, MANIFEST).items()}


def items_of_run(t: dict[str, DataFrame], limit: int | None = None) -> DataFrame:
    """Origin posts, re-shares and comments with text, as one frame of items."""
    posts = stance.items_of(normalize.origin_posts(t["posts"]), "post", "post_id", limit=limit)
    shares = stance.items_of(t["propagations"], "propagation", "propagation_id", limit=limit)
    return posts.unionByName(shares).unionByName(stance.items_of(t["comments"], "comment", "comment_id", "parent_post_id", limit))


def analyze_run(
    spark: SparkSession, config: Config, root: str, run_id: str, now: str, embedder: providers.EmbeddingProvider | None = None, model: providers.TextModel | None = None,
    clusters: Callable[[DataFrame], DataFrame] | None = None, profiles: languages.Profiles | None = None,
) -> dict[str, DataFrame]:
    """Languages, embeddings, clusters, stances and support of a run. Texts that the caches have are neither embedded nor labelled again. `clusters`
    assigns items with embeddings to clusters, by density unless another function is given; a null one is noise. Languages are told by `profiles`, or
    by those of the seeds, and have to be among the configured ones."""
    t = {n: store.load(spark, root, n).where(F.col("run_id") == run_id) for n in ("posts", "propagations", "comments")}
    items = store.checkpointed(items_of_run(t, config.max_items))
    stamped = lambda df, name: normalize.shaped(df.withColumn("run_id", F.lit(run_id)), name)
    names = embedder.name if embedder else providers.HASH, model.name if model else providers.HEURISTIC
    key = providers.provider_key(names[0], config.embedding_kind, config.embedding_model, config.dimension, config.embedding_url)
    vectors, embedded = providers.cached_embeddings(items, store.load(spark, root, "embedding_cache"), key, now, config.dimension, embedder, config.batch_size)
    vectors = store.checkpointed(vectors)  # before the cache that it reads is written
    store.upsert(normalize.shaped(embedded, "embedding_cache"), root, "embedding_cache")
    by_density = lambda df: clustering.density_clusters(df, config.min_cluster_size, config.min_samples)
    assigned = (clusters or by_density)(vectors).withColumn("cluster_id", F.concat_ws("-", "item_type", F.coalesce("cluster", F.lit("noise"))))
    members = store.checkpointed(items.join(assigned.select("item_type", "item_id", "cluster_id"), ["item_type", "item_id"]).withColumn("ord", F.col("item_id")))
    by_model = (lambda texts: providers.model_labels(texts, list(config.sides), model)) if model else None
    labels, fresh = stance.cached_labels(items.drop("parent_post_id"), store.load(spark, root, "stance_cache"), list(config.sides), names[1], now, by_model)
    labels = store.checkpointed(labels)
    store.upsert(normalize.shaped(fresh, "stance_cache"), root, "stance_cache")
    support = metrics.support_metrics(labels, t["comments"], members)
    counts = items.groupBy().pivot("item_type", ["post", "propagation", "comment"]).count()
    run = counts.select(F.lit(names[0]).alias("embedding_provider"), F.lit(names[1]).alias("llm_provider"), F.to_json(F.struct(*counts.columns)).alias("item_counts"), F.lit(now).alias("created_at"))
    narrated = narratives.summaries(members, run_id, config.exemplar_count)
    if model:
        narrated = providers.model_summaries(narrated, narratives.first_texts(members), model)
    made = {
        "detected_languages": languages.detect(items, profiles or languages.seeded(spark), config.languages), "cluster_memberships": members, "narrative_clusters": narrated, "stance_labels": labels, "support_metrics": support, "analysis_runs": run,
    }
    return {name: store.upsert(stamped(df, name), root, name) for name, df in made.items()}


def review_sheets(spark: SparkSession, root: str, review: str, run_id: str) -> dict[str, DataFrame]:
    """Sheets to edit, of clusters and stances; what was edited in older ones stays."""
    own = lambda n: store.load(spark, root, n).where(F.col("run_id") == run_id)
    empty = lambda *names: [F.lit("").alias(n) for n in names]
    sheets = {
        "narrative_overrides": (own("narrative_clusters").select("item_type", "cluster_id", F.col("label").alias("current_label"), F.col("description").alias("current_description"), *empty("action", "target_cluster_id", "new_label", "new_description")), ["item_type", "cluster_id"], ["action", "target_cluster_id", "new_label", "new_description"]),
        "stance_overrides": (own("stance_labels").select("item_type", "item_id", "side_id", F.col("label").alias("current_label"), "confidence", *empty("override_label", "override_confidence", "note")), ["item_type", "item_id", "side_id"], ["override_label", "override_confidence", "note"]),
    }
    out = {}
    for name, (sheet, keys, editable) in sheets.items():
        path = f"{review}/{name}"
        if store.exists(spark, path):
            sheet = overrides.review_sheet(sheet, store.read_csv(spark, path), keys, editable)
        out[name] = store.checkpointed(sheet)
        store.write_csv(out[name], path)
    counts = {"run_id": run_id, "cluster_count": out["narrative_overrides"].count(), "stance_labels_count": out["stance_overrides"].count()}
    store.write_bytes(spark, f"{review}/current_analysis_snapshot.json", json.dumps(counts, ensure_ascii=False, indent=2).encode())
    return out


def report_run(spark: SparkSession, root: str, review: str, run_id: str, raw: str | None = None) -> dict[str, DataFrame]:
    """The report's tables, with corrections applied before anything is counted. Source runs are traced by their snapshots below `raw`."""
    names = ("posts", "propagations", "comments", "collection_runs", "stance_labels", "cluster_memberships", "narrative_clusters", "detected_languages")
    t = {n: store.load(spark, root, n).where(F.col("run_id") == run_id) for n in names}
    if store.exists(spark, f"{review}/narrative_overrides"):
        edits = store.read_csv(spark, f"{review}/narrative_overrides")
        t["narrative_clusters"], t["cluster_memberships"] = overrides.narrative(t["narrative_clusters"], t["cluster_memberships"], edits)
        t["narrative_clusters"] = normalize.shaped(t["narrative_clusters"], "narrative_clusters")
    if store.exists(spark, f"{review}/stance_overrides"):
        t["stance_labels"] = overrides.stances(t["stance_labels"], store.read_csv(spark, f"{review}/stance_overrides"))
    seen = manifests.read_manifests(spark, f"{raw}/*/manifest.json", strict=False) if raw else None
    return report.tables(t, run_id, seen)


def report_head(spark: SparkSession, root: str, run_id: str) -> tuple[dict[str, list[tuple[str, object]]], dict[str, DataFrame]]:
    """What a report shows before its tables: facts by section, and the run's warnings and quotes."""
    names = ("posts", "propagations", "comments", "collection_runs", "analysis_runs", "narrative_clusters", "cluster_memberships")
    t = {n: store.load(spark, root, n) for n in names}
    analysed = t["analysis_runs"].where(F.col("run_id") == run_id).first()
    heuristic = analysed is None or analysed.llm_provider == providers.HEURISTIC
    return report.facts(t, run_id), {"data_quality_warnings": report.warnings(t, run_id, heuristic), "quotes": report.quoted(t, run_id)}
