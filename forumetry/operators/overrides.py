"""Corrections by people: clusters merged or renamed, stances set, and review sheets that keep what was edited before."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forumetry.operators.normalize import or_null


def _set(c: str):
    return or_null(F.trim(c))


def narrative(clusters: DataFrame, memberships: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Clusters and memberships after edits (item_type, cluster_id, action, target_cluster_id, new_label, new_description).

    A merge is one hop. New labels and descriptions go to the target of their edit, or to its own cluster. Of clusters merged into one, the
    one of least original id gives what isn't set.
    """
    named = edits.select("item_type", "cluster_id", F.lower(F.trim("action")).alias("action"), _set("target_cluster_id").alias("target"), _set("new_label").alias("new_label"), _set("new_description").alias("new_description"))
    hops = named.where("action = 'merge' AND target IS NOT NULL").groupBy("item_type", "cluster_id").agg(F.max("target").alias("target"))
    news = named.withColumn("cluster_id", F.coalesce("target", "cluster_id")).groupBy("item_type", "cluster_id").agg(F.max("new_label").alias("new_label"), F.max("new_description").alias("new_description"))
    moved = lambda df: df.join(hops, ["item_type", "cluster_id"], "left").withColumn("_from", F.col("cluster_id")).withColumn("cluster_id", F.coalesce("target", "cluster_id")).drop("target")
    kept = ("label", "description", "top_keywords", "exemplar_ids")
    merged = moved(clusters).groupBy("item_type", "cluster_id", "run_id").agg(*(F.min_by(c, "_from").alias(c) for c in kept))
    renamed = merged.join(news, ["item_type", "cluster_id"], "left").withColumns({"label": F.coalesce("new_label", "label"), "description": F.coalesce("new_description", "description")}).drop("new_label", "new_description")
    return renamed, moved(memberships).drop("_from").select(*memberships.columns)


def stances(labels: DataFrame, edits: DataFrame) -> DataFrame:
    """Stances after edits (item_type, item_id, side_id, override_label, override_confidence), all of them text; what is no number is passed over."""
    key = ["item_type", "item_id", "side_id"]
    own = edits.groupBy(*key).agg(F.max(_set("override_label")).alias("_label"), F.max(F.trim("override_confidence").try_cast("double")).alias("_confidence"))
    return labels.join(own, key, "left").withColumns({"label": F.coalesce("_label", "label"), "confidence": F.coalesce("_confidence", "confidence")}).select(*labels.columns)


def review_sheet(current: DataFrame, edited: DataFrame, keys: list[str], editable: list[str]) -> DataFrame:
    """current with its editable columns as they were edited before, where they were."""
    before = edited.select(*keys, *(or_null(c).alias(f"_old_{c}") for c in editable))
    return current.join(before, keys, "left").withColumns({c: F.coalesce(f"_old_{c}", c) for c in editable}).select(*current.columns)
