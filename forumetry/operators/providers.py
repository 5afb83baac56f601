"""Models that a user brings along: embeddings of texts, stances and descriptions of clusters. Without one, the library's expressions are used.

A provider is a Python object that can be pickled; it is called in batches inside tasks, only with texts that the caches lack.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forumetry.operators.narratives import hash_embeddings
from forumetry.operators.stance import Side


class EmbeddingProvider(Protocol):
    name: str

    def embed_texts(self, texts: list[str]) -> Sequence[Sequence[float]]: ...


class TextModel(Protocol):
    name: str

    def classify_stance(self, text: str, side: Side) -> tuple[str, float]: ...

    def summarize_cluster(self, item_type: str, keywords: list[str], texts: list[str]) -> tuple[str, str]: ...


#: What providers may be asked for, and the names of those that need no network.
KINDS, HASH, HEURISTIC = ("auto", "openai_compatible", "hash", "heuristic"), "hash", "heuristic_llm"


def chosen(kind: str, remote, url: str | None, key: str | None):
    """The remote provider if it's asked for by name, or by `auto` where it has a URL and a key; else None, for the library's own."""
    if kind not in KINDS:
        raise ValueError(f"unknown provider {kind!r}, only {', '.join(KINDS)}")
    if kind == "openai_compatible" and not (url and key):
        raise ValueError("an openai_compatible provider needs a URL and a key")
    return remote if kind == "openai_compatible" or kind == "auto" and url and key else None


def provider_key(name: str, kind: str, model: str, dimension: int, url: str | None) -> str:
    """Goes into cache keys, so that another model doesn't get old vectors."""
    return "|".join((name, kind, model, str(dimension), url or ""))


def _batched(frames: Iterator[pd.DataFrame], size: int) -> Iterator[pd.DataFrame]:
    for pdf in frames:
        for at in range(0, len(pdf), max(1, size)):
            yield pdf.iloc[at : at + max(1, size)]


def embedded(texts: DataFrame, provider: EmbeddingProvider | None, dimension: int, batch: int = 25) -> DataFrame:
    """(text_hash, embedding) of texts (text_hash, text)."""
    if provider is None:
        items = texts.select(F.lit("text").alias("item_type"), F.col("text_hash").alias("item_id"), "text")
        return hash_embeddings(items, dimension).select(F.col("item_id").alias("text_hash"), "embedding")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _batched(frames, batch):
            vectors = provider.embed_texts(pdf["text"].tolist())
            yield pd.DataFrame({"text_hash": pdf["text_hash"].tolist(), "embedding": [[float(x) for x in v] for v in vectors]})

    return texts.select("text_hash", "text").mapInPandas(run, "text_hash string, embedding array<double>")


def cached_embeddings(items: DataFrame, cache: DataFrame, key: str, now: str, dimension: int, provider: EmbeddingProvider | None = None, batch: int = 25) -> tuple[DataFrame, DataFrame]:
    """((item_type, item_id, embedding) of all items (item_type, item_id, text), new cache rows). Each text that the cache lacks is embedded once,
    however many items have it."""
    from forumetry.functions.text import text_hash
    from forumetry.operators.store import checkpointed

    wanted = items.select("item_type", "item_id", "text", text_hash(F.col("text")).alias("text_hash"))
    known = cache.where(F.col("provider_key") == key).select("text_hash", "embedding")
    # one row a text: partial aggregates, so that a text that many items have is no hot key
    missing = wanted.groupBy("text_hash").agg(F.first("text").alias("text")).join(known.select("text_hash"), "text_hash", "left_anti")
    missing = checkpointed(missing)
    fresh = missing.join(embedded(missing, provider, dimension, batch), "text_hash")
    fresh = checkpointed(fresh.select(F.lit(key).alias("provider_key"), "text_hash", "text", F.col("embedding").cast("array<double>").alias("embedding"), F.lit(now).alias("created_at")))
    every = known.unionByName(fresh.select("text_hash", "embedding"))
    return wanted.join(every, "text_hash").select("item_type", "item_id", "embedding"), fresh


def model_labels(texts: DataFrame, sides: list[Side], model: TextModel) -> DataFrame:
    """(text_hash, side_id, label, confidence) by a text model, of texts (text_hash, side_id, text)."""
    by_id = {s.side_id: s for s in sides}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            made = [model.classify_stance(t, by_id[s]) for t, s in zip(pdf["text"], pdf["side_id"], strict=True)]
            yield pd.DataFrame({"text_hash": pdf["text_hash"].tolist(), "side_id": pdf["side_id"].tolist(), "label": [str(x[0]) for x in made], "confidence": [float(x[1]) for x in made]})

    return texts.select("text_hash", "side_id", "text").mapInPandas(run, "text_hash string, side_id string, label string, confidence double")


def model_summaries(clusters: DataFrame, texts: DataFrame, model: TextModel) -> DataFrame:
    """clusters with label and description by a text model, where it has any, from their keywords and `texts` (item_type, cluster_id, texts)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            made = [model.summarize_cluster(k, list(w), list(t)) for k, w, t in zip(pdf["item_type"], pdf["top_keywords"], pdf["texts"], strict=True)]
            yield pdf[["item_type", "cluster_id"]].assign(_label=[x[0] or None for x in made], _description=[x[1] for x in made])

    none = F.array().cast("array<string>")
    asked = clusters.join(texts, ["item_type", "cluster_id"], "left").select("item_type", "cluster_id", "top_keywords", F.coalesce("texts", none).alias("texts"))
    said = asked.mapInPandas(run, "item_type string, cluster_id string, _label string, _description string")
    named = clusters.join(said, ["item_type", "cluster_id"], "left")
    return named.withColumns({"label": F.coalesce("_label", "cluster_id"), "description": F.coalesce("_description", F.lit(""))}).select(*clusters.columns)
