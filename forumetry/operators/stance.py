"""Stance of texts towards configured sides, and which language a text is in: expressions over markers, without Python on the rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forumetry.functions.text import or_empty, text_hash

#: Markers of approval and of rejection, and words that only English has.
POSITIVE = ("good", "great", "support", "agree", "important", "справедливо", "підтримую", "поддерживаю", "молодцы", "дякую")
NEGATIVE = ("bad", "wrong", "oppose", "against", "hate", "не поддерживаю", "против", "брехня", "ложь", "коррупция")
ENGLISH = ("the", "and", "with", "that", "this", "from", "will")


@dataclass(frozen=True)
class Side:
    side_id: str
    name: str
    aliases: tuple[str, ...] = ()
    support: tuple[str, ...] = ()
    oppose: tuple[str, ...] = ()

    @property
    def names(self) -> tuple[str, ...]:
        return tuple(x.lower() for x in (self.name, *self.aliases) if x)

    @property
    def fingerprint(self) -> str:
        """Goes into cache keys, so that a side with other words doesn't get old labels."""
        return "|".join((self.side_id, *self.names, "+", *self.support, "-", *self.oppose))


def hits(text: Column, markers: tuple[str, ...]) -> Column:
    """How many of the markers occur in a lower-case text."""
    return sum((text.contains(m.lower()).cast("int") for m in markers), F.lit(0))


def stance(text: Column, side: Side) -> Column:
    """struct<label, confidence> of a text towards a side. Labels and confidences."""
    low = F.lower(or_empty(text))
    mentioned = hits(low, side.names) > 0
    own_for, own_against = hits(low, side.support), hits(low, side.oppose)
    pro, con = own_for + hits(low, POSITIVE), own_against + hits(low, NEGATIVE)
    sure = lambda n: F.least(F.lit(0.55) + F.lit(0.1) * n, F.lit(0.95))
    result = lambda label, confidence: F.struct(F.lit(label).alias("label"), confidence.alias("confidence"))
    return (
        F.when(F.trim(low) == "", result("unclear", F.lit(0.0)))
        .when((pro > con) & (mentioned | (own_for > 0)), result("support", sure(pro)))
        .when((con > pro) & (mentioned | (own_against > 0)), result("oppose", sure(con)))
        .when(mentioned, result("neutral", F.lit(0.45)))
        .otherwise(result("unclear", F.lit(0.35)))
    )


def label_items(items: DataFrame, sides: list[Side]) -> DataFrame:
    """items (item_type, item_id, text, ...) with a row for each side: side_id, label, confidence. Items x sides by exploding an array of as
    many structs as there are sides, so nothing is shuffled."""
    each = F.array(*(F.struct(F.lit(s.side_id).alias("side_id"), stance(F.col("text"), s).alias("s")) for s in sides))
    return items.withColumn("_side", F.explode(each)).select(*items.columns, "_side.side_id", "_side.s.label", F.round("_side.s.confidence", 4).alias("confidence")).drop("text")


def cached_labels(items: DataFrame, cache: DataFrame, sides: list[Side], key: str, now: str, by_model=None) -> tuple[DataFrame, DataFrame]:
    """(labels of all items, new cache rows). Each text that the cache lacks for a side is labelled once, however many items have it: by the
    expressions here, or by by_model, from texts (text_hash, side_id, text) to (text_hash, side_id, label, confidence)."""
    model = F.lit(key)
    prints = {s.side_id: f"{key}|{s.fingerprint}" for s in sides}
    wanted = items.withColumn("text_hash", text_hash(F.col("text"))).withColumn("_s", F.explode(F.array(*(F.struct(F.lit(i).alias("side_id"), F.lit(k).alias("llm_key")) for i, k in prints.items()))))
    wanted = wanted.select(*items.columns, "text_hash", "_s.side_id", "_s.llm_key")
    on = ["llm_key", "text_hash", "side_id"]
    # one row a text and side, by partial aggregates: a text that many items have is no hot key
    missing = wanted.groupBy(*on).agg(F.first("text").alias("text")).join(cache.select(*on), on, "left_anti")
    if by_model is None:
        fresh = label_items(missing.withColumns({"of": F.col("side_id"), "said": F.col("text")}).drop("side_id"), sides).where("of = side_id").withColumnRenamed("said", "text")
    else:
        from forumetry.operators.store import checkpointed

        missing = checkpointed(missing)
        fresh = missing.join(by_model(missing), ["text_hash", "side_id"])
    fresh = fresh.select("llm_key", "text_hash", "text", "side_id", "label", "confidence", model.alias("model_name"), F.lit(now).alias("created_at"))
    known = cache.select(*on, "label", "confidence", "model_name").unionByName(fresh.select(*on, "label", "confidence", "model_name"))
    return wanted.join(known, on).select(*[c for c in items.columns if c != "text"], "side_id", "label", "confidence", "model_name"), fresh


def language(text: Column) -> Column:
    """struct<language, confidence, method> by scripts and words that only one language has. Letters, confidences and methods."""
    bare = F.trim(F.regexp_replace(or_empty(text), r"^(?U)\s+|(?U)\s+$", ""))
    low = F.lower(bare)
    result = lambda name, confidence, how: F.struct(F.lit(name).alias("language"), F.lit(confidence).alias("confidence"), F.lit(how).alias("method"))
    tokens = F.regexp_extract_all(low, F.lit(r"[a-zA-Z']+"), F.lit(0))
    return (
        F.when(bare == "", result("unknown", 0.0, "empty"))
        .when(low.rlike("[іїєґ]"), result("uk", 0.72, "heuristic-script"))
        .when(low.rlike("[ыэёъ]"), result("ru", 0.72, "heuristic-script"))
        .when(low.rlike("[а-я]"), result("ru", 0.58, "heuristic-cyrillic"))
        .when(F.arrays_overlap(tokens, F.array(*(F.lit(w) for w in ENGLISH))), result("en", 0.6, "heuristic-lexicon"))
        .when(low.rlike("[a-z]"), result("en", 0.45, "heuristic-latin"))
        .otherwise(result("unknown", 0.2, "heuristic-fallback"))
    )


def detect_languages(items: DataFrame) -> DataFrame:
    """(item_type, item_id, language, confidence, method)."""
    return items.select("item_type", "item_id", language(F.col("text")).alias("l")).select("item_type", "item_id", "l.*")


def items_of(frame: DataFrame, item_type: str, key: str, parent: str | None = None, limit: int | None = None) -> DataFrame:
    """(item_type, item_id, text, parent_post_id) of the rows whose message isn't empty; at most `limit`, those of least id."""
    rows = frame.select(F.lit(item_type).alias("item_type"), F.col(key).alias("item_id"), F.col("message").alias("text"), (F.col(parent) if parent else F.lit(None).cast("string")).alias("parent_post_id"))
    rows = rows.where(F.length("text") > 0)
    return rows.orderBy("item_id").limit(limit) if limit else rows
