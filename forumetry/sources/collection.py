"""Runs of collectors: names of runs and passes, the first collector of a chain that works, and snapshots that are used again.

A collector is a function from a run's id to its snapshots (rows by the MANIFEST schema). What talks to a network is the user's.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from forumetry.schemas import MANIFEST
from forumetry.sources import manifests

Collector = Callable[[str], DataFrame]
#: Which collectors a mode tries, in order, where it isn't the one of its own name.
CHAINS = {("facebook", "hybrid"): ("api", "web")}


def run_name(now: datetime.datetime) -> str:
    """A run's id: its time in UTC, so that ids are in the order of the runs."""
    return now.astimezone(datetime.UTC).strftime("%Y%m%dT%H%M%SZ")


def passes(run_id: str, n: int) -> list[str]:
    """The ids of a run of n passes; a run of one is itself."""
    return [run_id] if n <= 1 else [f"{run_id}-p{k:02d}" for k in range(1, n + 1)]


def chain(platform: str, mode: str, known: dict[str, Collector]) -> list[tuple[str, Collector]]:
    """The collectors to try, in order; those of a chain that aren't there are left out."""
    names = CHAINS.get((platform, mode), (mode,))
    found = [(name, known[name]) for name in names if name in known]
    if not found:
        raise ValueError(f"no collector for {platform} in mode {mode}")
    return found


def collected(run_id: str, collectors: Sequence[tuple[str, Collector]], start: str | None = None, end: str | None = None) -> DataFrame:
    """The snapshot of the first collector that doesn't fail, with the asked dates. Failures before it are its first warnings, and tell that it is a
    fallback. A collector's frame is computed here, so that it fails here."""
    from forumetry.operators.store import checkpointed

    failed: list[str] = []
    for k, (name, collect) in enumerate(collectors):
        try:
            got = checkpointed(collect(run_id))
        except Exception as e:  # noqa: BLE001  whatever a collector raises, the next one is tried
            failed.append(f"{name}: {e}")
            continue
        none = F.array().cast("array<string>")
        made = got.withColumns({
            "warnings": F.concat(F.array(*map(F.lit, failed)).cast("array<string>"), F.coalesce("warnings", none)), "fallback_used": F.lit(k > 0), "requested_date_start": F.lit(start).cast("string"), "requested_date_end": F.lit(end).cast("string"),
        })
        return made.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in MANIFEST.fields))
    raise RuntimeError("all collectors failed: " + "; ".join(failed))


def reused(spark: SparkSession, raw: str, run_id: str, key: tuple[str, ...]) -> DataFrame | None:
    """A run's snapshot on disk, if it was asked for the same; None if there is none or it was asked for something else."""
    if run_id not in manifests.run_ids(spark, raw):
        return None
    found = manifests.matches_request(manifests.read_manifests(spark, f"{raw}/{run_id}/manifest.json", strict=False), key)
    return None if found.isEmpty() else found


def within(snapshots: DataFrame, start: str | None, end: str | None) -> DataFrame:
    """snapshots without the posts that were made outside the asked dates; posts whose time is unknown stay."""
    from forumetry.functions.times import in_range

    if not (start or end):
        return snapshots
    return snapshots.withColumn("posts", F.filter("posts", lambda p: in_range(p["created_at"], start, end, allow_missing=True)))
