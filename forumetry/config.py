"""The configuration of a project: sides, range of dates, analysis, merging and paths, read from YAML and validated."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from forumetry.operators.stance import Side

#: Which collection modes each platform has.
MODES = {"facebook": ("api", "web", "hybrid"), "telegram": ("mtproto", "bot_api", "web"), "x": ("x_api", "web"), "threads": ("threads_api", "web"), "instagram": ("instagram_graph_api", "web")}


@dataclass(frozen=True)
class Config:
    platform: str
    mode: str
    sides: tuple[Side, ...]
    source_id: str = ""
    source_url: str = ""
    source_name: str = ""
    date_start: str | None = None
    date_end: str | None = None
    min_cluster_size: int = 3
    min_samples: int = 1
    exemplar_count: int = 3
    batch_size: int = 25
    embedding_kind: str = "auto"
    embedding_model: str = ""
    embedding_url: str = ""
    dimension: int = 256
    max_items: int | None = None
    languages: tuple[str, ...] = ("ru", "uk", "en")
    merge_recent_runs: int = 1
    source_run_ids: tuple[str, ...] = ()
    paths: dict[str, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.platform not in MODES:
            raise ValueError(f"unknown platform {self.platform!r}")
        if self.mode not in MODES[self.platform]:
            raise ValueError(f"{self.platform} has no mode {self.mode!r}, only {', '.join(MODES[self.platform])}")
        if not (self.source_id or self.source_url or self.source_name):
            raise ValueError("a source needs an id, a URL or a name")
        if not self.sides:
            raise ValueError("at least one side is needed")
        if len({s.side_id for s in self.sides}) < len(self.sides):
            raise ValueError("side ids must differ")


def from_dict(raw: dict[str, Any]) -> Config:
    source, dates, analysis, merging = (raw.get(k) or {} for k in ("source", "date_range", "analysis", "normalization"))
    known = {"source", "date_range", "analysis", "normalization", "sides", "collector", "paths", "providers"}
    embeddings = (raw.get("providers") or {}).get("embeddings") or {}
    named = {"kind": "embedding_kind", "model": "embedding_model", "base_url": "embedding_url", "dimension": "dimension"}
    if extra := set(raw) - known:
        raise ValueError(f"unknown keys: {', '.join(sorted(extra))}")
    sides = tuple(Side(s["side_id"], s["name"], tuple(s.get("aliases") or ()), tuple(s.get("support_keywords") or ()), tuple(s.get("oppose_keywords") or ())) for s in raw.get("sides") or ())
    numbers = {k: analysis[k] for k in ("min_cluster_size", "min_samples", "exemplar_count", "batch_size", "max_items") if k in analysis}
    languages = {"languages": tuple(analysis["languages"])} if "languages" in analysis else {}
    return Config(
        platform=source.get("platform", "facebook"), mode=(raw.get("collector") or {}).get("mode", "web"), sides=sides, source_id=source.get("source_id") or "", source_url=source.get("url") or "", source_name=source.get("source_name") or "",
        date_start=dates.get("start"), date_end=dates.get("end"), merge_recent_runs=max(1, merging.get("merge_recent_runs", 1)), source_run_ids=tuple(merging.get("source_run_ids") or ()), paths=dict(raw.get("paths") or {}),
        **numbers, **languages, **{field: embeddings[k] for k, field in named.items() if embeddings.get(k)},
    )


def load(path: str) -> Config:
    import yaml

    with open(path, encoding="utf-8") as f:
        return from_dict(yaml.safe_load(f) or {})
