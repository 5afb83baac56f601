"""Command line: python -m forumetry.cli VERB --config FILE [--raw DIR] [--root DIR] [--run RUN].

Folders that aren't named are those of the configuration's `paths` (raw, root, review, out). With --collector NAME=MODULE:FUNCTION, once or more,
`collect` and `run-all` first collect a run, in one or more passes.
"""

from __future__ import annotations

import argparse
import datetime
import importlib
import tempfile

from pyspark.sql import SparkSession

from forumetry import config
from forumetry.operators import report, store
from forumetry.plans import lifecycle
from forumetry.sources import collection, manifests

VERBS = ("collect", "normalize", "analyze", "review-export", "report", "export-tables", "run-all")


def _collector(named: str) -> tuple[str, collection.Collector]:
    """NAME=MODULE:FUNCTION as the name and the function."""
    name, _, place = named.partition("=")
    module, _, function = place.partition(":")
    return name, getattr(importlib.import_module(module), function)


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> str:
    parser = argparse.ArgumentParser(prog="forumetry", description=__doc__)
    parser.add_argument("verb", choices=VERBS)
    parser.add_argument("--config", required=True)
    for name in ("raw", "root", "review", "out", "run"):
        parser.add_argument(f"--{name}")
    parser.add_argument("--collector", action="append", default=[])
    parser.add_argument("--passes", type=int, default=1)
    a = parser.parse_args(args)
    spark = spark or SparkSession.builder.appName("forumetry").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    project = config.load(a.config)
    a.raw, a.root = (getattr(a, name) or project.paths.get(name) or parser.error(f"--{name} or a path of the configuration is needed") for name in ("raw", "root"))
    review, out = a.review or project.paths.get("review") or f"{a.root}/review", a.out or project.paths.get("out") or f"{a.root}/report"
    if a.verb == "collect" or a.collector:
        known = dict(_collector(x) for x in a.collector)
        started = a.run or collection.run_name(datetime.datetime.now(datetime.UTC))
        a.run = lifecycle.collect_run(spark, project, a.raw, known, started, a.passes)[-1]
    run = a.run or manifests.latest_run(spark, a.raw)
    if not run:
        raise SystemExit(f"no snapshots below {a.raw}")
    every = a.verb == "run-all"
    if every or a.verb == "normalize":
        lifecycle.normalize_run(spark, project, a.raw, a.root, run)
    if every or a.verb == "analyze":
        lifecycle.analyze_run(spark, project, a.root, run, datetime.datetime.now(datetime.UTC).isoformat(timespec="seconds"))
    if every or a.verb == "review-export":
        lifecycle.review_sheets(spark, a.root, review, run)
    if every or a.verb in ("report", "export-tables"):
        made = lifecycle.report_run(spark, a.root, review, run, a.raw)
        report.export(made, f"{out}/tables")
        if a.verb != "export-tables":
            head, more = lifecycle.report_head(spark, a.root, run)
            shown = more | made
            store.write_lines(spark, f"{out}/report.md", report.markdown(shown, f"Run {run}", head))
            store.write_lines(spark, f"{out}/report.html", report.page(shown, f"Run {run}", head))
            with tempfile.TemporaryFile() as f:  # of the driver, which writes it row by row
                report.workbook(made, f)
                f.seek(0)
                store.write_bytes(spark, f"{out}/report.xlsx", f.read())
    return run


if __name__ == "__main__":
    main()
