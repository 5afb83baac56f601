"""The report's tables from the stored ones, and their export as CSV, Markdown and HTML. Rows of a report pass the driver one partition after
the other."""

from __future__ import annotations

import html
from collections.abc import Iterator
from itertools import islice
from typing import BinaryIO

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forumetry.operators import metrics, narratives, normalize, store, summaries

NAMES = (
    "per_side_support", "per_origin_support", "per_origin_plus_propagations", "per_propagation_support", "per_post_overview", "per_propagation_overview", "per_propagation_comments", "per_thread_conflict",
    "post_narratives", "propagation_narratives", "comment_narratives", "language_mix", "top_supportive_comments", "top_critical_comments", "coverage_gaps", "propagation_coverage_gaps", "reply_depth_summary",
    "top_propagated_items", "source_run_trace", "source_warnings",
)


def source_runs(runs: DataFrame, manifests: DataFrame | None) -> DataFrame:
    """(source_run_id, collector, mode, status, fallback_used, warning_count, warnings) of the runs that were merged into the runs (rows of
    collection_runs), from their snapshots; a run itself stands for those without any."""
    own = runs.select(F.col("run_id").alias("_run"), "collector", "mode", "status", "fallback_used", "warning_count", F.col("warning_messages").alias("warnings"), F.explode("source_run_ids").alias("source_run_id"))
    if manifests is None:
        found = own.limit(0).drop("_run")
    else:
        none = F.array().cast("array<string>")
        seen = manifests.select(F.col("run_id").alias("source_run_id"), "collector", "mode", "status", F.coalesce("fallback_used", F.lit(False)).alias("fallback_used"), F.coalesce("warnings", none).alias("warnings"))
        found = seen.join(own.select("source_run_id").distinct(), "source_run_id", "left_semi").withColumn("warning_count", F.size("warnings").cast("long"))
    alone = own.drop("source_run_id").withColumnRenamed("_run", "source_run_id").distinct()
    return found.select(*alone.columns).unionByName(alone) if found.isEmpty() else found.select(*alone.columns)


def tables(t: dict[str, DataFrame], run_id: str, manifests: DataFrame | None = None) -> dict[str, DataFrame]:
    """The report's tables for a run, from stored tables by name, and of the snapshots that were merged. Overrides are to be applied to clusters,
    memberships and stances before."""
    own = {name: df.where(F.col("run_id") == run_id) if "run_id" in df.columns else df for name, df in t.items()}
    posts, comments, shares, stances = own["posts"], own["comments"], own["propagations"], own["stance_labels"]
    origins, members = normalize.origin_posts(posts), own["cluster_memberships"]
    support = metrics.support_metrics(stances, comments, members)
    scope = lambda kind: support.where(F.col("scope_type") == kind).orderBy(F.desc("support_count"), "scope_id", "side_id")
    clusters = summaries.clusters_with_counts(own["narrative_clusters"], members)
    of_kind = lambda kind: clusters.where(F.col("item_type") == kind).orderBy(F.desc("member_count"), "cluster_id")
    newest = lambda df, key: df.orderBy(F.desc_nulls_first("created_at"), key)
    posted, shared = summaries.post_overview(origins, comments), summaries.propagation_overview(shares, comments)
    traced = source_runs(own["collection_runs"], manifests)
    made = (
        scope("global"), scope("origin_post"), scope("origin_plus_propagations"), scope("propagation"), newest(posted, "post_id"), newest(shared, "propagation_id"), newest(summaries.propagation_comments(comments, shares), "comment_id"),
        metrics.conflicts(stances, comments, origins), of_kind("post"), of_kind("propagation"), of_kind("comment"), summaries.language_mix(own["detected_languages"]).orderBy("item_type", F.desc("n"), "language"),
        metrics.top_comments(stances, comments, "support"), metrics.top_comments(stances, comments, "oppose"), summaries.gaps(posted, "post_id"), summaries.gaps(shared, "propagation_id"), summaries.reply_depths(comments).orderBy("depth"),
        summaries.top_propagated(origins, shares), traced.drop("warnings").orderBy("source_run_id"),
        traced.select("source_run_id", F.posexplode("warnings").alias("i", "warning")).where("warning <> ''").select("source_run_id", (F.col("i") + 1).alias("warning_index"), "warning").orderBy("source_run_id", "warning_index"),
    )
    return dict(zip(NAMES, made, strict=True))


def export(made: dict[str, DataFrame], folder: str) -> None:
    """A CSV a table, lists and structs as JSON."""
    for name, df in made.items():
        store.write_csv(df, f"{folder}/{name}")


def facts(t: dict[str, DataFrame], run_id: str) -> dict[str, list[tuple[str, object]]]:
    """What a report begins with, by section: the source and what was collected of it, its platform's metrics, re-shares, and the runs that were merged.
    Each section is of one row, or of a row a kind; none grows with the run."""
    own = {name: df.where(F.col("run_id") == run_id) if "run_id" in df.columns else df for name, df in t.items()}
    posts, shares, comments, run = own["posts"], own["propagations"], own["comments"], own["collection_runs"]
    row = run.first()
    if row is None:
        return {}
    analysed = own["analysis_runs"].first() if "analysis_runs" in own else None
    named = lambda frame: [(k.replace("_", " "), v) for k, v in frame.first().asDict().items()]
    out = {
        "Source snapshot": [
            ("platform", row.platform), ("source", row.source_name), ("source id", row.source_id), ("source type", row.source_type), ("posts collected", row.post_count),
            ("re-shares", row.propagation_count), ("comments collected", row.comment_count), ("source runs merged", row.source_run_count),
            ("embeddings provider", analysed.embedding_provider if analysed else "n/a"), ("text model", analysed.llm_provider if analysed else "n/a"),
        ],
    }
    if row.platform in summaries.SUMMED:
        summed = summaries.platform_summary(row.platform, posts, comments, run)
        kinds = [(f"reaction {r.reaction}", r.n) for r in summed.first().reactions]
        out[f"{row.platform.capitalize()} metrics"] = named(summed.drop("reactions")) + kinds
    if not shares.isEmpty():
        kinds = [(r.propagation_kind, r.n) for r in summaries.propagation_kinds(shares).orderBy(F.desc("n"), "propagation_kind").collect()]
        out["Propagation summary"] = named(summaries.propagation_summary(shares, comments)) + kinds
    out["Source runs"] = [("source run", r) for r in row.source_run_ids or []]
    return out


def warnings(t: dict[str, DataFrame], run_id: str, heuristic: bool = True) -> DataFrame:
    """(warning) of a run, in the order in which they are shown: the sources' own, then those of the rules."""
    own = {name: t[name].where(F.col("run_id") == run_id) for name in ("collection_runs", "posts", "propagations", "comments")}
    told = own["collection_runs"].select(F.posexplode("warning_messages").alias("ord", "warning"))
    return summaries.quality_warnings(own["collection_runs"], own["posts"], own["propagations"], own["comments"], told, heuristic).orderBy("ord").select("warning")


def quoted(t: dict[str, DataFrame], run_id: str) -> DataFrame:
    """(cluster_id, label, text): comments that stand for the largest clusters."""
    own = {name: t[name].where(F.col("run_id") == run_id) for name in ("narrative_clusters", "cluster_memberships", "comments")}
    clusters = summaries.clusters_with_counts(own["narrative_clusters"], own["cluster_memberships"])
    return narratives.quotes(clusters, own["comments"]).orderBy("rank", "place").select("cluster_id", "label", "text")


def _title(name: str) -> str:
    return name.replace("_", " ").capitalize()


def markdown(made: dict[str, DataFrame], title: str, head: dict[str, list[tuple[str, object]]] | None = None) -> Iterator[str]:
    """The lines of a report: its head, and a section a table with all of its rows, which pass the driver one partition after the other."""
    cell = lambda x: "" if x is None else str(x).replace("|", "\\|").replace("\n", " ")
    line = lambda cells: "| " + " | ".join(map(cell, cells)) + " |"
    yield f"# {title}"
    for name, pairs in (head or {}).items():
        yield from ("", f"## {name}", "", *(f"- {k}: {cell(v)}" for k, v in pairs))
    for name, df in made.items():
        yield from ("", f"## {_title(name)}", "")
        body = df.toLocalIterator()
        first = next(body, None)
        if first is None:
            yield "None."
            continue
        yield from (line(df.columns), "|" + "---|" * len(df.columns), line(first))
        yield from map(line, body)


def page(made: dict[str, DataFrame], title: str, head: dict[str, list[tuple[str, object]]] | None = None) -> Iterator[str]:
    """The same as the lines of an HTML page."""
    cell = lambda tag, x: f"<{tag}>{'' if x is None else html.escape(str(x))}</{tag}>"
    yield f"<!doctype html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1>"
    for name, pairs in (head or {}).items():
        yield f"<h2>{html.escape(name)}</h2><ul>{''.join(cell('li', f'{k}: {v}') for k, v in pairs)}</ul>"
    for name, df in made.items():
        yield f"<h2>{html.escape(_title(name))}</h2><table><tr>{''.join(cell('th', c) for c in df.columns)}</tr>"
        yield from (f"<tr>{''.join(cell('td', x) for x in r)}</tr>" for r in df.toLocalIterator())
        yield "</table>"
    yield "</body></html>"


#: Rows of a sheet at most, by the format.
SHEET_ROWS = 1_048_576


def workbook(made: dict[str, DataFrame], out: BinaryIO) -> None:
    """An XLSX file with a sheet a table, all rows of it: names of 31 characters at most, numbers as numbers. Rows are written as they come, one
    partition after the other. A table of more rows than a sheet may have goes on in further sheets."""
    import zipfile
    from xml.sax.saxutils import escape

    main, package = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/package/2006"
    office = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    names: list[str] = []

    def named(name: str) -> str:
        short, k = name[:31], 2
        while short in names:
            short, k = f"{name[: 30 - len(str(k))]}_{k}", k + 1
        names.append(short)
        return short

    def cell(x) -> str:
        if isinstance(x, (int, float)) and not isinstance(x, bool) and x == x and abs(x) < 1e300:
            return f"<c><v>{x!r}</v></c>"
        return "<c t='inlineStr'><is><t xml:space='preserve'>" + escape("".join(c for c in ("" if x is None else str(x)) if c >= " " or c in "\n\t")) + "</t></is></c>"

    line = lambda r: ("<row>" + "".join(map(cell, r)) + "</row>").encode()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, df in made.items():
            rest, more = store.flat_cells(df).toLocalIterator(), True
            while more:
                named(name)
                with z.open(f"xl/worksheets/sheet{len(names)}.xml", "w") as sheet:
                    sheet.write(f"<worksheet xmlns='{main}'><sheetData>".encode() + line(df.columns))
                    n = 1
                    for n, r in enumerate(islice(rest, SHEET_ROWS - 1), start=2):
                        sheet.write(line(r))
                    sheet.write(b"</sheetData></worksheet>")
                more = n == SHEET_ROWS
        sheets = range(1, len(names) + 1)
        part = lambda k: f"<Override PartName='/xl/worksheets/sheet{k}.xml' ContentType='{kind}.worksheet+xml'/>"
        z.writestr("[Content_Types].xml", f"<Types xmlns='{package}/content-types'><Default Extension='rels' ContentType='application/vnd.openxmlformats-package.relationships+xml'/><Override PartName='/xl/workbook.xml' ContentType='{kind}.sheet.main+xml'/>" + "".join(map(part, sheets)) + "</Types>")
        z.writestr("_rels/.rels", f"<Relationships xmlns='{package}/relationships'><Relationship Id='r1' Type='{office}/officeDocument' Target='xl/workbook.xml'/></Relationships>")
        z.writestr("xl/workbook.xml", f"<workbook xmlns='{main}' xmlns:r='{office}'><sheets>" + "".join(f"<sheet name='{escape(n)}' sheetId='{k}' r:id='r{k}'/>" for k, n in zip(sheets, names)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", f"<Relationships xmlns='{package}/relationships'>" + "".join(f"<Relationship Id='r{k}' Type='{office}/worksheet' Target='worksheets/sheet{k}.xml'/>" for k in sheets) + "</Relationships>")
