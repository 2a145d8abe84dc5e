"""Sinks: reports as JSON, Markdown and HTML, models with findings, archives of reports.

Rows become text in the plan; a report is one small row, which the driver writes.
"""

from __future__ import annotations

import io
import json
import zipfile
from pathlib import PurePath

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.functions.text import escape_html, script_safe
from orrery.operators import evidence

# Headings of reports and names of JSON fields, here and below.
NOTICE = "This report was generated with the help of a model and may contain errors; review it before use."
NODE_FIELDS = ["id", "label", "zone", "zones", "zone_path", "type", "data", "auth", "notes"]


def in_order(by: str, *cols: Column | str) -> Column:
    """The rows of a group as an array of structs in the order of `by`."""
    s = F.struct(*cols)
    return F.transform(F.sort_array(F.collect_list(F.struct(F.col(by).alias("_o"), s.alias("_s")))), lambda x: x["_s"])


def with_zone_paths(nodes: DataFrame, zones: DataFrame) -> DataFrame:
    """Adds zone_path: the names of a node's zones in their order; an id that is no zone stays as it is."""
    names = zones.select("graph_id", F.col("id").alias("z"), "name")
    each = nodes.select("graph_id", "id", F.posexplode("zones").alias("p", "z")).join(names, ["graph_id", "z"], "left")
    path = each.groupBy("graph_id", "id").agg(F.transform(F.sort_array(F.collect_list(F.struct("p", F.coalesce("name", "z").alias("n")))), lambda x: x["n"]).alias("zone_path"))
    return nodes.join(path, ["graph_id", "id"], "left").withColumn("zone_path", F.coalesce("zone_path", F.array().cast("array<string>")))


def graph_json(nodes: DataFrame, edges: DataFrame, zones: DataFrame) -> DataFrame:
    """(graph_id, graph): nodes with their zone paths, edges without ids, zones."""
    n = with_zone_paths(nodes, zones).groupBy("graph_id").agg(in_order("node_pos", *NODE_FIELDS).alias("nodes"))
    e = edges.groupBy("graph_id").agg(in_order("edge_pos", "src", "dst", "label", "protocol", "data").alias("edges"))
    z = zones.groupBy("graph_id").agg(in_order("zone_pos", "id", "name", "parent_id").alias("zones"))
    return n.join(e, "graph_id", "left").join(z, "graph_id", "left").select("graph_id", F.struct("nodes", F.coalesce("edges", F.array()).alias("edges"), F.coalesce("zones", F.array()).alias("zones")).alias("graph"))


def prompt_json(nodes: DataFrame, edges: DataFrame, zones: DataFrame) -> DataFrame:
    """(graph_id, json): the graph for a prompt."""
    return graph_json(nodes, edges, zones).select("graph_id", F.to_json(F.struct("graph.nodes", "graph.edges"), {"ignoreNullFields": "false"}).alias("json"))


def finding_struct() -> list[Column]:
    return ["id", "title", "stride", "severity", "score", "affected", "why", "recommended_action", "references", "rag_sources", F.struct(F.col("evidence_nodes").alias("nodes"), F.col("evidence_edges").alias("edges")).alias("evidence"), "confidence"]


def report_json(findings: DataFrame, metrics: DataFrame | None = None, graph: DataFrame | None = None, generated_at: str | None = None) -> DataFrame:
    """K1: findings(graph_id, pos, id, ...) -> (graph_id, json), findings in their order."""
    at = F.lit(generated_at) if generated_at else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    out = findings.groupBy("graph_id").agg(in_order("pos", *finding_struct()).alias("threats"))
    parts = [at.alias("generated_at"), F.size("threats").alias("count"), "threats"]
    if metrics is not None:
        out = out.join(metrics.select("graph_id", F.struct(*[c for c in metrics.columns if c != "graph_id"]).alias("import_metrics")), "graph_id", "left")
        parts.append("import_metrics")
    if graph is not None:
        out = out.join(graph, "graph_id", "left")
        parts.append("graph")
    return out.select("graph_id", F.to_json(F.struct(*parts), {"ignoreNullFields": "false"}).alias("json"))


def report_markdown(findings: DataFrame) -> DataFrame:
    """K2: (graph_id, markdown): a table of all findings, then each in full. Pipes stay as they are."""
    score = F.format_string("%.1f", "score")
    row = F.concat(F.lit("| "), F.concat_ws(" | ", "id", "title", "severity", score), F.lit(" |\n"))
    para = lambda name, c: F.concat(F.lit(f"**{name}:** "), c, F.lit("\n\n"))
    cited = F.transform("rag_sources", lambda s: F.format_string("- kb=%s, source=%s, chunk=%s, score=%.3f, method=%s\n", s["kb"], s["source"], s["chunk_id"], s["score"], s["method"]))
    full = F.concat(
        F.lit("### "), "id", F.lit(": "), "title", F.lit("\n\n"), para("Severity", F.col("severity")), para("Score", score), para("STRIDE", F.array_join("stride", ", ")), para("Affected Components", F.array_join("affected", ", ")),
        para("Why", F.col("why")), F.when(F.size("references") > 0, para("References", F.array_join("references", ", "))).otherwise(""),
        F.when(F.size("rag_sources") > 0, F.concat(F.lit("**RAG Sources:**\n\n"), F.array_join(cited, ""), F.lit("\n"))).otherwise(""),
        F.lit("**Recommended Actions:**\n\n"), "recommended_action", F.lit("\n\n---\n\n"),
    )
    own = findings.groupBy("graph_id").agg(F.array_join(F.transform(in_order("pos", row.alias("t")), lambda x: x["t"]), "").alias("r"), F.array_join(F.transform(in_order("pos", full.alias("t")), lambda x: x["t"]), "").alias("f"))
    head = f"# Threat Analysis Report\n\n> {NOTICE}\n\n## Threat Summary\n\n| ID | Threat | Severity | Score |\n|----|---------|---------|-------|\n"
    return own.select("graph_id", F.concat(F.lit(head), "r", F.lit("\n## Threat Details\n\n"), "f").alias("markdown"))


EMPTY_MARKDOWN = f"# Threat Analysis Report\n\n> {NOTICE}\n\nNo threats identified.\n"


def diff_markdown(nodes: DataFrame, edges: DataFrame, findings: DataFrame, narrative: str = "") -> str:
    """K5: differences (rows with side and a text `name`) as Markdown; a pipe in a title becomes a slash. The rows of one report pair come to the driver."""
    out = ["# Threat Report Diff", ""]
    for what, df in (("Components", nodes), ("Data flows", edges), ("Findings", findings)):
        rows = df.where("side <> 'same'").orderBy("side", "name").select("side", "name").collect()  # of one pair of reports
        out += [f"## {what}", "", *(f"- {r['side']}: {r['name'].replace('|', '/')}" for r in rows), "" if rows else "No change.\n"]
    return "\n".join([*out, *(["## Summary", "", narrative, ""] if narrative else [])])


def diff_changes(nodes: DataFrame, edges: DataFrame, findings: DataFrame) -> str:
    """K5, F32: what one pair of reports has gained and lost, as JSON for a prompt: counts and rows. nodes(side, id, label, type), edges(side, src, dst, label), findings(side, id, title, severity)."""
    out: dict[str, dict] = {"graph_changes": {}, "threat_changes": {}}
    for part, what, df, fields in (("graph_changes", "nodes", nodes, ["id", "label", "type"]), ("graph_changes", "edges", edges, ["src", "dst", "label"]), ("threat_changes", "threats", findings, ["id", "title", "severity"])):
        rows = df.where("side in ('added', 'removed')").select("side", *fields).orderBy(*fields).collect()  # of one pair of reports
        for side in ("added", "removed"):
            own = [{f: r[f] if r[f] is not None else "" for f in fields} for r in rows if r["side"] == side]
            out[part] |= {f"{what}_{side}": len(own), f"{side}_{what}": own}
    return json.dumps(out, ensure_ascii=False, indent=2)


def html_rows(findings: DataFrame, nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Table rows of HTML for nodes and edges with the findings that name them."""
    listed = F.array_join(F.transform("findings", escape_html), ", ")
    cell = lambda *c: F.concat(F.lit("<tr>"), *[x for y in c for x in (F.lit("<td>"), y, F.lit("</td>"))], F.lit("</tr>"))
    n = evidence.to_nodes(findings, nodes).join(nodes.select("graph_id", F.col("id").alias("node_id"), "label", "node_pos"), ["graph_id", "node_id"])
    e = evidence.to_edges(findings, edges).join(edges, ["graph_id", "edge_pos"])
    arrow = F.concat(escape_html(F.col("src")), F.lit(" &rarr; "), escape_html(F.col("dst")), F.when(F.coalesce("label", F.lit("")) != "", F.concat(F.lit(" : "), escape_html(F.col("label")))).otherwise(""))
    named = F.concat(escape_html(F.col("label")), F.lit(" ["), escape_html(F.col("node_id")), F.lit("]"))
    return n.select("graph_id", "node_pos", cell(named, listed).alias("html")), e.select("graph_id", "edge_pos", cell(arrow, listed).alias("html"))


def report_html(findings: DataFrame, nodes: DataFrame, edges: DataFrame, graph: DataFrame) -> DataFrame:
    """K3: (graph_id, html): findings, the tables of nodes and edges, and the graph as JSON inside a script, with `</` made safe."""
    n, e = html_rows(findings, nodes, edges)
    text = lambda df, by, name: df.groupBy("graph_id").agg(F.array_join(F.transform(in_order(by, "html"), lambda x: x["html"]), "\n").alias(name))
    br = lambda c: F.replace(escape_html(F.col(c)), F.lit("\n"), F.lit("<br>"))
    section = F.concat(F.lit("<section><h2>"), escape_html(F.col("id")), F.lit(": "), br("title"), F.lit("</h2><p>"), escape_html(F.col("severity")), F.format_string(" (%.1f)", "score"), F.lit("</p><p>"), br("why"), F.lit("</p><p>"), br("recommended_action"), F.lit("</p></section>"))
    f = text(findings.withColumn("html", section), "pos", "f")
    own = f.join(text(n, "node_pos", "n"), "graph_id", "full").join(text(e, "edge_pos", "e"), "graph_id", "full").join(graph.select("graph_id", script_safe(F.to_json("graph")).alias("g")), "graph_id", "left")
    part = lambda c: F.coalesce(c, F.lit(""))
    head = f'<!DOCTYPE html>\n<html lang="en"><head><meta charset="UTF-8"><title>Threat Analysis Report</title></head><body><h1>Threat Analysis Report</h1><p>{NOTICE}</p>\n'
    return own.select("graph_id", F.concat(
        F.lit(head), F.coalesce("f", F.lit("<p>No threats identified.</p>")), F.lit("\n<table><caption>Components</caption>"), part("n"), F.lit("</table>\n<table><caption>Data flows</caption>"), part("e"),
        F.lit('</table>\n<script type="application/json" id="graph">'), part("g"), F.lit("</script></body></html>"),
    ).alias("html"))


def into_model(model: str, placed: list[tuple[str | None, dict]]) -> str:
    """A model's JSON with findings added: placed holds (cell id or None, block) in order. Cells' hasOpenThreats follow from their threats."""
    doc = json.loads(model)
    diagrams = (doc.get("detail") or {}).get("diagrams") or []
    if not diagrams:
        raise ValueError("the model has no diagram")
    first = diagrams[0]
    by_cell: dict[str | None, list[dict]] = {}
    for cell, block in placed:
        by_cell.setdefault(cell, []).append(block)
    for cell in first.get("cells") or []:
        data = cell.get("data")
        if not isinstance(data, dict) or not cell.get("id"):
            continue
        old = data.get("threats")
        every = (old if isinstance(old, list) else []) + by_cell.get(cell["id"], [])
        if every or "threats" in data:
            data["threats"] = every
        if every or "hasOpenThreats" in data:
            data["hasOpenThreats"] = any(str(t.get("status") or "Open").lower() != "closed" for t in every)
    old = first.get("threats")
    if (every := (old if isinstance(old, list) else []) + by_cell.get(None, [])) or "threats" in first:
        first["threats"] = every
    return json.dumps(doc, ensure_ascii=False, indent=2)


def threat_dragon(texts: DataFrame, findings: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """K4: (graph_id, json): each model with its findings in the cells that they name, or in its diagram. A graph's findings are bounded by an answer's length."""
    from orrery.sources.threat_dragon import cells, export_cells

    all_cells = cells(texts)
    diagram = texts.select("graph_id", F.explode(F.from_json(F.get_json_object("text", "$.detail.diagrams[0].threats"), "array<struct<id: string>>")).alias("t"))
    used = all_cells.select("graph_id", F.explode("data.threats.id").alias("id")).unionByName(diagram.select("graph_id", "t.id"))
    named = evidence.unique_ids(findings, used.where("id is not null"))
    placed = evidence.to_cells(findings, nodes, edges, export_cells(all_cells)).join(named.select("graph_id", F.col("id").alias("finding_id"), F.to_json(evidence.model_block(), {"ignoreNullFields": "false"}).alias("block")), ["graph_id", "finding_id"])
    per = placed.groupBy("graph_id").agg(F.to_json(F.sort_array(F.collect_list(F.struct("p", "q", "cell_id", "block"))), {"ignoreNullFields": "false"}).alias("placed"))

    @F.pandas_udf("string")
    def put(text: pd.Series, rows: pd.Series) -> pd.Series:
        return pd.Series([into_model(t, [(r["cell_id"], json.loads(r["block"])) for r in json.loads(x or "[]")]) for t, x in zip(text, rows, strict=True)], dtype=object)

    return texts.join(per, "graph_id", "left").select("graph_id", put("text", "placed").alias("json"))


def report_paths(source: str, folder: str) -> dict[str, str]:
    """K10."""
    stem = PurePath(source).stem
    return {k: f"{folder.rstrip('/')}/{stem}_report.{k}" for k in ("json", "md", "html")} | {f"diff_{k}": f"{folder.rstrip('/')}/{stem}_diff.{k}" for k in ("json", "md")}


def zipped(job_id: str, reports: dict[str, str]) -> bytes:
    """K8: a job's reports as one archive."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for fmt, text in sorted(reports.items()):
            z.writestr(f"{job_id}.{ {'markdown': 'md', 'threat-dragon': 'threat-dragon.json'}.get(fmt, fmt) }", text)
    return out.getvalue()


def emit(text: str, path: str | None = None) -> str:
    """Text with one line end at its end, to a file if one is given."""
    text = text.rstrip("\n") + "\n"
    if path:
        with open(path, "w", encoding="utf-8") as f:
            f.write(text)
    return text

