"""draw.io diagrams (S5, S5a-S5d, P6-P9, J17, G6, F9, F30): payloads are decoded and taken apart to one row a cell by Arrow batches, since raw deflate has no built-in; all else is joins over cells."""

from __future__ import annotations

import base64
import xml.etree.ElementTree as ET
import zlib
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions.text import clean_value
from orrery.operators.zones import absolute, holding_others, place_nodes
from orrery.sources.graphs import TEXTS, Graph, lines, metrics, ones, register
from orrery.tables import written

CELLS = (
    "graph_id string, page_no int, page_id string, page_name string, cell_pos int, id string, label string, style string, vertex string, edge string, source string, target string, parent string, "
    "connectable string, has_geometry boolean, x double, y double, width double, height double, error string"
)
# What styles tell.
CONTAINER = r"rectangle|shape=rect|rounded=1|swimlane|group"
BOUNDARY = r"dashed=1|dashpattern|boundary|zone|trust|swimlane|group|container=1"


def payload(raw: str) -> str | None:
    """The XML of a page: as it is, URL-encoded, base64, or base64 of URL-encoded text in raw deflate; the first that gives XML."""

    def packed() -> bytes:
        return base64.b64decode(raw + "=" * (-len(raw) % 4))

    readings = (lambda: raw, lambda: unquote(raw), lambda: packed().decode(), lambda: unquote(zlib.decompress(packed(), -15).decode()))
    for read in readings:
        try:
            text = read()
        except (ValueError, zlib.error):
            continue
        if text.lstrip().startswith("<"):
            return text
    return None


def local(e: ET.Element) -> str:
    """S5d: a tag without its namespace."""
    return e.tag.rpartition("}")[2].rpartition(":")[2] if isinstance(e.tag, str) else ""


def find(e: ET.Element, name: str) -> ET.Element | None:
    return next((x for x in e.iter() if local(x) == name), None)


def models(root: ET.Element) -> Iterator[tuple[str | None, str | None, ET.Element]]:
    """(page id, page name, model): of the pages of a file, or else the first model there is."""
    if local(root) != "mxfile":
        if (m := find(root, "mxGraphModel")) is not None:
            yield None, None, m
        return
    for page in root:
        if local(page) != "diagram":
            continue
        m, text = find(page, "mxGraphModel"), "".join(page.itertext()).strip()
        if m is None and text and (inner := payload(text)):
            try:
                m = find(ET.fromstring(inner), "mxGraphModel")
            except ET.ParseError:
                continue
        if m is not None:
            yield page.get("id"), page.get("name"), m


def number(e: ET.Element | None, name: str) -> float | None:
    try:
        return float((e.get(name) if e is not None else None) or 0)
    except ValueError:
        return None


def cell_rows(graph_id: str, text: str) -> Iterator[tuple]:
    try:
        pages = list(models(ET.fromstring(text)))
    except ET.ParseError as e:
        yield (graph_id, *[None] * 18, f"XML: {e}")
        return
    for page_no, (page_id, page_name, model) in enumerate(pages):
        for pos, c in enumerate(x for x in model.iter() if local(x) == "mxCell"):
            g = find(c, "mxGeometry")
            box = [number(g, k) for k in ("x", "y", "width", "height")]
            fine = g is not None and None not in box
            yield (graph_id, page_no, page_id, page_name, pos, c.get("id"), clean_value(c.get("value")), (c.get("style") or "").lower(), *(c.get(k) for k in ("vertex", "edge", "source", "target", "parent", "connectable")), fine, *(v or 0.0 for v in box), None)


def cells(texts: DataFrame) -> DataFrame:
    """texts(graph_id, text) -> one row a cell of each page; a file that is no XML gives one row with its error."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"string": pa.string(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_()}
        schema = pa.schema([(n, kinds[t]) for n, t in (x.split() for x in CELLS.split(", "))])
        for b in batches:
            for graph_id, text in zip(b["graph_id"].to_pylist(), b["text"].to_pylist(), strict=True):
                if rows := list(cell_rows(graph_id, text or "")):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    return texts.select("graph_id", "text").mapInArrow(read, CELLS)


def select_page(all_cells: DataFrame, page: str | None = None) -> DataFrame:
    """The cells of one page of each file: by id, then by name, then by its number from 0, else the first."""
    want = (page or "").strip()
    pages = all_cells.where("page_no is not null").select("graph_id", "page_no", "page_id", "page_name").distinct()
    rank = F.when(F.lit(want) == "", 3).when(F.col("page_id") == want, 0).when(F.col("page_name") == want, 1).when(F.col("page_no").cast("string") == F.lit(str(int(want)) if want.isdigit() else ""), 2).otherwise(3)
    chosen = pages.groupBy("graph_id").agg(F.min(F.struct(rank.alias("r"), "page_no")).alias("p")).select("graph_id", F.col("p.page_no").alias("page_no"))
    return all_cells.join(chosen, ["graph_id", "page_no"])


def is_edge_label() -> Column:
    """P7."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    return F.contains("style", F.lit("edgelabel")) | ((text("vertex") == "1") & (text("connectable") == "0") & (text("parent") != "") & F.contains("style", F.lit("label")))


@register("drawio")
def parse(texts: DataFrame, page: str | None = None) -> Graph:
    """texts(graph_id, text) -> a graph's tables. What can't be read gives an empty graph and an error row (Q25)."""
    every = written(cells(texts), "cells")  # read by many joins; the files are taken apart once
    own = select_page(every, page).where("coalesce(id, '') <> ''").withColumn("is_label", is_edge_label())
    edge = F.coalesce(F.col("edge") == "1", F.lit(False))
    flows = own.where(edge & ~F.col("is_label"))
    wired = own.where(edge)
    vertices = own.where(~edge & ~F.col("is_label") & (F.col("vertex") == "1") & ~F.col("id").isin("0", "1"))
    boxes = absolute(own.select("graph_id", "id", "parent", "x", "y", "width", "height", "has_geometry"))  # G6
    vertices = vertices.drop("x", "y", "width", "height", "has_geometry").join(boxes.drop("parent"), ["graph_id", "id"])
    sized = vertices.where("has_geometry")
    around = holding_others(sized.select("graph_id", "id", "x", "y", "width", "height")).select("graph_id", "id").withColumn("around", F.lit(True))
    style = lambda p: F.rlike("style", F.lit(p))
    zone = F.col("has_geometry") & (F.col("width") > 0) & (F.col("height") > 0) & (F.col("label") != "") & style(CONTAINER) & (style(BOUNDARY) | F.coalesce("around", F.lit(False)))  # P8
    vertices = written(vertices.join(around, ["graph_id", "id"], "left").withColumn("is_zone", zone), "vertices")
    ends = flows.select("graph_id", F.col("source").alias("id")).unionByName(flows.select("graph_id", F.col("target").alias("id"))).where("coalesce(id, '') <> ''").distinct().withColumn("is_end", F.lit(True))
    named = vertices.where("not is_zone").join(ends, ["graph_id", "id"], "left").where("label <> '' or is_end").withColumn("label", F.coalesce(F.nullif("label", F.lit("")), "id"))  # P9
    rects = vertices.where("is_zone").select("graph_id", "cell_pos", "id", F.col("label").alias("name"), "x", "y", "width", "height")
    points = named.where("has_geometry").select("graph_id", F.col("id").alias("node_id"), (F.col("x") + F.col("width") / 2).alias("cx"), (F.col("y") + F.col("height") / 2).alias("cy"))
    zones, placed = place_nodes(points, rects)
    by_pos = Window.partitionBy("graph_id").orderBy("cell_pos")
    nodes = named.join(placed.withColumnRenamed("node_id", "id"), ["graph_id", "id"], "left").select(
        "graph_id", (F.row_number().over(by_pos) - 1).alias("node_pos"), "id", "label", "zone", F.coalesce("zones", F.expr(TEXTS)).alias("zones"), F.lit(None).cast("string").alias("type"), F.expr(TEXTS).alias("data"),
        F.lit(None).cast("boolean").alias("auth"), F.lit(None).cast("string").alias("notes"),
    )
    child = own.where("is_label and coalesce(parent, '') <> '' and label <> ''").groupBy("graph_id", F.col("parent").alias("id")).agg(F.max_by("label", "cell_pos").alias("child"))  # J17
    ids = named.select("graph_id", "id")
    found = wired.join(ids.withColumnRenamed("id", "source"), ["graph_id", "source"], "left_semi").join(ids.withColumnRenamed("id", "target"), ["graph_id", "target"], "left_semi").join(child, ["graph_id", "id"], "left")
    edges = found.select("graph_id", (F.row_number().over(by_pos) - 1).alias("edge_pos"), F.col("source").alias("src"), F.col("target").alias("dst"), F.coalesce(F.nullif("label", F.lit("")), "child").alias("label"), F.lit(None).cast("string").alias("protocol"), F.expr(TEXTS).alias("data"), "id")
    zones = zones.join(rects.select("graph_id", "id", (F.row_number().over(by_pos) - 1).alias("zone_pos")), ["graph_id", "id"]).select("graph_id", "zone_pos", "id", "name", "parent_id")
    told = metrics(texts.select("graph_id", F.size(lines(F.coalesce("text", F.lit("")))).alias("total_lines")), {"edge_candidates": ones(flows), "edges_parsed": ones(edges), "node_label_candidates": ones(nodes), "node_labels_parsed": ones(nodes)})
    return Graph(nodes, edges, zones, told, every.where("error is not null").select("graph_id", "error"))
