"""Threat Dragon models of version 2 (S6, P5, F13, F14): one from_json with a fixed schema, then filters and joins. The first diagram counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions.text import blank_to_null, strip
from orrery.operators.zones import place_nodes
from orrery.sources.graphs import TEXTS, Graph, lines, metrics, ones, register

# Fixed values.
NODE_TYPES = {"tm.Actor": "actor", "tm.Process": "process", "tm.Store": "store"}
BOUNDARY_TYPES = ("tm.BoundaryBox", "tm.boundary")
CELL = (
    "id string, shape string, position struct<x: double, y: double>, size struct<width: double, height: double>, source struct<cell: string>, target struct<cell: string>, "
    "attrs struct<text: struct<text: string>, label: struct<text: string>>, labels array<string>, "
    "data struct<type: string, name: string, protocol: string, isEncrypted: boolean, isPublicNetwork: boolean, isBidirectional: boolean, threats: array<struct<id: string, status: string>>>"
)
MODEL = f"version string, detail struct<diagrams: array<struct<cells: array<struct<{CELL}>>, threats: array<struct<id: string, status: string>>>>>"


def filled(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def node_label() -> Column:
    """F13."""
    return strip(F.coalesce(filled(F.col("data.name")), filled(F.col("attrs.text.text")), filled(F.col("attrs.label.text")), "id"))


def flow_label() -> Column:
    """the name, else the first label, which is a text or an object with one."""
    first = F.get("labels", F.lit(0))
    text = F.when(F.startswith(first, F.lit("{")), F.get_json_object(first, "$.text")).otherwise(first)
    return F.when(filled(F.col("data.name")).isNotNull(), blank_to_null(F.col("data.name"))).otherwise(blank_to_null(text))


def flags() -> Column:
    """F14."""
    d = lambda k, text: F.when(F.col(f"data.{k}"), F.lit(text))
    return F.array_compact(F.array(d("isEncrypted", "encrypted"), d("isPublicNetwork", "public-network"), d("isBidirectional", "bidirectional")))


def cells(texts: DataFrame) -> DataFrame:
    """(graph_id, cell_pos, the cell's fields) of the first diagram."""
    parsed = texts.select("graph_id", F.from_json("text", MODEL).alias("m"))
    return parsed.select("graph_id", F.posexplode(F.get("m.detail.diagrams", F.lit(0))["cells"]).alias("cell_pos", "c")).select("graph_id", "cell_pos", "c.*")


def export_cells(all_cells: DataFrame) -> DataFrame:
    """The cells as evidence.to_cells wants them."""
    kind = F.when((F.col("data.type") == "tm.Flow") & (F.col("shape") == "flow"), "flow").otherwise("cell")
    return all_cells.where("id is not null and id <> ''").select("graph_id", "cell_pos", "id", kind.alias("kind"), F.col("source.cell").alias("src"), F.col("target.cell").alias("dst"), flow_label().alias("label"))


@register("threat-dragon")
def parse(texts: DataFrame) -> Graph:
    """texts(graph_id, text) -> a graph's tables. Text that isn't such a model gives an empty graph and an error."""
    own = cells(texts)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    box = (F.col("shape") == "trust-boundary-box") | F.coalesce(F.col("data.type").isin(*BOUNDARY_TYPES), F.lit(False))
    rects = own.where(box).select("graph_id", "cell_pos", F.coalesce(filled(F.col("id")), node_label()).alias("id"), node_label().alias("name"), zero("position.x").alias("x"), zero("position.y").alias("y"), zero("size.width").alias("width"), zero("size.height").alias("height"))
    kinds = F.create_map(*[F.lit(x) for kv in NODE_TYPES.items() for x in kv])
    found = own.where(filled(F.col("id")).isNotNull() & F.col("data.type").isin(*NODE_TYPES))
    found = found.select("graph_id", "cell_pos", "id", node_label().alias("label"), kinds[F.col("data.type")].alias("type"), (zero("position.x") + zero("size.width") / 2).alias("cx"), (zero("position.y") + zero("size.height") / 2).alias("cy"))
    zones, placed = place_nodes(found.select("graph_id", F.col("id").alias("node_id"), "cx", "cy"), rects)
    by_pos = Window.partitionBy("graph_id").orderBy("cell_pos")
    nodes = found.join(placed.withColumnRenamed("node_id", "id"), ["graph_id", "id"], "left").select(
        "graph_id", (F.row_number().over(by_pos) - 1).alias("node_pos"), "id", "label", "zone", F.coalesce("zones", F.expr(TEXTS)).alias("zones"), "type", F.expr(TEXTS).alias("data"),
        F.lit(None).cast("boolean").alias("auth"), F.lit(None).cast("string").alias("notes"),
    )
    flows = own.where("data.type = 'tm.Flow' and shape = 'flow'")
    ends = flows.select("graph_id", "cell_pos", F.col("source.cell").alias("src"), F.col("target.cell").alias("dst"), flow_label().alias("label"), filled(F.col("data.protocol")).alias("protocol"), flags().alias("data"), "id")
    ids = found.select("graph_id", "id")
    edges = ends.join(ids.withColumnRenamed("id", "src"), ["graph_id", "src"], "left_semi").join(ids.withColumnRenamed("id", "dst"), ["graph_id", "dst"], "left_semi")
    edges = edges.withColumn("edge_pos", F.row_number().over(by_pos) - 1).select("graph_id", "edge_pos", "src", "dst", "label", "protocol", "data", "id")
    order = rects.select("graph_id", "id", (F.row_number().over(by_pos) - 1).alias("zone_pos"))
    zones = zones.join(order, ["graph_id", "id"]).select("graph_id", "zone_pos", "id", "name", "parent_id")
    told = metrics(texts.select("graph_id", F.size(lines(F.coalesce("text", F.lit("")))).alias("total_lines")), {"edge_candidates": ones(flows), "edges_parsed": ones(edges), "node_label_candidates": ones(nodes), "node_labels_parsed": ones(nodes)})
    wrong = texts.where(F.try_parse_json("text").isNull()).select("graph_id", F.lit("not JSON").alias("error"))
    return Graph(nodes, edges, zones, told, wrong)
