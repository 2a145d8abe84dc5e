"""Images of diagrams (S8): binaryFile rows, an injected extractor that answers JSON, then the same joins as other formats."""

from __future__ import annotations

import base64
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orrery.operators.zones import ordered_zones, points_in_rects, rect_parents
from orrery.sources.graphs import TEXTS, Graph, metrics, register

BOX = "struct<x: double, y: double, width: double, height: double>"
ANSWER = (
    f"zones array<struct<id: string, name: string, bounds: {BOX}>>, nodes array<struct<id: string, label: string, type: string, zone: string, zones: array<string>, bounds: {BOX}>>, "
    "edges array<struct<src: string, dst: string, label: string, protocol: string>>"
)


def extract(spark: SparkSession, path: str, extractor: Callable[[str, str], str]) -> DataFrame:
    """(graph_id, text): the extractor's answer to (base64 of the image, media type) for each image under path."""
    images = spark.read.format("binaryFile").option("pathGlobFilter", "*.{png,jpg,jpeg,gif,bmp,webp}").option("recursiveFileLookup", True).load(path)

    @F.pandas_udf("string")
    def ask(path: pd.Series, content: pd.Series) -> pd.Series:
        kind = path.str.rpartition(".")[2].str.lower().replace({"jpg": "jpeg"})
        return pd.Series([extractor(base64.b64encode(c).decode(), f"image/{k}") for c, k in zip(content, kind, strict=True)])

    return images.select(F.col("path").alias("graph_id"), ask("path", "content").alias("text"))


@register("image")
def parse(texts: DataFrame) -> Graph:
    """Answers texts(graph_id, text) -> a graph's tables. A node's zones: hinted ones, then those that hold its centre, then its named zone; from outer to inner where there are zones."""
    a = texts.select("graph_id", F.from_json("text", ANSWER).alias("a"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0)).alias(c.rpartition(".")[2])
    z = a.select("graph_id", F.posexplode("a.zones").alias("zone_pos", "z"))
    rects = z.select("graph_id", "zone_pos", F.coalesce(F.nullif("z.id", F.lit("")), "z.name").alias("id"), F.coalesce(F.nullif("z.name", F.lit("")), "z.id", F.lit("")).alias("name"), *(zero(f"z.bounds.{k}") for k in ("x", "y", "width", "height")))
    zones = rect_parents(rects).join(rects.select("graph_id", "id", "zone_pos"), ["graph_id", "id"]).select("graph_id", "zone_pos", "id", "name", "parent_id")
    n = a.select("graph_id", F.posexplode("a.nodes").alias("node_pos", "n")).select("graph_id", "node_pos", "n.*")
    known = n.where("coalesce(id, '') <> ''")
    half = lambda o, s: F.coalesce(F.col(f"bounds.{o}"), F.lit(0.0)) + F.coalesce(F.col(f"bounds.{s}"), F.lit(0.0)) / 2
    points = known.where("bounds is not null").select("graph_id", F.col("id").alias("node_id"), half("x", "width").alias("cx"), half("y", "height").alias("cy"))
    hinted = known.select("graph_id", F.col("id").alias("node_id"), F.posexplode("zones").alias("pos", "zone_id")).where("coalesce(zone_id, '') <> ''").select("graph_id", "node_id", "zone_id", F.col("pos").cast("long").alias("pos"))
    inside = points_in_rects(points, rects).select("graph_id", "node_id", "zone_id", F.lit(1_000_000).cast("long").alias("pos"))
    single = known.where("coalesce(zone, '') <> ''").select("graph_id", F.col("id").alias("node_id"), F.col("zone").alias("zone_id"), F.lit(2_000_000).cast("long").alias("pos"))
    placed = ordered_zones(hinted.unionByName(inside).unionByName(single), zones).select("graph_id", F.col("node_id").alias("id"), F.col("zones").alias("_zones"), F.col("zone").alias("_zone"))
    nodes = known.join(placed, ["graph_id", "id"], "left").select(
        "graph_id", "node_pos", "id", F.coalesce("label", "id").alias("label"), F.coalesce("_zone", "zone").alias("zone"), F.coalesce("_zones", F.expr(TEXTS)).alias("zones"), "type", F.expr(TEXTS).alias("data"),
        F.lit(None).cast("boolean").alias("auth"), F.lit(None).cast("string").alias("notes"),
    )
    e = a.select("graph_id", F.posexplode("a.edges").alias("pos", "e")).select("graph_id", "pos", "e.*")
    good = e.where("coalesce(src, '') <> '' and coalesce(dst, '') <> ''")
    edges = good.select("graph_id", (F.row_number().over(Window.partitionBy("graph_id").orderBy("pos")) - 1).alias("edge_pos"), "src", "dst", "label", "protocol", F.expr(TEXTS).alias("data"), F.lit(None).cast("string").alias("id"))
    one = lambda df: df.select("graph_id", F.lit(1).alias("n"))
    told = metrics(texts.select("graph_id", F.octet_length("text").alias("total_lines")), {"edge_candidates": one(e), "edges_parsed": one(edges), "node_label_candidates": one(n), "node_labels_parsed": one(nodes)})
    return Graph(nodes, edges, zones, told, a.where("a is null").select("graph_id", F.lit("answer is not JSON").alias("error")))
