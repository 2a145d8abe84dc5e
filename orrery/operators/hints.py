"""Hints: a model's answers as tables of patches, applied to graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.operators import patch
from orrery.operators.findings import all_said, field, is_kind, said
from orrery.sources.graphs import Graph

#: What a hint may say of a node; zones and data come as lists of their own.
ATTRIBUTES = ("label", "type", "zone", "auth", "notes")


def texts_or_null(v: Column) -> Column:
    """A list as texts; null where there is no list, so that it isn't taken for an empty one."""
    return F.when(is_kind(v, "ARRAY"), all_said(v))


def from_answers(answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """answers(request_id, answer: JSON with `nodes` by id and `edges`) -> (nodes: graph_id, id, attrs, zones, data; edges: graph_id, hint_pos, src, dst, protocol, data).

    A key that is there with null is in attrs with null, one that is missing isn't (Q16); lists that are no lists are left out. Edges need both ends.
    """
    own = answers.where("answer is not null").select(F.col("request_id").alias("graph_id"), F.try_parse_json("answer").alias("v"))
    each = own.select("graph_id", F.explode(F.try_variant_get("v", "$.nodes", "map<string,variant>")).alias("id", "a")).where(is_kind(F.col("a"), "OBJECT"))
    keys = F.json_object_keys(F.to_json("a"))
    text = lambda k: F.when(~is_kind(field(F.col("a"), k), "VOID"), F.when(is_kind(field(F.col("a"), k), "BOOLEAN"), F.try_variant_get("a", f"$.{k}", "string")).otherwise(said(field(F.col("a"), k))))
    attrs = F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(k).alias("k"), text(k).alias("v")) for k in ATTRIBUTES]), lambda e: F.array_contains(keys, e["k"])))
    nodes = each.select("graph_id", "id", attrs.alias("attrs"), texts_or_null(field(F.col("a"), "zones")).alias("zones"), texts_or_null(field(F.col("a"), "data")).alias("data"))
    flows = own.select("graph_id", F.posexplode(F.try_variant_get("v", "$.edges", "array<variant>")).alias("hint_pos", "e"))
    end = lambda k: F.try_variant_get("e", f"$.{k}", "string")
    edges = flows.select("graph_id", "hint_pos", end("from").alias("src"), end("to").alias("dst"), end("protocol").alias("protocol"), texts_or_null(field(F.col("e"), "data")).alias("data"))
    return nodes, edges.where("coalesce(src, '') <> '' and coalesce(dst, '') <> ''")


def merge(graph: Graph, answers: DataFrame) -> Graph:
    """Graphs with the hints of answers(request_id, answer), request_id being the graph's id. Graphs without an answer stay as they are."""
    nodes, edges = from_answers(answers)
    return Graph(patch.patch_nodes(graph.nodes, nodes, graph.zones), patch.patch_edges(graph.edges, edges), graph.zones, graph.metrics, graph.errors)
