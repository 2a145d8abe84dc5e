"""The native graph format (S7, P21, J9, G5): maps of nodes and zones, a list of edges; strict. Violations are rows, so a corpus is validated in one job; parse(..., strict=True) raises on any."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.functions.text import blank_to_null, strip
from orrery.operators.zones import cyclic, ordered_zones
from orrery.sources.graphs import TEXTS, Graph, lines, metrics, register
from orrery.tables import written

NODE = "struct<id: string, label: string, zone: string, zones: array<string>, type: string, data: array<string>, auth: string, notes: string>"
EDGE = "struct<id: string, src: string, dst: string, label: string, protocol: string, data: array<string>>"
ZONE = "struct<id: string, name: string, parent_id: string>"
SCHEMA = f"nodes map<string, {NODE}>, edges array<{EDGE}>, zones map<string, {ZONE}>"


class ValidationError(ValueError):
    pass


def kind(v: Column, path: str) -> Column:
    """OBJECT, ARRAY, BOOLEAN ... of the value at a path, VOID for null and for none."""
    return F.regexp_extract(F.coalesce(F.schema_of_variant(F.try_variant_get(v, path, "variant")), F.lit("VOID")), r"^\w+", 0)


def entries(texts: DataFrame, field: str) -> DataFrame:
    """(graph_id, pos, key, raw): the members of an object as JSON texts, in the order of their keys in the text."""
    return texts.select("graph_id", F.posexplode(F.map_entries(F.from_json(F.get_json_object("text", f"$.{field}"), "map<string,string>"))).alias("pos", "kv")).select("graph_id", "pos", F.col("kv.key").alias("key"), F.col("kv.value").alias("raw"))


def violations(texts: DataFrame) -> DataFrame:
    """(graph_id, error): everything that the format forbids, by the whole file first, then by field, then by reference."""
    v = F.try_parse_json("text")
    top = texts.select("graph_id", "text", v.alias("v"), kind(v, "$").alias("k"))
    bad = [top.where("v is null").select("graph_id", F.lit("invalid JSON").alias("error")), top.where("v is not null and k <> 'OBJECT'").select("graph_id", F.lit("not a JSON object").alias("error"))]
    fine = top.where("k = 'OBJECT'")
    dragon = F.coalesce(F.to_json(F.try_variant_get("v", "$.threat_dragon", "variant")), F.lit("null"))
    bad.append(fine.where(~dragon.isin("null", "{}")).select("graph_id", F.lit("threat_dragon is not supported").alias("error")))
    for field, want in (("nodes", "OBJECT"), ("edges", "ARRAY"), ("zones", "OBJECT")):
        present = F.get_json_object("text", f"$.{field}")
        bad.append(fine.where(present.isNotNull() & (kind(F.col("v"), f"$.{field}") != want)).select("graph_id", F.lit(f"{field} must be an {want.lower()}").alias("error")))
    say = lambda df, what: df.select("graph_id", F.concat(*[F.lit(w) if isinstance(w, str) else w for w in what]).alias("error"))
    good = fine.select("graph_id", "text")
    zones, nodes = (entries(good, f).withColumn("x", F.from_json("raw", s)).withColumn("v", F.try_parse_json("raw")) for f, s in (("zones", ZONE), ("nodes", NODE)))
    for name, df, text in (("zone", zones, "name"), ("node", nodes, "label")):
        obj = df.where(kind(F.col("v"), "$") == "OBJECT")
        bad.append(say(df.where(kind(F.col("v"), "$") != "OBJECT"), [name, " ", F.col("key"), " must be an object"]))
        bad.append(say(obj.where((F.coalesce(blank_to_null(F.col("x.id")), "key") != F.col("key")) | (strip(F.col("key")) == "")), [name, " ", F.col("key"), " has another id"]))
        bad.append(say(obj.where(F.coalesce(strip(F.col(f"x.{text}")), F.lit("")) == ""), [name, " ", F.col("key"), f" has no {text}"]))
    for field in ("zones", "data"):
        bad.append(say(nodes.where(~kind(F.col("v"), f"$.{field}").isin("ARRAY", "VOID")), ["node ", F.col("key"), f" field {field} must be an array"]))
    bad.append(say(nodes.where(~kind(F.col("v"), "$.auth").isin("BOOLEAN", "VOID")), ["node ", F.col("key"), " field auth must be a boolean"]))
    edges = good.select("graph_id", F.posexplode(F.from_json(F.get_json_object("text", "$.edges"), "array<string>")).alias("pos", "raw")).withColumn("x", F.from_json("raw", EDGE)).withColumn("v", F.try_parse_json("raw"))
    at = F.col("pos").cast("string")
    bad.append(say(edges.where(kind(F.col("v"), "$") != "OBJECT"), ["edge ", at, " must be an object"]))
    ends = edges.where(kind(F.col("v"), "$") == "OBJECT").select("graph_id", "pos", F.coalesce(strip(F.col("x.src")), F.lit("")).alias("src"), F.coalesce(strip(F.col("x.dst")), F.lit("")).alias("dst"), "v")
    bad.append(say(ends.where("src = '' or dst = ''"), ["edge ", at, " must have src and dst"]))
    bad.append(say(ends.where(~kind(F.col("v"), "$.data").isin("ARRAY", "VOID")), ["edge ", at, " field data must be an array"]))
    named = ends.where("src <> '' and dst <> ''").select("graph_id", "pos", F.explode(F.array_distinct(F.array("src", "dst"))).alias("key"))
    bad.append(say(named.join(nodes.select("graph_id", "key"), ["graph_id", "key"], "left_anti"), ["edge ", at, " names unknown node ", F.col("key")]))  # J9
    refs = nodes.select("graph_id", F.col("key").alias("node"), F.explode("x.zones").alias("z")).withColumn("key", F.coalesce(strip(F.col("z")), F.lit("")))
    bad.append(say(refs.where("key = ''"), ["node ", F.col("node"), " has an empty zone"]))
    some = zones.select("graph_id").distinct()
    bad.append(say(refs.where("key <> ''").join(some, "graph_id", "left_semi").join(zones.select("graph_id", "key"), ["graph_id", "key"], "left_anti"), ["node ", F.col("node"), " names unknown zone ", F.col("key")]))
    parents = zones.select("graph_id", F.col("key").alias("zone"), blank_to_null(F.col("x.parent_id")).alias("key")).where("key is not null")
    bad.append(say(parents.join(zones.select("graph_id", "key"), ["graph_id", "key"], "left_anti"), ["zone ", F.col("zone"), " names unknown parent ", F.col("key")]))
    tree = zones.select("graph_id", F.col("key").alias("id"), blank_to_null(F.col("x.parent_id")).alias("parent_id"))
    bad.append(say(cyclic(tree), ["zone ", F.col("id"), " is in a cycle"]))  # G5
    return reduce(DataFrame.unionByName, bad)


@register("ir")
def parse(texts: DataFrame, strict: bool = False) -> Graph:
    """texts(graph_id, text) -> a graph's tables, those of files without violations only. Keys of an object that repeat: the last counts."""
    wrong = violations(texts)
    if strict and (first := wrong.first()) is not None:
        raise ValidationError(f"{first['graph_id']}: {first['error']}")
    good = written(texts.join(wrong.select("graph_id").distinct(), "graph_id", "left_anti"), "valid-graphs")  # validated once, read for nodes, edges, zones and metrics
    zones = entries(good, "zones").withColumn("x", F.from_json("raw", ZONE)).select("graph_id", F.col("pos").alias("zone_pos"), F.col("key").alias("id"), strip(F.col("x.name")).alias("name"), blank_to_null(F.col("x.parent_id")).alias("parent_id"))
    x = entries(good, "nodes").withColumn("x", F.from_json("raw", NODE)).select("graph_id", F.col("pos").alias("node_pos"), F.col("key").alias("id"), "x.label", "x.zone", "x.zones", "x.type", "x.data", "x.auth", "x.notes")
    members = x.select("graph_id", F.col("id").alias("node_id"), F.posexplode("zones").alias("pos", "z")).select("graph_id", "node_id", strip(F.col("z")).alias("zone_id"), "pos")
    known = members.join(zones.select("graph_id").distinct(), "graph_id", "left_semi")
    placed = ordered_zones(known, zones).select("graph_id", F.col("node_id").alias("id"), F.col("zones").alias("_zones"), F.col("zone").alias("_zone"))
    kept = lambda c: F.filter(F.coalesce(c, F.expr(TEXTS)), lambda t: F.coalesce(t, F.lit("None")) != "")
    nodes = x.join(placed, ["graph_id", "id"], "left").select(
        "graph_id", "node_pos", "id", strip(F.col("label")).alias("label"), F.coalesce("_zone", strip(F.col("zone"))).alias("zone"), F.coalesce("_zones", F.array_distinct(F.transform("zones", strip)), F.expr(TEXTS)).alias("zones"),
        blank_to_null(F.col("type")).alias("type"), kept(F.col("data")).alias("data"), F.col("auth").try_cast("boolean").alias("auth"), blank_to_null(F.col("notes")).alias("notes"),
    )
    e = good.select("graph_id", F.posexplode(F.from_json(F.get_json_object("text", "$.edges"), f"array<{EDGE}>")).alias("edge_pos", "x"))
    opt = lambda c: blank_to_null(F.col(f"x.{c}")).alias(c)
    edges = e.select("graph_id", "edge_pos", strip(F.col("x.src")).alias("src"), strip(F.col("x.dst")).alias("dst"), opt("label"), opt("protocol"), kept(F.col("x.data")).alias("data"), opt("id"))
    n = lambda df: df.select("graph_id", F.lit(1).alias("n"))
    told = metrics(good.select("graph_id", F.size(lines(F.col("text"))).alias("total_lines")), {"edge_candidates": n(edges), "edges_parsed": n(edges), "node_label_candidates": n(nodes), "node_labels_parsed": n(nodes)})
    return Graph(nodes, edges, zones, told, wrong)
