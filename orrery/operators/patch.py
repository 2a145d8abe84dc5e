"""Patches of graphs: hints update attributes of nodes and edges.

A hint's attributes are a map: a key that is present with null overwrites, a key that is missing doesn't (Q16).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orrery.operators.zones import above, depths, intervals
from orrery.tables import scratch, written

NONE = "cast(array() as array<string>)"


def zone_names(zones: DataFrame) -> DataFrame:
    """(graph_id, name, zone_id): lower-cased names; the last zone of a name."""
    return zones.where("coalesce(name, '') <> ''").groupBy("graph_id", F.lower("name").alias("name")).agg(F.max_by("id", "zone_pos").alias("zone_id"))


def resolve_zones(refs: DataFrame, zones: DataFrame) -> DataFrame:
    """Adds zone_id to refs(graph_id, ref): the zone of that id, else of that name, else null."""
    ids = zones.select("graph_id", F.col("id").alias("ref"), F.col("id").alias("_id"))
    names = zone_names(zones).select("graph_id", F.col("name").alias("_low"), F.col("zone_id").alias("_name"))
    out = refs.join(ids, ["graph_id", "ref"], "left").withColumn("_low", F.lower("ref")).join(names, ["graph_id", "_low"], "left")
    return out.withColumn("zone_id", F.coalesce("_id", "_name")).drop("_id", "_name", "_low")


def normalised_zones(hints: DataFrame, nodes: DataFrame, zones: DataFrame, labels: DataFrame | None = None, level: DataFrame | None = None) -> DataFrame:
    """hints(graph_id, id, zones), nodes(graph_id, id, zones) -> (graph_id, id, zones). `labels` are the zones' intervals and `level` their depths, if they are at hand.

    Hinted zones are resolved. Where the node has zones: those that are above or below one of them join them, from outer to inner; if there are none, its
    zones stay. Where it has none: the resolved ones, or the hint as it is if nothing resolves.
    """
    asked = hints.select("graph_id", "id", F.posexplode("zones").alias("pos", "ref")).where("coalesce(ref, '') <> ''")
    mapped = resolve_zones(asked, zones).where("zone_id is not null").groupBy("graph_id", "id", "zone_id").agg(F.min("pos").alias("pos"))
    have = nodes.select("graph_id", "id", F.posexplode("zones").alias("pos", "zone_id"))
    labels = intervals(zones) if labels is None else labels
    label = lambda df, as_: df.join(labels.select("graph_id", F.col("id").alias("zone_id"), "root", "enter", "leave"), ["graph_id", "zone_id"], "left").alias(as_)
    m, h = label(mapped, "m"), label(have, "h")
    near = (F.col("m.graph_id") == F.col("h.graph_id")) & (F.col("m.id") == F.col("h.id")) & ((F.col("m.zone_id") == F.col("h.zone_id")) | above("m", "h") | above("h", "m"))
    fits = m.join(h, near, "left_semi").select("graph_id", "id", "zone_id", "pos")
    base = have.withColumn("part", F.lit(0)).unionByName(fits.withColumn("part", F.lit(1)))
    level = depths(zones) if level is None else level
    level = level.select("graph_id", F.col("id").alias("zone_id"), "depth")
    once = base.groupBy("graph_id", "id", "zone_id").agg(F.min(F.struct("part", "pos")).alias("at")).join(level, ["graph_id", "zone_id"], "left")
    joined = once.groupBy("graph_id", "id").agg(F.transform(F.sort_array(F.collect_list(F.struct(F.coalesce("depth", F.lit(0)).alias("depth"), "at", "zone_id"))), lambda x: x["zone_id"]).alias("joined"))
    plain = mapped.groupBy("graph_id", "id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "zone_id"))), lambda x: x["zone_id"]).alias("plain"))
    fit = fits.select("graph_id", "id").distinct().withColumn("fit", F.lit(True))
    n = nodes.select("graph_id", "id", F.col("zones").alias("own"))
    out = hints.select("graph_id", "id", F.filter("zones", lambda z: F.coalesce(z, F.lit("")) != "").alias("raw")).join(n, ["graph_id", "id"])
    out = out.join(joined, ["graph_id", "id"], "left").join(plain, ["graph_id", "id"], "left").join(fit, ["graph_id", "id"], "left")
    has = F.size("own") > 0
    kept = F.when(has & F.col("fit"), F.col("joined")).when(has, F.col("own")).when(F.col("plain").isNotNull(), F.col("plain")).otherwise(F.col("raw"))
    return out.select("graph_id", "id", kept.alias("zones"))


def merged_data(own, more):
    """The union of two lists of tags, sorted (Q18)."""
    none = F.expr(NONE)
    return F.array_sort(F.array_union(F.coalesce(own, none), F.coalesce(more, none)))


def patch_nodes(nodes: DataFrame, hints: DataFrame, zones: DataFrame) -> DataFrame:
    """Nodes ⟕ hints(graph_id, id, attrs map<string,string>, zones array, data array). Unknown ids are ignored. label, type, auth and notes are taken where the key is present; a zone hint is resolved;
    a node's zone follows the innermost of its zones."""
    with scratch() as keep:
        labels = keep(intervals(zones))
        level = keep(written(depths(zones), "zone-depths"))
    fresh = normalised_zones(hints.where("zones is not null"), nodes, zones, labels, level).withColumnRenamed("zones", "_zones")
    one = resolve_zones(hints.where("attrs['zone'] is not null and attrs['zone'] <> ''").select("graph_id", "id", F.col("attrs")["zone"].alias("ref")), zones).select("graph_id", "id", F.coalesce("zone_id", "ref").alias("_zone"))
    h = hints.select("graph_id", "id", "attrs", F.col("data").alias("_data"), F.lit(True).alias("_hit"))
    out = nodes.join(h, ["graph_id", "id"], "left").join(fresh, ["graph_id", "id"], "left").join(one, ["graph_id", "id"], "left")
    given = lambda k: F.coalesce(F.map_contains_key("attrs", k), F.lit(False))
    take = lambda k: F.when(given(k), F.col("attrs")[k]).otherwise(F.col(k))
    out = out.withColumns({
        "label": take("label"),
        "type": take("type"),
        "notes": take("notes"),
        "auth": F.when(given("auth"), F.col("attrs")["auth"].try_cast("boolean")).otherwise(F.col("auth")),
        "data": F.when(F.col("_data").isNotNull(), merged_data(F.col("data"), F.col("_data"))).otherwise(F.col("data")),
        "zones": F.coalesce("_zones", "zones"),
    })
    out = out.withColumn("zones", F.when((F.size("zones") == 0) & F.col("_zone").isNotNull(), F.array("_zone")).otherwise(F.col("zones")))
    names = zones.select("graph_id", F.col("id").alias("_inner"), F.col("name").alias("_name"))
    level = level.select("graph_id", F.col("id").alias("z"), "depth")
    inner = out.where("_hit").select("graph_id", "id", F.posexplode("zones").alias("p", "z")).join(level, ["graph_id", "z"], "left")
    inner = inner.groupBy("graph_id", "id").agg(F.max_by("z", F.struct(F.coalesce("depth", F.lit(0)), "p")).alias("_inner"))
    out = out.join(inner, ["graph_id", "id"], "left").join(names, ["graph_id", "_inner"], "left")
    zone = F.when(F.col("_hit"), F.coalesce("_name", "_inner", "_zone", "zone")).otherwise(F.col("zone"))
    return out.withColumn("zone", zone).select(*nodes.columns)


def patch_edges(edges: DataFrame, hints: DataFrame) -> DataFrame:
    """hints(graph_id, hint_pos, src, dst, protocol, data) update the first edge from src to dst: the last protocol that isn't blank, the union of tags."""
    w = Window.partitionBy("graph_id", "src", "dst")
    tags = F.array_distinct(F.flatten(F.collect_list(F.coalesce("data", F.expr(NONE)))))
    h = hints.where("coalesce(src, '') <> '' and coalesce(dst, '') <> ''").groupBy("graph_id", "src", "dst").agg(
        F.max_by("protocol", F.when(F.coalesce("protocol", F.lit("")) != "", F.col("hint_pos"))).alias("_protocol"), F.when(F.count("data") > 0, tags).alias("_data")
    )
    out = edges.withColumn("_n", F.row_number().over(w.orderBy("edge_pos"))).join(h, ["graph_id", "src", "dst"], "left")
    first = F.col("_n") == 1
    out = out.withColumns({
        "protocol": F.when(first & (F.coalesce("_protocol", F.lit("")) != ""), F.col("_protocol")).otherwise(F.col("protocol")),
        "data": F.when(first & F.col("_data").isNotNull(), merged_data(F.col("data"), F.col("_data"))).otherwise(F.col("data")),
    })
    return out.select(*edges.columns)
