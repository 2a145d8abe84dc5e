"""Flows over nodes and edges: enrichment, boundary crossings, risk, query texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions.text import QUERY_CHARS, collapse

# Fixed values.
RISKY_PROTOCOLS = r"http|sql|grpc|tcp|ssh"
PUBLIC_ZONES = r"internet|public|external|untrusted|dmz"
PUBLIC_TYPES = ("actor", "client", "gateway", "browser")
MAX_QUERIES, TOP_FLOWS, TOP_NODES = 8, 3, 2
#: No entry of a graph's text is shorter: `->`, ` (x) data=y` and what stands between two entries. 2000 characters hold so few of them that Spark limits the groups before it shuffles them (it does for less than 1000 rows).
ENTRY_CHARS = 15


def zone_of(zone: Column, zones: Column) -> Column:
    """A node's zone, else the last of its zones, else n/a."""
    return F.coalesce(F.nullif(zone, F.lit("")), F.when(F.size(zones) > 0, F.element_at(zones, -1)), F.lit("n/a"))


def enriched(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Each edge whose ends are known with its nodes' labels and zones, whether it crosses zones, its data and its risk (0 to 5). The data are those of the first of edge, source and target that has any (Q21).

    What an edge or a node tells alone is computed before the joins, each thing as a column of its own, so that shuffles carry what the result reads and nothing else. Nodes are fewer than edges: they are hashed,
    and no side is sorted. Sources come last, so that flows lie by source where all edges are of one graph."""
    listed = lambda c: F.when(F.size(c) > 0, F.array_join(c, ", "))
    weight = lambda c: F.when(F.size(c) > 0, F.when(F.array_join(c, ", ").isin("", "none"), 0).otherwise(2))
    side = lambda p: nodes.select(F.col("graph_id"), F.col("id").alias(p), F.col("label").alias(f"{p}_label"), zone_of(F.col("zone"), F.col("zones")).alias(f"{p}_zone"), listed("data").alias(f"_{p}_items"), weight("data").alias(f"_{p}_weight")).hint("shuffle_hash")
    proto = F.coalesce(F.nullif("protocol", F.lit("")), F.nullif("label", F.lit("")), F.lit("unknown"))
    own = edges.withColumns({"proto": proto, "_risky": F.when(F.rlike(F.lower(proto), F.lit(RISKY_PROTOCOLS)), 1).otherwise(0), "_items": listed("data"), "_weight": weight("data")})
    out = own.join(side("dst"), ["graph_id", "dst"]).join(side("src"), ["graph_id", "src"])
    out = out.withColumns({
        "crossing": F.col("src_zone") != F.col("dst_zone"),
        "items": F.coalesce(F.nullif(F.coalesce("_items", "_src_items", "_dst_items"), F.lit("")), F.lit("none")),
    })
    risk = F.when(F.col("crossing"), 2).otherwise(0) + F.coalesce("_weight", "_src_weight", "_dst_weight", F.lit(0)) + F.col("_risky")
    return out.withColumn("risk", risk).drop("_risky", *[f"{p}_{c}" for p in ("", "_src", "_dst") for c in ("items", "weight")])


def top_flows(flows: DataFrame, k: int = TOP_FLOWS) -> DataFrame:
    """T5: the k riskiest flows of each graph, earlier edges first among equals."""
    w = Window.partitionBy("graph_id").orderBy(F.col("risk").desc(), "edge_pos")
    return flows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def is_sensitive(data: Column) -> Column:
    return F.exists(F.coalesce(data, F.array().cast("array<string>")), lambda d: F.length(F.regexp_replace(F.coalesce(d, F.lit("")), r"\s", "")) > 0)


def is_public(zone: Column, zones: Column, kind: Column) -> Column:
    text = F.lower(F.concat_ws(" ", F.coalesce(zone, F.lit("")), zones))
    return F.rlike(text, F.lit(PUBLIC_ZONES)) | F.coalesce(F.lower(kind).isin(*PUBLIC_TYPES), F.lit(False))


def or_na(c: str) -> Column:
    return F.coalesce(F.nullif(c, F.lit("")), F.lit("n/a"))


def graph_query(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """one text a graph that names its components and flows, each list cut at 2000 characters. Entries have so many characters that the first few of a list are all that can count: tasks hand on no more of a
    graph than those, so that none reads a large graph whole."""
    data = F.coalesce(F.nullif(F.array_join("data", ","), F.lit("")), F.lit("none"))
    node = F.concat("id", F.lit(":"), "label", F.lit(" zone="), or_na("zone"), F.lit(" type="), or_na("type"), F.lit(" data="), data)
    edge = F.concat("src", F.lit("->"), "dst", F.lit(" ("), F.coalesce(F.nullif("label", F.lit("")), F.lit("flow")), F.lit(") data="), data)

    def listed(rows: DataFrame, part: Column, pos: str, name: str) -> DataFrame:
        own = rows.select("graph_id", pos, part.alias("t"))
        first = Window.partitionBy("graph_id").orderBy(F.col("t").isNull(), pos, "t")  # entries without text count for nothing
        kept = own.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= QUERY_CHARS // ENTRY_CHARS + 1)
        texts = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(pos, "t"))), lambda x: x["t"]), "; ")
        return kept.groupBy("graph_id").agg(F.substring(texts, 1, QUERY_CHARS).alias(name))

    n, e = listed(nodes, node, "node_pos", "n"), listed(edges, edge, "edge_pos", "e")
    # fixed value
    text = F.concat(F.lit("Security knowledge needed for a system with components: "), F.coalesce("n", F.lit("")), F.lit(" | data flows: "), F.coalesce("e", F.lit("")))
    return n.join(e, "graph_id", "full").select("graph_id", text.alias("query"))


def graph_queries(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph_id, query_pos, query): the graph's text, its riskiest flows, sensitive and public nodes; distinct but for case and white space, 8 at most."""
    # fixed values: the texts of queries
    flow = F.concat(
        F.lit("Security controls and abuse cases for flow "), "src_label", F.lit(" ("), "src_zone", F.lit(") -> "), "dst_label", F.lit(" ("), "dst_zone", F.lit(") over "), "proto",
        F.lit("; data="), "items", F.lit(". Include authentication, authorization, encryption, and tampering risks."),
    )
    tail = F.concat(F.lit("(type="), or_na("type"), F.lit(", zone="), or_na("zone"), F.lit(")."))
    sensitive = F.concat(F.lit("Threat modeling guidance for handling sensitive data ("), F.array_join("data", ", "), F.lit(") in component "), "label", F.lit(" "), tail)
    public = F.concat(F.lit("Common attack patterns and mitigations for internet-facing component "), "label", F.lit(" "), tail)
    first = Window.partitionBy("graph_id").orderBy("node_pos")

    def some(rows: DataFrame, text: Column, block: int) -> DataFrame:
        return rows.withColumn("r", F.row_number().over(first)).where(F.col("r") <= TOP_NODES).select("graph_id", F.lit(block).alias("b"), "r", text.alias("query"))

    parts = graph_query(nodes, edges).select("graph_id", F.lit(0).alias("b"), F.lit(1).alias("r"), "query")
    parts = parts.unionByName(top_flows(enriched(nodes, edges)).select("graph_id", F.lit(1).alias("b"), F.col("rank").alias("r"), flow.alias("query")))
    parts = parts.unionByName(some(nodes.where(is_sensitive(F.col("data"))), sensitive, 2)).unionByName(some(nodes.where(is_public(F.col("zone"), F.col("zones"), F.col("type"))), public, 3))
    return distinct_queries(parts)


def distinct_queries(parts: DataFrame, most: int = MAX_QUERIES) -> DataFrame:
    """U4: (graph_id, b, r, query) in the order of (b, r): the first of those that differ in case and white space only; `most` at most, numbered from 0."""
    seen = Window.partitionBy("graph_id", F.lower(collapse(F.col("query")))).orderBy("b", "r")
    once = parts.withColumn("_k", F.row_number().over(seen)).where("_k = 1")
    pos = F.row_number().over(Window.partitionBy("graph_id").orderBy("b", "r")) - 1
    return once.withColumn("query_pos", pos).where(F.col("query_pos") < most).select("graph_id", "query_pos", "query")
