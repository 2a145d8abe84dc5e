"""Queries of graph sources: texts in each format are written from the tables and read again."""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.plans.registry import query, table
from orrery.sources import drawio, graphs, ir, mermaid, threat_dragon


def s(c: str):
    return F.col(c).cast("string")


def in_order(rows: DataFrame, sep: str) -> DataFrame:
    """rows(graph_id, o, t) -> graphs(graph_id, text): the texts of a graph in order."""
    return rows.groupBy("graph_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("o", "t"))), lambda x: x["t"]), sep).alias("text"))


def mermaid_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer a flowchart: its node in its nation's subgraph, within its region's, and a flow to each of its orders; every fifth order's arrow points both ways, every third has no label."""
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    head = F.concat(F.lit("graph TD\nsubgraph "), "r_name", F.lit("\n  subgraph x["), "n_name", F.lit("]\n    c"), s("c_custkey"), F.lit('["'), "c_name", F.lit('"]\n  end'))
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    arrow = F.when(k % 5 == 0, F.lit(" <--> ")).when(k % 3 == 0, F.lit(" --> ")).otherwise(F.concat(F.lit(" -->|"), "o_orderpriority", F.lit("| ")))
    line = F.concat(F.lit("c"), s("o_custkey"), arrow, F.lit("o"), s("o_orderkey"), F.lit("(("), "o_orderstatus", F.lit("))  %% note"))
    rows = c.select(F.col("c_custkey").alias("graph_id"), F.lit(-1).cast("long").alias("o"), head.alias("t")).unionByName(o.select(F.col("o_custkey").alias("graph_id"), k.alias("o"), line.alias("t")))
    tail = c.select(F.col("c_custkey").alias("graph_id"), F.lit(2**60).alias("o"), F.lit("end\nend\n").alias("t"))
    return in_order(rows.unionByName(tail), "\n")


@query("""WITH e AS (SELECT o_custkey AS graph_id, o_orderkey, 'c' || o_custkey AS c, 'o' || o_orderkey AS o, CASE WHEN o_orderkey % 5 = 0 OR o_orderkey % 3 = 0 THEN NULL ELSE o_orderpriority END AS label, unnest(CASE WHEN o_orderkey % 5 = 0 THEN [0, 1] ELSE [0] END) AS ord FROM orders)
SELECT graph_id, (row_number() OVER (PARTITION BY graph_id ORDER BY o_orderkey, ord) - 1)::INTEGER AS edge_pos, CASE ord WHEN 0 THEN c ELSE o END AS src, CASE ord WHEN 0 THEN o ELSE c END AS dst, label FROM e""")
def mermaid_edges(spark, sf_dir):
    """S4, F10-F12, P10."""
    return mermaid.parse(mermaid_texts(spark, sf_dir)).edges.select("graph_id", "edge_pos", "src", "dst", "label")


@query("""SELECT c_custkey AS graph_id, 'c' || c_custkey AS id, c_name AS label, 'zone_0,zone_1' AS zones, n_name AS zone FROM customer JOIN nation ON n_nationkey = c_nationkey
UNION ALL SELECT o_custkey, 'o' || o_orderkey, o_orderstatus, 'zone_0', r_name FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey""")
def mermaid_nodes(spark, sf_dir):
    """Labels of nodes and the subgraphs that they are in."""
    return mermaid.parse(mermaid_texts(spark, sf_dir)).nodes.select("graph_id", "id", "label", F.array_join("zones", ",").alias("zones"), "zone")


@query("""WITH o AS (SELECT o_custkey AS g, count(*) AS n, count(*) FILTER (o_orderkey % 5 = 0) AS b FROM orders GROUP BY 1) SELECT c_custkey AS graph_id, (8 + coalesce(n, 0) - 1)::INTEGER AS total_lines, coalesce(n, 0) AS edge_candidates, coalesce(n + b, 0) AS edges_parsed, 1::BIGINT AS node_label_candidates, 1::BIGINT AS node_labels_parsed,
round_even((coalesce(n + b, 0) + 1) / (coalesce(n, 0) + 1), 3) AS import_success_rate FROM customer LEFT JOIN o ON g = c_custkey""")
def import_success_rate(spark, sf_dir):
    """A8, F7."""
    return mermaid.parse(mermaid_texts(spark, sf_dir)).metrics


def ir_texts(spark: SparkSession, sf_dir: str, broken: bool = False) -> DataFrame:
    """Each nation a native graph: its suppliers are nodes in zone r, in zone w, and flow to themselves. If broken, odd nations flow to a node that isn't there and lack a zone."""
    n = table(spark, sf_dir, "supplier")
    me = F.concat(F.lit("n"), s("s_suppkey"))
    node = F.to_json(F.struct(me.alias("id"), F.concat(F.lit(" "), "s_name").alias("label"), F.array(F.lit("r"), F.lit("w")).alias("zones"), F.lit("process").alias("type"), F.array(F.lit("d"), F.lit("")).alias("data"), (F.col("s_suppkey") % 2 == 0).alias("auth")))
    other = F.when(F.lit(broken) & (F.col("s_nationkey") % 2 == 1), F.lit("nowhere")).otherwise(me)
    edge = F.to_json(F.struct(me.alias("src"), other.alias("dst"), F.lit("  ").alias("label"), F.lit("https").alias("protocol")))
    rows = n.groupBy(F.col("s_nationkey").alias("graph_id")).agg(F.sort_array(F.collect_list(F.struct("s_suppkey", F.concat(F.lit('"'), me, F.lit('":'), node).alias("n"), edge.alias("e")))).alias("x"))
    zones = F.when(F.lit(broken) & (F.col("graph_id") % 2 == 1), F.lit('{"r":{"name":"R","parent_id":"w"}}')).otherwise(F.lit('{"w":{"name":"World"},"r":{"name":"R","parent_id":"w"}}'))
    text = F.concat(F.lit('{"nodes":{'), F.array_join(F.transform("x", lambda x: x["n"]), ","), F.lit('},"edges":['), F.array_join(F.transform("x", lambda x: x["e"]), ","), F.lit('],"zones":'), zones, F.lit("}"))
    return rows.select("graph_id", text.alias("text"))


@query("SELECT s_nationkey AS graph_id, 'n' || s_suppkey AS id, s_name AS label, 'w,r' AS zones, 'R' AS zone, 'process' AS type, 'd' AS data, s_suppkey % 2 = 0 AS auth FROM supplier")
def ir_nodes(spark, sf_dir):
    """S7, P21, T7."""
    return ir.parse(ir_texts(spark, sf_dir)).nodes.select("graph_id", "id", "label", F.array_join("zones", ",").alias("zones"), "zone", "type", F.array_join("data", ",").alias("data"), "auth")


@query("""SELECT s_nationkey AS graph_id, 'edge ' || (row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1) || ' names unknown node nowhere' AS error FROM supplier WHERE s_nationkey % 2 = 1
UNION ALL SELECT s_nationkey, 'node n' || s_suppkey || ' names unknown zone w' FROM supplier WHERE s_nationkey % 2 = 1 UNION ALL SELECT DISTINCT s_nationkey, 'zone r names unknown parent w' FROM supplier WHERE s_nationkey % 2 = 1""")
def ir_violations(spark, sf_dir):
    """S7, J9, P21, G5."""
    return ir.violations(ir_texts(spark, sf_dir, broken=True))


def dragon_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each nation a model: its suppliers are stores, in an inner and an outer boundary, in the outer one or in none, by turns; each flows to itself, and to one that isn't there."""
    x = table(spark, sf_dir, "supplier")
    k, me = F.col("s_suppkey"), F.concat(F.lit("s"), F.col("s_suppkey").cast("string"))
    at = F.when(k % 3 == 0, 10.0).when(k % 3 == 1, 150.0).otherwise(900.0)
    box = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    size = F.struct(F.lit(20.0).alias("width"), F.lit(20.0).alias("height"))
    store = F.to_json(F.struct(me.alias("id"), F.lit("store").alias("shape"), box(at, at).alias("position"), size.alias("size"), F.struct(F.lit("tm.Store").alias("type"), F.col("s_name").alias("name")).alias("data")))
    flow = lambda to: F.to_json(F.struct(F.concat(F.lit("f"), me).alias("id"), F.lit("flow").alias("shape"), F.struct(me.alias("cell")).alias("source"), F.struct(to.alias("cell")).alias("target"), F.array(F.struct(F.lit(" ships ").alias("text"))).alias("labels"), F.struct(F.lit("tm.Flow").alias("type"), F.lit("tls").alias("protocol"), (k % 2 == 0).alias("isEncrypted"), F.lit(True).alias("isBidirectional")).alias("data")))
    rows = x.select(F.col("s_nationkey").alias("graph_id"), k.alias("o"), F.concat_ws(",", store, flow(me), flow(F.lit("nowhere"))).alias("t"))
    boxes = '{"id":"out","shape":"trust-boundary-box","position":{"x":0,"y":0},"size":{"width":300,"height":300},"data":{"type":"tm.BoundaryBox","name":"Outer"}},{"id":"in","shape":"trust-boundary-box","position":{"x":5,"y":5},"size":{"width":100,"height":100},"data":{"type":"tm.BoundaryBox","name":"Inner"}},'
    return in_order(rows, ",").select("graph_id", F.concat(F.lit('{"version":"2.0","detail":{"diagrams":[{"cells":[' + boxes), "text", F.lit("]}]}}")).alias("text"))


@query("SELECT s_nationkey AS graph_id, 's' || s_suppkey AS id, s_name AS label, 'store' AS type, CASE s_suppkey % 3 WHEN 0 THEN 'out,in' WHEN 1 THEN 'out' ELSE '' END AS zones, CASE s_suppkey % 3 WHEN 0 THEN 'Inner' WHEN 1 THEN 'Outer' END AS zone FROM supplier")
def td_nodes(spark, sf_dir):
    """S6, P5, F13, J1, J2."""
    return threat_dragon.parse(dragon_texts(spark, sf_dir)).nodes.select("graph_id", "id", "label", "type", F.array_join("zones", ",").alias("zones"), "zone")


@query("SELECT s_nationkey AS graph_id, 's' || s_suppkey AS src, 's' || s_suppkey AS dst, 'ships' AS label, 'tls' AS protocol, CASE WHEN s_suppkey % 2 = 0 THEN 'encrypted,bidirectional' ELSE 'bidirectional' END AS data, 'fs' || s_suppkey AS id FROM supplier")
def td_flows(spark, sf_dir):
    """S6, J3, F13, F14."""
    return threat_dragon.parse(dragon_texts(spark, sf_dir)).edges.select("graph_id", "src", "dst", "label", "protocol", F.array_join("data", ",").alias("data"), "id")


def drawio_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each nation a diagram: a dashed box around groups, one a supplier, each with a shape inside, placed relative to its group; shapes flow to themselves, with a label in a cell of its own. By turns the page is
    plain, URL-encoded, base64, base64 of raw deflate, and plain with a namespace."""
    n = table(spark, sf_dir, "supplier")
    k = s("s_suppkey")
    geo = lambda x, y, w, h: f'<mxGeometry x="{x}" y="{y}" width="{w}" height="{h}" as="geometry"/>'
    cells = F.concat(
        F.lit('<mxCell id="g'), k, F.lit('" value="&lt;b&gt;'), "s_name", F.lit('&lt;/b&gt;" style="group;rounded=1" vertex="1" parent="1">'), F.lit('<mxGeometry x="'), (F.col("s_suppkey") * 100).cast("string"), F.lit('" y="10" width="80" height="80" as="geometry"/></mxCell>'),
        F.lit('<mxCell id="s'), k, F.lit('" value="shop%20'), k, F.lit('" style="ellipse" vertex="1" parent="g'), k, F.lit('">' + geo(10, 10, 20, 20) + "</mxCell>"),
        F.lit('<mxCell id="e'), k, F.lit('" edge="1" source="s'), k, F.lit('" target="s'), k, F.lit('" parent="1"/><mxCell id="l'), k, F.lit('" value="sells" style="edgeLabel;html=1" vertex="1" connectable="0" parent="e'), k, F.lit('"/>'),
    )
    rows = n.select(F.col("s_nationkey").cast("string").alias("graph_id"), F.col("s_suppkey").alias("o"), cells.alias("t"))
    head = '<mxGraphModel><root><mxCell id="0"/><mxCell id="1" parent="0"/><mxCell id="w" value="World" style="rectangle;dashed=1" vertex="1" parent="1">' + geo(0, 0, 1_000_000_000, 200) + "</mxCell>"

    def deflated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            packed = []
            for text in b["text"].to_pylist():
                packer = zlib.compressobj(wbits=-15)
                packed.append(base64.b64encode(packer.compress(quote(text).encode()) + packer.flush()).decode())
            yield pa.RecordBatch.from_arrays([b["graph_id"], pa.array(packed, pa.string())], ["graph_id", "text"])

    pages = in_order(rows, "").select("graph_id", F.concat(F.lit(head), "text", F.lit("</root></mxGraphModel>")).alias("text"))
    way = F.col("graph_id").cast("int") % 5
    plain = pages.where(way != 3).select("graph_id", F.when(way == 1, F.replace(F.url_encode("text"), F.lit("+"), F.lit("%20"))).when(way == 2, F.base64(F.encode("text", "UTF-8"))).otherwise(F.col("text")).alias("text"))
    every = plain.unionByName(pages.where(way == 3).mapInArrow(deflated, "graph_id string, text string"))
    whole = F.concat(F.lit('<mxfile><diagram id="p" name="Page">'), "text", F.lit("</diagram></mxfile>"))
    spaced = F.replace(F.regexp_replace(whole, "<(/?)(?=mx|root|diagram)", "<$1d:"), F.lit("<d:mxfile>"), F.lit('<d:mxfile xmlns:d="urn:d">'))
    return every.select("graph_id", F.when(way == 4, spaced).otherwise(whole).alias("text"))


@query("SELECT s_nationkey::VARCHAR AS graph_id, 's' || s_suppkey AS id, 'shop ' || s_suppkey AS label, 'w,g' || s_suppkey AS zones, s_name AS zone FROM supplier")
def drawio_nodes(spark, sf_dir):
    """S5, S5a, S5c, S5d, P6-P9, G6, F8, F9, F30, J1, J2, J2b."""
    return drawio.parse(drawio_texts(spark, sf_dir)).nodes.select("graph_id", "id", "label", F.array_join("zones", ",").alias("zones"), "zone")


@query("SELECT s_nationkey::VARCHAR AS graph_id, 's' || s_suppkey AS src, 's' || s_suppkey AS dst, 'sells' AS label, 'e' || s_suppkey AS id FROM supplier")
def drawio_edges(spark, sf_dir):
    """S5, J3, J17, P7."""
    return drawio.parse(drawio_texts(spark, sf_dir)).edges.select("graph_id", "src", "dst", "label", "id")


@query("""SELECT o_orderkey AS id, CASE o_orderkey % 8 WHEN 0 THEN 'mermaid' WHEN 1 THEN 'drawio' WHEN 2 THEN 'drawio' WHEN 3 THEN 'threat-dragon' WHEN 4 THEN NULL WHEN 5 THEN 'image' WHEN 6 THEN 'image' END AS fmt,
CASE o_orderkey % 8 WHEN 0 THEN 'mermaid' WHEN 1 THEN 'drawio' WHEN 2 THEN 'drawio' WHEN 3 THEN 'threat-dragon' WHEN 4 THEN 'threat-dragon' WHEN 5 THEN 'image' WHEN 6 THEN NULL END AS upload, CASE o_orderkey % 8 WHEN 0 THEN '.mmd' WHEN 1 THEN '.drawio' WHEN 2 THEN '.drawio' WHEN 3 THEN '.json' ELSE '.txt' END AS suffix FROM orders""")
def format_detect(spark, sf_dir):
    """S1, S1b, S2, F31, Q20."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey") % 8
    names = ["a.MMD", "a.drawio", "a.xml", "a.json", "b.json", "a.JPG", "a.bmp", "a.pdf"]
    name = F.element_at(F.array(*[F.lit(x) for x in names]), (k + 1).cast("int"))
    text = F.when(k == 3, '{"version":"2.1","detail":{"diagrams":[{"cells":[{}]}]}}').when(k == 4, '{"version":"1.0","detail":{"diagrams":[{"cells":[{}]}]}}').otherwise("x")
    fmt = graphs.input_format(name, text)
    return o.select(F.col("o_orderkey").alias("id"), fmt.alias("fmt"), graphs.upload_format(name).alias("upload"), graphs.suffix(fmt).alias("suffix"))


@query("""WITH RECURSIVE p AS (SELECT n_nationkey AS id, CASE WHEN n_nationkey % 5 = 4 THEN n_nationkey - 4 ELSE n_nationkey + 1 END AS parent, n_nationkey < 10 AS loop FROM nation) SELECT id FROM p WHERE loop""")
def zone_cycles(spark, sf_dir):
    """Nations in rings of five, of which those from 10 on are open."""
    from orrery.operators.zones import cyclic

    k = F.col("n_nationkey")
    ring = F.when((k % 5 == 4) & (k < 10), k - 4).when(k % 5 != 4, k + 1)
    n = table(spark, sf_dir, "nation").select(F.lit("all").alias("graph_id"), k.alias("id"), ring.alias("parent_id"))
    return cyclic(n).select("id")


