"""Queries of graphs: flows, zones, rectangles, patches, differences, evidence. Customers and suppliers are nodes, order lines are edges, nations lie in regions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orrery.operators import diff, evidence, flows, patch, zones
from orrery.plans.registry import query, table
from orrery.tables import written

def none():
    return F.array().cast("array<string>")



def party(spark, sf_dir) -> DataFrame:
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("z"), F.col("n_name").alias("zone"))
    c = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"), F.col("c_name").alias("label"), F.col("c_nationkey").alias("k"), F.lit("client").alias("type"), F.when(F.col("c_acctbal") > 0, F.array("c_mktsegment")).otherwise(none()).alias("data"), F.col("c_custkey").alias("node_pos"))
    s = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("id"), F.col("s_name").alias("label"), F.col("s_nationkey").alias("k"), F.lit("store").alias("type"), none().alias("data"), (F.col("s_suppkey") + 1_000_000_000).alias("node_pos"))
    n = c.unionByName(s).join(nation, "k")
    return n.select(F.lit("all").alias("graph_id"), "node_pos", "id", "label", "zone", F.array("z").alias("zones"), "type", "data", F.lit(None).cast("boolean").alias("auth"), F.lit(None).cast("string").alias("notes"))


def lines(spark, sf_dir) -> DataFrame:
    """Order lines as edges; edge_pos is unique: orders, then a place within the order. Orders are fewer than lines: they are hashed, and neither is sorted."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderstatus", "o_orderpriority").hint("shuffle_hash")
    li = table(spark, sf_dir, "lineitem").join(o, "l_orderkey")
    protocol = F.when(F.col("l_linestatus") == "O", "HTTPS").when(F.col("l_returnflag") == "R", "smtp")
    return li.select(
        F.lit("all").alias("graph_id"), (F.col("l_orderkey") * 1000 + F.col("l_linenumber")).alias("edge_pos"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("src"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("dst"),
        F.col("o_orderpriority").alias("label"), protocol.alias("protocol"), F.when(F.col("l_returnflag") == "A", F.array(F.lit("returns"))).otherwise(none()).alias("data"),
        F.concat_ws("-", F.lit("e"), F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string")).alias("id"), "o_orderstatus", "l_partkey", "l_extendedprice",
    )


PARTY = """nodes AS (SELECT 'c' || c_custkey AS id, c_name AS label, n_name AS zone, CASE WHEN c_acctbal > 0 THEN c_mktsegment END AS item FROM customer JOIN nation ON n_nationkey = c_nationkey
UNION ALL SELECT 's' || s_suppkey, s_name, n_name, NULL FROM supplier JOIN nation ON n_nationkey = s_nationkey)"""
LINES = """edges AS (SELECT l_orderkey * 1000 + l_linenumber AS edge_pos, 'c' || o_custkey AS src, 's' || l_suppkey AS dst, o_orderpriority AS label, CASE WHEN l_linestatus = 'O' THEN 'HTTPS' WHEN l_returnflag = 'R' THEN 'smtp' END AS protocol,
CASE WHEN l_returnflag = 'A' THEN 'returns' END AS item, 'e-' || l_orderkey || '-' || l_linenumber || '-' || l_partkey AS id, o_orderstatus, l_partkey, l_extendedprice FROM lineitem JOIN orders ON o_orderkey = l_orderkey)"""
FLOWS = f"""{PARTY}, {LINES}, flows AS (SELECT e.*, a.label AS src_label, b.label AS dst_label, a.zone AS src_zone, b.zone AS dst_zone, a.zone <> b.zone AS crossing, coalesce(e.item, a.item, b.item, 'none') AS items, coalesce(protocol, e.label) AS proto,
(CASE WHEN a.zone <> b.zone THEN 2 ELSE 0 END + CASE WHEN coalesce(e.item, a.item, b.item) IS NOT NULL THEN 2 ELSE 0 END + CASE WHEN regexp_matches(lower(coalesce(protocol, e.label)), 'http|sql|grpc|tcp|ssh') THEN 1 ELSE 0 END)::INTEGER AS risk
FROM edges e JOIN nodes a ON e.src = a.id JOIN nodes b ON e.dst = b.id)"""


@query(f"WITH {FLOWS} SELECT edge_pos, l_partkey, src, dst, src_zone, dst_zone, crossing, items, proto, risk FROM flows")
def flow_enrich(spark, sf_dir):
    """J3, G7, Q21."""
    out = flows.enriched(party(spark, sf_dir), lines(spark, sf_dir))
    return out.select("edge_pos", "l_partkey", "src", "dst", "src_zone", "dst_zone", "crossing", "items", "proto", "risk")


@query(f"WITH {FLOWS} SELECT src_zone, dst_zone, count(*) AS n, sum(risk)::BIGINT AS risk FROM flows WHERE crossing GROUP BY 1, 2")
def cross_zone_flows(spark, sf_dir):
    """G7."""
    out = flows.enriched(party(spark, sf_dir), lines(spark, sf_dir)).where("crossing")
    return out.groupBy("src_zone", "dst_zone").agg(F.count("*").alias("n"), F.sum("risk").alias("risk"))


@query(f"WITH {FLOWS}, r AS (SELECT src AS graph_id, edge_pos * 10000000 + l_partkey AS edge_pos, dst, risk, row_number() OVER (PARTITION BY src ORDER BY risk DESC, edge_pos * 10000000 + l_partkey, l_extendedprice) AS rank FROM flows) SELECT graph_id, edge_pos, dst, risk, rank::INTEGER AS rank FROM r WHERE rank <= 3")
def flow_risk_topk(spark, sf_dir):
    """T5: the three riskiest flows of each customer."""
    out = flows.enriched(party(spark, sf_dir), lines(spark, sf_dir)).withColumn("graph_id", F.col("src")).withColumn("edge_pos", F.col("edge_pos") * 10_000_000 + F.col("l_partkey"))
    return flows.top_flows(out).select("graph_id", "edge_pos", "dst", "risk", "rank")


@query("""WITH n AS (SELECT 'n' || c_nationkey AS graph_id, c_custkey, 'c' || c_custkey || ':' || c_name || ' zone=' || n_name || ' type=client data=' || CASE WHEN c_acctbal > 0 THEN c_mktsegment ELSE 'none' END AS t FROM customer JOIN nation ON n_nationkey = c_nationkey)
SELECT graph_id, 'Security knowledge needed for a system with components: ' || substr(string_agg(t, '; ' ORDER BY c_custkey), 1, 2000) || ' | data flows: ' AS query FROM n GROUP BY 1""")
def graph_query_text(spark, sf_dir):
    """Each nation's customers as a graph without flows."""
    n = party(spark, sf_dir).where("type = 'client'").withColumn("graph_id", F.element_at("zones", 1))
    e = lines(spark, sf_dir).limit(0)
    return flows.graph_query(n, e)


@query()
def graph_queries(spark, sf_dir):
    """All query texts of each nation's customers and of one graph of everything."""
    n, e = party(spark, sf_dir), lines(spark, sf_dir)
    nation = n.where("type = 'client'").withColumn("graph_id", F.element_at("zones", 1))
    return flows.graph_queries(nation, e).unionByName(flows.graph_queries(n, e))


def places(spark, sf_dir, customers: bool = False) -> DataFrame:
    """The world, regions in it, nations in those and, if asked, customers in those; the world is its own parent."""
    r = table(spark, sf_dir, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("id"), F.col("r_name").alias("name"), F.lit("w").alias("parent_id"), (F.col("r_regionkey") + 1).alias("zone_pos"))
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("id"), F.col("n_name").alias("name"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("parent_id"), (F.col("n_nationkey") + 1000).alias("zone_pos"))
    w = spark.sql("SELECT 'w' AS id, 'WORLD' AS name, 'w' AS parent_id, 0 AS zone_pos")
    out = w.unionByName(r).unionByName(n)
    if customers:
        c = F.col("c_custkey").cast("string")
        out = out.unionByName(table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), c).alias("id"), F.col("c_name").alias("name"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("parent_id"), (F.col("c_custkey") + 10_000).cast("int").alias("zone_pos")))
    return out.withColumn("graph_id", F.lit("all"))


PLACES = """z AS (SELECT 'w' AS id, 'WORLD' AS name, 'w' AS parent_id UNION ALL SELECT 'r' || r_regionkey, r_name, 'w' FROM region UNION ALL SELECT 'n' || n_nationkey, n_name, 'r' || n_regionkey FROM nation UNION ALL SELECT 'c' || c_custkey, c_name, 'n' || c_nationkey FROM customer)"""


@query(f"WITH RECURSIVE {PLACES}, t AS (SELECT id, name AS path, 0 AS depth FROM z WHERE id = parent_id UNION ALL SELECT z.id, t.path || ' > ' || z.name, t.depth + 1 FROM z JOIN t ON z.parent_id = t.id WHERE z.id <> z.parent_id) SELECT id, path, depth::INTEGER AS depth FROM t")
def zone_depth_path(spark, sf_dir):
    """G1, G2."""
    return zones.paths(places(spark, sf_dir, True)).select("id", "path", "depth")


@query(f"WITH RECURSIVE {PLACES}, t AS (SELECT id, id AS ancestor, 0 AS distance FROM z UNION ALL SELECT t.id, z.parent_id, distance + 1 FROM t JOIN z ON z.id = t.ancestor WHERE z.parent_id <> z.id) SELECT id, ancestor, distance::INTEGER AS distance FROM t")
def zone_ancestors(spark, sf_dir):
    """G3."""
    return zones.closure(places(spark, sf_dir, True)).select("id", "ancestor", "distance")


def rects(spark, sf_dir) -> DataFrame:
    p = table(spark, sf_dir, "part")
    k, s = F.col("p_partkey"), F.col("p_size")
    return p.select(F.col("p_brand").alias("graph_id"), k.alias("id"), F.col("p_name").alias("name"), ((k * 37) % 500).cast("double").alias("x"), ((k * 53) % 500).cast("double").alias("y"), (s * 8).cast("double").alias("width"), ((s * 7) % 50 * 8).cast("double").alias("height"))


RECTS = "r AS (SELECT p_brand AS graph_id, p_partkey AS id, p_name AS name, ((p_partkey * 37) % 500)::DOUBLE AS x, ((p_partkey * 53) % 500)::DOUBLE AS y, (p_size * 8)::DOUBLE AS width, ((p_size * 7) % 50 * 8)::DOUBLE AS height FROM part)"
ENCLOSES = "a.graph_id = b.graph_id AND a.id <> b.id AND a.x <= b.x AND a.y <= b.y AND a.x + a.width >= b.x + b.width AND a.y + a.height >= b.y + b.height"


@query(f"WITH {RECTS}, p AS (SELECT b.graph_id, b.id, min((a.width * a.height, a.id)) AS m FROM r b JOIN r a ON {ENCLOSES} AND (a.width * a.height > b.width * b.height OR (a.width * a.height = b.width * b.height AND a.id < b.id)) GROUP BY 1, 2) SELECT r.graph_id, r.id, r.name, m[2] AS parent_id FROM r LEFT JOIN p ON p.graph_id = r.graph_id AND p.id = r.id")
def rect_parent(spark, sf_dir):
    """Rectangles of parts within a brand."""
    return zones.rect_parents(rects(spark, sf_dir))


@query(f"WITH {RECTS} SELECT p.graph_id, p.id AS node_id, r.id AS zone_id FROM r p JOIN r ON p.graph_id = r.graph_id AND p.x + p.width / 2 BETWEEN r.x AND r.x + r.width AND p.y + p.height / 2 BETWEEN r.y AND r.y + r.height")
def point_in_rect(spark, sf_dir):
    """The centres of the rectangles."""
    r = rects(spark, sf_dir)
    return zones.points_in_rects(r.select("graph_id", F.col("id").alias("node_id"), (F.col("x") + F.col("width") / 2).alias("cx"), (F.col("y") + F.col("height") / 2).alias("cy")), r)


@query(f"WITH {RECTS} SELECT a.* FROM r a WHERE width > 0 AND height > 0 AND EXISTS (SELECT 1 FROM r b WHERE b.width > 0 AND b.height > 0 AND {ENCLOSES})")
def rect_holding(spark, sf_dir):
    """J2b."""
    return zones.holding_others(rects(spark, sf_dir))


@query("""SELECT c_custkey AS node_id, 'w,x,r' || n_regionkey || ',n' || c_nationkey AS zones, n_name AS zone FROM customer JOIN nation ON n_nationkey = c_nationkey""")
def zone_order(spark, sf_dir):
    """Zones of customers, given inside out, one of them unknown."""
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    ids = F.array(F.concat(F.lit("n"), F.col("c_nationkey").cast("string")), F.lit("w"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")), F.lit("x"))
    members = c.select(F.lit("all").alias("graph_id"), F.col("c_custkey").alias("node_id"), F.posexplode(ids).alias("pos", "zone_id"))
    return zones.ordered_zones(members, places(spark, sf_dir)).select("node_id", F.array_join("zones", ",").alias("zones"), "zone")


@query("""SELECT 'c' || c_custkey AS id, CASE WHEN c_acctbal < 0 THEN 'debtor ' || c_custkey ELSE c_name END AS label, CASE WHEN c_acctbal < 0 THEN NULL ELSE 'client' END AS type,
CASE WHEN c_acctbal < 0 THEN 'debt' ELSE CASE WHEN c_acctbal > 0 THEN c_mktsegment ELSE '' END END AS data,
CASE WHEN c_acctbal < 0 THEN 'r' || n_regionkey || ',n' || c_nationkey ELSE 'n' || c_nationkey END AS zones, n_name AS zone FROM customer JOIN nation ON n_nationkey = c_nationkey""")
def hint_patch_nodes(spark, sf_dir):
    """Customers in debt are renamed, lose their type, get a tag and their region, named in lower case, as a zone beside another region, which doesn't fit."""
    n = party(spark, sf_dir).where("type = 'client'")
    c = table(spark, sf_dir, "customer").where("c_acctbal < 0").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    other = F.concat(F.lit("r"), ((F.col("n_regionkey") + 1) % 5).cast("string"))
    h = c.select(F.lit("all").alias("graph_id"), F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"), F.create_map(F.lit("label"), F.concat(F.lit("debtor "), F.col("c_custkey").cast("string")), F.lit("type"), F.lit(None).cast("string")).alias("attrs"), F.array(other, F.lower("r_name"), F.lit("nowhere")).alias("zones"), F.array(F.lit("debt"), F.lit("debt")).alias("data"))
    out = patch.patch_nodes(n, h, places(spark, sf_dir))
    return out.select("id", "label", "type", F.array_join("data", ",").alias("data"), F.array_join("zones", ",").alias("zones"), "zone")


@query(f"""WITH {LINES}, u AS (SELECT *, edge_pos * 10000000 + l_partkey AS p FROM edges), n AS (SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY p, l_extendedprice) AS r FROM u), f AS (SELECT src, dst, bool_or(o_orderstatus = 'F') AS hit FROM edges GROUP BY 1, 2)
SELECT p AS edge_pos, n.src, n.dst, CASE WHEN hit AND r = 1 THEN 'ssh' ELSE protocol END AS protocol, CASE WHEN hit AND r = 1 THEN array_to_string(list_sort(list_distinct(list_filter([item, 'final'], lambda x: x IS NOT NULL))), ',') ELSE coalesce(item, '') END AS data FROM n JOIN f ON f.src = n.src AND f.dst = n.dst""")
def hint_patch_edges(spark, sf_dir):
    """Ends that a finished order joins get a protocol and a tag on their first edge."""
    e = lines(spark, sf_dir).withColumn("edge_pos", F.col("edge_pos") * 10_000_000 + F.col("l_partkey"))
    h = e.where("o_orderstatus = 'F'").select("graph_id", F.col("edge_pos").alias("hint_pos"), "src", "dst", F.lit("ssh").alias("protocol"), F.array(F.lit("final")).alias("data"))
    return patch.patch_edges(e, h).select("edge_pos", "src", "dst", "protocol", F.array_join("data", ",").alias("data"))


def snapshots(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Orders before and from the median day on, as two snapshots of edges customer -> priority; urgent ones have no label."""
    o = table(spark, sf_dir, "orders")
    key = o.select(F.col("o_custkey").cast("string").alias("src"), F.col("o_orderpriority").alias("dst"), F.when(F.col("o_orderpriority") == "1-URGENT", F.lit(None)).otherwise(F.col("o_orderstatus")).alias("label"), "o_orderstatus", "o_totalprice", (F.col("o_orderdate") < F.lit("1995-06-01").cast("timestamp_ntz")).alias("old"))
    return key.where("old"), key.where("not old")


SNAP = "o AS (SELECT o_custkey::VARCHAR AS src, o_orderpriority AS dst, CASE WHEN o_orderpriority = '1-URGENT' THEN NULL ELSE o_orderstatus END AS label, o_orderstatus, o_totalprice, o_orderdate < TIMESTAMP '1995-06-01' AS old FROM orders)"
NODES = "b AS (SELECT src AS id, max(o_orderstatus) AS status FROM o WHERE old GROUP BY 1), a AS (SELECT src AS id, max(o_orderstatus) AS status FROM o WHERE NOT old GROUP BY 1), n AS (SELECT coalesce(a.id, b.id) AS id, CASE WHEN b.id IS NULL THEN 'added' WHEN a.id IS NULL THEN 'removed' WHEN a.status IS DISTINCT FROM b.status THEN 'changed' ELSE 'same' END AS side FROM b FULL JOIN a ON a.id = b.id)"
EDGES = "k AS (SELECT src || '->' || dst || ':' || coalesce(label, 'None') AS key, bool_or(old) AS b, bool_or(NOT old) AS a FROM o GROUP BY 1), e AS (SELECT key, CASE WHEN NOT b THEN 'added' WHEN NOT a THEN 'removed' ELSE 'same' END AS side FROM k)"


def node_sides(spark, sf_dir):
    b, a = (d.groupBy(F.col("src").alias("id")).agg(F.max("o_orderstatus").alias("status")) for d in snapshots(spark, sf_dir))
    return diff.sides(b, a, ["id"], ["status"])


def edge_sides(spark, sf_dir):
    key = diff.edge_key(F.col("src"), F.col("dst"), F.col("label")).alias("key")
    b, a = (d.select(key).distinct() for d in snapshots(spark, sf_dir))
    return diff.sides(b, a, ["key"])


@query(f"WITH {SNAP}, {NODES} SELECT id, side FROM n")
def snapshot_diff_nodes(spark, sf_dir):
    """U1, with changes (Q14)."""
    return node_sides(spark, sf_dir).select("id", "side")


@query(f"WITH {SNAP}, {EDGES} SELECT key, side FROM e WHERE side <> 'same'")
def snapshot_diff_edges(spark, sf_dir):
    """U2, Q9."""
    return edge_sides(spark, sf_dir).where("side <> 'same'").select("key", "side")


@query(f"WITH {SNAP}, {NODES}, {EDGES} SELECT count(*) FILTER (side = 'added') AS nodes_added, count(*) FILTER (side = 'removed') AS nodes_removed, count(*) FILTER (side = 'changed') AS nodes_changed, (SELECT count(*) FROM e WHERE side = 'added') AS edges_added, (SELECT count(*) FROM e WHERE side = 'removed') AS edges_removed, 0::BIGINT AS edges_changed FROM n")
def snapshot_diff_counts(spark, sf_dir):
    """A9, C7."""
    return diff.counts(node_sides(spark, sf_dir), "nodes").crossJoin(diff.counts(edge_sides(spark, sf_dir), "edges"))  # one row each


@query("""WITH o AS (SELECT o_custkey AS p, o_orderpriority AS pr, o_orderstatus AS st, 'T' || (o_orderkey % 5) AS t, o_orderdate < TIMESTAMP '1995-06-01' AS old FROM orders),
u AS (SELECT p, 0 AS k, pr AS name, max(st) FILTER (old) AS b, max(st) FILTER (NOT old) AS a FROM o GROUP BY 1, 3
UNION ALL SELECT p, 1, p || ' -> ' || pr || ': ' || st, CASE WHEN bool_or(old) THEN 'x' END, CASE WHEN bool_or(NOT old) THEN 'x' END FROM o GROUP BY 1, 3
UNION ALL SELECT p, 2, t || ' | ' || pr, CASE WHEN bool_or(old) THEN 'x' END, CASE WHEN bool_or(NOT old) THEN 'x' END FROM o GROUP BY 1, 3),
s AS (SELECT p, k, name, CASE WHEN b IS NULL THEN 'added' WHEN a IS NULL THEN 'removed' WHEN a <> b THEN 'changed' ELSE 'same' END AS side FROM u),
l AS (SELECT p, k, string_agg('- ' || side || ': ' || replace(name, '|', '/') || chr(10), '' ORDER BY side, name) FILTER (side <> 'same') AS l FROM s GROUP BY 1, 2),
t AS (SELECT p, '# Threat Report Diff' || chr(10) || chr(10) || string_agg('## ' || ['Components', 'Data flows', 'Findings'][k + 1] || chr(10) || chr(10) || coalesce(l, 'No change.' || chr(10)) || chr(10), '' ORDER BY k) AS text FROM l GROUP BY 1)
SELECT p AS pair_id, count(*) FILTER (k = 0 AND side = 'added') AS nodes_added, count(*) FILTER (k = 0 AND side = 'removed') AS nodes_removed, count(*) FILTER (k = 0 AND side = 'changed') AS nodes_changed, count(*) FILTER (k = 1 AND side = 'added') AS edges_added,
count(*) FILTER (k = 1 AND side = 'removed') AS edges_removed, count(*) FILTER (k = 2 AND side = 'added') AS threats_added, count(*) FILTER (k = 2 AND side = 'removed') AS threats_removed, md5(any_value(text)) AS markdown_md5 FROM s JOIN t USING (p) GROUP BY 1""")
def report_pair_diffs(spark, sf_dir):
    """Each customer's orders before and from the median day on as a pair of reports: priorities are components, priorities with a status flows, and numbers with a priority findings."""
    o = table(spark, sf_dir, "orders")
    o = o.select(F.col("o_custkey").alias("pair_id"), F.col("o_orderpriority").alias("id"), F.col("o_orderstatus").alias("label"), F.concat(F.lit("T"), (F.col("o_orderkey") % 5).cast("string")).alias("t"), (F.col("o_orderdate") < F.lit("1995-06-01").cast("timestamp_ntz")).alias("old"))
    sides = [o.where("old"), o.where("not old")]
    n = diff.sides(*[d.groupBy("pair_id", "id").agg(F.max("label").alias("label")) for d in sides], ["pair_id", "id"], ["label"])
    n = n.select("pair_id", "side", F.col("id").alias("name"), F.create_map(F.lit("id"), "id").alias("row"))
    e = diff.sides(*[d.select("pair_id", "id", "label").distinct() for d in sides], ["pair_id", "id", "label"])
    e = e.select("pair_id", "side", F.concat(F.col("pair_id").cast("string"), F.lit(" -> "), "id", F.lit(": "), "label").alias("name"), F.create_map(F.lit("dst"), "id", F.lit("label"), "label").alias("row"))
    f = diff.sides(*[d.select("pair_id", "t", "id").distinct() for d in sides], ["pair_id", "t", "id"])
    f = f.select("pair_id", "side", F.concat("t", F.lit(" | "), "id").alias("name"), F.create_map(F.lit("id"), "t", F.lit("title"), "id").alias("row"))
    out = diff.pair_reports(n, e, f)
    return out.select("pair_id", "nodes_added", "nodes_removed", "nodes_changed", "edges_added", "edges_removed", "threats_added", "threats_removed", F.md5("markdown").alias("markdown_md5"))


def named_findings(spark, sf_dir):
    """Each order a finding on its customer and on one that isn't there."""
    o = table(spark, sf_dir, "orders")
    return o.select(F.lit("all").alias("graph_id"), F.concat(F.lit("f"), F.col("o_orderkey").cast("string")).alias("id"), F.col("o_orderkey").alias("pos"), F.array(F.concat(F.lit("c"), F.col("o_custkey").cast("string")), F.lit("nobody")).alias("evidence_nodes"))


@query("SELECT 'c' || c_custkey AS node_id, coalesce(string_agg('f' || o_orderkey, ',' ORDER BY o_orderkey), '') AS findings FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1 UNION ALL SELECT 's' || s_suppkey, '' FROM supplier")
def evidence_to_nodes(spark, sf_dir):
    """J4, A6."""
    return evidence.to_nodes(named_findings(spark, sf_dir), party(spark, sf_dir)).select("node_id", F.array_join("findings", ",").alias("findings"))


def edge_findings(e: DataFrame):
    """Each order line names its own edge: with label, with a label that no edge has, bare, or by id."""
    e = e.withColumn("edge_pos", F.col("edge_pos") * 10_000_000 + F.col("l_partkey"))
    ends, n = F.concat("src", F.lit("->"), "dst"), F.pmod(F.floor(F.col("edge_pos") / 10_000_000), F.lit(4))
    ref = F.when(n == 0, F.concat(ends, F.lit(": "), "label")).when(n == 1, F.concat(ends, F.lit(":unknown"))).when(n == 2, F.concat("src", F.lit(" -> "), "dst")).otherwise(F.col("id"))
    return e, e.select("graph_id", F.concat(F.lit("f"), F.col("edge_pos").cast("string")).alias("id"), F.col("edge_pos").alias("pos"), F.array(ref).alias("evidence_edges"))


@query(f"""WITH {LINES}, u AS (SELECT *, edge_pos * 10000000 + l_partkey AS p, edge_pos % 4 AS n FROM edges), x AS (SELECT src, dst, label, max(p) AS e FROM u GROUP BY 1, 2, 3), b AS (SELECT src, dst, min(p) AS e FROM u GROUP BY 1, 2), i AS (SELECT id, max(p) AS e FROM u GROUP BY 1)
SELECT 'f' || p AS finding_id, CASE n WHEN 0 THEN x.e WHEN 3 THEN i.e ELSE b.e END AS edge_pos FROM u JOIN x ON x.src = u.src AND x.dst = u.dst AND x.label = u.label JOIN b ON b.src = u.src AND b.dst = u.dst JOIN i ON i.id = u.id""")
def evidence_edge_resolve(spark, sf_dir):
    """By ends and label, else by ends, else by id."""
    e = written(lines(spark, sf_dir).select("graph_id", "edge_pos", "src", "dst", "label", "id", "l_partkey"), "lines")  # read for the references and for each lookup
    e, f = edge_findings(e)
    return evidence.resolve_edges(f, e).select("finding_id", "edge_pos")


@query("""WITH u AS (SELECT n_regionkey AS g, n_nationkey AS pos, ['T0', 'T1', 'T0-tt', '', 'T1'][row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey)] AS id, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS r FROM nation)
SELECT g::VARCHAR AS graph_id, pos, id, ['T0-tt', 'T1', 'T0-tt-tt', 'TT-threat', 'T1-tt-1'][r] AS new_id FROM u""")
def finding_unique_ids(spark, sf_dir):
    """W7."""
    place = F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_nationkey"))
    n = table(spark, sf_dir, "nation").select(F.col("n_regionkey").cast("string").alias("graph_id"), F.col("n_nationkey").alias("pos"), F.element_at(F.array(*[F.lit(x) for x in ("T0", "T1", "T0-tt", "", "T1")]), place).alias("id"))
    used = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("string").alias("graph_id"), F.explode(F.array(F.lit("T0"), F.lit("T1-tt"))).alias("id"))
    return evidence.unique_ids(n, used).select("graph_id", "pos", "id", "new_id")
