"""Tests of the findings of round 3 at size."""

from pyspark.sql import functions as F

from orrery.operators import flows

NODE = "graph_id string, node_pos long, id string, label string, zone string, zones array<string>, type string, data array<string>"
EDGE = "graph_id string, edge_pos long, src string, dst string, label string, protocol string, data array<string>"


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_flows_are_joined_without_sorts_and_ranked_where_they_lie(spark):
    """no side of the joins is sorted, shuffles carry no texts that the result doesn't read, and the flows of a source need no shuffle of their own."""
    nodes = spark.createDataFrame([("all", 0, "a", "A", "x", [], None, ["d"]), ("all", 1, "b", "B", "y", [], None, [])], NODE).withColumn("graph_id", F.lit("all"))
    edges = spark.createDataFrame([("all", 0, "a", "b", "l", None, []), ("all", 1, "a", "a", None, "HTTPS", [""]), ("all", 2, "b", "b", "", "", []), ("all", 3, "b", "b", "tcp", "", ["none"])], EDGE).withColumn("graph_id", F.lit("all"))
    own = flows.enriched(nodes, edges)
    top = flows.top_flows(own.withColumn("graph_id", F.col("src")), 1).select("graph_id", "edge_pos", "risk")
    plan = plan_of(top)
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" not in plan and plan.count("Exchange hashpartitioning") == 4
    assert sorted(map(tuple, top.collect())) == [("a", 0, 4), ("b", 3, 1)]
    found = {r["edge_pos"]: (r["src_label"], r["dst_zone"], r["crossing"], r["items"], r["proto"], r["risk"]) for r in own.collect()}
    assert found == {0: ("A", "y", True, "d", "l", 4), 1: ("A", "x", False, "none", "HTTPS", 1), 2: ("B", "y", False, "none", "unknown", 0), 3: ("B", "y", False, "none", "tcp", 1)}


def test_graph_text_is_limited_before_the_shuffle(spark):
    """tasks hand on the first entries of a graph only; entries without text don't use them up."""
    n = spark.range(3000).select(F.lit("g").alias("graph_id"), F.col("id").alias("node_pos"), F.concat(F.lit("n"), F.col("id").cast("string")).alias("id"), F.when(F.col("id") >= 2500, "L").alias("label"), F.lit("z").alias("zone"), F.lit(None).cast("string").alias("type"), F.array().cast("array<string>").alias("data"))
    e = spark.range(1000).select(F.lit("g").alias("graph_id"), F.col("id").alias("edge_pos"), F.lit("").alias("src"), F.lit("").alias("dst"), F.lit("x").alias("label"), F.array(F.lit("y")).alias("data"))
    out = flows.graph_query(n, e)
    assert plan_of(out).count("TakeOrderedAndProject") == 2
    node = "; ".join(f"n{i}:L zone=z type=n/a data=none" for i in range(2500, 3000))[:2000]
    edge = "; ".join(["-> (x) data=y"] * 1000)[:2000]
    assert [r["query"] for r in out.collect()] == [f"Security knowledge needed for a system with components: {node} | data flows: {edge}"]


def test_mermaid_lines_are_taken_apart_once(spark, monkeypatch):
    """nodes and metrics read the parsed lines once, and subgraphs are found without pairs of lines of a graph."""
    from orrery.sources import mermaid

    text = "graph TD\nend\nsubgraph a[A]\nsubgraph b\nx --> y[Y]\nend\nsubgraph c\nz[Z]\nend\nend\nend\nsubgraph d\nsubgraph e\nx <--> w\n"
    texts = spark.createDataFrame([("g", text), ("none", None)], "graph_id string, text string")
    plans, plain = [], mermaid.written
    monkeypatch.setattr(mermaid, "written", lambda df, name: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or plain(df, name))
    g = mermaid.parse(texts)
    assert sorted((r["id"], r["name"], r["parent_id"]) for r in g.zones.collect()) == [("zone_0", "A", None), ("zone_1", "b", "zone_0"), ("zone_2", "c", "zone_0"), ("zone_3", "d", None), ("zone_4", "e", "zone_3")]
    assert {r["id"]: (r["label"], r["zones"]) for r in g.nodes.collect()} == {"x": ("x", ["zone_0", "zone_3", "zone_1", "zone_4"]), "y": ("Y", ["zone_0", "zone_1"]), "z": ("Z", ["zone_0", "zone_2"]), "w": ("w", ["zone_3", "zone_4"])}
    assert len(plans) == 2 and not any("Join" in p for p in plans) and all(p.count("posexplode") == 1 for p in plans)
    assert {tuple(r) for r in g.metrics.collect()} == {("g", 14, 2, 3, 1, 1, 1.333), ("none", 0, 0, 0, 0, 0, 0.0)}
    assert g.metrics._jdf.queryExecution().optimizedPlan().toString().count("posexplode") == 1


def test_pairs_of_items_and_documents_stay_where_they_arise(spark):
    """no shuffle by item and document, and no token lists in any shuffle."""
    from orrery.plans import registry

    registry.load()
    plan = plan_of(registry.QUERIES["sql_functions"](spark, "/root/testdata/sf0.001"))
    shuffles = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert shuffles and not any("item_id" in s and "doc_id" in s for s in shuffles)
    assert plan.count("Exchange hashpartitioning(doc_id") + plan.count("REPARTITION_BY_COL") >= 1 and "SortMergeJoin [doc_id" not in plan


def test_references_are_joined_by_their_kind(spark):
    """a reference without ends isn't joined by ends, nor one with ends by id."""
    from orrery.operators import evidence

    f = spark.createDataFrame([("g", "f", 0, ["a->b", "a->b: l", "a->b:x", "e2", "a->c", None])], "graph_id string, id string, pos int, evidence_edges array<string>")
    e = spark.createDataFrame([("g", 1, "a", "b", "l", "e1"), ("g", 2, "a", "b", None, "e2"), ("g", 3, "a", "b", "l", "")], "graph_id string, edge_pos long, src string, dst string, label string, id string")
    out = evidence.resolve_edges(f, e)
    assert {r["q"]: r["edge_pos"] for r in out.collect()} == {0: 2, 1: 3, 2: 2, 3: 2, 4: None, 5: None}
    assert "Union" in out._jdf.queryExecution().optimizedPlan().toString()
