"""Evidence of findings mapped back onto the graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.functions.text import let, strip

PREFIX = "[Generated]"  # the default mark of findings written into a model; a parameter of model_block


def to_nodes(findings: DataFrame, nodes: DataFrame) -> DataFrame:
    """(graph_id, node_id, findings): each node with the ids of the findings that name it, in their order; none for the others."""
    named = findings.select("graph_id", F.col("pos").alias("p"), F.col("id").alias("f"), F.posexplode("evidence_nodes").alias("q", "node_id"))
    hit = named.groupBy("graph_id", "node_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("p", "q", "f"))), lambda x: x["f"]).alias("findings"))
    return nodes.select("graph_id", F.col("id").alias("node_id")).join(hit, ["graph_id", "node_id"], "left").withColumn("findings", F.coalesce("findings", F.array().cast("array<string>")))


def edge_refs(findings: DataFrame) -> DataFrame:
    """`a->b` or `a->b:label` taken apart; anything else is an edge's id: (graph_id, finding_id, p, q, ref, src, dst, label, edge_id)."""
    own = findings.select("graph_id", F.col("id").alias("finding_id"), F.col("pos").alias("p"), F.posexplode("evidence_edges").alias("q", "ref"))
    arrow, rest = F.contains("ref", F.lit("->")), F.regexp_extract("ref", r"(?s)^.*?->(.*)$", 1)
    part = lambda c: F.when(arrow, c)
    return own.withColumns({
        "src": part(strip(F.regexp_extract("ref", r"(?s)^(.*?)->", 1))),
        "dst": part(strip(F.regexp_extract(rest, r"(?s)^([^:]*)", 1))),
        "label": part(F.nullif(strip(F.regexp_extract(rest, r"(?s)^[^:]*:(.*)$", 1)), F.lit(""))),
        "edge_id": F.when(~arrow, F.col("ref")),
    })


def last_edges(edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Lookups of one edge each: by (src, dst, label) the last, by (src, dst) the last without label or else the first, by id the last."""
    own = edges.withColumn("_l", F.nullif("label", F.lit("")))
    exact = own.where("_l is not null").groupBy("graph_id", "src", "dst", F.col("_l").alias("label")).agg(F.max("edge_pos").alias("e1"))
    bare = own.groupBy("graph_id", "src", "dst").agg(F.coalesce(F.max(F.when(F.col("_l").isNull(), F.col("edge_pos"))), F.min("edge_pos")).alias("e2"))
    ids = own.where("id is not null and id <> ''").groupBy("graph_id", F.col("id").alias("edge_id")).agg(F.max("edge_pos").alias("e3"))
    return exact, bare, ids


def resolve_edges(findings: DataFrame, edges: DataFrame) -> DataFrame:
    """Each edge reference with the edge_pos that it means, null if none: by ends and label, else by ends, else by id."""
    exact, bare, ids = last_edges(edges)
    refs = edge_refs(findings)
    out = ["graph_id", "finding_id", "p", "q", "ref"]
    # a reference has ends or an id, so that each kind is joined to its own lookups only; rows without a key would all meet in one task
    ends = refs.where("src is not null").select(*out, "src", "dst", "label").join(exact, ["graph_id", "src", "dst", "label"], "left").drop("label").join(bare, ["graph_id", "src", "dst"], "left").select(*out, F.coalesce("e1", "e2").alias("edge_pos"))
    named = refs.where("src is null").select(*out, "edge_id").join(ids, ["graph_id", "edge_id"], "left").select(*out, F.col("e3").alias("edge_pos"))
    return ends.unionByName(named)


def to_edges(findings: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph_id, edge_pos, findings) for the edges that some finding names."""
    hit = resolve_edges(findings, edges).where("edge_pos is not null")
    return hit.groupBy("graph_id", "edge_pos").agg(F.transform(F.sort_array(F.collect_list(F.struct("p", "q", F.col("finding_id").alias("f")))), lambda x: x["f"]).alias("findings"))


def resolve_names(refs: DataFrame, nodes: DataFrame, ref: str = "ref") -> DataFrame:
    """Adds node_id to refs(graph_id, ref): the node of that id, else the first with that label."""
    own = refs.withColumn("_r", strip(F.col(ref)))
    ids = nodes.select("graph_id", F.col("id").alias("_r"), F.col("id").alias("_by_id")).distinct()
    labels = nodes.groupBy("graph_id", F.col("label").alias("_r")).agg(F.min_by("id", "node_pos").alias("_by_label"))
    return own.join(ids, ["graph_id", "_r"], "left").join(labels, ["graph_id", "_r"], "left").withColumn("node_id", F.coalesce("_by_id", "_by_label")).drop("_r", "_by_id", "_by_label")


def to_cells(findings: DataFrame, nodes: DataFrame, edges: DataFrame, cells: DataFrame) -> DataFrame:
    """(graph_id, finding_id, cell_id, p, q): the model's cells that each finding belongs to; cell_id is null for those that belong to the whole diagram.

    Node references go by id, then label; edge references by ends and label, then by ends alone, to the first such flow cell. cells(graph_id, cell_pos, id, kind, src, dst, label).
    """
    named = findings.select("graph_id", F.col("id").alias("finding_id"), F.col("pos").alias("p"), F.posexplode("evidence_nodes").alias("q", "ref"))
    known = cells.select("graph_id", F.col("id").alias("node_id")).distinct()
    by_node = resolve_names(named, nodes).join(known, ["graph_id", "node_id"], "left_semi").select("graph_id", "finding_id", F.col("node_id").alias("cell_id"), "p", "q")
    refs = edge_refs(findings)
    ends = refs.where("src is not null")
    ends = resolve_names(ends.withColumnRenamed("ref", "_ref"), nodes, "src").withColumnRenamed("node_id", "a")
    ends = resolve_names(ends, nodes, "dst").withColumnRenamed("node_id", "b").select("graph_id", "finding_id", "p", "q", "a", "b", "label")
    first = edges.where("id is not null").groupBy("graph_id", F.col("id").alias("edge_id")).agg(F.min_by(F.struct(F.col("src").alias("a"), F.col("dst").alias("b"), "label"), "edge_pos").alias("e"))
    by_id = refs.where("edge_id is not null").join(first, ["graph_id", "edge_id"]).select("graph_id", "finding_id", "p", "q", "e.a", "e.b", "e.label")
    flows = cells.where("kind = 'flow' and src is not null and dst is not null")
    exact = flows.groupBy("graph_id", F.col("src").alias("a"), F.col("dst").alias("b"), "label").agg(F.min_by("id", "cell_pos").alias("c1")).where("label is not null")
    bare = flows.groupBy("graph_id", F.col("src").alias("a"), F.col("dst").alias("b")).agg(F.min_by("id", "cell_pos").alias("c2"))
    hit = ends.unionByName(by_id).where("a is not null and b is not null").join(exact, ["graph_id", "a", "b", "label"], "left").join(bare, ["graph_id", "a", "b"], "left")
    by_edge = hit.withColumn("cell_id", F.coalesce("c1", "c2")).where("cell_id is not null").select("graph_id", "finding_id", "cell_id", "p", (F.col("q") + 1_000_000).alias("q"))
    found = by_node.unionByName(by_edge)
    rest = findings.select("graph_id", F.col("id").alias("finding_id"), F.lit(None).cast("string").alias("cell_id"), F.col("pos").alias("p"), F.lit(0).alias("q")).join(found.select("graph_id", "finding_id"), ["graph_id", "finding_id"], "left_anti")
    return found.unionByName(rest)


def unique_ids(findings: DataFrame, used: DataFrame) -> DataFrame:
    """Adds new_id to findings(graph_id, pos, id): the id if nothing has it yet, else with -tt, then -tt-1 to -tt-1000; earlier findings go first, and their new ids count as used. used(graph_id, id).

    A graph's findings, which an answer bounds, are folded in their order; of the used ids only those that one of them could get are gathered. An id without a free suffix is an error.
    """
    own = findings.withColumn("_b", F.coalesce(F.nullif("id", F.lit("")), F.lit("TT-threat")))
    stems = F.array_distinct(F.array("id", F.regexp_replace("id", "-tt$", ""), F.regexp_replace("id", "-tt-[0-9]+$", "")))
    near = used.select("graph_id", "id", F.explode(stems).alias("_b")).join(own.select("graph_id", "_b").distinct(), ["graph_id", "_b"], "left_semi")
    near = near.groupBy("graph_id").agg(F.collect_set("id").alias("_used"))
    row = F.struct(*[F.col(c) for c in [*findings.columns, "_b"] if c != "graph_id"])
    lists = own.groupBy("graph_id").agg(F.sort_array(F.collect_list(F.struct("pos", "_b", row.alias("row")))).alias("rows")).join(near, "graph_id", "left")

    def add(acc: Column, x: Column) -> Column:
        b, taken = x["_b"], acc["used"]
        numbered = F.filter(F.transform(F.sequence(F.lit(1), F.lit(1000)), lambda k: F.concat(b, F.lit("-tt-"), k.cast("string"))), lambda n: ~F.array_contains(taken, n))
        tt = F.concat(b, F.lit("-tt"))
        new = F.when(~F.array_contains(taken, b), b).when(~F.array_contains(taken, tt), tt).otherwise(F.coalesce(F.get(numbered, F.lit(0)), F.raise_error(F.concat(F.lit("no free id for "), b)).cast("string")))
        return let(new, lambda n: F.struct(F.array_append(taken, n).alias("used"), F.array_append(acc["new"], n).alias("new")))

    none = F.array().cast("array<string>")
    folded = F.aggregate("rows", F.struct(F.coalesce("_used", none).alias("used"), none.alias("new")), add)
    each = lists.select("graph_id", F.explode(F.arrays_zip(F.col("rows.row").alias("row"), folded["new"].alias("new_id"))).alias("z"))
    return each.select("graph_id", "z.row.*", "z.new_id").select(*findings.columns, "new_id")


def model_block(new_id: str = "new_id", prefix: str = PREFIX) -> Column:
    """a finding as a model's threat block; its title is marked unless it is already."""
    title = F.when(F.startswith(F.coalesce("title", F.lit("")), F.lit(prefix)), F.col("title")).otherwise(F.concat(F.lit(f"{prefix} "), F.coalesce("title", F.lit(""))))
    named = F.transform("rag_sources", lambda s: F.concat(F.coalesce(F.nullif(s["source"], F.lit("")), F.lit("?")), F.lit("#"), F.coalesce(F.nullif(s["chunk_id"], F.lit("")), F.lit("?"))))
    cited = F.when(F.size("rag_sources") > 0, F.concat(F.lit("RAG Sources: "), F.array_join(named, "; ")))
    why = F.nullif(F.coalesce("why", F.lit("")), F.lit(""))
    return F.struct(
        F.col(new_id).alias("id"), title.alias("title"), F.coalesce(F.get("stride", F.lit(0)), F.lit("")).alias("type"), F.lit("Open").alias("status"), "severity",
        F.coalesce(F.concat_ws("\n\n", why, cited), F.lit("")).alias("description"), F.col("recommended_action").alias("mitigation"), "references", "score", "affected", "confidence",
    )
