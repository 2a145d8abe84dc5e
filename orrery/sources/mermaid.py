"""Mermaid flowcharts (S4, P10, F10-F12, G4): lines as rows, patterns as columns, the stack of open subgraphs by windows.

A subgraph opens at its line and closes at the first line after it that leaves it; a line's zones are the subgraphs whose stretch holds it.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions.text import let, strip, unquoted_label
from orrery.operators.zones import ordered_zones
from orrery.sources.graphs import TEXTS, Graph, LazyGraph, lines, rated, register
from orrery.tables import written

# The syntax.
ARROW = r"<-->|==>|-\.->|--->|-->|->"
OP = r"(?:==>|-\.->|--->|-->|->)"
BOTH_WAYS = r"^\s*(.+?)\s*<-->\s*(?:\|\s*([^|]+?)\s*\|\s*)?(.+?)\s*$"
PIPE = rf"^\s*(.+?)\s*{OP}\s*\|\s*([^|]+?)\s*\|\s*(.+?)\s*$"
TRAILING_PIPE = rf"^\s*(.+?)\s*{OP}\s*(.+?)\s*\|\s*([^|]+?)\s*\|\s*$"
INLINE = rf"^\s*(.+?)\s*--+\s*([^|<>]+?)\s*{OP}\s*(.+?)\s*$"
INLINE_PART = rf"--\s*[^|<>]+?\s*{OP}"
PLAIN = rf"^\s*(.+?)\s*{OP}\s*(.+?)\s*$"
NODE_ID = r"^\s*([A-Za-z0-9_.-]+)(.*)$"
SUBGRAPH, END = r"(?i)^\s*subgraph\s+(.+)", r"(?i)^\s*end\s*$"
BRACKETS = [("[(", ")]"), ("((", "))"), ("{{", "}}"), ("[[", "]]"), ("[", "]"), ("(", ")"), ("{", "}")]


def node_token(c: Column) -> Column:
    """a struct of id and label; both null if the text is no node."""
    body = F.regexp_replace(strip(c), r";+$", "")
    return let(strip(F.split_part(body, F.lit(":::"), F.lit(1))), lambda t: let(F.struct(F.regexp_extract(t, NODE_ID, 1).alias("id"), strip(F.regexp_extract(t, NODE_ID, 2)).alias("rest")), labelled))


def labelled(t: Column) -> Column:
    name, rest = t["id"], t["rest"]
    none = F.lit(None).cast("struct<id:string,label:string>")
    out = F.when(name == "", none).when(rest == "", F.struct(name.alias("id"), F.lit(None).cast("string").alias("label")))
    for left, right in BRACKETS:
        inner = F.substring(rest, F.lit(len(left) + 1), F.greatest(F.length(rest) - len(left) - len(right), F.lit(0)))
        out = out.when(F.startswith(rest, F.lit(left)) & F.endswith(rest, F.lit(right)), F.struct(name.alias("id"), unquoted_label(inner).alias("label")))
    return out.otherwise(none)


def edge_parts(line: Column) -> Column:
    """a struct of src, dst, label texts and `both`; null where no pattern fits. The first pattern that fits decides, even if its ends are no nodes."""
    return let(line, _edge_parts)


def _edge_parts(line: Column) -> Column:
    get = lambda p, i: F.regexp_extract(line, p, i)
    part = lambda p, s, d, l, both=False: F.struct(get(p, s).alias("src"), get(p, d).alias("dst"), (F.nullif(get(p, l), F.lit("")) if l else F.lit(None).cast("string")).alias("label"), F.lit(both).alias("both"))  # noqa: E731, E741
    fits = lambda p: F.rlike(line, F.lit(p))
    has = lambda t: F.contains(line, F.lit(t))  # noqa: E731  what a pattern can't do without is looked for first: it is cheap, and a pattern that doesn't fit tries every start
    return (
        F.when(has("<-->") & fits(BOTH_WAYS), part(BOTH_WAYS, 1, 3, 2, True)).when(has("|") & fits(PIPE), part(PIPE, 1, 3, 2)).when(has("|") & fits(TRAILING_PIPE), part(TRAILING_PIPE, 1, 2, 3))
        .when(fits(INLINE_PART) & fits(INLINE), part(INLINE, 1, 3, 2)).when(fits(PLAIN), part(PLAIN, 1, 2, 0))
    )


def numbered(texts: DataFrame) -> DataFrame:
    """(graph_id, line_no, line)."""
    return texts.select("graph_id", F.posexplode(lines(F.coalesce("text", F.lit("")))).alias("line_no", "line"))


def subgraphs(rows: DataFrame) -> DataFrame:
    """(graph_id, zone_pos, id, name, parent_id, depth, opened, closed), a row a subgraph, with closed null for those that never end.

    The depth after a line is the running sum of +1 and -1 that never falls below 0, since an `end` that closes nothing is ignored: the sum less its lowest value so far. What closes a subgraph is the next end of its
    level, and its parent is the last subgraph that was opened a level above: windows along a level, without pairs of lines. The table is written, as lines would be read again wherever it stands in a plan.
    """
    w = Window.partitionBy("graph_id").orderBy("line_no")
    opens, ends = F.rlike("line", F.lit(SUBGRAPH)), F.rlike("line", F.lit(END))
    marks = rows.where(opens | ends).withColumn("open", opens).withColumn("sum", F.sum(F.when(F.col("open"), 1).otherwise(-1)).over(w))
    marks = marks.withColumn("depth", F.col("sum") - F.least(F.lit(0), F.min("sum").over(w)))
    raw = strip(F.regexp_extract("line", SUBGRAPH, 1))
    bracket = F.contains(raw, F.lit("[")) & F.endswith(raw, F.lit("]"))
    name = F.when(bracket, F.regexp_replace(F.regexp_extract(raw, r"(?s)^[^\[]*\[(.*)$", 1), r"\]+$", "")).otherwise(raw)
    later = Window.partitionBy("graph_id", "level").orderBy(F.col("line_no").desc()).rowsBetween(Window.unboundedPreceding, -1)
    closed = F.min(F.when(~F.col("open"), F.col("line_no"))).over(later)
    starts = marks.withColumn("level", F.when(F.col("open"), F.col("depth")).otherwise(F.col("depth") + 1)).withColumn("closed", closed).where("open")
    starts = starts.withColumns({"zone_pos": F.row_number().over(w) - 1, "name": strip(name)}).withColumn("id", F.concat(F.lit("zone_"), F.col("zone_pos").cast("string")))
    above = Window.partitionBy("graph_id", "level").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    sides = F.array(F.struct(F.col("depth").alias("level"), F.lit(None).cast("string").alias("outer")), F.struct((F.col("depth") + 1).alias("level"), F.col("id").alias("outer")))  # as a child on its level, as a parent below
    held = starts.drop("level").withColumn("side", F.explode(sides)).select("*", "side.*").withColumn("parent_id", F.last("outer", ignorenulls=True).over(above)).where("outer is null")
    return written(held.select("graph_id", "zone_pos", "id", "name", "parent_id", "depth", F.col("line_no").alias("opened"), "closed"), "subgraphs")


@register("mermaid")
def parse(texts: DataFrame) -> Graph:
    """texts(graph_id, text) -> a graph's tables. Labels on edges and alone: the last one of a node stays. A node is in every subgraph that is open where an edge or a label names it (Q24)."""
    rows = numbered(texts)
    # each step in an explode of one element: the optimiser would merge the steps' expressions and repeat them without end
    step = lambda df, c, name: df.withColumn(name, F.explode(F.array(c)))

    @cache
    def stack() -> DataFrame:
        return subgraphs(rows)

    @cache
    def cut() -> DataFrame:
        plain = rows.where(~F.rlike("line", F.lit(SUBGRAPH)) & ~F.rlike("line", F.lit(END)))
        cleaned = strip(F.replace(F.replace(F.split_part("line", F.lit("%%"), F.lit(1)), F.lit("—"), F.lit("-")), F.lit("→"), F.lit(">")))
        body = plain.select("graph_id", "line_no", cleaned.alias("t")).where("t <> ''").withColumn("cand", F.rlike("t", F.lit(ARROW)))
        out = step(body, F.when(F.col("cand"), edge_parts(F.col("t"))), "e")
        out = step(out, F.struct(node_token(F.col("e.src")).alias("s"), node_token(F.col("e.dst")).alias("d"), unquoted_label(F.col("e.label")).alias("label")), "x")
        return out.select("graph_id", "line_no", "t", "cand", "e.both", "x.s", "x.d", "x.label").withColumn("ok", F.coalesce(F.col("s.id").isNotNull() & F.col("d.id").isNotNull(), F.lit(False)))

    @cache
    def found() -> DataFrame:
        one = F.struct(F.lit(0).alias("ord"), F.col("s").alias("s"), F.col("d").alias("d"))
        two = F.struct(F.lit(1).alias("ord"), F.col("d").alias("s"), F.col("s").alias("d"))
        pairs = cut().where("ok").select("graph_id", "line_no", "label", F.explode(F.when(F.col("both"), F.array(one, two)).otherwise(F.array(one))).alias("p"))
        w = Window.partitionBy("graph_id").orderBy("line_no", "ord")
        return pairs.select("graph_id", "line_no", F.col("p.ord").alias("ord"), F.col("p.s.id").alias("src"), F.col("p.d.id").alias("dst"), "label", F.col("p.s.label").alias("sl"), F.col("p.d.label").alias("dl")).withColumn("edge_pos", F.row_number().over(w) - 1)

    def named() -> DataFrame:
        """cut() with `n`, the node of a line that is a label alone: id and label, null elsewhere."""
        out = step(cut(), F.when(~F.col("ok"), node_token(F.col("t"))), "n")
        return out.withColumn("n", F.when(F.col("n.id").isNotNull() & F.col("n.label").isNotNull(), F.col("n")))

    def nodes() -> DataFrame:
        at_place = lambda o, n: F.struct(F.lit(o).alias("o"), F.col(n)["id"].alias("id"), F.col(n)["label"].alias("label"))
        once = [at_place(0, "s"), at_place(1, "d")]
        each = F.when(F.col("ok") & F.col("both"), F.array(*once, at_place(2, "d"), at_place(3, "s"))).when(F.col("ok"), F.array(*once)).when(F.col("n").isNotNull(), F.array(at_place(0, "n")))
        seen = named().select("graph_id", "line_no", F.explode(each).alias("x")).select("graph_id", "line_no", "x.*")
        seen = written(seen, "named-nodes")  # files are taken apart once for the nodes' joins
        zones = stack()
        at = F.struct("line_no", "o")
        out = seen.groupBy("graph_id", "id").agg(F.min(at).alias("first"), F.max_by("label", F.when(F.col("label").isNotNull(), at)).alias("label"))
        out = out.withColumn("node_pos", F.row_number().over(Window.partitionBy("graph_id").orderBy("first")) - 1).withColumn("label", F.coalesce("label", "id"))
        inside = (F.col("line_no") > F.col("opened")) & (F.col("closed").isNull() | (F.col("line_no") < F.col("closed")))
        stretches = zones.select("graph_id", F.col("id").alias("zone_id"), "depth", "opened", "closed")
        member = seen.select("graph_id", F.col("id").alias("node_id"), "line_no").distinct().join(stretches, "graph_id").where(inside)
        level = zones.select("graph_id", "id", "name", "depth")  # the stack tells it
        placed = ordered_zones(member.select("graph_id", "node_id", "zone_id", (F.col("line_no") * 1000 + F.col("depth")).alias("pos")), zones, level).withColumnRenamed("node_id", "id")
        return out.join(placed, ["graph_id", "id"], "left").select(
            "graph_id", "node_pos", "id", "label", "zone", F.coalesce("zones", F.expr(TEXTS)).alias("zones"), F.lit(None).cast("string").alias("type"), F.expr(TEXTS).alias("data"),
            F.lit(None).cast("boolean").alias("auth"), F.lit(None).cast("string").alias("notes"),
        )

    def told() -> DataFrame:
        total = lambda c: F.sum(F.when(c, 1).otherwise(0))
        labels = total(F.col("n").isNotNull())
        counts = named().groupBy("graph_id").agg(
            total(F.col("cand")).alias("edge_candidates"), (total(F.col("ok")) + total(F.col("ok") & F.col("both"))).alias("edges_parsed"), labels.alias("node_label_candidates"), labels.alias("node_labels_parsed"),
        )
        out = texts.select("graph_id", F.size(lines(F.coalesce("text", F.lit("")))).alias("total_lines")).join(counts, "graph_id", "left")
        return rated(out.select("graph_id", "total_lines", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts.columns[1:]]))

    def edges() -> DataFrame:
        return found().select("graph_id", "edge_pos", "src", "dst", "label", F.lit(None).cast("string").alias("protocol"), F.expr(TEXTS).alias("data"), F.lit(None).cast("string").alias("id"))

    return LazyGraph(nodes=nodes, edges=edges, zones=lambda: stack().select("graph_id", "zone_pos", "id", "name", "parent_id"), metrics=told, errors=lambda: texts.select("graph_id", F.lit("").alias("error")).limit(0))
