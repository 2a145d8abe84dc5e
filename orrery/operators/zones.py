"""Trust boundaries: rectangles, containment joins, the zone forest.

Every key includes graph_id, so a corpus of diagrams is one job and nothing joins across diagrams.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.tables import scratch, written


def area(r: str) -> Column:
    return F.col(f"{r}.width") * F.col(f"{r}.height")


def encloses(a: str, b: str) -> Column:
    """Rectangle a holds rectangle b, edges included."""
    c = F.col
    return (c(f"{a}.x") <= c(f"{b}.x")) & (c(f"{a}.y") <= c(f"{b}.y")) & (c(f"{a}.x") + c(f"{a}.width") >= c(f"{b}.x") + c(f"{b}.width")) & (c(f"{a}.y") + c(f"{a}.height") >= c(f"{b}.y") + c(f"{b}.height"))


def holds_point(r: str, x: Column, y: Column) -> Column:
    c = F.col
    return x.between(c(f"{r}.x"), c(f"{r}.x") + c(f"{r}.width")) & y.between(c(f"{r}.y"), c(f"{r}.y") + c(f"{r}.height"))


#: Levels of the grid: on level k a diagram's longer side is 2**k cells.
LEVELS = 16


def grid(rects: DataFrame) -> DataFrame:
    """(graph_id, _x0, _y0, _side): each diagram's corner and its longer side, which the grid's cells halve from level to level."""
    found = rects.groupBy("graph_id").agg(F.min("x").alias("_x0"), F.min("y").alias("_y0"), F.max(F.col("x") + F.col("width")).alias("_x1"), F.max(F.col("y") + F.col("height")).alias("_y1"))
    return found.select("graph_id", "_x0", "_y0", F.greatest(F.col("_x1") - F.col("_x0"), F.col("_y1") - F.col("_y0"), F.lit(1e-300)).alias("_side"))


def _cell(value: Column, axis: str, level: Column) -> Column:
    """The cell of a coordinate on a level; rises with it. What lies outside of the grid is in its first or last cell."""
    cells = F.pow(F.lit(2.0), level)
    return F.greatest(F.lit(0.0), F.least(F.floor((value - F.col(f"_{axis}0")) / F.col("_side") * cells).cast("double"), cells - 1)).cast("int")


def in_cells(rects: DataFrame, cells: DataFrame) -> DataFrame:
    """Each rectangle in the cells that it meets on the level whose cells are as long as its longer side or longer, less than twice: 4 cells at most, whatever the rectangles are."""
    own = rects.where("x is not null and y is not null and width >= 0 and height >= 0").join(cells, "graph_id")
    long = F.greatest("width", "height")
    level = F.when(long > 0, F.greatest(F.lit(0), F.least(F.lit(LEVELS), F.floor(-F.log2(long / F.col("_side"))).cast("int")))).otherwise(F.lit(LEVELS))
    own = own.withColumn("_level", level)
    ends = {f"_{a}{e}": _cell(F.col(a) + (F.col(n) if e else F.lit(0)), a, F.col("_level")) for a, n in (("x", "width"), ("y", "height")) for e in ("", 1)}
    own = own.withColumns({f"_c{k[1:]}": v for k, v in ends.items()})
    both = [F.struct(F.col(x).alias("x"), F.col(y).alias("y")) for x in ("_cx", "_cx1") for y in ("_cy", "_cy1")]
    own = own.withColumn("_c", F.explode(F.array_distinct(F.array(*both))))
    return own.withColumns({"_cx": F.col("_c.x"), "_cy": F.col("_c.y")}).drop("_c", "_cx1", "_cy1", *cells.columns[1:])


def at_cell(df: DataFrame, cells: DataFrame, x: Column, y: Column, levels: DataFrame) -> DataFrame:
    """A point's cell on each level of `levels`(graph_id, _level) that some rectangle is on."""
    own = df.join(cells, "graph_id").join(levels, "graph_id")
    return own.withColumns({"_cx": _cell(x, "x", F.col("_level")), "_cy": _cell(y, "y", F.col("_level"))}).drop(*cells.columns[1:])


def levels_of(placed: DataFrame) -> DataFrame:
    """(graph_id, _level): the levels that rectangles are on, LEVELS + 1 a diagram at most."""
    return placed.select("graph_id", "_level").distinct()


CELL = ["graph_id", "_level", "_cx", "_cy"]


def _same_cell(a: str, b: str, more: tuple[str, ...] = ()) -> Column:
    return reduce(Column.__and__, [F.col(f"{a}.{c}") == F.col(f"{b}.{c}") for c in (*CELL, *more)])


#: What makes rectangles equal; ids of equal ones that a row holds at most.
SHAPE, TOGETHER = ["graph_id", "x", "y", "width", "height"], 256
#: Pieces a partition that the pairs of all cells are cut into; pairs up to which a piece stays whole.
PIECES, WHOLE = 8, 1_000_000


def smallest(rects: DataFrame, n: int = 2) -> DataFrame:
    """Of equal rectangles those with the n smallest ids, cut in each task before the shuffle: (SHAPE, id)."""
    own = rects.select(*SHAPE, "id").distinct()
    return own.withColumn("_r", F.row_number().over(Window.partitionBy(*SHAPE).orderBy("id"))).where(F.col("_r") <= n).drop("_r")


def together(df: DataFrame, key: list[str], one: str) -> DataFrame:
    """(key, _n, ids): the column `one` of equal rows in arrays of at most TOGETHER, numbered, as a written table. Rows are brought together by their key; adaptive execution may split a key of many."""
    n = F.floor(F.monotonically_increasing_id() / TOGETHER)
    own = df.select(*key, F.col(one).alias("_one")).hint("rebalance", *key).sortWithinPartitions(*key).withColumn("_n", n)
    return written(own.groupBy(*key, "_n").agg(F.collect_list(F.struct("_one")).alias("ids")), "together")


def dealt(a: DataFrame, b: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """Rows (CELL, _n, ids, ...) of both sides dealt to n partitions by CELL and piece (_a, _b), to be joined by these. A cell of more pairs of ids than its share is cut into _a times _b pieces, as even as its two sides: a row
    goes to one slice of its own side, with a copy for each slice of the other. Cut cells are PIECES * n at most, so they are sent to all tasks; what is shuffled are lists, never pairs."""
    load = lambda df, to: df.groupBy(*CELL).agg(F.sum(F.size("ids")).cast("double").alias(to))
    with scratch() as keep:
        loads = keep(written(load(a, "_x").join(load(b, "_y"), CELL), "cell-loads"))
    share = max(WHOLE, (loads.agg(F.sum(F.col("_x") * F.col("_y"))).first()[0] or 0) / (PIECES * n))
    pieces = F.ceil(F.col("_x") * F.col("_y") / share)
    own = F.least(pieces, F.greatest(F.lit(1), F.ceil(F.sqrt(pieces * F.col("_x") / F.col("_y")))))
    cut = F.broadcast(loads.where(F.col("_x") * F.col("_y") > share).select(*CELL, own.cast("int").alias("_as"), F.ceil(pieces / own).cast("int").alias("_bs")))

    def side(df: DataFrame, one: str, other: str) -> DataFrame:
        slices = lambda c: F.coalesce(f"{c}s", F.lit(1))
        df = df.join(cut, CELL, "left").withColumn(one, F.pmod(F.xxhash64("_n", *[c for c in df.columns if c not in (*CELL, "_n", "ids")]), slices(one)).cast("int"))
        return df.withColumn(other, F.explode(F.sequence(F.lit(0), slices(other) - 1))).drop("_as", "_bs", "_n").repartition(n, *CELL, "_a", "_b")

    return side(a, "_a", "_b"), side(b, "_b", "_a")


def rect_parents(rects: DataFrame) -> DataFrame:
    """rects(graph_id, id, name, x, y, width, height) -> zones(graph_id, id, name, parent_id).

    The parent is the smallest rectangle that encloses one; ties by id. Rectangles of one size and place enclose each other, so only the larger, or of two equals that
    with the smaller id, can be the parent: parents never form a cycle (Q4). What encloses a rectangle holds its corner, so they meet in that corner's cell. Equal rectangles
    are compared once: of those that enclose only the two smallest ids can count (the second where the first is the rectangle's own), and of those that are enclosed only an id that several
    different rectangles have goes alone.
    """
    with scratch() as keep:
        several = F.count("*").over(Window.partitionBy("graph_id", "id")) > 1
        rows = keep(written(rects.select(*SHAPE, "id").distinct().withColumn("_own", F.when(several, F.col("id"))), "rectangles"))
        cells = grid(rects)
        placed = in_cells(smallest(rows), cells)
        shapes = rows.select(*SHAPE, "_own").distinct()
        a, b = placed.alias("a"), at_cell(shapes, cells, F.col("x"), F.col("y"), levels_of(placed)).alias("b")
        other = F.col("b._own").isNull() | (F.col("a.id") != F.col("b._own"))
        pairs = b.join(a, _same_cell("a", "b") & other & encloses("a", "b") & (area("a") >= area("b")))
        larger = F.when(area("a") > area("b"), F.struct(area("a").alias("area"), F.col("a.id").alias("id")))
        found = pairs.groupBy(*[F.col(f"b.{c}").alias(c) for c in [*SHAPE, "_own"]]).agg(F.min(larger).alias("larger"), F.min(F.when(area("a") == area("b"), F.col("a.id"))).alias("equal"))
        found = keep(written(found, "enclosing"))
    r, f = rows.alias("r"), found.alias("f")
    each = r.join(f, reduce(Column.__and__, [F.col(f"r.{c}") == F.col(f"f.{c}") for c in SHAPE]) & F.col("r._own").eqNullSafe(F.col("f._own")))
    # of equal areas the one nearest in the order of (area, id descending) is the inner one
    p = F.when(F.col("equal") < F.col("r.id"), F.struct(area("r").alias("area"), F.col("equal").alias("id"))).otherwise(F.col("larger"))
    best = each.groupBy(F.col("r.graph_id").alias("graph_id"), F.col("r.id").alias("id")).agg(F.min(p).alias("p"))
    own = rects.select("graph_id", "id", "name").distinct().join(best, ["graph_id", "id"], "left")
    return own.select("graph_id", "id", F.coalesce(F.nullif("name", F.lit("")), F.col("id").cast("string")).alias("name"), F.col("p.id").alias("parent_id"))


def points_in_rects(points: DataFrame, rects: DataFrame) -> DataFrame:
    """points(graph_id, node_id, cx, cy) -> (graph_id, node_id, zone_id) for each rectangle that holds the point, edges included. Equal points and equal rectangles are compared once; the result lists their pairs, which
    are made after the last shuffle."""
    cells = grid(rects)
    n = int(rects.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    with scratch() as keep:
        placed = in_cells(keep(together(rects, SHAPE, "id")), cells)
        p = at_cell(keep(together(points, ["graph_id", "cx", "cy"], "node_id")), cells, F.col("cx"), F.col("cy"), levels_of(placed))
    p, r = (x.alias(c) for x, c in zip(dealt(p, placed, n), "pr", strict=True))
    found = p.join(r, _same_cell("p", "r", ("_a", "_b")) & holds_point("r", F.col("p.cx"), F.col("p.cy")))
    found = found.select(F.col("p.graph_id").alias("graph_id"), F.col("p.ids").alias("_p"), F.col("r.ids").alias("_r"))
    found = found.select("graph_id", F.explode("_p").alias("_p"), "_r")
    return found.select("graph_id", F.col("_p._one").alias("node_id"), F.explode("_r").alias("_z")).select("graph_id", "node_id", F.col("_z._one").alias("zone_id"))


def holding_others(rects: DataFrame) -> DataFrame:
    """The rectangles of positive size that enclose another of positive size."""
    sized = rects.where("width > 0 and height > 0")
    cells = grid(sized)
    placed = in_cells(sized, cells)
    a, b = placed.alias("a"), at_cell(smallest(sized), cells, F.col("x"), F.col("y"), levels_of(placed)).alias("b")
    return a.join(b, _same_cell("a", "b") & (F.col("a.id") != F.col("b.id")) & encloses("a", "b"), "left_semi").drop("_level", "_cx", "_cy").distinct()


def apart(df: DataFrame) -> DataFrame:
    """Joined by sorted partitions, never by a broadcast: tables of a row a node lie compressed in few bytes, so that the planner would send them whole through the driver."""
    return df.hint("merge")


def climbed(nodes: DataFrame, parent: str = "parent_id", sums: list[str] = [], names: str | None = None) -> DataFrame:
    """(graph_id, id, root, depth, outside, <sums>, names): of each node that isn't in or below a cycle its root, its depth (a root's is 0), the root's own parent where that is no node, the sums of the columns
    `sums` over its ancestors and, if asked, the values of the column `names` from the root down to itself. The others have a null depth.

    Each round a node jumps as far again as it has come, so rounds grow with the logarithm of the depth and each writes one row a node. A round in which no node arrives ends it: what is left goes round in circles.
    """
    zero = F.lit(0.0)
    cols = [F.max(F.coalesce(c, zero)).cast("double").alias(c) for c in sums] + ([F.array(F.max(names)).alias("names")] if names else [])
    lists = ["names"] if names else []
    own = nodes.groupBy("graph_id", "id").agg(F.max(parent).alias("_p"), *cols)
    with scratch() as keep:
        own = written(own, "forest")
        known = own.select("graph_id", F.col("id").alias("_p"), F.lit(True).alias("_known"), *[F.col(c).alias(f"_up_{c}") for c in sums])
        up = own.join(apart(known), ["graph_id", "_p"], "left")
        child = F.coalesce("_known", F.lit(False)) & (F.col("_p") != F.col("id"))
        outside = F.when(~child & (F.col("_p") != F.col("id")), F.col("_p"))
        now = up.select("graph_id", "id", F.when(child, F.col("_p")).alias("to"), F.when(child, 1).otherwise(0).alias("depth"), outside.alias("outside"), F.when(~child, F.col("id")).alias("root"), *[F.when(child, F.col(f"_up_{c}")).otherwise(zero).alias(c) for c in sums], *lists)
        now = written(now, "climbed")
        open_ = now.where("to is not null").count()
        while open_:
            t = now.select("graph_id", F.col("id").alias("to"), F.col("to").alias("t_to"), F.col("depth").alias("t_depth"), F.col("outside").alias("t_outside"), F.col("root").alias("t_root"), *[F.col(c).alias(f"t_{c}") for c in [*sums, *lists]])
            moved = now.where("to is not null").join(apart(t), ["graph_id", "to"]).select("graph_id", "id", F.col("t_to").alias("to"), (F.col("depth") + F.col("t_depth")).alias("depth"), F.col("t_outside").alias("outside"), F.col("t_root").alias("root"), *[(F.col(c) + F.col(f"t_{c}")).alias(c) for c in sums], *[F.concat(f"t_{c}", c).alias(c) for c in lists])
            now = written(now.where("to is null").unionByName(moved), "climbed")
            left = now.where("to is not null").count()
            if left == open_:
                break
            open_ = left
        keep(now)
    lost = F.col("to").isNotNull()
    return now.select("graph_id", "id", F.col("root"), F.when(~lost, F.col("depth")).alias("depth"), "outside", *[F.when(~lost, F.col(c)).alias(c) for c in [*sums, *lists]])


def intervals(nodes: DataFrame, parent: str = "parent_id", up: DataFrame | None = None) -> DataFrame:
    """(graph_id, id, root, depth, enter, leave) of the nodes that aren't in or below a cycle: their places in an Euler tour of their tree. A node is above another, or the same, if both have the same root and its
    interval holds the other's.

    The tour is a list of 2 events a node, ranked by jumping pointers: each round writes 2 rows a node at most, and rounds grow with the logarithm of the tree's size, whatever its shape. `up` is climbed()'s table, if it is at hand.
    """
    up = climbed(nodes, parent) if up is None else up
    with scratch() as keep:
        tree = nodes.groupBy("graph_id", "id").agg(F.max(parent).alias("_p")).join(apart(up.where("depth is not null").select("graph_id", "id", "root", "depth", "outside")), ["graph_id", "id"])
        tree = written(tree.withColumn("n", F.monotonically_increasing_id()), "tree")
        kid = tree.where("depth > 0").join(apart(tree.select("graph_id", F.col("id").alias("_p"), F.col("n").alias("above"))), ["graph_id", "_p"])
        after = F.lead("n").over(Window.partitionBy("above").orderBy("id"))  # two rows at a time, however many children
        kid = written(kid.select("n", "above", "id", after.alias("next")), "siblings")
        first = kid.groupBy("above").agg(F.min_by("n", "id").alias("first")).withColumnRenamed("above", "n")
        enters = tree.select("n").join(apart(first), "n", "left").select((F.col("n") * 2).alias("e"), F.coalesce(F.col("first") * 2, F.col("n") * 2 + 1).alias("to"))
        leaves = tree.select("n").join(apart(kid), "n", "left").select((F.col("n") * 2 + 1).alias("e"), F.coalesce(F.col("next") * 2, F.col("above") * 2 + 1).alias("to"))
        now = written(enters.unionByName(leaves).withColumn("far", F.when(F.col("to").isNotNull(), 1).otherwise(0)), "tour")
        while not now.where("to is not null").isEmpty():
            t = now.select(F.col("e").alias("to"), F.col("to").alias("t_to"), F.col("far").alias("t_far"))
            moved = now.where("to is not null").join(apart(t), "to").select("e", F.col("t_to").alias("to"), (F.col("far") + F.col("t_far")).alias("far"))
            now = written(now.where("to is null").unionByName(moved), "tour")
        place = now.groupBy(F.shiftright("e", 1).alias("n")).agg(F.max(F.when(F.col("e") % 2 == 0, -F.col("far"))).alias("enter"), F.max(F.when(F.col("e") % 2 == 1, -F.col("far"))).alias("leave"))
        # events to the tour's end, negative, so that they rise along it
        return keep(written(tree.join(apart(place), "n").select("graph_id", "id", "root", "depth", "outside", "enter", "leave"), "intervals"))


def above(a: str, b: str) -> Column:
    """Whether a's interval holds b's: a is an ancestor of b, or b."""
    c = F.col
    return (c(f"{a}.root") == c(f"{b}.root")) & (c(f"{a}.enter") <= c(f"{b}.enter")) & (c(f"{b}.leave") <= c(f"{a}.leave"))


def closure(nodes: DataFrame, parent: str = "parent_id") -> DataFrame:
    """(graph_id, id, parent) -> (graph_id, id, ancestor, distance), itself at distance 0; in a cycle each ancestor once, at its shortest distance.

    All pairs, for results that list them; tests of a pair need intervals() alone. Intervals are cut into dyadic pieces, and a node looks up the pieces that its place lies in, one a level, so that the join makes the
    pairs themselves and nothing else. Nodes in or below cycles go by circles().
    """
    with scratch() as keep:
        up = written(climbed(nodes, parent), "climbed")
        tree = written(intervals(nodes, parent, up), "intervals")
        lost = written(nodes.select("graph_id", "id", F.col(parent).alias("parent_id")).join(apart(up.where("depth is null").select("graph_id", "id")), ["graph_id", "id"], "left_semi"), "lost")
        deepest = tree.agg(F.max("depth"), F.min("enter")).first()
        parts = [tree.select("graph_id", "id", F.col("id").alias("ancestor"), F.lit(0).alias("distance"))]
        if deepest[0]:
            levels = int(-deepest[1]).bit_length() + 1
            # the aligned piece of each level that begins or ends an interval from inside, as in a segment tree
            span = tree.withColumns({"lo": F.col("enter") - deepest[1], "hi": F.col("leave") - deepest[1] + 1})
            pieces = []
            for k in range(levels):  # a power of two a level
                low, high = F.expr(f"(lo + {(1 << k) - 1}) div {1 << k}"), F.expr(f"hi div {1 << k}")  # aligned pieces inside are low to high - 1
                left = (low % 2 == 1) & (low < high)
                right = (high % 2 == 1) & (low < high)
                pieces.append(F.array_compact(F.array(F.when(left, F.struct(F.lit(k).alias("k"), low.alias("i"))), F.when(right & ~(left & (low == high - 1)), F.struct(F.lit(k).alias("k"), (high - 1).alias("i"))))))
            a = span.select("graph_id", "root", F.col("id").alias("ancestor"), F.col("depth").alias("_d"), F.explode(F.flatten(F.array(*pieces))).alias("p"))
            b = span.select("graph_id", "root", "id", "depth", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.expr(f"lo div {1 << k}").alias("i")) for k in range(levels)])).alias("p"))
            parts.append(b.join(apart(a), ["graph_id", "root", "p"]).where("ancestor <> id").select("graph_id", "id", "ancestor", (F.col("depth") - F.col("_d")).alias("distance")))
        parts.append(tree.where("outside is not null").select("graph_id", "id", F.col("outside").alias("ancestor"), (F.col("depth") + 1).alias("distance")))
        for t in (tree, lost):
            keep(t)
    if not lost.isEmpty():
        parts.append(circles(lost))
    return reduce(DataFrame.unionByName, [p.select("graph_id", "id", "ancestor", F.col("distance").cast("int").alias("distance")) for p in parts])


def circles(nodes: DataFrame, parent: str = "parent_id") -> DataFrame:
    """closure() for nodes in or below cycles, which are mistakes and few: pointers are doubled over pairs."""
    key = ["graph_id", "id", "ancestor"]
    own = nodes.select("graph_id", "id", F.col(parent).alias("ancestor"))
    with scratch() as keep:
        parts = [written(own.where("ancestor is not null and ancestor <> id").withColumn("distance", F.lit(1)), "ancestors")]
        reach, loops = 1, False
        while True:
            up = reduce(DataFrame.unionByName, parts)
            far = parts[-1].where(F.col("distance") == reach).select("graph_id", "id", F.col("ancestor").alias("via"))
            more = far.join(up.select("graph_id", F.col("id").alias("via"), "ancestor", (F.col("distance") + reach).alias("distance")), ["graph_id", "via"]).select(*key, "distance")
            new = written(more, "ancestors")
            loops = loops or not new.where("id = ancestor").isEmpty()
            if loops:  # what is in or behind a cycle comes back to ancestors that it has already
                once = new.where("id <> ancestor").groupBy(*key).agg(F.min("distance").alias("distance"))
                new = written(once.join(up.select(*key), key, "left_anti"), "ancestors")
            if new.isEmpty():
                break
            parts.append(new)
            reach *= 2
        for p in parts:
            keep(p)
    itself = own.select("graph_id", "id", F.col("id").alias("ancestor"), F.lit(0).alias("distance"))
    return reduce(DataFrame.unionByName, [itself, *parts])


def depths(zones: DataFrame, up: DataFrame | None = None) -> DataFrame:
    """G1: (graph_id, id, name, depth), a root at 0. A parent that isn't a zone makes no level; nor does a zone that is its own parent. In or below a cycle it is the distance of the farthest ancestor. `up` is climbed()'s
    table, if it is at hand."""
    with scratch() as keep:
        up = keep(written(climbed(zones), "climbed")) if up is None else up
        lost = keep(written(zones.select("graph_id", "id", "parent_id").join(apart(up.where("depth is null").select("graph_id", "id")), ["graph_id", "id"], "left_semi"), "lost"))
    deep = up.where("depth is not null").select("graph_id", "id", "depth")
    if not lost.isEmpty():
        deep = deep.unionByName(circles(lost).groupBy("graph_id", "id").agg(F.max("distance").alias("depth")))
    return deep.join(apart(zones.select("graph_id", "id", "name")), ["graph_id", "id"])


def paths(zones: DataFrame, sep: str = " > ") -> DataFrame:
    """(graph_id, id, depth, path): the names from the outermost zone to this one. In or below a cycle, by the distances of circles()."""
    with scratch() as keep:
        up = keep(written(climbed(zones, names="name"), "zone-paths"))
        lost = keep(written(zones.join(apart(up.where("depth is null").select("graph_id", "id")), ["graph_id", "id"], "left_semi"), "lost"))
    out = up.where("depth is not null").select("graph_id", "id", "depth", F.array_join("names", sep).alias("path"))
    if lost.isEmpty():
        return out
    far = circles(lost).join(zones.select("graph_id", F.col("id").alias("ancestor"), "name"), ["graph_id", "ancestor"])
    ordered = F.transform(F.sort_array(F.collect_list(F.struct((-F.col("distance")).alias("d"), "name"))), lambda x: x["name"])
    return out.unionByName(far.groupBy("graph_id", "id").agg(F.max("distance").alias("depth"), F.array_join(ordered, sep).alias("path")))


def cyclic(zones: DataFrame) -> DataFrame:
    """The zones that are an ancestor of themselves. A zone that is its own parent counts."""
    own = zones.select("graph_id", "id", "parent_id").where("parent_id is not null")
    with scratch() as keep:
        lost = own.join(climbed(zones).where("depth is null").select("graph_id", "id"), ["graph_id", "id"], "left_semi")
        lost = keep(written(lost, "lost"))
    alone = own.where("parent_id = id").select("graph_id", "id")
    if lost.isEmpty():
        return alone
    up = circles(lost).select("graph_id", F.col("id").alias("parent_id"), F.col("ancestor").alias("id"))
    return lost.join(up, ["graph_id", "parent_id", "id"], "left_semi").select("graph_id", "id").unionByName(alone).distinct()


def ordered_zones(members: DataFrame, zones: DataFrame, level: DataFrame | None = None) -> DataFrame:
    """members(graph_id, node_id, zone_id, pos) -> (graph_id, node_id, zones, zone): distinct ids from outer to inner, stable; zone is the innermost one's name, or its id where it isn't known.
    `level`(graph_id, id, name, depth) are the zones' depths, if they are at hand."""
    known = (depths(zones) if level is None else level).select("graph_id", F.col("id").alias("zone_id"), "depth", "name")
    once = members.groupBy("graph_id", "node_id", "zone_id").agg(F.min("pos").alias("pos"))
    at = once.join(known, ["graph_id", "zone_id"], "left").select("graph_id", "node_id", F.struct(F.coalesce("depth", F.lit(0)).alias("depth"), "pos", "zone_id", F.coalesce("name", "zone_id").alias("name")).alias("z"))
    kept = at.groupBy("graph_id", "node_id").agg(F.sort_array(F.collect_list("z")).alias("z"))
    return kept.select("graph_id", "node_id", F.transform("z", lambda x: x["zone_id"]).alias("zones"), F.element_at("z", -1)["name"].alias("zone"))


def place_nodes(points: DataFrame, rects: DataFrame) -> tuple[DataFrame, DataFrame]:
    """J1 + J2 + T7: (zones, placement of each point that some rectangle holds)."""
    zones = written(rect_parents(rects), "zones")  # read in each round below
    held = points_in_rects(points, rects).withColumn("pos", F.col("zone_id"))
    return zones, ordered_zones(held, zones)


def absolute(cells: DataFrame) -> DataFrame:
    """cells(graph_id, id, parent, x, y, width, height) -> the same with x and y summed over all ancestors; cells whose parents form a cycle count each once."""
    with scratch() as keep:
        up = keep(written(climbed(cells, "parent", ["x", "y"]), "climbed"))
        lost = keep(written(cells.join(apart(up.where("depth is null").select("graph_id", "id")), ["graph_id", "id"], "left_semi"), "lost"))
    off = up.where("depth is not null").select("graph_id", "id", F.col("x").alias("dx"), F.col("y").alias("dy"))
    if not lost.isEmpty():
        pairs = circles(lost, "parent").where("distance > 0").join(cells.select("graph_id", F.col("id").alias("ancestor"), F.col("x").alias("px"), F.col("y").alias("py")), ["graph_id", "ancestor"])
        off = off.unionByName(pairs.groupBy("graph_id", "id").agg(F.sum(F.coalesce("px", F.lit(0.0))).alias("dx"), F.sum(F.coalesce("py", F.lit(0.0))).alias("dy")))
    return cells.join(off, ["graph_id", "id"], "left").withColumns({"x": F.col("x") + F.coalesce("dx", F.lit(0.0)), "y": F.col("y") + F.coalesce("dy", F.lit(0.0))}).drop("dx", "dy")
