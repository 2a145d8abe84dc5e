"""Differences of two snapshots."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def edge_key(src: Column, dst: Column, label: Column, present: Column | None = None) -> Column:
    """`src->dst:label`; a null label is the text None, as reports write it, a missing one (present is false) is empty (Q9)."""
    text = F.coalesce(label, F.lit("None"))
    return F.concat(src, F.lit("->"), dst, F.lit(":"), text if present is None else F.when(present, text).otherwise(F.lit("")))


def sides(before: DataFrame, after: DataFrame, key: list[str], compare: list[str] = []) -> DataFrame:
    """U1 with changes: one row a key: side `added`, `removed`, `changed` or `same`, and the names of the compared columns that differ. One full join on the key; nulls in it are equal.

    Keys are distinct on either side, as ids and edge keys are; of repeated ones one is taken.
    """
    names = [f"_k{i}" for i in range(len(key))]
    part = lambda df, p: df.groupBy(*[F.col(k).alias(f"{p}{n}") for k, n in zip(key, names, strict=True)]).agg(F.first(F.struct(*[F.col(c) for c in compare] or [F.lit(1).alias("_")])).alias(p))
    on = F.lit(True)
    for n in names:
        on = on & F.col(f"_b{n}").eqNullSafe(F.col(f"_a{n}"))
    both = part(before, "_b").join(part(after, "_a"), on, "full").select(*[F.coalesce(f"_a{n}", f"_b{n}").alias(k) for k, n in zip(key, names, strict=True)], "_a", "_b")
    differ = F.array_compact(F.array(*[F.when(~F.col("_a")[c].eqNullSafe(F.col("_b")[c]), F.lit(c)) for c in compare]).cast("array<string>"))
    side = F.when(F.col("_b").isNull(), "added").when(F.col("_a").isNull(), "removed").when(F.size(differ) > 0, "changed").otherwise("same")
    return both.select(*key, side.alias("side"), F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), differ).otherwise(F.array().cast("array<string>")).alias("changes"))


def only_in(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """The rows of left whose key right hasn't, in their own columns."""
    return left.join(right.select(*key).distinct(), key, "left_anti")


def counts(sided: DataFrame, what: str) -> DataFrame:
    """A9."""
    n = lambda s: F.count_if(F.col("side") == s).alias(f"{what}_{s}")
    return sided.agg(n("added"), n("removed"), n("changed"))


def summary(graph_nodes: DataFrame, graph_edges: DataFrame, findings: DataFrame) -> DataFrame:
    """One row of all counts."""
    return counts(graph_nodes, "nodes").crossJoin(counts(graph_edges, "edges")).crossJoin(counts(findings, "findings"))  # one row each


#: Sections of a report of differences: the part of its JSON, its name there, its title.
SECTIONS = (("graph_changes", "nodes", "Components"), ("graph_changes", "edges", "Data flows"), ("threat_changes", "threats", "Findings"))


def pair_reports(nodes: DataFrame, edges: DataFrame, findings: DataFrame, narratives: DataFrame | None = None) -> DataFrame:
    """Many pairs of reports at once. nodes, edges, findings: sides() of all pairs with pair_id in the key, and the columns side, name (how a row is told) and row (a map of its fields) ->
    one row a pair: pair_id, <section>_added, <section>_removed, <section>_changed, markdown, changes (JSON of what was added and removed, for a prompt). narratives(pair_id, narrative) end the Markdown.

    The three parts are one table with a section, which one aggregation by pair brings together; a report is as long as its pair's differences. Pairs without any difference have a report too.
    """
    parts = [df.select("pair_id", "side", "name", "row", F.lit(k).alias("k")) for k, df in enumerate((nodes, edges, findings))]
    every = reduce(DataFrame.unionByName, parts)
    told = F.collect_list(F.when(F.col("side") != "same", F.struct("k", "side", "name", "row")))
    counted = [F.count_if((F.col("k") == k) & (F.col("side") == side)).alias(f"{what}_{side}") for k, (_, what, _) in enumerate(SECTIONS) for side in ("added", "removed", "changed")]
    # maps have no order, so that rows are ordered by side and name, then by their JSON
    own = every.groupBy("pair_id").agg(told.alias("_r"), *counted)
    own = own.withColumn("_r", F.array_sort(F.transform("_r", lambda x: F.struct(x["k"].alias("k"), x["side"].alias("side"), x["name"].alias("name"), F.to_json(x["row"]).alias("json")))))
    section = lambda k: F.filter("_r", lambda x: x["k"] == k)

    def lines(k: int, title: str) -> Column:
        rows = F.transform(section(k), lambda x: F.concat(F.lit("- "), x["side"], F.lit(": "), F.replace(x["name"], F.lit("|"), F.lit("/")), F.lit("\n")))
        return F.concat(F.lit(f"## {title}\n\n"), F.when(F.size(section(k)) == 0, F.lit("No change.\n")).otherwise(F.array_join(rows, "")), F.lit("\n"))

    def of(k: int, side: str) -> Column:
        return F.array_join(F.transform(F.filter("_r", lambda x: (x["k"] == k) & (x["side"] == side)), lambda x: x["json"]), ",")

    def listed(k: int, what: str) -> Column:
        out = []
        for side in ("added", "removed"):
            out += [F.concat(F.lit(f'"{what}_{side}":'), F.col(f"{what}_{side}").cast("string"), F.lit(f',"{side}_{what}":['), of(k, side), F.lit("]"))]
        return F.concat_ws(",", *out)

    groups = {part: [listed(k, what) for k, (p, what, _) in enumerate(SECTIONS) if p == part] for part, _, _ in SECTIONS}
    changes = F.concat(F.lit("{"), F.concat_ws(",", *[F.concat(F.lit(f'"{part}":{{'), F.concat_ws(",", *x), F.lit("}")) for part, x in groups.items()]), F.lit("}"))
    text = F.concat(F.lit("# Threat Report Diff\n\n"), *[lines(k, title) for k, (_, _, title) in enumerate(SECTIONS)])
    if narratives is not None:
        own = own.join(narratives.select("pair_id", "narrative"), "pair_id", "left")
        text = F.concat(text, F.when(F.coalesce("narrative", F.lit("")) != "", F.concat(F.lit("## Summary\n\n"), "narrative", F.lit("\n"))).otherwise(""))
    return own.select("pair_id", *[f"{what}_{side}" for _, what, _ in SECTIONS for side in ("added", "removed", "changed")], text.alias("markdown"), changes.alias("changes"))
