"""Evaluation against gold lists."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orrery.operators import best
from orrery.tables import scratch, written


def similarity_text(title: Column, why: Column) -> Column:
    """F21."""
    return F.concat_ws(" ", title, why)


def ratio(n: Column, d: Column) -> Column:
    return F.when(d == 0, F.lit(0.0)).otherwise(n.cast("double") / d)


def prf(accepted: Column, outputs: Column, gold: Column) -> dict[str, Column]:
    """A10: precision, recall and their harmonic mean, each 0 where it isn't defined."""
    p, r = ratio(accepted, outputs), ratio(accepted, gold)
    return {"precision": p, "recall": r, "f1": ratio(2 * p * r, p + r)}


def best_matches(expected: DataFrame, actual: DataFrame, score: Column, threshold: float, one_to_one: bool = False) -> DataFrame:
    """Expected e(scenario, id, threshold), actual a(scenario, pos, id), score over the aliases e and a -> (scenario, id, actual_id, score): the highest score of at least
    the item's threshold (the default where it has none or 0: Q11); the last of equal ones. Pairs are of one scenario only. Many items may take one output (Q10); with one_to_one an output goes to its best item."""
    e, a = expected.alias("e"), actual.alias("a")
    least = F.coalesce(F.nullif(F.col("e.threshold"), F.lit(0.0)), F.lit(threshold))
    pairs = e.join(a, F.col("e.scenario") == F.col("a.scenario")).select(F.col("e.scenario").alias("scenario"), F.col("e.id").alias("id"), F.col("a.id").alias("actual_id"), F.col("a.pos").alias("pos"), F.round(score, 9).alias("score"), least.alias("least"))
    out = pairs.where(F.col("score") >= F.col("least")).groupBy("scenario", "id").agg(F.max(F.struct("score", "pos", "actual_id")).alias("m")).select("scenario", "id", "m.actual_id", "m.score")
    return once_each(out) if one_to_one else out


def embedded_matches(expected: DataFrame, actual: DataFrame, threshold: float, one_to_one: bool = False) -> DataFrame:
    """J14, X7 over embeddings: each distinct text is embedded once before; here the columns embedding are compared, equal ones once, as products of matrices: best_matches() by cosine without a row a pair. Vectors that aren't
    finite match nothing."""
    least = F.coalesce(F.nullif(F.col("threshold"), F.lit(0.0)), F.lit(threshold))
    found = expected.select("scenario", "id", "embedding", least.alias("_least")).join(best.matches(expected, actual), ["scenario", "embedding"]).where(F.col("score") >= F.col("_least"))
    out = found.groupBy("scenario", "id").agg(F.max(F.struct("score", "pos", "actual_id")).alias("m")).select("scenario", "id", "m.actual_id", "m.score")
    return once_each(out) if one_to_one else out


def once_each(matches: DataFrame) -> DataFrame:
    """Q10: each output goes to its best item."""
    return matches.withColumn("_r", F.row_number().over(Window.partitionBy("scenario", "actual_id").orderBy(F.col("score").desc(), "id"))).where("_r = 1").drop("_r")


def embedded(sides: list[DataFrame], embed: Callable[[pd.Series], pd.Series]) -> list[DataFrame]:
    """The tables with `embedding`, that of their column `text`. Each distinct text of all of them is embedded once, by embed, which takes a column of texts and gives one of vectors."""

    @F.pandas_udf("array<double>")
    def vector(text: pd.Series) -> pd.Series:
        return embed(text)

    with scratch() as keep:
        texts = reduce(DataFrame.unionByName, [d.select("text") for d in sides]).distinct()
        known = keep(written(texts.withColumn("embedding", vector("text")), "text-embeddings"))
    return [d.join(known, "text", "left") for d in sides]


def benchmark(gold: DataFrame, threats: DataFrame, embed: Callable[[pd.Series], pd.Series], threshold: float = 0.6, one_to_one: bool = False, digits: int = 4) -> tuple[DataFrame, DataFrame]:
    """gold(scenario, id, title, why, threshold), threats(scenario, pos, id, title, why) -> (matches: scenario, id, actual_id, score, with nulls for items that nothing matches; report() of scenarios and all together).
    Texts are compared by similarity_text()."""
    expected, actual = embedded([d.withColumn("text", similarity_text(F.col("title"), F.col("why"))) for d in (gold, threats)], embed)
    with scratch() as keep:
        expected, actual = keep(written(expected, "gold")), keep(written(actual, "threats"))
        found = keep(written(embedded_matches(expected, actual, threshold, one_to_one), "matches"))
    every = expected.select("scenario", "id").join(found, ["scenario", "id"], "left")
    return every, report(expected, actual, found, digits)


def benchmark_files(spark: SparkSession, root: str, reports: str, embed: Callable[[pd.Series], pd.Series], only: list[str] | None = None, threshold: float = 0.6, **options) -> tuple[DataFrame, DataFrame]:
    """The gold lists <root>/<scenario>/expected_threats.json against the reports <reports>/<scenario>.json, in one call. Unknown scenarios, or none, are an error."""
    from orrery.sources import documents

    gold = documents.gold(spark, root, only)
    if gold.isEmpty():
        raise documents.DocumentError("no scenario with expected_threats.json")
    own = documents.reports(spark, f"{reports}/*.json").withColumn("scenario", F.regexp_extract("path", r"([^/]+)\.json$", 1))
    threats = own.join(gold.select("scenario").distinct(), "scenario", "left_semi").select("scenario", F.posexplode("threats").alias("pos", "t")).select("scenario", "pos", "t.id", "t.title", "t.why")
    return benchmark(gold.select("scenario", "id", "title", "why", "threshold"), threats, embed, threshold, **options)


def benchmark_text(matches: DataFrame, told: DataFrame, digits: int = 4) -> DataFrame:
    """(scenario, line): each scenario's metrics with the ids that were matched and missed, and the total, as text. A line is as long as its scenario's gold list."""
    number = lambda c: F.format_string(f"%.{digits}f", F.col(c))
    ids = lambda hit: F.array_join(F.array_sort(F.collect_list(F.when(F.col("actual_id").isNotNull() == hit, F.col("id").cast("string")))), ", ")
    listed = matches.groupBy("scenario").agg(ids(True).alias("_m"), ids(False).alias("_n"))
    head = F.when(F.col("scenario").isNull(), F.lit("TOTAL")).otherwise(F.concat(F.lit("["), F.col("scenario").cast("string"), F.lit("]")))
    line = F.concat(head, F.lit(" accepted="), "accepted", F.lit("/"), "gold", F.lit(" outputs="), "outputs", F.lit(" precision="), number("precision"), F.lit(" recall="), number("recall"), F.lit(" f1="), number("f1"))
    more = lambda c, name: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"\n  {name}: "), c)).otherwise("")
    return told.join(listed, "scenario", "left").select("scenario", F.concat(line, more(F.col("_m"), "matched "), more(F.col("_n"), "missing ")).alias("line"))


def report(expected: DataFrame, actual: DataFrame, matches: DataFrame, digits: int = 4) -> DataFrame:
    """Scenario (null for all together), accepted, outputs, gold, precision, recall, f1: scenarios and the micro average in one pass by grouping sets."""
    n = lambda df, name: df.groupBy("scenario").agg(F.count("*").alias(name))
    own = n(expected, "gold").join(n(actual, "outputs"), "scenario", "full").join(n(matches, "accepted"), "scenario", "full").fillna(0)
    total = own.groupingSets([[F.col("scenario")], []], "scenario").agg(F.sum("accepted").alias("accepted"), F.sum("outputs").alias("outputs"), F.sum("gold").alias("gold"))
    return total.withColumns({k: F.round(c, digits) for k, c in prf(F.col("accepted"), F.col("outputs"), F.col("gold")).items()})


def manual(accepted: int, outputs: int, gold: int) -> dict[str, float]:
    """C9 by hand: counts are checked; values rounded to 4 digits."""
    if min(accepted, outputs, gold) < 0 or accepted > outputs or accepted > gold:
        raise ValueError("counts must not be negative, and accepted not above outputs or gold")
    p, r = (accepted / outputs if outputs else 0.0), (accepted / gold if gold else 0.0)
    return {"precision": round(p, 4), "recall": round(r, 4), "f1": round(2 * p * r / (p + r) if p + r else 0.0, 4)}
