"""Tests of the findings of round 4 at size."""

import random

import pytest
from pyspark.sql import functions as F

from orrery.operators import zones


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("whole", [1, 5, 1_000_000])
def test_pairs_of_points_and_rectangles_are_not_shuffled(spark, monkeypatch, whole):
    """what is shuffled are lists of equal points and rectangles, never a row a pair; a cell of many pairs is cut, whichever of its sides is long."""
    if hasattr(zones, "WHOLE"):
        monkeypatch.setattr(zones, "WHOLE", whole)
    monkeypatch.setattr(zones, "TOGETHER", 4)
    rng = random.Random(whole)
    rows = [("gh"[i % 7 == 0], i, "", float(rng.choice([0, 1, 2, 90])), float(rng.choice([0, 3, 50])), float(rng.choice([0, 5, 60])), float(rng.choice([1, 5, 40]))) for i in range(120)] + [("k", i, "", 0.0, 0.0, 9.0, 9.0) for i in range(60)] + [("l", 1, "", 0.0, 0.0, 1.0, 1.0), ("h", 900, "", None, 0.0, 1.0, 1.0)]
    spots = [(g, i, float(rng.choice([0, 1, 5, 60, 200])), float(rng.choice([0, 4, 50]))) for g in "ghk" for i in range(30)] + [("l", i, 1.0, 1.0) for i in range(80)] + [("g", 900, None, 1.0), ("m", 1, 0.0, 0.0)]
    rects = spark.createDataFrame(rows, "graph_id string, id long, name string, x double, y double, width double, height double")
    points = spark.createDataFrame(spots, "graph_id string, node_id long, cx double, cy double")
    got = zones.points_in_rects(points, rects)
    plan = plan_of(got)
    assert plan.index("Join") < plan.index("Exchange"), plan  # the plan's top comes first
    want = [(g, i, z) for g, i, cx, cy in spots if cx is not None for h, z, _, x, y, w, t in rows if g == h and x is not None and x <= cx <= x + w and y <= cy <= y + t]
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 500


def test_a_diagram_of_one_cell_is_dealt_to_all_tasks(spark, monkeypatch):
    """without a shuffle of the pairs one cell would be one task's."""
    monkeypatch.setattr(zones, "TOGETHER", 4)
    if hasattr(zones, "WHOLE"):
        monkeypatch.setattr(zones, "WHOLE", 100)
    rects = spark.range(200).select(F.lit("g").alias("graph_id"), "id", F.lit("").alias("name"), *[F.lit(float(v)).alias(c) for c, v in (("x", 0), ("y", 0), ("width", 8), ("height", 8))])
    points = spark.range(300).select(F.lit("g").alias("graph_id"), F.col("id").alias("node_id"), F.lit(1.0).alias("cx"), F.lit(1.0).alias("cy"))
    got = zones.points_in_rects(points, rects).groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in got) == 60_000 and len(got) == 4 and max(r["count"] for r in got) < 30_000


def test_tokens_of_bytes_are_those_of_the_expression(spark):
    """runs are found in bytes, not by an expression a row; no run goes over the end of a text."""
    import pyarrow as pa

    from orrery.functions.text import tokens
    from orrery.operators import best

    rng = random.Random(3)
    texts = ["", None, "a", "ab", "ab", "É", "aÉbc", "x" * 70_000, " -- ", "KKK İi ß"] + ["".join(rng.choice("aBzZ09_:/.-@[`{ \n\té 😀\x00") for _ in range(rng.randint(0, 30))) for _ in range(2000)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    want = [r["t"] or [] for r in df.select("i", tokens(F.col("text")).alias("t")).orderBy("i").collect()]
    for part, lists in ((pa.array(texts), want), (pa.array(texts).slice(3, 900), want[3:903]), (pa.array([], pa.string()), []), (pa.array(["", None]), [[], []])):
        size, found = best.token_runs(part)
        assert size.tolist() == [len(x) for x in lists] and found.to_pylist() == [w for x in lists for w in x]
    assert len(want) == len(texts)


@pytest.mark.parametrize("first, held, positive", [(10, 2_000_000, False), (10, 50, True), (10**9, 50, False)])
def test_terms_of_all_blocks_are_counted_once_and_bounds_lose_no_row(spark, monkeypatch, first, held, positive):
    """with several blocks of queries the chunks were tokenized again for each, and each task ranked every pair above nothing. What a share of the chunks reaches may only pass over rows that aren't among the k best, ties and
    lists of fewer than k included, in each kb."""
    from orrery.operators import best, index, retrieve

    rng = random.Random(first)
    word = lambda: f"w{min(int(rng.paretovariate(0.6)), 400)}"
    chunks = [("ab"[i % 5 == 0], i, " ".join(word() for _ in range(rng.randint(0, 40))) if i % 9 else "w1 w2 w3") for i in range(900)] + [(None, 5000, "w1 w1 w7"), ("c", 5001, "w1"), ("a", 5002, None)]
    asked = [(i, " ".join(word() for _ in range(rng.randint(0, 60)))) for i in range(40)] + [(100, ""), (101, "none of them"), (102, None)]
    chunked = spark.createDataFrame(chunks, "kb string, chunk_id long, text string")
    queries = spark.createDataFrame(asked, "query_id long, text string")
    # three blocks or more, each cut as in a large table
    counts, plain, blocks = [], best.counted, retrieve.blocks
    monkeypatch.setattr(best, "counted", lambda *a: counts.append(1) or plain(*a))
    monkeypatch.setattr(retrieve, "blocks", lambda q, most=12: blocks(q, most))
    for name, value in (("FIRST", first), ("HELD", held), ("WAITING", 100), ("CELLS", 700), ("ADDS", 300), ("SHARE", 3)):
        if hasattr(best, name):
            monkeypatch.setattr(best, name, value)
    got = best.bm25(queries, chunked, 7, positive=positive)
    assert len(counts) == 1
    monkeypatch.setattr(retrieve, "blocks", blocks)
    known = chunked.where("kb is not null")
    want = retrieve.topk(retrieve.bm25(queries.where("text is not null"), index.postings(known), index.lengths(known)), 7)
    if positive:
        want = want.where("score > 0")
    rows = lambda df: sorted((r["query_id"], r["kb"], r["chunk_id"], r["score"], r["rank"]) for r in df.where("kb is not null").collect())
    assert rows(got) == rows(want) and len(rows(want)) > 500
