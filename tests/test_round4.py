"""The best rows without pairs, distinct rectangles, bounds of texts over all rows, and narrow joins."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.operators import best, evaluate, index, retrieve, zones
from orrery.plans import retrieval
from tests.test_round3 import corpus

KEY = ["query_id", "kb", "chunk_id", "score", "rank"]


def told(df, key=KEY):
    return sorted((tuple(r) for r in df.select(*key).collect()), key=str)


@pytest.mark.parametrize("cells,held", [(best.CELLS, best.HELD), (60, 50)])
def test_best_vectors_equal_all_pairs(spark, monkeypatch, cells, held):
    monkeypatch.setattr(best, "CELLS", cells)
    monkeypatch.setattr(best, "HELD", held)
    rng = np.random.default_rng(3)
    x = [rng.normal(size=8).tolist() for _ in range(300)] + [[1.0] * 8] * 60 + [[0.0] * 8]
    fine = spark.createDataFrame([(f"kb{i % 3}" if i % 7 else None, f"c{i % 340}", v) for i, v in enumerate(x)], "kb string, chunk_id string, embedding array<double>").repartition(3)
    odd = spark.createDataFrame([("kb0", "a", None), ("kb0", "b", [float("nan")] * 8), ("kb0", "c", [1.0]), ("kb0", "d", [1.0] * 7 + [None])], "kb string, chunk_id string, embedding array<double>")
    q = spark.createDataFrame([(i, x[i]) for i in range(0, 320, 20)], "query_id long, embedding array<double>")
    assert told(best.dense(q, fine.unionByName(odd), 7)) == told(retrieve.topk(retrieve.dense(q, fine), 7))
    assert best.dense(q.limit(0), fine, 7).count() == 0 and best.dense(q, fine.limit(0), 7).count() == 0


@pytest.mark.parametrize("cells", [best.CELLS, 40])
def test_best_texts_equal_full_scoring(spark, monkeypatch, cells):
    monkeypatch.setattr(best, "CELLS", cells)
    docs, queries = corpus(spark, 5)
    many = queries.unionByName(spark.createDataFrame([(200 + i, f"w{i} w{i % 3} odd{i}") for i in range(60)] + [(500, None)], "query_id long, text string"))
    assert told(best.bm25(many, docs, 5)) == told(retrieve.topk(retrieve.bm25(many, index.postings(docs), index.lengths(docs)), 5))
    lens = index.lengths(docs)
    full = retrieve.topk(retrieve.with_zeros(retrieve.bm25(many, index.postings(docs), lens), many, lens, 9), 9)
    assert told(retrieve.topk(retrieve.with_zeros(best.bm25(many, docs, 9, positive=True).drop("rank"), many, lens, 9), 9)) == told(full)
    assert best.bm25(queries.limit(0), docs, 5).count() == 0 and best.bm25(queries, docs.limit(0), 5).count() == 0


def test_no_pairs_are_written(spark, monkeypatch):
    """what hybrid retrieval writes grows with the documents and with k rows a query, not with their product."""
    sizes, plain = {}, best.written

    def counted(df, name):
        out = plain(df, name)
        sizes[name] = out.count()
        return out

    for module in (best, retrieve, retrieval):
        monkeypatch.setattr(module, "written", counted)
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    retrieval.hybrid_rrf(spark, folder).collect()
    assert sizes and max(sizes.values()) <= docs.count()


def rectangles(n, seed, ids):
    rng = random.Random(seed)
    side = lambda: float(rng.choice([0, 0, 1, 2, 3, 8, 20]))
    return [(f"g{rng.randint(0, 1)}", ids(i, rng), rng.choice(["", "n"]), float(rng.randint(0, 8)), float(rng.randint(0, 8)), side(), side()) for i in range(n)]


@pytest.mark.parametrize("repeated", [False, True])
def test_equal_rectangles_are_compared_once(spark, monkeypatch, repeated):
    """against all pairs, with many equal rectangles, empty ones and, once, ids that several rectangles have."""
    monkeypatch.setattr(zones, "TOGETHER", 3)
    rows = rectangles(400, 11, (lambda i, rng: rng.randint(0, 150)) if repeated else (lambda i, rng: i))
    r = spark.createDataFrame(rows, "graph_id string, id long, name string, x double, y double, width double, height double").repartition(3)
    holds = lambda a, b: a[0] == b[0] and a[3] <= b[3] and a[4] <= b[4] and a[3] + a[5] >= b[3] + b[5] and a[4] + a[6] >= b[4] + b[6]
    want = {}
    for b in rows:
        own = want.setdefault((b[0], b[1]), [])
        for a in rows:
            size, less = a[5] * a[6], b[5] * b[6]
            if a[1] != b[1] and holds(a, b) and (size > less or (size == less and a[1] < b[1])):
                own.append((size, a[1]))
    got = zones.rect_parents(r).select("graph_id", "id", "parent_id").distinct().collect()
    assert sorted(((g, i), p) for g, i, p in got) == sorted((k, min(v)[1] if v else None) for k, v in want.items())
    points = r.select("graph_id", F.col("id").alias("node_id"), (F.col("x") + F.col("width") / 2).alias("cx"), (F.col("y") + F.col("height") / 2).alias("cy"))
    inside = sorted((p[0], p[1], z[1]) for p in rows for z in rows if p[0] == z[0] and z[3] <= p[3] + p[5] / 2 <= z[3] + z[5] and z[4] <= p[4] + p[6] / 2 <= z[4] + z[6])
    assert sorted(tuple(x) for x in zones.points_in_rects(points, r).collect()) == inside
    sized = [x for x in rows if x[5] > 0 and x[6] > 0]
    assert sorted(set(tuple(x) for x in zones.holding_others(r).select(*r.columns).collect())) == sorted({a for a in sized if any(a[1] != b[1] and holds(a, b) for b in sized)})


def test_forests_are_not_broadcast(spark, monkeypatch):
    """no table of a row a node goes through the driver, however small it lies on disk."""
    plans, plain = [], zones.written

    def kept(df, name):
        out = plain(df, name)
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return out

    monkeypatch.setattr(zones, "written", kept)
    nodes = spark.createDataFrame([("g", f"n{i}", f"n{i // 3}") for i in range(40)], "graph_id string, id string, parent_id string")
    plans.append(zones.closure(nodes)._jdf.queryExecution().executedPlan().toString())
    assert len(plans) > 5 and not any("Broadcast" in p for p in plans)


def test_bounds_of_texts_are_of_all_rows(spark):
    """beyond the rows that a sample had, the bounds are those of sorting every value."""
    from orrery.llm import hilbert_sharding

    df = spark.range(60_000).select(F.when(F.col("id") % 9 > 0, F.substring(F.md5(F.col("id").cast("string")), 1, 5)).alias("v"))
    values = sorted(r["v"] for r in df.where("v is not null").collect())
    first = {}
    for i, v in enumerate(values):
        first.setdefault(v, i)
    runs = {}
    for v, i in first.items():
        runs.setdefault(int(i / (len(values) - 1) * 32), v)
    assert hilbert_sharding.text_bounds(df, "v") == sorted(runs.values())[:31]
    assert hilbert_sharding.text_bounds(df.limit(0), "v") == []


def test_matches_make_no_pairs(spark, monkeypatch):
    """equal to all pairs, with equal and empty vectors, null scenarios and items of their own thresholds; the plan joins no outputs with items by scenario alone."""
    from orrery.functions.vectors import plain_cosine

    monkeypatch.setattr(best, "CELLS", 50)
    rng = random.Random(4)
    vector = lambda: [float(rng.randint(0, 2)) for _ in range(3)]
    gold = spark.createDataFrame([(rng.choice(["a", "b", None, "c"]), i, rng.choice([None, 0.0, 0.999]), vector()) for i in range(60)], "scenario string, id long, threshold double, embedding array<double>")
    outputs = spark.createDataFrame([(rng.choice(["a", "b", None, "d"]), i, i % 50, vector()) for i in range(200)], "scenario string, id long, pos long, embedding array<double>").repartition(3)
    key = ["scenario", "id", "actual_id", "score"]
    for one in (False, True):
        want = evaluate.best_matches(gold, outputs, plain_cosine(F.col("e.embedding"), F.col("a.embedding")), 0.5, one)
        assert told(evaluate.embedded_matches(gold, outputs, 0.5, one), key) == told(want, key)
    plan = evaluate.embedded_matches(gold, outputs, 0.5)._jdf.queryExecution().optimizedPlan().toString()
    assert not any(("Join" in line) and "scenario" in line and "embedding" not in line for line in plan.splitlines())
