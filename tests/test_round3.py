"""Event-time state, block-max postings, vector clusters, interval labels, the hierarchical grid and the diversity fold, each against a plain version."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.operators import blockmax, clusters, index, retrieve, zones
from orrery.operators import service as batch
from orrery.plans.service import replayed
from orrery.streaming import service as streams
from orrery.tables import written


def test_shuffled_stream_admits_what_the_batch_does(spark):
    rng = random.Random(1)
    rows = [(i, f"k{rng.randint(0, 5)}", 1_700_000_000 + rng.randint(0, 20_000)) for i in range(800)]
    df = spark.createDataFrame(rows, "event_id long, key string, s long").select("event_id", "key", F.timestamp_seconds("s").alias("ts"))
    want = {r["event_id"]: r["admitted"] for r in batch.sliding_log(df, 3, 600).collect()}
    got = replayed(spark, df, lambda s: streams.sliding_log(s, 3, 600, "900 seconds"), {"event_id": -1}, 900).collect()
    assert len(got) == len(want) and {r["event_id"]: r["admitted"] for r in got} == want


def state_rows(spark, query):
    return [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]


def test_state_ends_by_event_time_and_late_events_are_dropped(spark, tmp_path):
    from orrery.tables import settings

    store = {k.replace(".", "__"): v for k, v in streams.STATE_STORE.items()}
    def put(*rows):
        df = spark.createDataFrame(rows, "event_id long, key string, s long").select("event_id", "key", F.timestamp_seconds("s").alias("ts"))
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    put((1, "a", 1000), (2, "b", 1001))
    source = lambda: spark.readStream.schema("event_id long, key string, ts timestamp").parquet(str(tmp_path / "in"))

    def go():
        with settings(spark, **store):
            q = streams.sliding_log(source(), 1, 60, "10 seconds").writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(tmp_path / "out"))
        q.awaitTermination(120)
        return q

    go()
    put((3, "a", 5000))
    go()
    put((4, "a", 900), (5, "b", 9000))  # the first is later than the watermark allows
    q = go()
    out = {r["event_id"]: r["admitted"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert out == {1: True, 2: True, 3: True}
    assert state_rows(spark, q)[-1] <= 6  # only event 5 waits: a, b and their logs have ended
    before = spark.read.parquet(str(tmp_path / "out")).count()
    go()  # nothing new: a restart changes nothing
    assert spark.read.parquet(str(tmp_path / "out")).count() == before


def test_jobs_expire_by_event_time_whatever_the_order(spark):
    rows = [(1, 1000, "j", "queued"), (3, 1010, "j", "done"), (2, 1005, "j", "running"), (4, 4000, "i", "queued")]
    df = spark.createDataFrame(rows, "event_id long, s long, job_id string, status string").select("event_id", F.timestamp_seconds("s").alias("ts"), "job_id", "status")
    out = replayed(spark, df, lambda s: streams.job_states(s, 900, "60 seconds"), {"event_id": -1}, 60, parts=2).where("job_id is not null").collect()
    last = {j: max((r["updated_at"], r["event_id"], r["status"] == "expired", r["status"]) for r in out if r["job_id"] == j)[3] for j in "ij"}
    assert last == {"j": "expired", "i": "queued"}


def corpus(spark, seed, n=400):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(60)]
    text = lambda: " ".join(rng.choices(words, weights=[1 / (k + 1) for k in range(60)], k=rng.randint(0, 40)))
    docs = [(f"kb{i % 3}", i, text()) for i in range(n)] + [("kb0", 10_000 + i, "w1 w2 w50") for i in range(40)] + [("kb9", 1, None)]
    return spark.createDataFrame(docs, "kb string, chunk_id long, text string"), spark.createDataFrame([(i, text()) for i in range(12)] + [(99, "unknown"), (98, "")], "query_id long, text string")


@pytest.mark.parametrize("seed", [1, 2])
def test_block_max_equals_full_scoring(spark, seed):
    docs, queries = corpus(spark, seed)
    key = ["query_id", "kb", "chunk_id", "score", "rank"]
    want = sorted(tuple(r) for r in retrieve.topk(retrieve.bm25(queries, index.postings(docs), index.lengths(docs)), 5).select(*key).collect())
    for size, first in ((4, 1), (16, 2), (64, 4)):
        posts = written(blockmax.postings(docs, size), "posts")
        hits, seen = blockmax.search(queries, posts, 5, first)
        assert sorted(tuple(r) for r in hits.select(*key).collect()) == want
        assert posts.select(F.max(F.size("postings"))).first()[0] <= size
    assert blockmax.search(queries.limit(0), posts, 5)[0].count() == 0


def test_blocks_are_passed_over(spark):
    docs = spark.range(2000).select(F.lit("kb").alias("kb"), F.col("id").alias("chunk_id"), F.when(F.col("id") % 100 == 0, F.lit("needle needle needle")).otherwise(F.concat(F.lit("needle "), F.repeat(F.lit("hay "), 50))).alias("text"))
    queries = spark.createDataFrame([(1, "needle")], "query_id long, text string")
    _, seen = blockmax.search(queries, written(blockmax.postings(docs, 20), "posts"), 1, 1)
    n = {r["visited"]: r["count"] for r in seen.groupBy("visited").count().collect()}
    assert n[False] > 3 * n[True]


@pytest.mark.parametrize("seed", [1, 2])
def test_clusters_equal_all_pairs(spark, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, 16))
    x = [(centres[i % 12] + rng.normal(size=16) * 0.05).tolist() for i in range(1500)] + [rng.normal(size=16).tolist() for _ in range(100)] + [[0.0] * 16]
    rows = [(f"kb{i % 2}", i, v) for i, v in enumerate(x)] + [("kb0", 9000, None), ("kb0", 9001, [float("nan")] * 16)]
    v = spark.createDataFrame(rows, "kb string, chunk_id long, embedding array<double>")
    q = spark.createDataFrame([(i, x[i]) for i in range(0, 1500, 100)], "query_id long, embedding array<double>")
    key = ["query_id", "kb", "chunk_id", "score", "rank"]
    hits, visits = clusters.search(q, clusters.build(v), 8)
    fine = v.where("chunk_id < 9000")
    assert sorted(tuple(r) for r in hits.select(*key).collect()) == sorted(tuple(r) for r in retrieve.topk(retrieve.dense(q, fine), 8).select(*key).collect())
    share = visits.agg(F.sum(F.when(F.col("visited"), F.col("n"))) / F.sum("n")).first()[0]
    assert share < 0.5
    assert clusters.search(q, clusters.build(v.limit(0)), 8)[0].count() == 0


def test_a_query_without_direction_is_an_error(spark):
    v = spark.createDataFrame([("k", 1, [1.0, 0.0])], "kb string, chunk_id long, embedding array<double>")
    for bad in ([0.0, 0.0], None, [float("nan"), 1.0]):
        q = spark.createDataFrame([(7, bad)], "query_id long, embedding array<double>")
        for f in (lambda q=q: retrieve.dense(q, v), lambda q=q: clusters.search(q, clusters.build(v), 1)[0]):
            with pytest.raises(Exception, match="query 7 has no direction"):
                f().collect()


def plain_ancestors(parent):
    out = set()
    for v in parent:
        at, d, seen = v, 0, set()
        while at is not None and at not in seen:
            out.add((v, at, d))
            seen.add(at)
            up = parent.get(at)
            at, d = (None if up == at else up), d + 1
    return out


def forest(kind):
    rng = random.Random(5)
    if kind == "chain":
        return {f"n{i}": f"n{i - 1}" if i else None for i in range(300)}
    if kind == "star":
        return {"r": "r"} | {f"n{i}": "r" for i in range(200)}
    if kind == "cycles":
        return {"a": "b", "b": "c", "c": "a", "d": "a", "e": "e", "f": "e", "g": "outside", "h": "g"}
    return {f"n{i}": f"n{rng.randint(0, i - 1)}" if i % 20 else None for i in range(300)}


@pytest.mark.parametrize("kind", ["chain", "star", "cycles", "random"])
def test_interval_labels(spark, kind):
    parent = forest(kind)
    df = spark.createDataFrame([("g", k, p, k.upper()) for k, p in parent.items()] + [("other", "n1", None, "X")], "graph_id string, id string, parent_id string, name string")
    want = plain_ancestors(parent)
    got = {(r["id"], r["ancestor"], r["distance"]) for r in zones.closure(df).where("graph_id = 'g'").collect()}
    assert got == want
    tree = zones.intervals(df).where("graph_id = 'g'")
    pairs = {(r[0], r[1]) for r in tree.alias("a").join(tree.alias("b"), zones.above("a", "b")).select("b.id", "a.id").collect()}
    inside = {r["id"] for r in tree.collect()}
    assert pairs == {(v, a) for v, a, _ in want if v in inside and a in parent}
    assert {r["id"] for r in zones.cyclic(df).collect()} == ({"a", "b", "c", "e"} if kind == "cycles" else {"r"} if kind == "star" else set())
    known = [(v, d) for v, a, d in want if a in parent]
    assert {r["id"]: r["depth"] for r in zones.depths(df).where("graph_id = 'g'").collect()} == {v: max(d for x, d in known if x == v) for v in parent}
    far = defaultdict(list)
    for v, a, d in want:
        if a in parent:
            far[v].append((-d, a.upper()))
    if kind != "cycles":
        assert {r["id"]: r["path"] for r in zones.paths(df).where("graph_id = 'g'").collect()} == {v: " > ".join(n for _, n in sorted(x)) for v, x in far.items()}


def test_a_deep_chain_takes_few_rows(spark):
    n = 20_000
    df = spark.range(n).select(F.lit("g").alias("graph_id"), F.col("id"), F.when(F.col("id") > 0, F.col("id") - 1).alias("parent_id"), F.lit(1.0).alias("x"), F.lit(0.0).alias("y"))
    tree = zones.intervals(df)
    assert tree.count() == n and tree.where("id = 19999").first()["depth"] == n - 1 and tree.where("enter >= leave").isEmpty()
    moved = zones.absolute(df.withColumnsRenamed({"parent_id": "parent"}).withColumns({"width": F.lit(1.0), "height": F.lit(1.0)}))
    assert moved.where("id = 19999").first()["x"] == n


def test_the_grid_keeps_rectangles_few_and_joins_right(spark):
    rng = random.Random(7)
    side = lambda: rng.choice([0.0, 1.0, rng.random() * 30, rng.random() * 900])
    rows = [("big", i, f"r{i}", rng.random() * 1000, rng.random() * 1000, side(), side()) for i in range(1500)] + [("b", 1, "a", 0.0, 0.0, 0.0, 0.0), ("b", 2, "b", 0.0, 0.0, 0.0, 0.0), ("c", 1, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "graph_id string, id long, name string, x double, y double, width double, height double")
    whole = df.where("x is not null")
    assert zones.in_cells(df, zones.grid(df)).count() <= 4 * whole.count()
    a, b = whole.alias("a"), whole.alias("b")
    same = (F.col("a.graph_id") == F.col("b.graph_id")) & (F.col("a.id") != F.col("b.id")) & zones.encloses("a", "b")
    bigger = (zones.area("a") > zones.area("b")) | ((zones.area("a") == zones.area("b")) & (F.col("a.id") < F.col("b.id")))
    best = a.join(b, same & bigger).groupBy("b.graph_id", "b.id").agg(F.min(F.struct(zones.area("a").alias("s"), F.col("a.id").alias("i")))["i"].alias("p"))
    assert {(r["graph_id"], r["id"]): r["parent_id"] for r in zones.rect_parents(df).where("parent_id is not null").collect()} == {(r["graph_id"], r["id"]): r["p"] for r in best.collect()}
    points = whole.select("graph_id", F.col("id").alias("node_id"), (F.col("x") + 3).alias("cx"), (F.col("y") + 3).alias("cy"))
    held = points.alias("p").join(a.select("a.*").alias("r"), (F.col("p.graph_id") == F.col("r.graph_id")) & zones.holds_point("r", F.col("p.cx"), F.col("p.cy")))
    assert sorted(tuple(r) for r in zones.points_in_rects(points, df).collect()) == sorted(tuple(r) for r in held.select("p.graph_id", "p.node_id", "r.id").collect())


def plain_mmr(rows, k, trade, cap):
    rows = sorted(rows, key=lambda r: (-r[2], r[3]))
    unit = [np.array(r[4]) for r in rows]
    chosen = []
    while len(chosen) < k:
        open_ = [i for i in range(len(rows)) if i not in chosen and not (rows[i][1] and cap > 0 and sum(rows[j][1] == rows[i][1] for j in chosen) >= cap)]
        if not open_:
            break
        near = lambda i: max((float(unit[i] @ unit[j] / (np.linalg.norm(unit[i]) * np.linalg.norm(unit[j]) + 1e-10)) for j in chosen), default=0.0)
        chosen.append(max(open_, key=lambda i: (round(trade * rows[i][2] - (1 - trade) * near(i), 9), -i)))
    return [rows[i][0] for i in chosen]


@pytest.mark.parametrize("cap", [0, 1, 2])
def test_diversity_fold_equals_a_loop(spark, cap):
    rng = np.random.default_rng(cap)
    rows = {q: [(i, rng.choice(["a", "b", "c", "", None]), round(float(rng.random()), 2), i, rng.normal(size=4).tolist()) for i in range(int(n))] for q, n in enumerate(rng.integers(1, 15, 12))}
    df = spark.createDataFrame([(q, *r) for q, x in rows.items() for r in x], "request_id int, chunk_id int, source string, final_score double, pos int, vector array<double>")
    got = defaultdict(list)
    for r in retrieve.mmr(df, 5, 0.7, cap).orderBy("request_id", "mmr_rank").collect():
        got[r["request_id"]].append(r["chunk_id"])
    assert got == {q: plain_mmr(x, 5, 0.7, cap) for q, x in rows.items()}
    plan = retrieve.mmr(df, 5)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan
