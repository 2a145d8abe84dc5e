"""Streams whose keys share parts, each against a plain fold: the batch operator goes through pandas, where longs beside nulls are doubles."""

import random

import pytest
from pyspark.sql import functions as F

from orrery.plans.service import replayed
from orrery.streaming import service as streams
from orrery.tables import settings


def requests(spark, n, keys):
    rng = random.Random(n)
    big = 2**60  # beyond what a double holds
    rows = [(big + i, k + big if (k := rng.randint(0, keys)) else None, 1_700_000_000 + rng.randint(0, 20_000)) for i in range(n)]
    return spark.createDataFrame(rows, "event_id long, key long, s long").select("event_id", "key", F.timestamp_seconds("s").alias("ts"))


@pytest.mark.parametrize("parts", [1, 3, 1000])
def test_keys_of_a_part_are_judged_apart(spark, parts):
    df = requests(spark, 1500, 40)
    logs, want = {}, {}
    for t, event, key in sorted((r["t"], r["event_id"], r["key"]) for r in df.withColumn("t", F.unix_micros("ts")).collect()):
        log = [x for x in logs.get(key, ()) if x >= t - 600_000_000]
        want[event] = key, len(log) < 3
        logs[key] = log + [t] * (len(log) < 3)
    assert {a for _, a in want.values()} == {True, False}
    got = replayed(spark, df, lambda s: streams.sliding_log(s, 3, 600, "900 seconds", parts), {"event_id": -1}, 900).collect()
    assert len(got) == len(want) and {r["event_id"]: (r["key"], r["admitted"]) for r in got} == want


@pytest.mark.parametrize("parts", [1, 3, 1000])
def test_jobs_of_a_part_end_apart(spark, parts):
    df = requests(spark, 400, 40).where("key is not null").select(F.col("key").alias("job_id"), "ts", "event_id", F.format_string("s%d", F.col("event_id") % 5).alias("status"))
    out = replayed(spark, df, lambda s: streams.job_states(s, 900, "900 seconds", parts), {"event_id": -1}, 900).where("job_id is not null").collect()
    end = max(r["t"] for r in df.select(F.unix_micros("ts").alias("t")).collect())
    want = {}
    for r in df.select("job_id", F.unix_micros("ts").alias("t"), "event_id", "status").collect():
        want[r["job_id"]] = max(want.get(r["job_id"], ()), (r["t"], r["event_id"], r["status"]))
    got = {}
    for r in out:
        got[r["job_id"]] = max(got.get(r["job_id"], ()), (r["updated_at"], r["event_id"], r["status"] == "expired", r["status"]))
    assert {j: g[:2] for j, g in got.items()} == {j: w[:2] for j, w in want.items()}
    assert all(g[3] == ("expired" if g[0] < end - 900_000_000 else want[j][2]) for j, g in got.items()) and any(g[2] for g in got.values()) and not all(g[2] for g in got.values())


@pytest.mark.parametrize("portion", [10_000, 7])
def test_state_is_kept_by_parts(spark, tmp_path, monkeypatch, portion):
    """A state or timer that is kept by key is a dozen round trips to the JVM a key and micro-batch: with a million keys they are the query's time."""
    monkeypatch.setattr(streams, "PORTION", portion)
    df = requests(spark, 500, 300)
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    with settings(spark, **{k.replace(".", "__"): v for k, v in streams.STATE_STORE.items()}):
        q = streams.sliding_log(stream, 2, 600, "1 day", parts=4).writeStream.format("memory").queryName(f"parts{portion}").trigger(availableNow=True).start()
    q.awaitTermination(120)
    rows = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]][-1]
    assert rows <= 4 * 2 + (500 // portion if portion < 500 else 0) + 4  # a timer and its portions of waiting requests a part, not a key


def test_parts_follow_the_keys():
    assert [streams.parts_of(n) for n in (0, 1, streams.KEYS, streams.KEYS + 1, 540_000)] == [1, 1, 1, 2, -(-540_000 // streams.KEYS)]
