"""Queries of the job service over the table of events: users are keys and jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.operators import service
from orrery.plans.registry import query, table
from orrery.streaming import service as streams
from orrery.tables import fresh_path, settings


def requests(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "ts", F.col("user_id").alias("key"))


@query("SELECT event_id, ts, user_id AS key, floor(epoch_us(ts) / 60000000)::BIGINT AS bucket, (row_number() OVER w)::INTEGER AS n, row_number() OVER w <= 1 AS admitted FROM events WINDOW w AS (PARTITION BY user_id, floor(epoch_us(ts) / 60000000) ORDER BY ts, event_id)")
def rate_limit_fixed(spark, sf_dir):
    """One request a minute and user."""
    return service.fixed_window(requests(spark, sf_dir), 1)


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
r(user_id, i, event_id, log, ok) AS (SELECT user_id, i, event_id, [t], true FROM e WHERE i = 1 UNION ALL
SELECT e.user_id, e.i, e.event_id, CASE WHEN len(list_filter(log, lambda x: x >= e.t - 86400000000)) < 2 THEN list_append(list_filter(log, lambda x: x >= e.t - 86400000000), e.t) ELSE list_filter(log, lambda x: x >= e.t - 86400000000) END, len(list_filter(log, lambda x: x >= e.t - 86400000000)) < 2 FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1)
SELECT event_id, user_id AS key, ok AS admitted FROM r""")
def rate_limit_sliding(spark, sf_dir):
    """M2: two admitted requests within any day."""
    return service.sliding_log(requests(spark, sf_dir), 2, 86400).drop("ts")


def replayed(spark, events: DataFrame, operator, closing: dict, lateness_s: int = 3600, parts: int = 4) -> DataFrame:
    """What a streaming operator makes of events(ts, ...) that arrive up to lateness_s late and out of order, in `parts` deliveries. The stream is stopped after half of them and goes on
    from its checkpoint. A last row (`closing`) comes so late that the watermark reaches the last event."""
    path = fresh_path(spark, "replay")
    late = F.pmod(F.xxhash64("event_id"), F.lit(lateness_s)).cast("long")
    arrival = F.unix_micros(F.col("ts").cast("timestamp")) + late * 1_000_000
    first, last, end = events.agg(F.min(arrival), F.max(arrival), F.max(F.unix_micros(F.col("ts").cast("timestamp")))).first()
    if first is None:
        end = first = last = 0
    part = F.least(F.floor((arrival - first) * parts / max(1, last - first)), F.lit(parts - 1))
    end_row = events.sparkSession.range(1).select(*[F.lit(closing.get(c)).cast(t).alias(c) if c != "ts" else F.timestamp_micros(F.lit(-(-end // 1000) * 1000 + lateness_s * 1_000_000)).cast(t).alias(c) for c, t in events.dtypes])
    for k in range(parts):
        own = events.where(part == k)
        (own.unionByName(end_row) if k == parts - 1 else own).write.mode("append").parquet(f"{path}/in")
        if k in (parts // 2 - 1, parts - 1):
            source = spark.readStream.schema(events.schema).parquet(f"{path}/in")
            with settings(spark, **{c.replace(".", "__"): v for c, v in streams.STATE_STORE.items()}):
                run = operator(source).writeStream.format("parquet").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start(f"{path}/out")
            run.awaitTermination()
    return spark.read.parquet(f"{path}/out")


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
r(user_id, i, event_id, log, ok) AS (SELECT user_id, i, event_id, [t], true FROM e WHERE i = 1 UNION ALL
SELECT e.user_id, e.i, e.event_id, CASE WHEN len(list_filter(log, lambda x: x >= e.t - 86400000000)) < 2 THEN list_append(list_filter(log, lambda x: x >= e.t - 86400000000), e.t) ELSE list_filter(log, lambda x: x >= e.t - 86400000000) END, len(list_filter(log, lambda x: x >= e.t - 86400000000)) < 2 FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1)
SELECT event_id, user_id AS key, ok AS admitted FROM r""")
def rate_limit_stream(spark, sf_dir):
    """M2 as a stream with event-time state: all events, shuffled within an hour, by the SQL of the batch query."""
    r = requests(spark, sf_dir)
    parts = streams.parts_of(r.agg(F.approx_count_distinct("key")).first()[0])
    return replayed(spark, r, lambda s: streams.sliding_log(s, 2, 86400, "3600 seconds", parts), {"event_id": -1})


@query("""WITH n AS (SELECT ceil(max(epoch_us(ts)) / 1000.0)::BIGINT * 1000 AS now FROM events), l AS (SELECT user_id AS job_id, arg_max(event_type, (ts, event_id)) AS status, max(ts) AS updated_at FROM events GROUP BY 1)
SELECT job_id, CASE WHEN epoch_us(updated_at) < now - 86400000000 THEN 'expired' ELSE status END AS status, epoch_us(updated_at) AS updated_at FROM l, n""")
def job_state_stream(spark, sf_dir):
    """M5 as a stream: each job's last row, expired where it had no event for a day of event time."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), "ts", "event_id", F.col("event_type").alias("status"))
    parts = streams.parts_of(e.agg(F.approx_count_distinct("job_id")).first()[0])
    out = replayed(spark, e, lambda s: streams.job_states(s, 86400, "3600 seconds", parts), {"event_id": -1})
    last = F.max_by("status", F.struct("updated_at", "event_id", F.col("status") == "expired"))  # a job expires after the event it expires by
    return out.where("job_id is not null").groupBy("job_id").agg(last.alias("status"), F.max("updated_at").alias("updated_at"))


@query("""WITH x AS (SELECT event_id, user_id, CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 7 = 1 THEN '2001:DB8:9::' || (event_id % 90) WHEN event_id % 3 = 0 THEN '10.0.' || (event_id % 256) || '.1' ELSE '192.168.1.' || (event_id % 256) END AS host FROM events)
SELECT event_id, CASE WHEN event_id % 7 = 0 OR event_id % 7 <> 1 AND event_id % 3 <> 0 THEN host WHEN event_id % 4 = 0 THEN '172.16.0.' || (event_id % 200) WHEN event_id % 4 = 1 THEN '2001:db8::' || CASE WHEN event_id % 200 > 0 THEN lower(to_hex(event_id % 200)) ELSE '' END
WHEN event_id % 4 = 2 THEN '::ffff:9.8.7.' || (event_id % 250) ELSE host END AS ip, CASE WHEN event_id % 5 = 0 THEN 'k' || user_id ELSE coalesce(host, 'unknown') END AS key FROM x""")
def client_identity(spark, sf_dir):
    """M3, M4: addresses behind trusted networks of both kinds, in several spellings, peers that are missing, and keys."""
    e = table(spark, sf_dir, "events")
    k = F.col("event_id")
    s = lambda c: c.cast("string")
    four = F.when(k % 3 == 0, F.concat(F.lit("10.0."), s(k % 256), F.lit(".1"))).otherwise(F.concat(F.lit("192.168.1."), s(k % 256)))
    host = F.when(k % 7 == 0, None).when(k % 7 == 1, F.concat(F.lit("2001:DB8:9::"), s(k % 90))).otherwise(four)
    forwarded = F.when(k % 4 == 0, F.concat(F.lit("unknown, 172.16.0."), s(k % 200), F.lit(", 9.9.9.9"))).when(k % 4 == 2, F.concat(F.lit("1.2.3.04, ::::, 0:0::FFFF:9.8.7."), s(k % 250))).otherwise(F.lit("999.1.1.1"))
    real = F.when(k % 4 == 1, F.concat(F.lit(" 2001:0DB8:0:0::0:0"), F.hex(k % 200))).otherwise(F.lit("nonsense"))
    ip = service.client_ip(host, forwarded, real, proxies=["10.0.0.0/8", "no network", "2001:db8:8::/45"])
    return e.select("event_id", ip.alias("ip"), service.scope_key(F.lit("api_key"), F.when(k % 5 == 0, F.concat(F.lit("k"), F.col("user_id").cast("string"))), host).alias("key"))


@query("""WITH n AS (SELECT max(ts) AS now FROM events), l AS (SELECT user_id AS job_id, arg_max(event_type, (ts, event_id)) AS status, min(ts) AS created_at, max(ts) AS updated_at, count(*) AS n_events FROM events GROUP BY 1)
SELECT job_id, CASE WHEN epoch_us(updated_at) < epoch_us(now) - 86400000000 THEN 'expired' ELSE status END AS status, created_at, updated_at, n_events FROM l, n""")
def job_latest_state(spark, sf_dir):
    """M5: jobs that had no event for a day are expired."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), "ts", "event_id", F.col("event_type").alias("status"))
    return service.job_states(e, ttl=86400)


@query("SELECT event_id AS job_id, user_id AS queue, (row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC))::INTEGER AS place FROM events")
def job_queue_order(spark, sf_dir):
    """M6, Q12: last in, first out."""
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("job_id"), "ts", F.col("user_id").alias("queue"))
    return service.queue_order(e, lifo=True).drop("ts")


@query("SELECT event_id AS job_id, CASE WHEN value > 90 OR event_type = 'error' THEN 'failed' ELSE 'succeeded' END AS status, CASE WHEN value > 90 THEN 'Analysis timed out.' WHEN event_type = 'error' THEN 'error' END AS error FROM events")
def job_outcomes(spark, sf_dir):
    """M7."""
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("job_id"), F.col("value").alias("duration_s"), F.when(F.col("event_type") == "error", "error").alias("error"))
    return service.outcomes(e).select("job_id", "status", "error")


@query("SELECT doc_id, CASE WHEN strlen(text) > 8000 THEN 'body too large' WHEN length(text) > 2000 THEN 'text too long' END AS problem FROM documents")
def request_limits(spark, sf_dir):
    """P14 with small limits."""
    return table(spark, sf_dir, "documents").select("doc_id", service.within_limits(F.lit("text"), F.col("text"), F.col("text"), F.lit(None).cast("string"), max_body=8000, max_text=2000).alias("problem"))
