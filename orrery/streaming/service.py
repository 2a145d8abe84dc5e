"""The service's operators over streams (M1, M2, M5): watermarked windows and keyed state."""

from __future__ import annotations

import json
from collections import defaultdict, deque
from collections.abc import Iterable, Iterator
from itertools import batched

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, BooleanType, DataType, LongType, StringType, StructField, StructType


def window_counts(requests: DataFrame, limit: int, seconds: int = 60, lateness: str = "5 minutes") -> DataFrame:
    """M1: requests(ts, key) -> (key, start, n, admitted, rejected) a window, once the watermark has passed it."""
    w = F.window("ts", f"{seconds} seconds")
    n = requests.withWatermark("ts", lateness).groupBy("key", w).agg(F.count("*").alias("n"))
    return n.select("key", F.col("window.start").alias("start"), "n", F.least("n", F.lit(limit)).alias("admitted"), F.greatest(F.col("n") - limit, F.lit(0)).alias("rejected"))


#: The state store that transformWithState needs, as a setting of the session while a query starts.
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


#: Parts that keys are dealt to by their hash, where a caller doesn't say; keys of a part, about; rows of one element of a part's list at most.
PARTS, KEYS, PORTION = 1024, 128, 10_000


def parts_of(n_keys: int) -> int:
    """Parts for so many keys. Each call of a part's state or timer is a round trip between Python and the JVM, some twenty a micro-batch, so a part holds more keys than one, and a part's state is rewritten whole, so not many."""
    return max(1, -(-n_keys // KEYS))


class _Part(StatefulProcessor):
    """A processor of a part of the keys that has one event-time timer a part at most: registering another replaces it. Its lists lie in portions, as arrays of a column each."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.timer = handle.getValueState("timer", StructType([StructField("ms", LongType())]))

    def held(self, name: str, **columns: DataType):
        return self.handle.getListState(name, StructType([StructField(c, ArrayType(t)) for c, t in columns.items()]))

    def asleep(self) -> int | None:
        return self.timer.get()[0] if self.timer.exists() else None

    def wake(self, ms: int | None, old: int | None) -> None:
        """Be called once the watermark reaches `ms` (milliseconds since 1970), or not at all, and not at `old` any more, if that timer hasn't fired."""
        if old is not None:
            if old == ms:
                return
            self.handle.deleteTimer(old)
        if ms is None:
            self.timer.clear()
        else:
            self.handle.registerTimer(ms)
            self.timer.update((ms,))

    def close(self) -> None:
        pass


def _portions(rows: Iterable[tuple]) -> Iterator[tuple[list, ...]]:
    for some in batched(rows, PORTION):
        yield tuple(map(list, zip(*some, strict=True)))


def _rows(state) -> Iterator[tuple]:
    return (row for columns in state.get() for row in zip(*columns, strict=True))


def _put(state, rows: Iterable[tuple]) -> None:
    portions = list(_portions(rows))
    state.put(portions) if portions else state.clear()


class _SlidingLog(_Part):
    """State of a part: the requests that wait for the watermark, and by key the times of those admitted within the window behind it."""

    def __init__(self, limit: int, micros: int, key: DataType, event: DataType):
        self.limit, self.micros, self.key, self.event = limit, micros, key, event

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.waiting = self.held("waiting", key=self.key, t=LongType(), event_id=self.event)
        self.log = self.held("log", key=self.key, t=LongType())

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803  names of the interface
        first = None
        for keys, times, events in _portions((r["key"], r["t"], r["event_id"]) for r in rows):
            self.waiting.appendValue((keys, times, events))
            first = min(times) if first is None else min(first, *times)
        first, old = -(-first // 1000), self.asleep()
        self.wake(first if old is None else min(first, old), old)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        now = timerValues.getCurrentWatermarkInMs() * 1000
        due, rest, logs = defaultdict(list), [], defaultdict(deque)
        for k, t, event in _rows(self.waiting):
            if t <= now:  # nothing earlier can come any more
                due[k].append((t, event))
            else:
                rest.append((k, t, event))
        for k, t in _rows(self.log):
            logs[k].append(t)
        row, out = Row("event_id", "key", "admitted"), []
        for k, requests in due.items():
            log = logs[k]
            for t, event in sorted(requests):
                while log and log[0] < t - self.micros:
                    log.popleft()
                admitted = len(log) < self.limit
                if admitted:
                    log.append(t)
                out.append(row(event, k, admitted))
        admitted = [(k, t) for k, log in logs.items() for t in log if t >= now - self.micros]
        if due:
            _put(self.waiting, rest)
        _put(self.log, admitted)
        # with neither, the part has no state left
        self.wake(-(-min(t for _, t, _ in rest) // 1000) if rest else (max(t for _, t in admitted) + self.micros) // 1000 + 1 if admitted else None, None)
        return iter(out)


def sliding_log(requests: DataFrame, limit: int, seconds: int = 60, lateness: str = "5 minutes", parts: int = PARTS) -> DataFrame:
    """M2: requests(event_id, ts, key) -> (event_id, key, admitted), as the batch operator decides it, whatever order requests come in.

    A request waits until the watermark has passed its time, since an earlier one might still come; then those of its key are judged by (ts, event_id). Requests that come later than
    `lateness` are dropped. Keys (numbers, texts and the like; no arrays or structs) are dealt to `parts` by their hash, whose number stays as a checkpoint has it: see parts_of(). A part's state ends once the
    watermark is a window past its last admitted request. The session needs STATE_STORE when the query starts.
    """
    schema = requests.select("event_id", "key").schema
    own = requests.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)
    own = own.select(F.pmod(F.xxhash64("key"), F.lit(parts)).alias("part"), "event_id", "key", "ts", F.unix_micros("ts").alias("t"))
    processor = _SlidingLog(limit, seconds * 1_000_000, schema["key"].dataType, schema["event_id"].dataType)
    return own.groupBy("part").transformWithState(processor, StructType([schema["event_id"], schema["key"], StructField("admitted", BooleanType())]), "append", "eventTime")


class _JobStates(_Part):
    """State of a part: the latest event of each job."""

    def __init__(self, micros: int, job: DataType, event: DataType):
        self.micros, self.job, self.event = micros, job, event

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.last = self.held("last", job_id=self.job, t=LongType(), event_id=self.event, status=StringType())

    def keep(self, last: dict, old: int | None) -> None:
        _put(self.last, ((job, *x) for job, x in last.items()))
        self.wake((min(t for t, _, _ in last.values()) + self.micros) // 1000 + 1 if last else None, old)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        last = {job: (t, event, status) for job, t, event, status in _rows(self.last)}
        changed = {}
        for r in rows:
            job, new = r["job_id"], (r["t"], r["event_id"], r["status"])
            if job not in last or last[job][:2] < new[:2]:
                last[job] = changed[job] = new
        if changed:
            self.keep(last, self.asleep())
        return iter([Row(job_id=job, status=status, updated_at=t, event_id=event) for job, (t, event, status) in changed.items()])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        now = timerValues.getCurrentWatermarkInMs()
        out, last = [], {}
        for job, t, event, status in _rows(self.last):
            if (t + self.micros) // 1000 + 1 <= now:
                out.append(Row(job_id=job, status="expired", updated_at=t, event_id=event))
            else:
                last[job] = (t, event, status)
        self.keep(last, None)
        return iter(out)


def job_states(events: DataFrame, ttl: int = 900, lateness: str = "5 minutes", parts: int = PARTS) -> DataFrame:
    """M5: events(job_id, ts, status, event_id) -> (job_id, status, updated_at, event_id) whenever a job's latest status changes, by (ts, event_id) and not by arrival; `expired`, with the time of its last
    event, once the watermark is more than the time to live past that. A job's state ends with that. Jobs are dealt to `parts` as keys are in sliding_log(). The session needs STATE_STORE when the query starts."""
    if "event_id" not in events.columns:
        events = events.withColumn("event_id", F.lit(0))
    schema = events.select("job_id", "event_id").schema
    own = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)
    own = own.select(F.pmod(F.xxhash64("job_id"), F.lit(parts)).alias("part"), "job_id", "event_id", "status", "ts", F.unix_micros("ts").alias("t"))
    out = StructType([schema["job_id"], StructField("status", StringType()), StructField("updated_at", LongType()), schema["event_id"]])
    return own.groupBy("part").transformWithState(_JobStates(ttl * 1_000_000, schema["job_id"].dataType, schema["event_id"].dataType), out, "append", "eventTime")


def jobs(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """The queue as a stream: files of JSON lines under path, oldest first, as jobs(job_id, ts, status, payload)."""
    return spark.readStream.schema("job_id string, ts timestamp, status string, payload string").option("maxFilesPerTrigger", files_per_batch).json(path)


#: Parts of the table of states: a micro-batch rewrites those that its jobs fall into.
BUCKETS = 64


def upsert(states: DataFrame, path: str, checkpoint: str, buckets: int = BUCKETS, ttl: int | None = None):
    """K9: keeps a table of the latest state of each job under path, partitioned by a hash of the job, read by latest(). A micro-batch rewrites only the partitions that its jobs fall into, by a new version of each and then a
    manifest of the versions that count, so readers see whole batches and a batch that is repeated changes nothing; what the manifest no longer names is deleted. With ttl, jobs without a change for so many seconds go
    when their partition is rewritten."""

    def merge(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        done, fs = _file(spark, f"{path}/manifest-{n}")
        if fs.exists(done):  # a repeated batch that had been merged
            return
        new = batch.groupBy("job_id").agg(F.max_by(F.struct("status", "updated_at"), "updated_at").alias("s")).select("job_id", "s.*").withColumn("bucket", F.pmod(F.xxhash64("job_id"), F.lit(buckets)).cast("int"))
        before = versions(spark, path, n - 1)
        touched = sorted(r["bucket"] for r in new.select("bucket").distinct().collect())  # at most `buckets`
        old = [before[b] for b in touched if b in before]
        if old:
            kept = spark.read.schema(new.drop("bucket").schema).parquet(*old).withColumn("bucket", F.pmod(F.xxhash64("job_id"), F.lit(buckets)).cast("int"))
            new = kept.join(new.select("job_id"), "job_id", "left_anti").unionByName(new)
        if ttl is not None:
            new = new.where(F.col("updated_at") >= F.unix_micros(F.current_timestamp()) - ttl * 1_000_000)
        new.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/v={n}")
        now = {b: p for b, p in before.items() if b not in touched} | {b: f"{path}/v={n}/bucket={b}" for b in touched}
        _save(spark, f"{path}/manifest-{n}", json.dumps(now))
        for gone in set(before.values()) - set(now.values()):
            _delete(spark, gone)
        _delete(spark, f"{path}/manifest-{n - 2}")

    return states.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)


def _file(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def _save(spark: SparkSession, path: str, text: str) -> None:
    p, fs = _file(spark, path)
    out = fs.create(p, True)
    out.write(bytearray(text.encode()))
    out.close()


def _delete(spark: SparkSession, path: str) -> None:
    p, fs = _file(spark, path)
    fs.delete(p, True)


def versions(spark: SparkSession, path: str, n: int | None = None) -> dict[int, str]:
    """The folder of each partition that has one, by the manifest of batch n, or the last."""
    root, fs = _file(spark, path)
    if not fs.exists(root):
        return {}
    found = sorted(int(f.getPath().getName().removeprefix("manifest-")) for f in fs.listStatus(root) if f.getPath().getName().startswith("manifest-"))
    found = [k for k in found if n is None or k <= n]
    if not found:
        return {}
    text = spark.read.text(f"{path}/manifest-{found[-1]}", wholetext=True).first()[0]
    return {int(b): p for b, p in json.loads(text).items()}


def latest(spark: SparkSession, path: str) -> DataFrame:
    """(job_id, status, updated_at): the table that upsert() keeps. Partitions whose jobs have all gone have no files."""
    schema = "job_id string, status string, updated_at long"
    here = [p for p in versions(spark, path).values() if _file(spark, p)[1].exists(_file(spark, p)[0])]
    return spark.read.schema(schema).parquet(*here) if here else spark.createDataFrame([], schema)
