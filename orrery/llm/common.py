"""Helpers shared by the corpus operators: the shared folder, written tables, global ranks and connected components."""

from __future__ import annotations

import ctypes
import json
from contextlib import suppress

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orrery.tables import drop_written, fresh_path, scratch, shared_dir, written

__all__ = ["drop_written", "fresh_path", "scratch", "shared_dir", "written"]

#: White space of the word rule: space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: UTF-8 bytes of a batch of rows that goes to Python at once: a batch is held several times over there.
BATCH_BYTES = 2 << 20


def small_batches(spark: SparkSession, size: int = BATCH_BYTES) -> None:
    """Bound the batches that go to Python by their bytes, unless the session has a bound of its own. For queries, which own their session: operators leave it alone."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(size))


def trim() -> None:
    """In a Python worker, at a task's end: hand freed memory back to the system, since the worker stays for other tasks. Where the C library can't, nothing happens."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def word_count(c: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(c, F.lit(WORD)), F.lit(0)).cast("long")


def known_numbers(spark: SparkSession, rows: list[tuple], columns: list[str]) -> DataFrame:
    """A small table of longs that the driver knows, as one literal that the JVM reads: createDataFrame would send a list through Python workers on the executors, which stay after it."""
    kind = "array<struct<" + ",".join(f"{c}:bigint" for c in columns) + ">>"
    return spark.range(0, 1, 1, 1).select(F.inline(F.from_json(F.lit(json.dumps([dict(zip(columns, r, strict=True)) for r in rows])), kind)))


def global_rank(df: DataFrame, order: list[Column], name: str, rank: str = "rank", sums: tuple[str, ...] = ()) -> DataFrame:
    """Add the 0-based rank of each row in the total order `order`, without a window over all rows; for each column of `sums` also before_<column>, its sum over the rows of a lower rank.

    Rows are range partitioned by sampled bounds, sorted within partitions and written once, each with its
    partition and its place there; partition offsets are the running sum of the partitions' row counts (a table of
    one row a partition). Rows that tie in all of `order` get neighbouring ranks in any order, so the order should
    end in a key of many values; a hot leading key then spreads over many partitions.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("__orrery_at", F.monotonically_increasing_id())
    kept = written(placed, name)
    part = F.shiftright("__orrery_at", 33)
    found = kept.groupBy(part.alias("p")).agg(F.count("*").alias("n"), *[F.sum(c).alias(f"s{k}") for k, c in enumerate(sums)]).orderBy("p").collect()
    offsets, total = [], [0] * (1 + len(sums))
    for r in found:
        offsets.append((r["p"], *total))
        total = [a + (b or 0) for a, b in zip(total, r[1:], strict=True)]
    start = F.broadcast(known_numbers(spark, offsets, ["__orrery_p", "__orrery_start", *[f"__orrery_s{k}" for k in range(len(sums))]]))  # one row a partition
    out = kept.withColumn("__orrery_p", part)
    if sums:
        earlier = Window.partitionBy("__orrery_p").orderBy("__orrery_at").rowsBetween(Window.unboundedPreceding, -1)
        out = out.withColumns({f"before_{c}": F.coalesce(F.sum(c).over(earlier), F.lit(0)) for c in sums})
    out = out.join(start, "__orrery_p").withColumns({f"before_{c}": F.col(f"before_{c}") + F.col(f"__orrery_s{k}") for k, c in enumerate(sums)})
    out = out.withColumn(rank, F.col("__orrery_start") + F.col("__orrery_at").bitwiseAND(F.lit((1 << 33) - 1)))
    return out.drop("__orrery_p", "__orrery_at", "__orrery_start", *[f"__orrery_s{k}" for k in range(len(sums))])


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Connected components of the graph `edges(a, b)` (long or string ids): one row (node, component) for each node of
    an edge, component being the smallest node reachable.

    Alternates the large-star and small-star steps of Kiveris et al. (2014), which need a number of rounds that grows
    with the logarithm of the longest path. Each step takes the minimum over a node's neighbours with map-side
    combination and joins it back from a written table, so that adaptive execution can split a hub's partition.
    Loops are ignored. An empty table gives an empty result.
    """
    with scratch() as keep:
        now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name)
        state = _checksum(now)
        while state[0]:
            both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
            low = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), name)
            large = written(both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), name)
            low2 = written(large.groupBy("u").agg(F.min("v").alias("m")), name)
            small = large.join(low2, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low2.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
            now, before = written(small, name), state
            state = _checksum(now)
            if state == before:
                break
        keep(now)
    low = now.groupBy("u").agg(F.min("v").alias("v"))
    return low.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(low.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _checksum(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
