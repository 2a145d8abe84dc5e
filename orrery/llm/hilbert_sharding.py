"""Sharding: Hilbert-curve ordering.

Metadata dimensions are quantised at quantiles, rows are sorted by their index on the Hilbert curve through these cells,
and the order is cut into runs of equal length. A shard then covers a small box of every dimension, and readers skip
the shards whose boxes a filter doesn't meet.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from .common import global_rank, scratch

#: Cells along each dimension: 2 ** BITS.
BITS = 5
#: Error of the quantiles at which dimensions are cut; the driver holds 2 ** BITS bounds a dimension.
QUANTILE_ERROR = 0.005
#: The largest table of cells: 2 ** TABLE_BITS rows of two longs.
TABLE_BITS = 16


def curve_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert index of each row of cells (n, dimensions), by Skilling's transposition (2004); dimensions * bits < 64."""
    x = cells.astype(np.uint64).T.copy()
    n = len(x)
    one, q = np.uint64(1), np.uint64(1 << (bits - 1))
    while q > 1:  # undo excess work
        p = q - one
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, np.uint64(0), (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            x[i] = x[i] ^ swap
        q >>= one
    for i in range(1, n):  # Gray code
        x[i] ^= x[i - 1]
    t, q = np.zeros_like(x[0]), np.uint64(1 << (bits - 1))
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - one), t)
        q >>= one
    x ^= t
    out = np.zeros(x.shape[1], np.uint64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = (out << one) | ((x[i] >> np.uint64(b)) & one)
    return out.astype(np.int64)


def text_bounds(df: DataFrame, name: str, bits: int = BITS) -> list[str]:
    """At most 2 ** bits - 1 distinct values of a text column that part all its values into equal runs. Values are counted, and the counts of distinct values are summed in their order by range partitions: only the bounds come
    to the driver."""
    counts = df.select(F.col(name).cast("string").alias("v")).where("v is not null").groupBy("v").agg(F.count("*").alias("n"))
    with scratch():
        ranked = global_rank(counts, [F.col("v")], "text-counts", sums=("n",))
        total = ranked.agg(F.sum("n")).first()[0] or 0
        # rows below a value, as a share of all others: the first value of each run is a bound
        run = F.floor(F.col("before_n") / max(1, total - 1) * (1 << bits))
        cuts = ranked.groupBy(run).agg(F.min("v").alias("v")).select("v").collect()
    return sorted((r["v"] for r in cuts), key=lambda v: v.encode())[: (1 << bits) - 1]


def quantise(df: DataFrame, dimensions: list[str], bits: int = BITS) -> DataFrame:
    """Add an array of cells: how many of a dimension's bounds a value reaches, spread over all 2 ** bits cells; 0 for null and NaN.

    Bounds are quantiles over all rows: of numbers within QUANTILE_ERROR, of whole texts exactly. A dimension of few values has a cell for each of them, far apart on the curve.
    """
    numeric = [d for d in dimensions if isinstance(df.schema[d].dataType, NumericType)]
    steps = [k / (1 << bits) for k in range(1, 1 << bits)]
    found = df.select(*[F.col(d).cast("double").alias(f"__orrery_n{i}") for i, d in enumerate(numeric)]).approxQuantile([f"__orrery_n{i}" for i in range(len(numeric))], steps, QUANTILE_ERROR) if numeric else []
    bounds = {d: sorted(set(b)) for d, b in zip(numeric, found, strict=True)}
    cells = []
    for d in dimensions:
        value = F.col(d).cast("double" if d in numeric else "string")
        cuts = bounds[d] if d in numeric else text_bounds(df, d, bits)
        reached = F.size(F.filter(F.array(*[F.lit(x) for x in cuts]), _reached(value))) if cuts else F.lit(0)
        spread = F.floor(reached * ((1 << bits) - 1) / max(1, len(cuts))).cast("int")
        cells.append(F.when(value.isNull() | F.isnan(value) if d in numeric else value.isNull(), F.lit(0)).otherwise(spread))
    return df.withColumn("__orrery_cell", F.array(*cells))


def _reached(value: Column):
    return lambda bound: value >= bound


def with_curve(df: DataFrame, dimensions: int, bits: int) -> DataFrame:
    """Add curve, the Hilbert index of the array of cells. Up to TABLE_BITS bits in all it is looked up in a table of all cells, of a size that is known,
    and nothing leaves the JVM; beyond, Arrow batches compute it."""
    if dimensions * bits <= TABLE_BITS:
        n = 1 << (dimensions * bits)
        codes = np.arange(n)
        cells = np.stack([codes >> (bits * i) & ((1 << bits) - 1) for i in range(dimensions)], axis=1)
        table = df.sparkSession.createDataFrame(list(zip(codes.tolist(), curve_index(cells, bits).tolist(), strict=True)), "__orrery_code long, curve long")
        code = F.lit(0).cast("long")
        for i in range(dimensions):
            code = code + F.shiftleft(F.get("__orrery_cell", F.lit(i)).cast("long"), bits * i)
        return df.withColumn("__orrery_code", code).join(F.broadcast(table), "__orrery_code").drop("__orrery_code")

    @F.pandas_udf("long")
    def index(cell: pd.Series) -> pd.Series:
        return pd.Series(curve_index(np.stack(cell.to_numpy()), bits) if len(cell) else np.empty(0, np.int64))

    return df.withColumn("curve", index("__orrery_cell"))


def assign(df: DataFrame, dimensions: list[str], key: str = "doc_id", shards: int = 8, bits: int = BITS) -> DataFrame:
    """Add shard (0 to shards - 1), slot (place in the shard, gapless from 0) and curve (Hilbert index) to each row.

    Law `rows`: shards differ by one row at most; where the rows don't divide, some shards have one more. The order is
    (curve, a hash of the key, key, a hash of the other columns), so a cell that holds most rows still spreads over partitions; equal rows
    take neighbouring places. Nulls lie in a dimension's lowest cell; empty and very long texts are rows like others; an empty
    table gives an empty one; columns named shard, slot or curve are replaced. df is read several times, so a wide one should be narrow or written.
    """
    own = df.drop("shard", "slot", "curve", "__orrery_cell")
    placed = with_curve(quantise(own, dimensions, bits), len(dimensions), bits).drop("__orrery_cell")
    ties = [F.xxhash64(F.lit(7), key), F.col(key).asc(), F.xxhash64(*own.columns)]
    ranked = global_rank(placed, [F.col("curve"), *ties], "hilbert-order", "__orrery_rank")
    total = ranked.count()  # of the written table: its footers' row counts
    # shard s holds the ranks from ceil(s * total / shards) on
    shard = F.expr(f"cast(__orrery_rank * {shards}L div {max(total, 1)}L as int)")
    first = F.expr(f"(shard * {total}L + {shards - 1}L) div {shards}L")
    return ranked.withColumn("shard", shard).withColumn("slot", (F.col("__orrery_rank") - first).cast("long")).drop("__orrery_rank")


def write_shards(assigned: DataFrame, path: str) -> None:
    """Write one folder a shard, rows in slot order, to any store that Spark writes to; a folder's files have row-group statistics
    of every column, by which readers prune."""
    assigned.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
