"""Whitening of embeddings by a tall-skinny QR: rows are centred by exact sums, each task factors its rows, the R factors merge in a tree, and the last one's
singular values and right vectors whiten, without a covariance ever being formed.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal, localcontext
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import scratch, written

#: Steps of the grid that entries are put on, to the unit; components that rows are projected on.
SCALE, COMPONENTS = 256, 4
#: R factors that one task merges at once; the square of this logarithm is the tree's depth.
FAN = 8
#: Entries of a vector at most: a factor has so many squared, and the last one comes to the driver.
MOST_DIMENSIONS = 8192


class Whitening(NamedTuple):
    """n rows with exact sums a dimension; components as rows with their eigenvalues (0 where rows don't vary), and the trace."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    trace: float


def vectors(rows: DataFrame, column: str = "embedding", scale: int = SCALE) -> DataFrame:
    """rows with x, an array of longs: floor(scale * c) of each entry c as a double. Rows whose vector is null or empty, or holds a null, a non-finite entry or one beyond a long go."""
    entry = F.transform(F.col(column), lambda c: F.floor(c.cast("double") * scale))
    fine = (F.size(column) > 0) & F.forall(F.col(column), lambda c: F.coalesce(~F.isnan(c) & (F.abs(c.cast("double")) * scale < 2.0**63), F.lit(False)))
    return rows.where(F.coalesce(fine, F.lit(False))).withColumn("x", entry)


def same_length(rows: DataFrame) -> DataFrame:
    """Rows whose x is as long as most rows' are, the longer of two lengths that are equally frequent."""
    top = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if top is None:
        return rows
    if top["d"] > MOST_DIMENSIONS:
        raise ValueError(f"{top['d']} dimensions are more than {MOST_DIMENSIONS}")
    return rows.where(F.size("x") == top["d"])


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _partial_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's rows and exact sums: numpy's where they can't overflow, else Python's."""
    total, n = None, 0
    for b in batches:
        if len(b):
            x = _matrix(b["x"])
            if int(np.abs(x.astype(np.float64)).max()) * len(x) >= 1 << 62:
                x = x.astype(object)
            part = [int(v) for v in x.sum(axis=0)]
            total, n = part if total is None else [a + c for a, c in zip(total, part, strict=True)], n + len(x)
    if total is not None:
        with localcontext(prec=38):
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array([n] * len(total), pa.int64()), pa.array([Decimal(v) for v in total], pa.decimal128(38, 0))], ["dim", "n", "s"])


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - sums / n, rounded once or twice: the whole part of the mean is taken off as integers."""
    whole, rest = zip(*(divmod(s, n) for s in sums), strict=True)
    return (x - np.array(whole, np.int64)).astype(np.float64) - np.array([r / n for r in rest])


def _factor(n: int, sums: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = len(sums)
        r = np.zeros((0, d))
        for b in batches:
            for at in range(0, len(b), 4 * d):  # so that no more than a few squares are held
                r = np.linalg.qr(np.vstack([r, _centred(_matrix(b["x"].slice(at, 4 * d)), n, sums)]), mode="r")
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([r.ravel()], pa.list_(pa.float64()))], ["part", "r"])

    return run


def _merge(d: int):
    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("part")
        r = np.zeros((0, d))
        for one in group["r"]:
            r = np.linalg.qr(np.vstack([r, np.asarray(one.values).reshape(-1, d)]), mode="r")
        return pa.table({"part": pa.array([group["part"][0].as_py() // FAN], pa.int64()), "r": pa.array([r.ravel()], pa.list_(pa.float64()))})

    return run


def fit(distinct: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """Whitening by distinct(x), which is read three times and so should be a written table. None for an empty table.

    The tree's levels are grouped by the tasks' numbers, FAN factors at once; only the last factor, of the dimensions squared, reaches the driver.
    """
    found = distinct.select("x").mapInArrow(_partial_sums, "dim int, n long, s decimal(38,0)").groupBy("dim").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).orderBy("dim").collect()  # a row a dimension
    if not found:
        return None
    n, sums = found[0]["n"], [int(r["s"]) for r in found]
    d = len(sums)
    with scratch():
        level = written(distinct.select("x").mapInArrow(_factor(n, sums), "part long, r array<double>"), "factors")
        top = level.agg(F.max("part")).first()[0]
        while top:
            level = written(level.groupBy(F.floor(F.col("part") / FAN).alias("_g")).applyInArrow(_merge(d), "part long, r array<double>"), "factors")
            top //= FAN
        r = np.array(level.first()["r"]).reshape(-1, d)
    _, singular, right = np.linalg.svd(r, full_matrices=True)
    values = np.zeros(d)
    values[: len(singular)] = singular**2 / n
    values[values <= values[0] * (d * np.finfo(float).eps) ** 2] = 0  # what rounding leaves of a dimension without variance
    right = right[:components]
    right *= np.where(np.take_along_axis(right, np.abs(right).argmax(1)[:, None], 1) < 0, -1, 1)  # the largest entry is positive
    return Whitening(n, sums, right, values[:components], float((singular**2).sum() / n))


def _projected(fit: Whitening):
    """deviation and whitened of each row; null where a component has no variance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = fit.n, np.array(fit.sums, object)
        scale = np.where(fit.values > 0, np.sqrt(np.where(fit.values > 0, fit.values, 1)), np.nan)
        most = max(abs(s) for s in fit.sums)
        for b in batches:
            if not len(b):
                continue
            x = _matrix(b["x"])
            bound = int(np.abs(x.astype(np.float64)).max() + 1) * n + most
            if bound * bound * x.shape[1] < 1 << 62:
                deviation = pa.array(((x * n - sums.astype(np.int64)) ** 2).sum(axis=1)).cast(pa.decimal128(38, 0))
            else:
                with localcontext(prec=38):
                    deviation = pa.array([Decimal(int(v)) for v in ((x.astype(object) * n - sums) ** 2).sum(axis=1)], pa.decimal128(38, 0))
            white = _centred(x, n, fit.sums) @ fit.vectors.T / scale
            k = white.shape[1]
            flat = pa.array(white.ravel(), mask=np.isnan(white.ravel()))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(b) + 1, dtype=np.int32) * k), flat)
            own = b.drop_columns(["x"])
            yield pa.RecordBatch.from_arrays([*own.columns, deviation, lists], [*own.schema.names, "deviation", "whitened"])

    return run


def project(rows: DataFrame, fit: Whitening) -> DataFrame:
    """rows(x, ...) -> the other columns, deviation decimal(38,0) (exact: the sum over dimensions of (n*x - sum)^2, an error beyond 38 digits) and whitened array<double>, one entry a component.
    Columns of these names are replaced."""
    rows = rows.drop("deviation", "whitened")
    schema = rows.drop("x").schema.add("deviation", T.DecimalType(38, 0)).add("whitened", T.ArrayType(T.DoubleType()))
    return rows.mapInArrow(_projected(fit), schema)


def identity_error(distinct: DataFrame, fit: Whitening) -> float | None:
    """Largest absolute entry of the whitened fit rows' covariance less the identity, over the components with variance; None without such a component."""
    k = [i for i, v in enumerate(fit.values) if v > 0]
    if not k:
        return None
    w = [F.col("whitened")[i] for i in k]
    pairs = {(i, j): F.covar_pop(w[i], w[j]).alias(f"c{i}_{j}") for i in range(len(k)) for j in range(i, len(k))}
    got = project(distinct.select("x"), fit).agg(*pairs.values()).first()
    return max(abs(got[f"c{i}_{j}"] - (i == j)) for i, j in pairs)


def whiten(rows: DataFrame, keep: list[str], column: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row for each row of rows(embedding, ...) that has a vector and for each component: the columns `keep`, component (from 1), n, deviation, whitened, explained, identity_error.

    Rows without a finite vector go (see vectors), and so do those of another length than most. Repeated rows and ids each have their rows; equal vectors count once in the fit. Components are
    numbered by falling eigenvalue and there are no more than dimensions; where one has no variance, as with a single vector, whitened is null and explained 0. Columns of `keep` named
    like a result are replaced; other columns are left out. An empty table gives an empty one.
    """
    keep = [c for c in keep if c not in ("component", "n", "deviation", "whitened", "explained", "identity_error", "x")]
    with scratch() as hold:
        own = hold(written(same_length(written(vectors(rows, column).select(*keep, "x"), "vectors")), "vectors"))
        distinct = written(own.select("x").distinct(), "fit-vectors")
        fitted = fit(distinct, components)
        if fitted is None:
            fitted, error = Whitening(0, [0], np.zeros((0, 1)), np.zeros(0), 0.0), None
        else:
            error = identity_error(distinct, fitted)
    shares = [float(v / fitted.trace) if fitted.trace else 0.0 for v in fitted.values]
    out = project(own, fitted).select(*keep, "deviation", F.posexplode("whitened").alias("_k", "whitened"))
    explained = F.element_at(F.array(*[F.lit(s) for s in shares]), F.col("_k") + 1) if shares else F.lit(None)
    return out.select(
        *keep, (F.col("_k") + 1).cast("int").alias("component"), F.lit(fitted.n).cast("long").alias("n"), "deviation", "whitened", explained.cast("double").alias("explained"), F.lit(error).cast("double").alias("identity_error")
    )
