"""Exact top-k of vectors by clusters (J13, T2): each vector lies in the cluster of its nearest centroid, and the triangle inequality bounds the cosine of a whole cluster.

On the unit sphere a cosine is 1 - d**2 / 2, and no vector of a cluster is nearer to a query than the centroid's distance less the cluster's radius. A query first visits the clusters nearest to it; then
only those whose bound reaches its k-th score. Centroids are fitted on a sample; all vectors are assigned, and no query or vector is left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orrery.functions.vectors import EPSILON
from orrery.operators.retrieve import blocks, checked, topk
from orrery.tables import scratch, written

#: Vectors that centroids are fitted on, at most; centroids, at most; rounds of fitting; clusters that a query visits first.
SAMPLE, MOST_CLUSTERS, ROUNDS, FIRST_CLUSTERS = 20_000, 1024, 8, 3
#: What rounding may take from a bound: scores have 6 digits.
SLACK = 1e-6


class Clusters(NamedTuple):
    """vectors(kb, chunk_id, embedding, length, cluster), heads(kb, cluster, radius, n): written tables; centroids, a row each."""

    vectors: DataFrame
    heads: DataFrame
    centroids: np.ndarray


def _finite(c: Column) -> Column:
    return F.coalesce((F.size(c) > 0) & F.forall(c, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")), F.lit(False))), F.lit(False))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def fit(vectors: DataFrame, clusters: int | None = None, sample: int = SAMPLE, rounds: int = ROUNDS) -> np.ndarray:
    """Centroids by k-means on at most about `sample` vectors, chosen by a hash of kb and chunk_id; their number is the root of the vectors', MOST_CLUSTERS at most, if not given."""
    n = vectors.count()
    h = F.pmod(F.xxhash64("kb", "chunk_id"), F.lit(1 << 30))
    some = vectors.where(h < F.lit(int(min(1.0, sample / max(1, n)) * (1 << 30)) + 1)).orderBy(h, "chunk_id").select("embedding").limit(sample).toArrow()
    if not some.num_rows:
        return np.zeros((0, 0))
    x = _unit(_matrix(some["embedding"].combine_chunks()))
    k = max(1, min(len(x), clusters or min(MOST_CLUSTERS, int(n**0.5))))
    centres = x[np.linspace(0, len(x) - 1, k).astype(int)]
    for _ in range(rounds):
        near = (x @ centres.T * 2 - (centres**2).sum(1)).argmax(1)
        many = np.bincount(near, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        centres = np.where(many[:, None] > 0, sums / np.maximum(many, 1)[:, None], centres)
    return centres


def build(vectors: DataFrame, clusters: int | None = None, sample: int = SAMPLE) -> Clusters:
    """All vectors(kb, chunk_id, embedding) in their clusters. Vectors without finite entries, or of another length than the sample's first, are in no list; zero vectors are, with the score 0."""
    own = vectors.select("kb", "chunk_id", "embedding").where(_finite(F.col("embedding")))
    first = own.select(F.size("embedding")).first()
    own = own.where(F.size("embedding") == (first[0] if first else 0))
    centres = fit(own, clusters, sample)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                x = _matrix(b["embedding"])
                length, x = np.linalg.norm(x, axis=1), _unit(x)
                near = (x @ centres.T * 2 - (centres**2).sum(1)).argmax(1)
                away = np.linalg.norm(x - centres[near], axis=1)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(length), pa.array(near.astype(np.int32)), pa.array(away)], [*b.schema.names, "length", "cluster", "away"])

    schema = T.StructType([*own.schema, T.StructField("length", T.DoubleType()), T.StructField("cluster", T.IntegerType()), T.StructField("away", T.DoubleType())])
    placed = written(own.mapInArrow(assign, schema).repartition("cluster").sortWithinPartitions("cluster"), "clustered")
    heads = written(placed.groupBy("kb", "cluster").agg(F.max("away").alias("radius"), F.count("*").alias("n")), "cluster-heads")
    return Clusters(placed.drop("away"), heads, centres)


def _near(queries: DataFrame, centres: np.ndarray) -> DataFrame:
    """(query_id, _q, _n, cluster, far): a row for each query and cluster with the centroid's distance from the query's direction."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, len(b), 64):
                part = b.slice(at, 64)
                if len(part):
                    q = _unit(_matrix(part["_q"]))
                    far = np.sqrt(np.maximum(0, (q**2).sum(1)[:, None] - 2 * q @ centres.T + (centres**2).sum(1)))
                    rows = pa.array(np.repeat(np.arange(len(part)), len(centres)))
                    yield pa.RecordBatch.from_arrays([part["query_id"].take(rows), pa.array(np.tile(np.arange(len(centres), dtype=np.int32), len(part))), pa.array(far.ravel())], ["query_id", "cluster", "far"])

    kind = queries.schema["query_id"]
    return queries.select("query_id", "_q").mapInArrow(run, T.StructType([kind, T.StructField("cluster", T.IntegerType()), T.StructField("far", T.DoubleType())]))


def _scores(queries: DataFrame, found: Clusters, wanted: DataFrame) -> DataFrame:
    """Scores of the wanted(query_id, kb, cluster): each vector meets the queries that want its cluster, which are sent to the vectors."""
    pairs = wanted.select("query_id", "kb", "cluster").join(queries, "query_id")
    if wanted.count() <= 50 * 10_000:  # clusters' pairs with queries, the vectors of which are 10,000 at most
        pairs = F.broadcast(pairs)
    v = found.vectors.join(pairs, ["kb", "cluster"])
    total = F.aggregate(F.zip_with("embedding", "_q", lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return v.select("query_id", "kb", "chunk_id", (total / ((F.col("length") + EPSILON) * (F.col("_n") + EPSILON))).alias("score"))


def search(queries: DataFrame, found: Clusters, k: int, first_clusters: int = FIRST_CLUSTERS) -> tuple[DataFrame, DataFrame]:
    """queries(query_id, embedding) -> (topk()'s rows a query and kb, as comparing all pairs gives them; visits: query_id, kb, cluster, n, visited). Queries go in blocks, as many as there are."""
    tops, visits = [], []
    for block in blocks(checked(queries)):
        with scratch() as keep:
            q = keep(written(block, "cluster-queries"))
            near = _near(q, found.centroids).join(F.broadcast(found.heads), "cluster")  # a row a kb and cluster
            reach = F.greatest(F.lit(0.0), F.col("far") - F.col("radius"))
            near = written(near.select("query_id", "kb", "cluster", "n", (1 - reach * reach / 2).alias("bound")), "cluster-bounds")
            w = Window.partitionBy("query_id", "kb").orderBy(F.col("bound").desc(), "cluster")
            ranked = near.withColumns({"_r": F.row_number().over(w), "_before": F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1))})
            ranked = written(ranked.withColumn("first", (F.col("_r") <= first_clusters) | (F.coalesce("_before", F.lit(0)) < k)), "cluster-ranks")
            begun = keep(written(topk(_scores(q, found, ranked.where("first")), k), "first-scores"))
            least = begun.where(F.col("rank") == k).select("query_id", "kb", F.col("score").alias("least"))
            reached = F.col("first") | F.coalesce(F.col("bound") + SLACK >= F.col("least"), F.lit(True))
            seen = keep(written(ranked.join(least, ["query_id", "kb"], "left").select("query_id", "kb", "cluster", "n", "first", reached.alias("visited")), "cluster-visits"))
            more = keep(written(topk(_scores(q, found, seen.where("visited and not first")), k), "more-scores"))
        tops.append(topk(begun.drop("rank").unionByName(more.drop("rank")), k))
        visits.append(seen.drop("first"))
    return reduce(DataFrame.unionByName, tops), reduce(DataFrame.unionByName, visits)
