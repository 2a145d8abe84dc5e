"""Embedding near-duplicates by a subspace pigeonhole join.

Unit vectors are rotated and split into blocks of few dimensions. Two vectors within a squared distance T are within T in
proportion to its dimensions in one block at least, so a range join of each block under that budget finds every pair; the
union of the candidates is verified exactly. A pair counts in the first block that finds it.

The range join of a block is a grid over its first axes: each vector has a home cell, goes to the neighbour cells
within the block's radius as a visitor, and meets there the cell's own vectors. Vectors with one home cell are dealt to
tiles, and go to the cell's other tiles as visitors, so the work of a cell that holds most vectors spreads over many tasks. In a tile a
second, finer grid over other axes, which costs no copies, leaves few pairs to compare.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, scratch, trim, written
from .simhash import Forest

COSINE = 0.98
#: Dimensions of a block.
WIDTH = 16
#: Home vectors that are held at once: more make tiles. Cells of more than some eight times as many make finer grids.
TILE = 4096
#: Axes of the grid in a tile, and from how many home vectors it has one; pairs that are compared at once.
INNER, DENSE, AT_ONCE = 3, 128, 1 << 20
SEED = 5


@cache
def rotation(dims: int, seed: int = SEED) -> np.ndarray:
    """A random rotation: spreads a vector's energy evenly over the blocks."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def blocks(dims: int, width: int = WIDTH) -> list[slice]:
    return [slice(a, min(a + width, dims)) for a in range(0, dims, width)]


def budgets(dims: int, cosine: float, width: int = WIDTH) -> np.ndarray:
    """Squared distance of each block: its share of 2 - 2 cosine, with room for rounding."""
    total = (2 - 2 * cosine) * (1 + 1e-9) + 1e-12
    return np.array([total * (b.stop - b.start) / dims for b in blocks(dims, width)])


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.linalg.norm(rows, axis=-1, keepdims=True)


def axes(count: int, dims: int, width: int = WIDTH) -> int:
    """Axes of the grid over which `count` vectors of a label are dealt: each parts them by about two and doubles the rows that move. All of a block's, if it takes as many."""
    return int(np.clip(np.ceil(np.log2(max(1, count / (8 * TILE)))), 1, min(width, dims)))


def valid(df: DataFrame) -> DataFrame:
    """The rows that can link: label, id and vector not null, all components finite, not all zero."""
    e = F.col("embedding")
    fine = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf"))) & F.exists(e, lambda x: x != 0)
    return df.where(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & e.isNotNull()).where(F.coalesce(fine, F.lit(False)))


def near_duplicates(df: DataFrame, cosine: float = COSINE, width: int = WIDTH) -> DataFrame:
    """df(vec_id, embedding, label, ...) -> vec_id, label, n_links, component_id, kept: one row a vector.

    Vectors link when their labels and dimensions are equal and their cosine in double precision is `cosine` or more. Equal vectors
    are one node with a count, and link with each other. Rows that can't link (see valid) have no links and their own id; kept is
    null only for a null vec_id. Repeated rows count as vectors of their own; an empty table gives an empty one.
    """
    own = df.select("vec_id", "label", "embedding")
    with scratch() as keep:
        classes = written(valid(own).groupBy("label", "embedding").agg(F.min("vec_id").alias("id"), F.count("*").alias("n")), "vector-classes")
        largest = classes.groupBy("label", F.size("embedding").alias("d")).agg(F.count("*").alias("n"))
        sizes = largest.groupBy("d").agg(F.max("n").alias("n")).collect()  # one row a dimension
        grid = {r["d"]: axes(r["n"], r["d"], width) for r in sizes}
        n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        key = ["label", "d", "block", "cell", "tile"]
        dealt = _dealt(classes, grid, cosine, width).repartition(n, *key).sortWithinPartitions(*key, F.col("home").desc(), "id")
        found = written(dealt.mapInArrow(_joiner(cosine, width, DENSE), "a long, b long, links long"), "vector-links")
        counts = found.where("links > 0").groupBy(F.col("a").alias("_id")).agg(F.sum("links").alias("links"))
        parts = written(components(found.where("b is not null").select("a", "b").distinct(), "vector-components"), "vector-parts")
        named = classes.join(counts, F.col("id") == F.col("_id"), "left").join(parts, F.col("id") == F.col("node"), "left")
        named = named.select(F.col("label").alias("_label"), F.col("embedding").alias("_embedding"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
        named = keep(written(named, "vector-named"))
    out = own.join(named, (F.col("label") == F.col("_label")) & (F.col("embedding") == F.col("_embedding")) & F.col("vec_id").isNotNull(), "left")
    out = out.withColumns({"n_links": F.coalesce("n_links", F.lit(0)).cast("long"), "component_id": F.coalesce("component_id", "vec_id").cast("long")})
    return out.select("vec_id", "label", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))


def _dealt(classes: DataFrame, grid: dict[int, int], cosine: float, width: int) -> DataFrame:
    """Each vector to its home cell of each block and to the cells that its radius reaches; then to tiles."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = pc.list_value_length(b["embedding"]).to_numpy()
            for d in np.unique(sizes).tolist():
                here = np.flatnonzero(sizes == d)
                q, limit = rotation(d), budgets(d, cosine, width)
                x = unit(b["embedding"].take(pa.array(here)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)) @ q
                for k, block in enumerate(blocks(d, width)):
                    r = np.sqrt(limit[k]) * (1 + 1e-9)
                    side = 2 * r
                    use = min(grid.get(d, 1), block.stop - block.start)
                    part = x[:, block][:, :use]
                    rows, code, home = np.arange(len(here)), np.zeros(len(here), np.uint64), np.ones(len(here), bool)
                    for axis in range(use):
                        low, high = np.floor((part[rows, axis] - r) / side).astype(np.int64), np.floor((part[rows, axis] + r) / side).astype(np.int64)
                        many = high - low + 1
                        step = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                        rows, code, home, cell = np.repeat(rows, many), np.repeat(code, many), np.repeat(home, many), np.repeat(low, many) + step
                        home &= cell == np.floor(part[rows, axis] / side).astype(np.int64)
                        code = _mixed(code, cell)
                    at = pa.array(here[rows])
                    yield pa.RecordBatch.from_arrays([b["label"].take(at), pa.array(np.full(len(rows), d), pa.int32()), pa.array(np.full(len(rows), k), pa.int32()), pa.array(code.view(np.int64)), pa.array(home), *(b[c].take(at) for c in ("id", "n", "embedding"))], ["label", "d", "block", "cell", "home", "id", "n", "embedding"])

    types = dict(classes.dtypes)
    cells = classes.select("label", "embedding", "id", "n").mapInArrow(deal, f"label {types['label']}, d int, block int, cell long, home boolean, id long, n long, embedding {types['embedding']}")
    key = ["label", "d", "block", "cell"]
    homes = written(_homes(classes, cells, key), "vector-cells")
    tiles = F.coalesce("tiles", F.lit(1))
    out = cells.join(homes, key, "left").withColumn("own", F.when(F.col("home"), F.pmod(F.xxhash64("id"), tiles)).otherwise(F.lit(-1)))
    out = out.withColumn("tile", F.explode(F.sequence(F.lit(0), (tiles - 1).cast("int"))))
    return out.select(*key, "tile", (F.col("home") & (F.col("own") == F.col("tile"))).alias("home"), "id", "n", "embedding")


def _mixed(code: np.ndarray, cell: np.ndarray) -> np.ndarray:
    """The code of one more axis: a hash of 64 bits over all cells so far, since 16 axes don't fit otherwise."""
    return (code * np.uint64(0x9E3779B97F4A7C15) ^ (cell + (1 << 20)).astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(1)


def _homes(classes: DataFrame, cells: DataFrame, key: list[str]) -> DataFrame:
    """Cells with more home vectors than a tile holds, and how many tiles they have."""
    return cells.where("home").groupBy(*key).agg(F.count("*").alias("n")).where(F.col("n") > TILE).select(*key, F.ceil(F.col("n") / TILE).cast("int").alias("tiles"))


def _joiner(cosine: float, width: int, dense: int):
    """Rows sorted by cell and tile, home vectors first -> (a, null, links): the vectors that a links with here, copies of others counted each; and edges (a, b, 0) that span the links."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: _Cell | None = None
        for b in batches:
            keys = np.stack([b[c].cast(pa.string()).to_numpy(zero_copy_only=False) for c in ("label", "d", "block", "cell", "tile")], axis=1)
            cuts = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]).any(axis=1)))).tolist() + [len(keys)]
            home, ids, n = b["home"].to_numpy(zero_copy_only=False), b["id"].to_numpy(), b["n"].to_numpy()
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                key = tuple(keys[lo])
                if state is None or state.key != key:
                    if state is not None:
                        yield from state.result()
                    state = _Cell(key, int(b["block"][lo].as_py()), cosine, width, dense)
                x = b["embedding"].slice(lo, hi - lo).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(hi - lo, -1)
                state.add(home[lo:hi], ids[lo:hi], n[lo:hi], x)
        if state is not None:
            yield from state.result()
        trim()

    return join


class _Cell:
    """The home vectors of a tile, at most about TILE, which all others of the cell pass in batches."""

    def __init__(self, key: tuple, block: int, cosine: float, width: int, dense: int):
        self.key, self.block, self.cosine, self.width, self.dense = key, block, cosine, width, dense
        self.parts: list[tuple] = []
        self.built = False
        self.edges: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, home: np.ndarray, ids: np.ndarray, n: np.ndarray, raw: np.ndarray) -> None:
        x = unit(raw)
        y = x @ rotation(x.shape[1])
        k = int(home.sum())  # homes come first
        if k:
            self.parts.append((ids[:k], n[:k], x[:k], y[:k]))
        if k < len(ids):
            self._build()
            self._meet(ids[k:], n[k:], x[k:], y[k:], own=False)

    def _build(self) -> None:
        if self.built:
            return
        self.built = True
        if not self.parts:
            self.ids = np.empty(0, np.int64)
            return
        self.ids, self.n, self.x, self.y = (np.concatenate(c) for c in zip(*self.parts, strict=True))
        d = self.x.shape[1]
        self.slices, self.budget = blocks(d, self.width), budgets(d, self.cosine, self.width)
        own = self.y[:, self.slices[self.block]]
        self.inner, self.low, self.side = [], np.zeros(0), np.sqrt(self.budget[self.block]) * (1 + 1e-9)
        if len(self.ids) >= self.dense:
            self.inner = np.argsort(-own.var(axis=0), kind="stable")[:INNER].tolist()
            self.low = own[:, self.inner].min(axis=0)
            codes = self._codes(self._steps(own))
            order = np.argsort(codes, kind="stable")
            self.ids, self.n, self.x, self.y, own, self.codes = self.ids[order], self.n[order], self.x[order], self.y[order], own[order], codes[order]
        self.own, self.norms = own, (own * own).sum(1)
        self.links, self.forest = np.zeros(len(self.ids), np.int64), Forest(len(self.ids))
        for at in range(0, len(self.ids), 2048):
            part = slice(at, at + 2048)
            self._meet(self.ids[part], self.n[part], self.x[part], self.y[part], own=True, at=at)

    def _steps(self, block: np.ndarray) -> np.ndarray:
        return np.clip(np.floor((block[:, self.inner] - self.low) / self.side), -2, (1 << 18) - 1).astype(np.int64)

    @staticmethod
    def _codes(steps: np.ndarray) -> np.ndarray:
        code = np.zeros(len(steps), np.int64)
        for k in range(steps.shape[1]):
            code = (code << 20) + steps[:, k] + 4
        return code

    def _groups(self, block: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(home vectors, others) to compare: all, or by cells of the tile's grid each with its neighbours; along the last axis these lie together."""
        if not self.inner:
            yield np.arange(len(self.ids)), np.arange(len(block))
            return
        steps = self._steps(block)
        codes = self._codes(steps)
        order = np.argsort(codes, kind="stable")
        cuts = np.flatnonzero(np.concatenate(([True], np.diff(codes[order]) != 0)))
        around = np.array(list(product((-1, 0, 1), repeat=len(self.inner) - 1)), np.int64).reshape(-1, len(self.inner) - 1)
        for lo, hi in zip(cuts.tolist(), [*cuts[1:].tolist(), len(order)], strict=True):
            near = steps[order[lo]] + np.concatenate([around, np.zeros((len(around), 1), np.int64)], axis=1)
            code = self._codes(near)
            starts, stops = np.searchsorted(self.codes, code - 1, "left"), np.searchsorted(self.codes, code + 1, "right")
            homes = np.concatenate([np.arange(p, q) for p, q in zip(starts.tolist(), stops.tolist(), strict=True)])
            if len(homes):
                yield homes, order[lo:hi]

    def _meet(self, ids, n, x, y, own: bool, at: int = 0) -> None:
        if not len(self.ids):
            return
        block = y[:, self.slices[self.block]]
        norms = (block * block).sum(1)
        for homes, others in self._groups(block):
            step = max(1, AT_ONCE // len(homes))
            for lo in range(0, len(others), step):
                some = others[lo : lo + step]
                far = self.norms[homes][:, None] + norms[some][None, :] - 2 * (self.own[homes] @ block[some].T)
                i, j = np.nonzero(far <= self.budget[self.block] + 1e-12)
                i, j = homes[i], some[j]
                if own:
                    apart = i != j + at
                    i, j = i[apart], j[apart]
                for p in range(0, len(i), 1 << 16):
                    self._verify(i[p : p + (1 << 16)], j[p : p + (1 << 16)], ids, n, x, y, own, at)

    def _verify(self, i, j, ids, n, x, y, own, at) -> None:
        linked = np.einsum("ij,ij->i", self.x[i], x[j]) >= self.cosine
        i, j = i[linked], j[linked]
        if not len(i):
            return
        first = np.ones(len(i), bool)
        for k in range(self.block + 1):  # a pair counts in the first block that finds it
            d = self.y[i, self.slices[k]] - y[j, self.slices[k]]
            first &= ((d * d).sum(1) <= self.budget[k]) == (k == self.block)
        i, j = i[first], j[first]
        self.links += np.bincount(i, n[j], len(self.ids)).astype(np.int64)
        if own:
            self.forest.link(i, j + at)
        elif len(i):  # a visitor joins all home vectors that it links with
            order = np.argsort(j, kind="stable")
            i, j = i[order], j[order]
            same = j[1:] == j[:-1]
            self.forest.link(i[1:][same], i[:-1][same])
            head = np.concatenate(([True], ~same))
            self.edges.append((self.ids[i[head]], ids[j[head]]))

    def result(self) -> Iterator[pa.RecordBatch]:
        self._build()
        if not len(self.ids):
            return
        up = self.forest.root
        moved = up != np.arange(len(up))
        a = np.concatenate([self.ids, self.ids[up[moved]], *(e[0] for e in self.edges)])
        b = np.concatenate([np.zeros(len(self.ids), np.int64), self.ids[moved], *(e[1] for e in self.edges)])
        links = np.concatenate([self.links, np.zeros(len(a) - len(self.ids), np.int64)])
        alone = np.arange(len(a)) < len(self.ids)
        told = ~alone | (links > 0)
        yield pa.RecordBatch.from_arrays([pa.array(a[told], pa.int64()), pa.array(b[told], pa.int64(), mask=alone[told]), pa.array(links[told], pa.int64())], ["a", "b", "links"])
