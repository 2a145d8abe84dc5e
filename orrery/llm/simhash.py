"""SimHash near-duplicates by a binary trie self-join.

Pairs of trie nodes are traversed together, level by level; the differing bits accumulate and a pair is dropped once
they exceed the budget. Here the traversal is vectorised: nodes are ranges of the sorted fingerprints, and a frontier of
node pairs is held in arrays.

To run it on many executors, fingerprints are dealt by the pigeonhole rule: of BLOCKS blocks of bits one agrees in any linked
pair, so each fingerprint goes once to each of its blocks' values, and the trie below a value is traversed with the rest of
the bits. A value that too many fingerprints have is parted further by its remaining bits in the same way.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructType

from .common import components, scratch, trim, written

BUDGET, SHINGLE, SEED, BITS = 3, 3, 42, 64
#: More fingerprints than this with one value of a block are parted by their other bits.
HOT = 20_000
#: Node pairs that are expanded at once: bounds memory.
FRONTIER = 1 << 17
#: Fingerprints that are joined at once, whole groups of them.
CHUNK = 1 << 17


#: Bytes of a text that are split into words at once, a little more up to the next white space: bounds what one very long text needs.
AT_ONCE = 1 << 20
GAP = re.compile(rb"[\x20\x09-\x0d]")


def shingle_hashes(text: bytes | None, n: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """XXH64 of the word n-grams in turn, repeats included, A-Z in lower case; of the whole sequence for fewer than n words; none for a text without words."""
    text, digest, found, carry, at = text or b"", xxhash.xxh64_intdigest, [], [], 0
    while at < len(text):
        gap = GAP.search(text, at + AT_ONCE)
        stop = gap.start() if gap else len(text)
        words = carry + text[at:stop].lower().split()  # of bytes: A-Z only, and the white space of ASCII
        at, carry = stop, words[max(0, len(words) - n + 1) :]
        if len(words) >= n:
            joined = b" ".join(words)
            ends = np.cumsum([len(w) + 1 for w in words])
            starts = np.concatenate(([0], ends[:-1]))[: len(words) - n + 1].tolist()
            found.append(np.array([digest(joined[a:b], seed) for a, b in zip(starts, (ends[n - 1 :] - 1).tolist(), strict=True)], np.uint64))
    if found:
        return np.concatenate(found)
    return np.array([digest(b" ".join(carry), seed)] if carry else [], np.uint64)


def fingerprint_of(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half the hashes; 0 where there are none."""
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part = hashes[at : at + (1 << 14)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint(text: bytes | None, n: int = SHINGLE, seed: int = SEED) -> int:
    return fingerprint_of(shingle_hashes(text, n, seed))


def fingerprints(docs: DataFrame, keep: list[str], n: int = SHINGLE) -> DataFrame:
    """docs(text, ...) -> the columns `keep` and fp, the fingerprint as a long of the same 64 bits."""
    own = docs.select(*keep, F.col("text").alias("__orrery_text"))

    def batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.array([fingerprint(t, n) for t in b.column(b.num_columns - 1).cast(pa.binary()).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(found, pa.int64())], [*b.schema.names[:-1], "fp"])
        trim()

    return own.mapInArrow(batch, StructType(own.schema.fields[:-1]).add("fp", LongType()))


class Forest:
    """Disjoint sets over 0 to n - 1; roots are the smallest members."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.root[a], self.root[b]
            low, high = np.minimum(a, b), np.maximum(a, b)
            apart = low != high
            low, high = low[apart], high[apart]
            if not len(low):
                return
            np.minimum.at(self.root, high, low)
            while True:
                up = self.root[self.root]
                if np.array_equal(up, self.root):
                    break
                self.root = up
            a, b = low, high


def trie_join(values: np.ndarray, group: np.ndarray, bits: int, budget: int = BUDGET) -> np.ndarray:
    """Root (an index) of each value's component, among values (unsigned 64-bit, their lowest `bits` bits count) of its group that are linked at `budget`
    or fewer differing bits. Values are sorted by (group, value).

    A node is a range of sorted values that share a prefix. At depth d a pair of nodes is replaced by the pairs of their children by bit d. Pairs
    whose ranges are one component already need no more looking at.
    """
    n, forest = len(values), Forest(len(values))
    if n < 2:
        return forest.root
    cuts = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    ends = np.append(cuts[1:], n)
    zero = np.zeros(len(cuts), np.int8)
    work = [(bits - 1, np.stack([cuts, ends, cuts, ends]), zero)]
    while work:
        bit, span, differ = work.pop()
        a0, a1, b0, b1 = span
        same = a0 == b0
        alive = ~(same & (a1 - a0 < 2))
        if not same.all():  # one component already: the smallest and largest roots of both ranges agree
            alive &= same | ~_joined(forest.root, a0, a1, b0, b1)
        span, differ = span[:, alive], differ[alive]
        if not span.shape[1]:
            continue
        if span.shape[1] > FRONTIER:
            half = span.shape[1] // 2
            work += [(bit, span[:, half:], differ[half:]), (bit, span[:, :half], differ[:half])]
            continue
        a0, a1, b0, b1 = span
        single = (a1 - a0 == 1) & (b1 - b0 == 1)  # two leaves: compare what is left of them at once
        if single.any():
            x, y = a0[single], b0[single]
            near = np.bitwise_count(_low(values[x] ^ values[y], bits)) <= budget
            forest.link(x[near], y[near])
            a0, a1, b0, b1 = span = span[:, ~single]
            differ = differ[~single]
        if not span.shape[1]:
            continue
        if bit < 0:  # equal prefixes over all bits and within the budget
            forest.link(a0, b0)
            for lo, hi in ((a0, a1), (b0, b1)):
                wide = hi - lo > 1
                for s, e in zip(lo[wide].tolist(), hi[wide].tolist(), strict=True):
                    forest.link(np.full(e - s - 1, s), np.arange(s + 1, e))
            continue
        am, bm = _split(values, a0, a1, bit), _split(values, b0, b1, bit)
        same = a0 == b0
        pairs = [((a0, am, b0, bm), differ, None), ((am, a1, bm, b1), differ, None), ((a0, am, bm, b1), differ + 1, None), ((am, a1, b0, bm), differ + 1, ~same)]
        spans, counts = [], []
        for (p, q, r, s), d, only in pairs:
            ok = (q > p) & (s > r) & (d <= budget)
            if only is not None:
                ok &= only
            spans.append(np.stack([p[ok], q[ok], r[ok], s[ok]]))
            counts.append(d[ok])
        work.append((bit - 1, np.concatenate(spans, axis=1), np.concatenate(counts)))
    return forest.root


def _low(x: np.ndarray, bits: int) -> np.ndarray:
    return x if bits == 64 else x & np.uint64((1 << bits) - 1)


def _split(values: np.ndarray, lo: np.ndarray, hi: np.ndarray, bit: int) -> np.ndarray:
    """First place in each range whose value has the bit set: a binary search over all ranges at once."""
    lo, hi, shift, one = lo.copy(), hi.copy(), np.uint64(bit), np.uint64(1)
    while True:
        open_ = lo < hi
        if not open_.any():
            return lo
        mid = (lo + hi) >> 1
        high = (values[np.minimum(mid, len(values) - 1)] >> shift & one) == 1
        hi = np.where(open_ & high, mid, hi)
        lo = np.where(open_ & ~high, mid + 1, lo)


def _joined(root: np.ndarray, a0, a1, b0, b1) -> np.ndarray:
    """Whether all values of both ranges have one root. Ranges of more than 64 values are taken not to."""
    small = (a1 - a0 <= 64) & (b1 - b0 <= 64) & (root[a0] == root[b0])
    out = np.zeros(len(a0), bool)
    at = np.flatnonzero(small)
    if len(at):
        changes = np.concatenate(([0], np.cumsum(root[1:] != root[:-1])))
        out[at] = (changes[a1[at] - 1] == changes[a0[at]]) & (changes[b1[at] - 1] == changes[b0[at]])
    return out


def _blocks(bits: int, budget: int) -> list[tuple[int, int]]:
    """(shift, width) of budget + 1 blocks of `bits` bits."""
    size = -(-bits // (budget + 1))
    return [(s, min(size, bits - s)) for s in range(0, bits, size)]


def links(fps: DataFrame, budget: int = BUDGET, hot: int = HOT) -> DataFrame:
    """fps(fp), distinct -> edges (a, b) that span the components of fingerprints linked at `budget` or fewer differing bits.

    One edge a fingerprint and place at most, never all pairs of a group.
    """
    at = lambda fp, shift, width: F.shiftrightunsigned(fp, shift).bitwiseAND(F.lit((1 << width) - 1))
    first = _blocks(BITS, budget)
    dealt = fps.select("fp", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), at(F.col("fp"), s, w).alias("v")) for k, (s, w) in enumerate(first)])).alias("b")).select("fp", "b.k", "b.v")
    much = written(dealt.groupBy("k", "v").agg(F.count("*").alias("n")).where(F.col("n") > hot).select("k", "v", F.lit(True).alias("much")), "simhash-hot")
    dealt = dealt.join(much, ["k", "v"], "left")
    # a hot value is parted by blocks of the other bits: rotate its own away, then the lowest 48 bits are the others
    inner = []
    for k, (s, w) in enumerate(first):
        others = _rotated(F.col("fp"), s + w)
        inner.append(F.array(*[F.struct(F.lit(j).alias("j"), at(others, t, v).alias("x")) for j, (t, v) in enumerate(_blocks(BITS - w, budget))]))
    more = F.element_at(F.array(*inner), (F.col("k") + 1).cast("int"))
    once = F.array(F.struct(F.lit(-1).alias("j"), F.lit(0).cast("long").alias("x")))
    dealt = dealt.withColumn("m", F.explode(F.when(F.col("much"), more).otherwise(once))).select("k", "v", "m.j", "m.x", "fp")
    n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = dealt.repartition(n, "k", "v", "j", "x").sortWithinPartitions("k", "v", "j", "x")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, values in _chunks(batches):
            edges = _edges(keys, values, budget)
            yield pa.RecordBatch.from_arrays([pa.array(edges[0], pa.int64()), pa.array(edges[1], pa.int64())], ["a", "b"])
        trim()

    return sorted_.mapInArrow(join, "a long, b long").distinct()


def _rotated(fp, right: int):
    right %= BITS
    return fp if not right else F.shiftrightunsigned(fp, right).bitwiseOR(F.shiftleft(fp, BITS - right))


def _chunks(batches: Iterator[pa.RecordBatch], least: int = CHUNK) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(keys, fingerprints) of whole groups, of `least` rows or a little more at a time."""
    keys: list[np.ndarray] = []
    fps: list[np.ndarray] = []
    have = 0
    for b in batches:
        keys.append(np.stack([b[c].to_numpy().astype(np.int64) for c in ("k", "v", "j", "x")], axis=1))
        fps.append(b["fp"].to_numpy().view(np.uint64))
        have += b.num_rows
        if have >= least:
            k, f = np.concatenate(keys), np.concatenate(fps)
            last = int(np.flatnonzero((k != k[-1]).any(axis=1)).max(initial=-1)) + 1  # the last group may go on
            if last:
                yield k[:last], f[:last]
                k, f = k[last:], f[last:]
            keys, fps, have = [k], [f], len(f)
    if have:
        yield np.concatenate(keys), np.concatenate(fps)


def _edges(keys: np.ndarray, fps: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    changed = np.concatenate(([True], (keys[1:] != keys[:-1]).any(axis=1)))
    group = np.cumsum(changed)
    order = np.lexsort((fps, group))
    values, group = fps[order], group[order]
    root = trie_join(values, group, BITS, budget)
    linked = root != np.arange(len(root))
    return values[root[linked]].view(np.int64), values[linked].view(np.int64)


def near_duplicates(docs: DataFrame, keep: list[str] | None = None, budget: int = BUDGET, hot: int = HOT) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, the columns `keep`, fingerprint (16 lower-case hex digits) and component_id: the smallest doc_id that is reached by
    links of fingerprints.

    Equal fingerprints are one node, so copies make no pairs. A null or empty text has the fingerprint zero, linked like any other; a null doc_id counts only where a component has no other (its id is null then);
    repeated rows are kept; whole texts count, however long; an empty table gives an empty one.
    """
    keep = [c for c in keep or [] if c not in ("doc_id", "fp", "_fp", "fingerprint", "component_id")]
    with scratch() as hold:
        own = hold(written(fingerprints(docs, ["doc_id", *keep]), "fingerprints"))
        nodes = written(own.groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes")
        found = written(components(links(nodes.select("fp"), budget, hot)), "components")
        named = written(nodes.join(found, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("component", "fp").alias("c")), "named")
        least = written(named.groupBy("c").agg(F.min("first").alias("component_id")), "least")
        by_fp = hold(written(named.select("fp", "c").join(least, "c").select(F.col("fp").alias("_fp"), "component_id"), "by-fingerprint"))
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0")).cast(StringType())
    return own.join(by_fp, F.col("fp") == F.col("_fp")).select("doc_id", *keep, hexed.alias("fingerprint"), "component_id")
