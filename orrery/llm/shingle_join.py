"""Near copies by SimHash, completed by an exact join: the documents that are linked by a Jaccard similarity of 0.8 or more of five-word shingles.

The trie join of fingerprints (simhash) finds copies with few edits. It can't find all pairs of that similarity: they differ in
about 10 of 64 bits, and at such a budget nearly all pairs of nodes stay open. So what it finds is verified on whole sets, and the
pairs that it can't reach are found by a prefix-filtered join: with shingles in one order for all texts, two similar sets share
one of the first n - ceil(0.8 n) + 1 of either. Any order is right; here shingles that a sample shows to be frequent come last, so
that passages of many texts make few candidates.

The first round links each text by its fingerprint and with the nearest of one leader a shingle and range of sizes; a few more do so with other leaders, of other components than the text's; the last
compares only texts of different components so far, and of a shingle's texts none of its largest component with one another. So a group of near copies
doesn't make all its pairs. Sets take several bytes a word: only those of candidates are written.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructType

from . import simhash
from .common import components, scratch, trim, written

WORDS, SEED = 5, 42
#: Similar: 5 * |both| >= 4 * |either|, a Jaccard similarity of 0.8.
OVER, UNDER = 4, 5
#: Sets of one in SAMPLE show which shingles are frequent: in FREQUENT of them; the HOT most frequent come last. These only order shingles.
SAMPLE, FREQUENT, HOT = 50, 5, 50_000
#: Bits of a set's parity sketch, at least; it has two to four a shingle. Sets differ in as many shingles at least as their sketches in bits.
PARITY = 512
#: Rounds, at most, in which sets are held against leaders of other components before all that is left is compared.
ROUNDS = 1
#: So many keys are broadcast at most, 16 bytes each; more are joined.
FEW = 200_000


def shingles(text: bytes | None, n: int = WORDS) -> tuple[np.ndarray, int]:
    """The sorted distinct hashes of the word n-grams (one of the empty text for a text without words), and the fingerprint over all of them."""
    hashes = simhash.shingle_hashes(text, n, SEED)
    distinct = np.unique(hashes) if len(hashes) else np.array([xxhash.xxh64_intdigest(b"", SEED)], np.uint64)
    return np.sort(distinct.view(np.int64)), simhash.fingerprint_of(hashes)


def parity(grams: np.ndarray) -> np.ndarray:
    """A bit of each residue of hashes, set if an odd number of shingles have it. Of twice the bits, the halves' XOR is the smaller sketch."""
    bits = max(PARITY, 1 << (2 * len(grams) - 1).bit_length())
    return np.packbits((np.bincount(grams & (bits - 1), minlength=bits) & 1).astype(np.uint8)).view(np.int64)


def signature(grams: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(grams.tobytes(), SEED)).view(np.int64))


class Order:
    """The one order of shingles: those of `hot`, the most frequent first, come last, and the most frequent last of all; the others by their hash."""

    def __init__(self, hot: list[int]):
        late = np.array(hot, np.int64)
        place = np.argsort(late)
        self.known, self.rank = late[place], len(late) - place

    def prefix(self, grams: np.ndarray) -> tuple[np.ndarray, int]:
        """The first n - ceil(0.8 n) + 1 shingles, and how many of them aren't hot."""
        size = len(grams) - -(-OVER * len(grams) // UNDER) + 1
        if not len(self.known):
            return grams[:size], size
        place = np.minimum(np.searchsorted(self.known, grams), len(self.known) - 1)
        hot = self.known[place] == grams
        cold = grams[~hot][:size]
        if len(cold) == size:
            return cold, size
        return np.concatenate([cold, grams[hot][np.argsort(self.rank[place[hot]])]])[:size], len(cold)


def _lists(sets: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*sets, np.zeros(0, np.int64)])))


def sketched(docs: DataFrame, keep: list[str], order: Order) -> DataFrame:
    """docs(text, ...) -> the columns `keep`, sig (a hash of the set), fp, n (its size), parity, prefix (its first shingles in the order) and cold (how many of them aren't hot)."""

    def batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for t in b.column(b.num_columns - 1).cast(pa.binary()):
                grams, fp = shingles(t.as_py())
                first, cold = order.prefix(grams)
                rows.append((signature(grams), np.uint64(fp).view(np.int64), len(grams), cold, parity(grams), first))
            sig, fp, n, cold, bits, first = zip(*rows, strict=True) if rows else ([],) * 6
            longs = [pa.array(x, pa.int64()) for x in (sig, fp, n, cold)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *longs, _lists(list(bits)), _lists(list(first))], [*b.schema.names[:-1], *NEW])
        trim()

    own = docs.select(*keep, F.col("text").alias("__orrery_text"))
    schema = StructType(own.schema.fields[:-1])
    for name in NEW:
        schema = schema.add(name, ArrayType(LongType()) if name in ("parity", "prefix") else LongType())
    return own.mapInArrow(batch, schema)


NEW = ["sig", "fp", "n", "cold", "parity", "prefix"]


def whole_sets(docs: DataFrame) -> DataFrame:
    """docs(text, ...) -> sig, grams (the set, sorted)."""

    def batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(t.as_py())[0] for t in b["text"].cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([pa.array([signature(s) for s in sets], pa.int64()), _lists(sets)], ["sig", "grams"])
        trim()

    return docs.select("text").mapInArrow(batch, "sig long, grams array<long>")


def frequent(docs: DataFrame) -> Order:
    """The order of shingles, from a sample of the distinct sets chosen by a hash of the text. At most HOT of them come to the driver."""
    with scratch():
        some = written(whole_sets(docs.select("text").where(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0)), "sampled-sets")
        seen = some.dropDuplicates(["sig"]).select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))
        return Order([r["gram"] for r in seen.where(F.col("n") >= FREQUENT).orderBy(F.desc("n"), "gram").limit(HOT).collect()])


def few(keys: DataFrame) -> DataFrame:
    """A written table of keys, marked for broadcast if a count shows that it is small."""
    return F.broadcast(keys) if keys.count() <= FEW else keys


def is_row(left: str = "doc_id", right: str = "__orrery_id") -> Column:
    return F.col(left).eqNullSafe(F.col(right)) & (F.col("__orrery_row") == F.col("__orrery_key"))


def close(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """The pairs (a, b) that can be similar by their sizes and sketches (sig, n, parity), and differ: in how many bits of the sketch. Similar sets differ in (n1 + n2) / 9 shingles at most, so none is lost."""
    one, two = (sketches.select(F.col("sig").alias(k), F.col("n").alias(f"n{k}"), F.col("parity").alias(f"p{k}")) for k in "ab")
    xor = lambda x, y: F.zip_with(x, y, lambda p, q: p.bitwiseXOR(q))
    size = F.least(F.size("pa"), F.size("pb"))  # sizes so near have sketches of one size, or one of twice the other's
    folded = lambda p: F.when(F.size(p) == size, F.col(p)).otherwise(xor(F.slice(p, F.lit(1), size), F.slice(p, size + 1, size)))
    differ = F.aggregate(xor(folded("pa"), folded("pb")), F.lit(0), lambda acc, x: acc + F.bit_count(x))
    sized = pairs.join(one, "a").join(two, "b").where(F.greatest("na", "nb") * OVER <= F.least("na", "nb") * UNDER)
    return sized.withColumn("differ", differ).where(F.col("differ") * (OVER + UNDER) <= F.col("na") + F.col("nb")).select("a", "b", "differ")


def verified(pairs: DataFrame, keyed: DataFrame, best: DataFrame) -> DataFrame:
    """The written table of the pairs (a, b) whose whole sets are similar. Only their sets are made and moved."""
    with scratch() as keep:
        pairs = written(pairs, "candidates")
        ids = written(pairs.select(F.explode(F.array("a", "b")).alias("sig")).distinct(), "candidate-ids")
        rows = written(best.join(few(ids), "sig", "left_semi").select(F.col("row.doc_id").alias("__orrery_id"), F.col("row.__orrery_row").alias("__orrery_key")), "candidate-rows")
        grams = written(whole_sets(keyed.join(few(rows), is_row(), "left_semi")), "candidate-sets")
        left = grams.select(F.col("sig").alias("a"), F.col("grams").alias("ga"))
        right = grams.select(F.col("sig").alias("b"), F.col("grams").alias("gb"))
        both = F.size(F.array_intersect("ga", "gb"))
        found = pairs.join(right, "b").join(left, "a").where(both * (OVER + UNDER) >= (F.size("ga") + F.size("gb")) * OVER)
        return keep(written(found.select("a", "b"), "links"))


def held_prefixes(own: DataFrame, best: DataFrame) -> DataFrame:
    """(gram, sig, n, at): the prefixes of the distinct sets, without the shingles that only one of them has there; at: the place, from 0.

    Shingles known to be frequent are shared by the sample; the others' rows meet by shingle, and there are few of each.
    """
    rows = own.join(best.select("sig", "row"), ["sig", "row"], "left_semi").select("sig", "n", "cold", F.posexplode("prefix").alias("at", "gram"))
    hot = F.col("at") >= F.col("cold")
    place = F.shiftleft(F.col("n"), 32).bitwiseOR(F.col("at").cast("long"))  # one long, as these rows are the bulk of what moves
    rows = rows.select("gram", "sig", place.alias("place"), F.when(hot, F.xxhash64("gram", "sig")).otherwise(F.col("gram")).alias("meet"), hot.alias("hot"))
    meet = Window.partitionBy("meet")
    shared = rows.withColumns({"lo": F.min("sig").over(meet), "hi": F.max("sig").over(meet)}).where("hot or lo <> hi")
    return shared.select("gram", "sig", F.shiftright("place", 32).alias("n"), F.col("place").bitwiseAND(F.lit((1 << 32) - 1)).alias("at"))


def led_pairs(held: DataFrame, best: DataFrame, salt: int, part: DataFrame | None = None) -> DataFrame:
    """Candidates (a, b): of the leaders of a set's shingles and range of sizes the nearest, of another component than its own where `part`(sig, component) tells them. A shingle's leader is drawn by a hash of both, so that
    a group of near copies has many of them, and each round others: then a set that isn't similar to one is to another."""
    own = held if part is None else held.join(part, "sig", "left").withColumn("c", F.coalesce("component", "sig")).drop("component")
    own = own.withColumn("range", F.floor(F.log(F.col("n")) / F.log(F.lit(UNDER / OVER))))
    c = [] if part is None else ["c"]
    leader = own.groupBy("gram", "range").agg(F.min(F.struct(F.xxhash64("gram", "sig", F.lit(salt)).alias("h"), F.col("sig").alias("a"), *[F.col(x).alias("c_a") for x in c])).alias("l"), F.count("*").alias("k"))
    leader = written(leader.where("k > 1").select("gram", "range", "l.a", *["l.c_a" for _ in c]), "leaders")
    led = own.select("gram", "range", F.col("sig").alias("b"), *c).join(leader, ["gram", "range"]).where("a <> b" if part is None else "c <> c_a").select("a", "b").distinct()
    return close(written(led, "led"), best).groupBy("b").agg(F.min(F.struct("differ", "a")).alias("x")).select("x.a", "b")


def first_pairs(held: DataFrame, best: DataFrame) -> DataFrame:
    """Candidates (a, b) that are likely to span most components: by fingerprints, and by leaders."""
    nearest = led_pairs(held, best, 0)
    by_fp = written(best.groupBy("fp").agg(F.min("sig").alias("s")), "fingerprints")
    edges = written(simhash.links(by_fp.select("fp")), "fingerprint-links")
    one, two = (by_fp.select(F.col("fp").alias(k), F.col("s").alias(f"s{k}")) for k in "ab")
    near = edges.join(one, "a").join(two, "b").select(F.col("sa").alias("a"), F.col("sb").alias("b"))
    equal = best.select("fp", F.col("sig").alias("b")).join(by_fp, "fp").where("b <> s").select(F.col("s").alias("a"), "b")
    return nearest.unionByName(close(near.unionByName(equal), best).select("a", "b")).distinct()


def other_pairs(held: DataFrame, part: DataFrame, best: DataFrame) -> DataFrame:
    """All candidates (a, b) of different components: sets that share a shingle of their prefixes, at places that leave enough for both.

    Of similar sets, at the first shingle that they share no more than 1 + min(what follows in either) are shared, and that must reach 4 / 9 of both sizes. Of a
    shingle's sets only those outside its largest component are held against all others.
    """
    own = written(held.join(part, "sig", "left").withColumn("c", F.coalesce("component", "sig")).drop("component"), "parted")
    sizes = own.groupBy("gram", "c").agg(F.count("*").alias("k"))
    main = sizes.groupBy("gram").agg(F.max(F.struct("k", "c")).alias("most"), F.count("*").alias("parts")).where("parts > 1").select("gram", F.col("most.c").alias("main"))
    own = written(own.join(written(main, "mixed"), "gram"), "mixed-prefixes")
    a = own.where("c <> main").select("gram", *[F.col(x).alias(f"{x}_a") for x in ("sig", "n", "at", "c")])
    b = own.select("gram", *[F.col(x).alias(f"{x}_b") for x in ("sig", "n", "at", "c")])
    fits = (F.least(F.expr("n_a - at_a"), F.expr("n_b - at_b")) * (OVER + UNDER) >= (F.col("n_a") + F.col("n_b")) * OVER) & (F.greatest("n_a", "n_b") * OVER <= F.least("n_a", "n_b") * UNDER)
    met = a.join(b, "gram").where((F.col("c_a") != F.col("c_b")) & fits)
    met = met.select(F.least("sig_a", "sig_b").alias("a"), F.greatest("sig_a", "sig_b").alias("b")).distinct()
    return close(written(met, "met"), best).select("a", "b")


def survivors(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, ...), which is read several times -> one row of each component of similar texts: that of the smallest doc_id (nulls last), of repeated ids the one with the smallest hash.

    Rows are told apart by all their columns and not by doc_id alone, so repeated and null ids do no harm; of rows that are equal throughout one counts. Null texts and
    those without words are alike: one of them stays. Very long texts count whole. An empty table gives an empty one; other columns stay as they are.
    """
    keyed = docs.withColumn("__orrery_row", F.xxhash64(*docs.columns))
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__orrery_row").alias("row")
    key = [F.col("row.doc_id").alias("__orrery_id"), F.col("row.__orrery_row").alias("__orrery_key")]
    with scratch() as keep:
        own = written(sketched(keyed.select(row, "text"), ["row"], frequent(docs)), "sketches")
        again = keep(written(own.groupBy("row").count().where("count > 1").select(*key), "repeated"))
        if not again.isEmpty():
            some = few(again)
            keyed = keyed.join(some, is_row(), "left_anti").unionByName(keyed.join(some, is_row(), "left_semi").dropDuplicates(["doc_id", "__orrery_row"]))
        best = written(own.groupBy("sig").agg(F.min("row").alias("row"), F.min("fp").alias("fp"), F.min("n").alias("n"), F.first("parity").alias("parity")), "best")
        held = written(held_prefixes(own, best), "prefixes")
        found = verified(first_pairs(held, best), keyed, best)
        part = written(components(found), "parts").select(F.col("node").alias("sig"), "component")
        for salt in range(1, ROUNDS + 1):
            new = verified(led_pairs(held, best, salt, part), keyed, best)
            if new.isEmpty():
                break
            found = written(found.unionByName(new), "links")
            part = written(components(found), "parts").select(F.col("node").alias("sig"), "component")
        more = verified(other_pairs(held, part, best), keyed, best)
        part = written(components(found.unionByName(more)), "parts")
        named = written(own.select("sig", "row").join(part, F.col("sig") == F.col("node"), "left").select("row", F.coalesce("component", "sig").alias("c")), "named")
        first = named.groupBy("c").agg(F.min("row").alias("first"))
        gone = keep(written(named.join(first, "c").where(F.col("row") != F.col("first")).select(*key).distinct(), "gone"))
    return keyed.join(few(gone), is_row(), "left_anti").select(docs.columns)
