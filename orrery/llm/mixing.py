"""Mixing sources to target weights (native): systematic sampling.

Each document's expected copies are laid end to end within its source; one random offset a source is added, and a
document is emitted once for each integer boundary that its stretch crosses.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_written, global_rank, scratch, word_count, written

#: Weights that the sources take in turn, in code point order, null last; the share of all words to take; most copies.
WEIGHTS, SHARE_PERCENT, MOST = (3, 1, 2), 150, 2


#: Up to so many sources are ranked by one task; more by range partitions.
ONE_TASK = 50_000


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share_percent: int = SHARE_PERCENT, most: int = MOST, one_task: int = ONE_TASK) -> DataFrame:
    """targets(source, source_size), which is read several times -> + weight, target: the share is dealt by weight; what would exceed `most` times a source's size goes
    to the others by weight, until none is above.

    That ends at the level L with sum(min(most * size, weight * L)) = share. Sources are sorted by the level at which they
    fill; the level is found from running sums of integers, so the result is the same everywhere. One row a source.
    """
    few = sizes.count() <= one_task
    last = [F.col("source").isNull().asc(), F.col("source").asc()]

    def ranked(df: DataFrame, order: list[Column], name: str, sums: tuple[str, ...] = ()) -> DataFrame:
        if not few:
            return global_rank(df, order, name, "_rank", sums)
        w = Window.orderBy(*order)
        before = {f"before_{c}": F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) for c in sums}
        return df.withColumns({"_rank": F.row_number().over(w) - 1, **before})

    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod("_rank", F.lit(len(weights))) + 1).cast("int"))
    own = ranked(sizes, last, "mix-places").withColumn("weight", weight.cast("long")).drop("_rank")
    out = ranked(own, [(F.col("source_size") / F.col("weight")).asc(), *last], "mix-levels", ("source_size", "weight")).drop("_rank")
    out = written(out, "mix-running")
    sums = out.agg(F.sum("source_size"), F.sum("weight")).first()
    whole, all_weights = (F.lit(x or 0).cast("long") for x in sums)
    rest = all_weights - F.col("before_weight")
    # a source is full if the level from itself on reaches its own; whole numbers on both sides, in hundredths of a word
    left = whole * share_percent - F.col("before_source_size") * (100 * most)
    full = left * F.col("weight") >= F.col("source_size") * rest * (100 * most)
    first = out.where(~full).agg(F.min(F.struct("before_source_size", rest.alias("rest")))).first()[0]
    past, divided = (first[0], first[1]) if first else (0, 1)
    share = (whole * share_percent - F.lit(past).cast("long") * (100 * most)) * F.col("weight")
    target = F.when(full, (F.col("source_size") * most).cast("double")).otherwise(share.cast("double") / (F.lit(divided).cast("long") * 100).cast("double"))
    return out.select("source", "source_size", "weight", target.alias("target"))


def offset(source: Column, seed: int) -> Column:
    """A number in [0, 1) from the source's name and the seed."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(source, F.lit("\x00null")))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share_percent: int = SHARE_PERCENT, most: int = MOST, seed: int = 42, keep: list[str] | None = None) -> DataFrame:
    """docs(doc_id, text, source, ...) -> doc_id, source, the columns `keep`, size, source_size, target, copies: one row a row of docs.

    All documents of a source expect target / source_size copies. They are laid out by size, then doc_id, then a hash of what else they hold, so that reruns agree and any stretch of
    the source has its share of words and the words taken miss the target by little. The places come from
    global_rank: a source that holds most rows spreads over many partitions. A null or empty text has size 0; a source
    without words has target 0; null sources are one source; repeated rows each get copies of their own; very long texts count whole; an empty table gives an empty one.
    """
    keep = [c for c in keep or [] if c not in ("doc_id", "source", "size", "source_size", "target", "copies", "_tie")]
    tie = F.xxhash64("text", *[c for c in keep if c != "text"])
    own = docs.select("doc_id", "source", *keep, word_count(F.col("text")).alias("size"), tie.alias("_tie"))
    done = []
    if not keep:
        own = written(own, "mix-sizes")  # small, and read twice
        done.append(own)
    with scratch() as hold:
        sizes = written(own.groupBy("source").agg(F.sum("size").alias("source_size")), "mix-sources")
        by = hold(written(targets(sizes, weights, share_percent, most), "mix-targets"))
    ranked = global_rank(own, [F.col("source").asc_nulls_last(), F.col("size").asc(), F.col("doc_id").asc(), F.col("_tie").asc()], "mix-ranks")
    first = ranked.groupBy(F.col("source").alias("_s")).agg(F.min("rank").alias("_first"))
    starts = written(by.join(first, F.col("source").eqNullSafe(F.col("_s"))).select(F.col("source").alias("_source"), "source_size", "target", "_first"), "mix-starts")
    drop_written(*done, by)
    out = ranked.join(starts, F.col("source").eqNullSafe(F.col("_source")))
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size").cast("double")).otherwise(F.lit(0.0))
    at = F.col("rank") - F.col("_first")
    u = offset(F.col("source"), seed)
    crossed = F.floor(each * (at + 1).cast("double") + u) - F.floor(each * at.cast("double") + u)
    copies = F.least(crossed, F.lit(most)).cast("long")
    return out.select("doc_id", "source", *keep, "size", "source_size", "target", copies.alias("copies"))


def emit(mixed: DataFrame) -> DataFrame:
    """Each row of mix()'s result so many times as it has copies."""
    return mixed.where("copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).drop("_copy")
