"""Exact substring deduplication by suffix arrays: every byte that a string of `length` bytes covers goes if that string also starts anywhere else.

Texts are dealt to shards by content. The windows of `length` bytes at consecutive places that share the smallest hash of their `gram`-byte strings form a
segment, and that hash is its key. Equal windows have equal strings, so they meet under one key, whatever stands around them. Segments whose key occurs once
go, unless they repeat within themselves; equal segments are one with a count. Each shard's segments are one string, whose suffix array induced sorting makes, and permuted common prefixes tell
which windows occur twice. A key that holds more distinct bytes than a shard is parted by the same rule with longer strings, up to the whole window.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import scratch, trim, written
from .induced_sorting import common_prefixes, suffix_array

#: Bytes of a string whose repetition counts; bytes of the strings whose hashes are keys.
LENGTH, GRAM = 400, 64
#: Distinct bytes of a shard's segments, about; a key with more is parted.
SHARD = 1 << 20
#: Window starts of a segment at most: runs of a short period share a key for long. Bytes that are hashed at once.
LONGEST, PORTION = 4096, 256 << 10
#: An odd base of the polynomial hash.
BASE = 0x9E3779B97F4A7C15


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE and its inverse, modulo 2**64, to the powers 0 to n - 1."""
    def powers(b: int) -> np.ndarray:
        out = np.full(n, b, np.uint64)
        out[0] = 1
        return np.cumprod(out)

    return powers(BASE), powers(pow(BASE, -1, 1 << 64))


def _window_keys(data: np.ndarray, gram: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window of `length` bytes the smallest hash of the strings of `gram` bytes in it, and whether that is the hash of its first."""
    up, down = _powers(PORTION + LENGTH + length)
    sums = np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)])
    least = sums[gram - 1 :].copy()
    least[1:] -= sums[:-gram]
    least *= down[: len(least)]  # now the same wherever the string stands
    least ^= least >> np.uint64(29)
    least *= np.uint64(0xBF58476D1CE4E5B9)
    least ^= least >> np.uint64(32)
    first, width, span = least, length - gram + 1, 1
    while 2 * span <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < width:
        least = np.minimum(least[: span - width], least[width - span :])
    return least.view(np.int64), first[: len(least)] == least


def segments(data: np.ndarray, offsets: np.ndarray, gram: int = GRAM, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """(string, start, starts, key, folded) of the segments of many strings that lie end to end: segments part the places where a window can start.

    `folded`: two windows of the segment may be equal. Then the text repeats between them, and so the string with the key's hash is the first of a window that isn't the
    segment's last; where the string stands once in the segment, all windows hold it, and that isn't so.
    """
    found: list[tuple[np.ndarray, ...]] = []

    def portion(first: int, last: int, at: int, stop: int) -> None:
        """Strings first to last - 1, whose bytes from `at` to `stop` are looked at; more than one string only if they are whole."""
        keys, leads = _window_keys(data[at:stop], gram, length)
        ends = offsets[first + 1 : last + 1]
        many = np.minimum(ends, stop) - np.maximum(offsets[first:last], at)
        string = np.repeat(np.arange(first, last), many)[: len(keys)]
        place = np.arange(at, at + len(keys))
        valid = place + length <= offsets[string + 1]
        new = np.append(True, (keys[1:] != keys[:-1]) | (string[1:] != string[:-1]) | (valid[1:] != valid[:-1]))
        begin = np.flatnonzero(new)
        run = np.diff(begin, append=len(keys))
        begin, run = begin[valid[begin]] + at, run[valid[begin]]
        if len(run) and run.max() > LONGEST:
            parts = -(-run // LONGEST)
            k = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
            begin, run = np.repeat(begin, parts) + k * LONGEST, np.minimum(np.repeat(run, parts) - k * LONGEST, LONGEST)
        led = np.append(0, np.cumsum(leads))
        folded = led[begin - at + run - 1] > led[begin - at]
        found.append((string[begin - at], begin - offsets[string[begin - at]], run, keys[begin - at], folded))

    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + PORTION, "right")) - 1
        if j > i:  # whole strings
            if offsets[j] - offsets[i] >= length:
                portion(i, j, int(offsets[i]), int(offsets[j]))
            i = j
        else:  # a long one, cut by its own places
            for at in range(int(offsets[i]), int(offsets[i + 1]) - length + 1, PORTION):
                portion(i, i + 1, at, min(at + PORTION + length - 1, int(offsets[i + 1])))
            i += 1
    if not found:
        return (*(np.zeros(0, np.int64) for _ in range(4)), np.zeros(0, bool))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A binary column's bytes end to end and its offsets."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if not offsets[-1]:
        return np.zeros(0, np.uint8), offsets
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def repeated(contents: list[bytes], many: np.ndarray, length: int = LENGTH) -> list[tuple[int, int, int]]:
    """(segment, first, last) of the runs of window starts that occur twice or more, in these distinct segments or because the segment itself does."""
    sizes = np.array([len(c) for c in contents])
    text = np.frombuffer(b"\0".join(contents) + b"\0\0", np.uint8).astype(np.uint16) + 2
    ends = np.cumsum(sizes + 1)
    text[ends - 1], text[-1] = 1, 0
    suffixes = suffix_array(text, 258)
    shared, left = common_prefixes(text, suffixes, separator=1)
    hit = shared >= length
    hit[left[hit]] = True
    segment = np.repeat(np.arange(len(contents)), sizes + 1)
    place = np.arange(len(segment)) - np.repeat(ends - sizes - 1, sizes + 1)
    hit = (hit[:-1] | (many > 1)[segment]) & (place <= sizes[segment] - length)
    hit[ends - 1] = False
    edges = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    first, last = np.flatnonzero(edges > 0), np.flatnonzero(edges < 0) - 1
    return list(zip(segment[first].tolist(), place[first].tolist(), place[last].tolist(), strict=True))


def _first_pass(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            string, start, starts, key, folded = segments(*_flat(b["data"]), gram, length)
            yield pa.RecordBatch.from_arrays([b["rid"].take(pa.array(string)), pa.array(start.astype(np.int32)), pa.array(starts.astype(np.int32)), pa.array(key), pa.array(folded)], ["rid", "start", "starts", "key", "folded"])
        trim()

    return run


def _parted(length: int, gram: int):
    """Segments of segments: where each stands in its parent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            string, start, starts, key, folded = segments(*_flat(b["content"]), gram, length)
            content = b["content"].to_pylist()
            parts = [content[i][s : s + n + length - 1] for i, s, n in zip(string.tolist(), start.tolist(), starts.tolist(), strict=True)]
            rows = pa.array(string)
            yield pa.RecordBatch.from_arrays(
                [b["key"].take(rows), b["cid"].take(rows), pa.array(start.astype(np.int32)), pa.array(key), pa.array(parts, pa.binary()), b["n"].take(rows), pa.array(folded)], ["above_key", "above_cid", "start", "key", "content", "n", "folded"]
            )

    return run


def _shard(length: int):
    def run(group: pa.Table) -> pa.Table:
        group = group.take(pa.compute.sort_indices(group, sort_keys=[("key", "ascending"), ("cid", "ascending")]))
        found = repeated(group["content"].to_pylist(), group["n"].to_numpy(), length)
        rows, first, last = zip(*found, strict=True) if found else ((), (), ())
        rows = pa.array(rows, pa.int64())
        trim()
        return pa.table({"key": group["key"].take(rows), "cid": group["cid"].take(rows), "first": pa.array(first, pa.int32()), "last": pa.array(last, pa.int32())})

    return run


def digest(data: Column) -> Column:
    """128 bits of the SHA-256: what tells texts and segments apart."""
    return F.unhex(F.substring(F.sha2(data, 256), 1, 32))


def _distinct(rows: DataFrame, name: str) -> DataFrame:
    return written(rows.groupBy("key", "cid").agg(F.first("content").alias("content"), F.sum("n").alias("n")), name)


def _again(rows: DataFrame, many: Column) -> DataFrame:
    """Keys of segments in which a window may occur twice."""
    return rows.groupBy("key").agg(many.alias("n"), F.max("folded").alias("folded")).where("n > 1 OR folded").select("key")


def marks(contents: DataFrame, length: int, gram: int, shard: int) -> DataFrame:
    """contents(key, cid, content, n), one row a distinct segment -> key, cid, first, last: the runs of window starts that occur twice or more."""
    sizes = contents.groupBy("key").agg(F.sum(F.octet_length("content")).alias("size"))
    heavy = written(sizes.where(F.col("size") > shard).select("key"), "heavy-keys") if gram < length else None
    parted = heavy is not None and not heavy.isEmpty()
    light = contents.join(heavy, "key", "left_anti") if parted else contents
    total = light.agg(F.sum(F.octet_length("content"))).first()[0] or 0
    own = light.withColumn("_shard", F.pmod(F.xxhash64("key"), F.lit(-(-total // shard) or 1)))
    out = own.groupBy("_shard").applyInArrow(_shard(length), "key long, cid binary, first int, last int")
    if not parted:
        return written(out, "marks")
    finer = length - (length - gram) // 2
    cut = contents.join(heavy, "key", "left_semi").mapInArrow(_parted(length, finer), "above_key long, above_cid binary, start int, key long, content binary, n long, folded boolean")
    cut = written(cut.withColumn("cid", digest(F.col("content"))), "parted")
    again = written(_again(cut, F.sum("n")), "parted-keys")
    below = marks(_distinct(cut.join(again, "key"), "parted-contents"), length, finer, shard)
    up = cut.drop("content", "n", "folded").join(below, ["key", "cid"])
    up = up.select(F.col("above_key").alias("key"), F.col("above_cid").alias("cid"), (F.col("first") + F.col("start")).alias("first"), (F.col("last") + F.col("start")).alias("last"))
    return written(out.unionByName(up), "marks")


def find(texts: DataFrame, length: int = LENGTH, gram: int = GRAM, shard: int = SHARD) -> DataFrame:
    """texts(rid, data) with a row for each copy -> rid, spans: for each distinct text that loses bytes the byte ranges (start, stop), which may overlap."""
    with scratch() as keep:
        long = texts.where(F.octet_length("data") >= length)
        light = written(long.mapInArrow(_first_pass(length, min(gram, length)), "rid binary, start int, starts int, key long, folded boolean"), "segments")
        again = written(_again(light, F.count("*")), "segment-keys")
        wanted = light.join(again, "key").groupBy("rid", "start", "starts", "key").agg(F.count("*").alias("n"))
        lists = wanted.groupBy("rid").agg(F.collect_list(F.struct("start", "starts", "key", "n")).alias("own"))  # a text's own segments
        once = long.groupBy("rid").agg(F.first("data").alias("data"))
        cut = once.join(lists, "rid").select("rid", "data", F.inline("own"))
        cut = cut.select("rid", "start", "key", "n", F.expr(f"substring(data, start + 1, starts + {length - 1})").alias("content"))
        cut = written(cut.withColumn("cid", digest(F.col("content"))), "cut")
        found = marks(_distinct(cut, "contents"), length, min(gram, length), shard)
        spans = cut.select("rid", "start", "key", "cid").join(found, ["key", "cid"])
        spans = spans.select("rid", F.struct((F.col("start") + F.col("first")).alias("start"), (F.col("start") + F.col("last") + length).alias("stop")).alias("span"))
        return keep(written(spans.groupBy("rid").agg(F.collect_list("span").alias("spans")), "spans"))


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        kept, spans = [], []
        for data, found in zip(b["_data"].to_pylist(), b["_spans"].to_pylist(), strict=True):
            merged: list[list[int]] = []
            for s in sorted((x["start"], x["stop"]) for x in found or ()):
                if merged and s[0] <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], s[1])
                else:
                    merged.append(list(s))
            edges = [0, *(x for m in merged for x in m), len(data)]
            kept.append(b"".join(data[i:j] for i, j in zip(edges[::2], edges[1::2], strict=True)))
            spans.append([{"start": i, "stop": j} for i, j in merged])
        own = b.drop_columns(["_data", "_spans"])
        kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
        yield pa.RecordBatch.from_arrays([*own.columns, pa.array(kept, pa.binary()), pa.array(spans, kind)], [*own.schema.names, "kept", "removed"])


def remove_repeats(docs: DataFrame, keep: list[str], length: int = LENGTH, gram: int = GRAM, shard: int = SHARD) -> DataFrame:
    """The columns `keep` of docs(text, ...), n_bytes, kept (the bytes that stay) and removed (the maximal byte ranges that go, from start up to stop).

    A null text counts as empty and loses nothing, and neither does a text shorter than `length`; strings are judged on the input, within a text and across
    texts, and never run from one text into the next. Copies of a text and repeated rows lose all strings of `length` bytes; ids may be null or repeated. Columns of `keep`
    named like a result are replaced; other columns are left out. An empty table gives an empty one. A task holds one batch of texts or one shard.
    """
    data = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    texts = docs.select(data.alias("data")).select(digest(F.col("data")).alias("rid"), "data")
    spans = find(texts, length, gram, shard)
    keep = [c for c in keep if c not in ("n_bytes", "kept", "removed", "_data", "_spans", "_rid")]
    own = docs.select(*keep, data.alias("_data")).withColumn("_rid", digest(F.col("_data")))
    joined = own.join(spans.select(F.col("rid").alias("_rid"), F.col("spans").alias("_spans")), "_rid", "left").drop("_rid").withColumn("n_bytes", F.octet_length("_data").cast("long"))
    schema = joined.drop("_data", "_spans").schema.add("kept", T.BinaryType()).add("removed", T.ArrayType(T.StructType().add("start", T.IntegerType()).add("stop", T.IntegerType())))
    return joined.mapInArrow(_cut_out, schema)
