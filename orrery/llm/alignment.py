"""Alignment of two tokenizers by byte-owner arrays: np.repeat gives each byte its token of A and its token of B; where consecutive bytes' pairs of owners
differ, the pairs are the overlaps, and where both owners change at once, a cut parts the tokens into groups.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import cache
from hashlib import sha256
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import scratch, trim, written

#: Units (a word with the space before it, a punctuation mark, a new line) that a worker remembers; UTF-8 bytes of text that it aligns at once.
REMEMBERED, AT_ONCE = 300_000, 1 << 20
#: Links of a group beyond which they are counted without being listed.
WIDE = 1 << 16
#: Pairs of ids up to which their counts are broadcast: some 100 MB at most on an executor. Beyond, links and counts are joined by shuffles.
MOST_BROADCAST = 1_000_000
#: Punctuation marks that end a unit of letters.
MARKS = ".,;:!?"
#: Kinds of bytes: 0 any other, 1 a letter, 2 a mark, 3 other visible ASCII, 4 the first byte of a two-byte Latin letter, 5 a space, 6 a new line.
KINDS = np.zeros(256, np.int8)
KINDS[0x21:0x7F], KINDS[0xC3:0xCA], KINDS[0x20], KINDS[0x0A] = 3, 4, 5, 6
KINDS[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)]] = 1
KINDS[[ord(c) for c in MARKS]] = 2


def byte_symbols() -> dict[str, int]:
    """Characters by which byte-level vocabularies write bytes: printable Latin-1 stands for itself, the others for the characters from U+0100 on, in turn."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAC + 1), *range(0xAE, 0xFF + 1)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(others)}


def owners(a_sizes: np.ndarray, b_sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For tokens of A and of B over the same bytes, by their sizes: overlaps (pairs of a place in A and one in B, shape (n, 2)) and each token's group.

    Tokens are at least a byte long.
    """
    a, b = np.repeat(np.arange(len(a_sizes)), a_sizes), np.repeat(np.arange(len(b_sizes)), b_sizes)
    a_new, b_new = a[1:] != a[:-1], b[1:] != b[:-1]
    at = np.append(0, np.flatnonzero(a_new | b_new) + 1)[: len(a)]
    cut = np.append(0, np.cumsum(a_new & b_new))[: len(a)]
    overlaps = np.stack([a[at], b[at]], 1)
    first_a, first_b = np.append(0, np.cumsum(a_sizes[:-1]))[: len(a_sizes)], np.append(0, np.cumsum(b_sizes[:-1]))[: len(b_sizes)]
    return overlaps, cut[first_a], cut[first_b]


class Alignments(NamedTuple):
    """Alignments of many stretches of bytes, one after the other: tokens and groups of each, its groups' ids as text, and the links, each with its stretch."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    texts: list[str]
    stretch: np.ndarray
    pairs: np.ndarray  # id of A << 32 | id of B
    times: np.ndarray


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], ... starts[0] + sizes[0] - 1, starts[1], ..."""
    return np.repeat(starts - np.append(0, np.cumsum(sizes)[:-1])[: len(sizes)], sizes) + np.arange(sizes.sum())


def align(a_ids: np.ndarray, a_sizes: np.ndarray, b_ids: np.ndarray, b_sizes: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> Alignments:
    """Groups and links of stretches that lie end to end, n_a[i] and n_b[i] tokens each. A stretch's first byte is a cut. Links are all pairs of a token of A and one of B in a group;
    in a group with more than WIDE of them they are counted by pair of ids without being listed."""
    _, group_a, group_b = owners(a_sizes, b_sizes)
    n = int(group_a[-1]) + 1
    in_a, in_b = np.bincount(group_a, minlength=n), np.bincount(group_b, minlength=n)
    last_a, last_b = np.cumsum(in_a) - 1, np.cumsum(in_b) - 1
    # the groups' ids as text: each token with what follows it
    ends_a, ends_b = np.cumsum(n_a), np.cumsum(n_b)
    sign_a, sign_b = np.zeros(len(a_ids), np.int8), np.zeros(len(b_ids), np.int8)
    sign_a[last_a], sign_b[last_b] = 1, 2
    sign_b[ends_b - 1] = 3
    signs = (",", "|", ";", "")
    words = [str(i) + signs[k] for i, k in zip(np.concatenate([a_ids, b_ids]).tolist(), np.concatenate([sign_a, sign_b]).tolist(), strict=True)]
    order = np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable").tolist()
    ends = (ends_a + ends_b).tolist()
    words = [words[i] for i in order]
    texts = ["".join(words[i:j]) for i, j in zip([0, *ends], ends)]
    # links, by token of A
    stretch_a = np.repeat(np.arange(len(n_a)), n_a)
    wide = np.flatnonzero(in_a * in_b > WIDE)
    each = np.where(np.isin(group_a, wide), 0, in_b[group_a])
    other = _ranges((last_b - in_b + 1)[group_a], each)
    pairs, stretch, times = [np.repeat(a_ids << 32, each) | b_ids[other]], [np.repeat(stretch_a, each)], [np.ones(len(other), np.int64)]
    for g in wide.tolist():
        x, nx = np.unique(a_ids[last_a[g] - in_a[g] + 1 : last_a[g] + 1], return_counts=True)
        y, ny = np.unique(b_ids[last_b[g] - in_b[g] + 1 : last_b[g] + 1], return_counts=True)
        pairs.append(((x[:, None] << 32) | y[None, :]).ravel())
        times.append((nx[:, None] * ny[None, :]).ravel())
        stretch.append(np.full(len(times[-1]), stretch_a[last_a[g]]))
    stretch, pairs, times = np.concatenate(stretch), np.concatenate(pairs), np.concatenate(times)
    if len(wide):
        order = np.argsort(stretch, kind="stable")
        stretch, pairs, times = stretch[order], pairs[order], times[order]
    first = np.cumsum(n_a) - n_a
    n_groups = np.diff(np.append(group_a[first], n))
    return Alignments(n_a, n_b, n_groups, texts, stretch, pairs, times)


class Tokenizers:
    """A byte-level tokenizer (A, of the `tokenizers` library, given a space and the text) and a pieces model (B, of `sentencepiece`, which adds the space itself)."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        symbols = byte_symbols()
        vocab = self.a.get_vocab(with_added_tokens=False)
        self.a_bytes: list[bytes] = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.a_bytes[i] = bytes(symbols[c] for c in token)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_sizes, self.b_sizes = np.array([len(x) for x in self.a_bytes]), np.array([len(x) for x in self.b_bytes])
        # units can be told apart only where no token of either reaches across their border
        split = json.loads(self.a.to_str()).get("pre_tokenizer") or {}
        two = {p[i : i + 2] for i, p in enumerate(pieces) if not self.b.is_byte(i) for i in range(len(p) - 1)}
        self.by_units = split.get("type") == "ByteLevel" and split.get("use_regex", False) and not any(x[1] == "\n" or x[0] == "\n" or x[1] == "▁" and x[0] != "▁" or x[1] in MARKS and x[0].isalpha() for x in two)
        newline = next(i for i, x in enumerate(self.b_bytes) if x == b"\n")
        self.before = [*self.b.encode("\n")]  # what B puts before a text that begins with a new line, which nothing joins
        self.by_units &= self.before == [self.b.piece_to_id("▁"), newline]

    def aligned(self, stretches: list[bytes]) -> tuple[np.ndarray, Alignments | None]:
        """For stretches of UTF-8 text, which begin with a space or within a text: which of them both tokenizers give back unchanged, and the alignments of those."""
        texts = [x.decode() for x in stretches]
        a = [e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)]
        b = self.b.encode([t[1:] if t[0] == " " else "\n" + t for t in texts], num_threads=1)
        skip = len(self.before)
        b = [ids if t[0] == " " else ids[skip:] for t, ids in zip(texts, b, strict=True)]
        get_a, get_b = self.a_bytes.__getitem__, self.b_bytes.__getitem__
        fine = np.array([b"".join(map(get_a, x)) == raw == b"".join(map(get_b, y)) for raw, x, y in zip(stretches, a, b, strict=True)], bool)
        if not fine.any():
            return fine, None
        a, b = ([x for x, ok in zip(ids, fine, strict=True) if ok] for ids in (a, b))
        n_a, n_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (a, b))
        a, b = (np.fromiter(chain.from_iterable(x), np.int64, int(n.sum())) for x, n in ((a, n_a), (b, n_b)))
        return fine, align(a, self.a_sizes[a], b, self.b_sizes[b], n_a, n_b)


def unit_borders(raw: np.ndarray) -> np.ndarray:
    """Places in UTF-8 bytes where a unit begins, but the first: before a space or new line after a solid character, after a new line between two solid
    characters, and before a punctuation mark after a letter. Byte-level pre-tokenization parts all of these; solid characters are those of ASCII and of the Latin blocks, which are no white space."""
    kind = KINDS[raw]
    late = np.zeros(len(raw), bool)  # second bytes of Latin letters beyond ASCII
    late[1:] = kind[:-1] == 4
    solid = (kind == 1) | (kind == 2) | (kind == 3) | late
    letter = (kind == 1) | late
    sign = np.zeros(len(raw), bool)  # the multiplication and division signs
    sign[1:] = (raw[:-1] == 0xC3) & ((raw[1:] == 0x97) | (raw[1:] == 0xB7))
    letter &= ~sign
    begins = np.zeros(len(raw), bool)
    begins[1:] = solid[:-1] & (kind[1:] >= 5) | letter[:-1] & (kind[1:] == 2)
    after = solid[:-2] & (kind[1:-1] == 6) & ((kind[2:] <= 4) & (kind[2:] > 0))
    begins[2:] |= after
    return np.flatnonzero(begins)


class _Units:
    """Remembered alignments of units. A unit's first byte is a cut, so a text's alignment is its units' in turn."""

    def __init__(self, tokenizers: Tokenizers, remembered: int):
        self.tokenizers, self.remembered = tokenizers, remembered
        self.clear()

    def clear(self) -> None:
        self.place: dict[bytes, int] = {}
        self.texts: list[str] = []
        self.size = 0
        self.numbers, self.sizes = np.zeros((0, 3), np.int64), np.zeros(0, np.int64)
        self.pairs, self.times = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def learn(self, new: list[bytes]) -> None:
        fine, found = self.tokenizers.aligned(new)
        at = len(self.texts) + np.cumsum(fine) - 1
        self.place.update(zip(new, np.where(fine, at, -1).tolist(), strict=True))
        self.size += sum(map(len, new))
        if found:
            self.texts += found.texts
            self.numbers = np.vstack([self.numbers, np.stack([found.n_a, found.n_b, found.n_groups], 1)])
            self.sizes = np.append(self.sizes, np.bincount(found.stretch, minlength=len(found.texts)))
            self.pairs, self.times = np.append(self.pairs, found.pairs), np.append(self.times, found.times)

    def of(self, texts: list[bytes]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Of texts that begin with a space: n_a, n_b and n_groups (zeros where bytes change), the groups' text, and the distinct linked pairs with how often: text, pair, times."""
        raw = np.frombuffer(b"".join(texts), np.uint8)
        ends = np.cumsum([len(t) for t in texts])
        cuts = np.union1d(unit_borders(raw), np.append(0, ends[:-1])) if self.tokenizers.by_units else np.append(0, ends[:-1])
        whole, bounds = raw.tobytes(), np.append(cuts, len(raw)).tolist()
        units = [whole[i:j] for i, j in zip(bounds, bounds[1:])]
        text_of = np.searchsorted(ends, cuts, "right")
        new = set(units).difference(self.place)
        if len(self.place) + len(new) > self.remembered or self.size > 40 * self.remembered:
            self.clear()
            new = set(units)
        if new:
            self.learn(list(new))
        own = np.fromiter(map(self.place.__getitem__, units), np.int64, len(units))
        lost = np.unique(text_of[own < 0])  # here the whole text decides
        if len(lost):
            stay = ~np.isin(text_of, lost)
            own, text_of = own[stay], text_of[stay]
        numbers = np.stack([np.bincount(text_of, self.numbers[own, k], len(texts)) for k in range(3)], 1).astype(np.int64)
        many = np.bincount(text_of, minlength=len(texts))
        stops = np.cumsum(many).tolist()
        parts = list(map(self.texts.__getitem__, own.tolist()))
        out = [";".join(parts[i:j]) for i, j in zip([0, *stops], stops)]
        once, count = np.unique(text_of * max(1, len(self.texts)) + own, return_counts=True)
        text, unit = np.divmod(once, max(1, len(self.texts)))
        starts = np.append(0, np.cumsum(self.sizes)[:-1])[: len(self.sizes)]
        sizes = self.sizes[unit]
        at = _ranges(starts[unit], sizes)
        rows = [np.repeat(text, sizes)], [self.pairs[at]], [self.times[at] * np.repeat(count, sizes)]
        for k in lost.tolist():
            _, found = self.tokenizers.aligned([texts[k]]) if self.tokenizers.by_units else (None, None)
            if found:
                numbers[k], out[k] = (found.n_a[0], found.n_b[0], found.n_groups[0]), found.texts[0]
                for to, x in zip(rows, (np.full(len(found.pairs), k), found.pairs, found.times), strict=True):
                    to.append(x)
        text, pairs, times = (np.concatenate(x) for x in rows)
        order = np.lexsort((pairs, text))
        text, pairs, times = text[order], pairs[order], times[order]
        new = np.flatnonzero(np.append(True, (text[1:] != text[:-1]) | (pairs[1:] != pairs[:-1]))[: len(text)])
        return numbers, out, text[new], pairs[new], np.add.reduceat(times, new) if len(new) else times


@cache
def _units(a_path: str, b_path: str, remembered: int) -> _Units:
    """One a worker process, which serves many tasks."""
    return _Units(Tokenizers(a_path, b_path), remembered)


def _linked(b: pa.RecordBatch, units: _Units, names: list[str]) -> pa.RecordBatch:
    """The rows of a batch with their links."""
    texts = b["text"].cast(pa.binary()).to_pylist()
    have = np.array([k for k, t in enumerate(texts) if t], np.int64)
    numbers, groups, sizes, n_links = np.zeros((len(texts), 3), np.int64), [""] * len(texts), np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    pairs = times = np.zeros(0, np.int64)
    if len(have):
        own, out, text, pairs, times = units.of([b" " + texts[k] for k in have])
        numbers[have], sizes[have] = own, np.bincount(text, minlength=len(have))
        n_links[have] = np.bincount(text, times, len(have)).astype(np.int64)
        for k, x in zip(have.tolist(), out, strict=True):
            groups[k] = x
    each = pa.StructArray.from_arrays([pa.array((pairs >> 32).astype(np.int32)), pa.array((pairs & 0xFFFFFFFF).astype(np.int32)), pa.array(times)], ["a", "b", "times"])
    lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), each)
    hashes = pa.array([sha256(x.encode()).hexdigest() if x else "" for x in groups], pa.string())
    columns = [*(pa.array(numbers[:, k]) for k in range(3)), pa.array(n_links), hashes, lists, pa.array(groups, pa.string())]
    left = b.drop_columns(["text"])
    return pa.RecordBatch.from_arrays([*left.columns, *columns[: len(names)]], [*left.schema.names, *names])


def links(docs: DataFrame, a_path: str, b_path: str, remembered: int = REMEMBERED, with_groups: bool = False) -> DataFrame:
    """docs(text, ...) -> its other columns, n_a, n_b, n_groups, n_links, groups_sha256, links array<struct<a, b, times>> (the pairs of ids that are linked, and how often) and, if asked, groups (the text that is hashed).

    A text is tokenized whole. Null and empty texts, and those whose bytes either tokenizer changes, have zeros, an empty list and ''. Repeated rows have a row each; columns of these names are replaced.
    """
    names = ["n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links", *["groups"] * with_groups]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        units = _units(a_path, b_path, remembered)
        for b in batches:
            lengths = pc.fill_null(pc.binary_length(b["text"]), 0).to_numpy(zero_copy_only=False)
            for part in np.split(np.arange(len(b)), np.flatnonzero(np.diff(np.cumsum(lengths) // AT_ONCE)) + 1):
                if len(part):
                    rows = b.slice(int(part[0]), len(part))
                    yield _linked(rows, units, names)
        trim()

    docs = docs.drop(*names)
    schema = docs.drop("text").schema
    for name in names[:4]:
        schema = schema.add(name, T.LongType())
    schema = schema.add("groups_sha256", T.StringType()).add("links", T.ArrayType(T.StructType().add("a", T.IntegerType()).add("b", T.IntegerType()).add("times", T.LongType())))
    return docs.mapInArrow(run, schema.add("groups", T.StringType()) if with_groups else schema)


def pair_counts(linked: DataFrame) -> DataFrame:
    """linked(links) -> a, b, documents (rows that hold the pair), best (no pair of the same a is in more)."""
    with scratch() as keep:
        counts = keep(written(linked.select(F.inline("links")).groupBy("a", "b").agg(F.count("*").alias("documents")), "pair-counts"))
    top = counts.groupBy("a").agg(F.max("documents").alias("top"))  # a row an id of A
    return counts.join(top, "a").select("a", "b", "documents", (F.col("documents") == F.col("top")).alias("best"))


def score(linked: DataFrame, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """links()' rows with n_best and count_sum: links whose pair is in as many rows as any of its id of A, and the sum over links of the rows that hold the pair.

    The links are written once with a number a row. They meet their pairs' counts, by a broadcast while there are few pairs and by a shuffle else, and are summed up by row.
    Columns of these names are replaced; an empty table gives an empty one.
    """
    with scratch() as keep:
        rows = keep(written(linked.drop("n_best", "count_sum").withColumn("_row", F.monotonically_increasing_id()), "linked"))
        counts = keep(written(pair_counts(rows), "pair-scores"))
    counts = F.broadcast(counts) if counts.count() <= most_broadcast else counts
    best = F.sum(F.when(F.col("best"), F.col("times")).otherwise(0))
    per = rows.select("_row", F.inline("links")).join(counts, ["a", "b"]).groupBy("_row").agg(best.alias("n_best"), F.sum(F.col("times") * F.col("documents")).alias("count_sum"))
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")]
    return rows.join(per, "_row", "left").select(*[c for c in rows.columns if c != "_row"], *zero)
