"""Packing by minimum bin slack: a bitset subset-sum programme picks the multiset of remaining lengths that fills each
window closest to its capacity; back-tracking gives how many of each length it takes.
"""

from __future__ import annotations

import os
import re
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import trim

CAPACITY, END = 4096, 2
#: Documents are packed in groups of about so many by a hash; each group leaves a few windows at most that aren't full.
GROUP_DOCS = 4096
#: Words of which a worker remembers the ids; UTF-8 bytes of text that it encodes at once.
REMEMBERED, AT_ONCE = 400_000, 1 << 20
#: Lower-case Latin letters in UTF-8, composed.
PLAIN = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")
#: Punctuation that ends a word after a letter or digit: the tokenizer parts it from the word.
TAIL = re.compile(rb"[!#$%&*.,;:?](?:(?<=[A-Za-z0-9].)|(?<=\xc3[\x80-\x96\x98-\xb6\xb8-\xbf].))[!#$%&*.,;:?]*(?=[\x20\x09-\x0d]|\Z)", re.S)

#: White space, the punctuation marks of TAIL, and letters and digits, by byte.
BLANK, MARK, ALNUM = (np.isin(np.arange(256), list(x)) for x in (b" \t\n\r\x0b\x0c", b"!#$%&*.,;:?", b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"))


class WordTokens:
    """Ids of whole texts by a tokenizer of the `tokenizers` library that lower-cases, drops white space and splits at it and between letters and punctuation, so that
    a text's ids are its words' ids in turn. Words are lower-cased, parted from the punctuation that ends them, and remembered with their ids. New words of plain
    letters go to the tokenizer many at once, where `</w>` ends each, without the steps that leave such words as they are; all others one by one."""

    def __init__(self, path: str, remembered: int = REMEMBERED):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer, self.remembered = Tokenizer.from_file(path), remembered
        self.whole = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        self.plain = normalizers.Sequence([]), pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.ids: dict[bytes, bytes] = {}
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True

    def _ids(self, texts: list[bytes], steps: tuple) -> list[np.ndarray]:
        """The texts' ids with the given normaliser and first splits: one tokenizer serves for both, to save memory."""
        self.tokenizer.normalizer, self.tokenizer.pre_tokenizer = steps
        return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]

    def _learn(self, new: list[bytes]) -> None:
        plain = list(filter(PLAIN.fullmatch, new))
        rest = list(set(new).difference(plain))
        portions = [plain[at : at + 1000] for at in range(0, len(plain), 1000)]
        for some, ids in zip(portions, self._ids([b" ".join(p) for p in portions], self.plain), strict=True):
            cuts = ((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist()
            if len(cuts) == len(some):
                raw = ids.tobytes()
                self.ids.update(zip(some, (raw[i:j] for i, j in zip([0, *cuts], cuts)), strict=True))
            else:
                rest += some
        self.ids.update(zip(rest, (x.tobytes() for x in self._ids(rest, self.whole)), strict=True))

    def forget(self) -> None:
        """Give the memory of remembered words back: a worker process goes on to other tasks."""
        self.ids = {}
        trim()

    def _remembered(self, words: list[bytes]) -> list[bytes]:
        """Ids of words."""
        if len(self.ids) > self.remembered:
            self.ids.clear()
        if new := {w for w in words if w not in self.ids}:
            self._learn(list(new))
        return list(map(self.ids.__getitem__, words))

    def _special(self, text: bytes) -> bytes:
        """A text with what may be a special token, whose own text keeps its case, by which alone it is one."""
        return b"".join(self._remembered(TAIL.sub(rb" \g<0>", text).split()))

    def encode(self, texts: list[bytes | None]) -> list[bytes]:
        """Ids of UTF-8 texts as little-endian unsigned 32-bit numbers.

        Words with the white space after them lie end to end in the texts' bytes, so that they are an Arrow array without a copy, whose distinct values are looked up once; the texts' ids are gathered by those
        values' numbers.
        """
        out: list[bytes] = [self._special(t) if t and b"<|" in t else b"" for t in texts]
        plain = [k for k, t in enumerate(texts) if t and b"<|" not in t]
        if not plain:
            return out
        joined = b"".join([texts[k].lower() for k in plain])
        raw = np.frombuffer(joined, np.uint8)
        ends = np.cumsum([len(texts[k]) for k in plain])
        begins = word_borders(raw, ends)
        raw = np.where(BLANK[raw], np.uint8(0x20), raw)
        offsets = np.append(begins, len(raw)).astype(np.int32)
        found = pa.Array.from_buffers(pa.binary(), len(begins), [None, pa.py_buffer(offsets), pa.py_buffer(raw)]).dictionary_encode()
        _, at, values = found.dictionary.buffers()
        at, values = np.frombuffer(at, np.int32)[: len(found.dictionary) + 1].tolist(), values.to_pybytes()
        ids = self._remembered([values[i:j].strip() for i, j in zip(at, at[1:])])
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        starts = np.cumsum(sizes) - sizes
        word = found.indices.to_numpy()
        many = sizes[word]
        at = np.repeat(starts[word] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        flat = np.frombuffer(b"".join(ids), "<u4")[at]
        last = np.append(0, np.cumsum(many))[np.searchsorted(begins, ends, "left")].tolist()
        for k, i, j in zip(plain, [0, *last], last):
            out[k] = flat[i:j].tobytes()
        return out


def word_borders(raw: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where words begin in the lower-cased bytes of texts that end at `ends`: at a text's start, after white space, and where a run of TAIL's punctuation marks follows a letter or digit and ends the word."""
    blank, mark = BLANK[raw], MARK[raw]
    n = len(raw)
    first = np.zeros(n + 1, bool)
    first[0], first[ends] = True, True
    first = first[:n] if ends[-1] != n else first[:-1]
    word = ~blank
    begins = first.copy()
    begins[1:] |= word[1:] & blank[:-1]
    runs, stops = np.flatnonzero(mark & ~np.append(False, mark[:-1] & ~first[1:])), np.flatnonzero(mark & ~np.append(mark[1:] & ~first[1:], False))
    after = np.append(blank[1:] | first[1:], True)[stops]
    before = raw[runs - 1]
    two = raw[runs - 2]
    known = ALNUM[before] | (two == 0xC3) & (before >= 0x80) & (before <= 0xBF) & (before != 0x97) & (before != 0xB7)
    begins[runs[after & known & ~first[runs]]] = True
    return np.flatnonzero(begins)


@cache
def tokens_of(path: str, remembered: int) -> WordTokens:
    """One a worker process, which serves many tasks."""
    return WordTokens(path, remembered)


def portions(sizes: list[int], most: int = AT_ONCE) -> Iterator[tuple[int, int]]:
    """(start, stop) of runs whose sizes add up to `most` or little more."""
    start, total = 0, 0
    for i, n in enumerate(sizes):
        total += n
        if total >= most:
            yield start, i + 1
            start, total = i + 1, 0
    if start < len(sizes):
        yield start, len(sizes)


def cut(doc_tokens: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: full windows, then what is left."""
    return [(s, min(capacity, doc_tokens - s)) for s in range(0, doc_tokens, capacity)]


def fill(lengths: list[int], counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The multiset of lengths (ascending), at most counts[length] of each, whose sum comes closest to capacity from below.

    Bit s of `reach` says that the sum s can be made of the lengths so far, longest first. The bits that a length adds are kept
    by how many of it they need at least; going back from the best sum takes that many of each length.
    """
    mask, reach, steps = (1 << (capacity + 1)) - 1, 1, []
    for at in range(bisect_right(lengths, capacity) - 1, -1, -1):
        length, now, added = lengths[at], reach, []
        for _ in range(min(counts[length], capacity // length)):
            fresh = (now << length) & mask & ~now
            if not fresh:
                break
            added.append(fresh)
            now |= fresh
        if added:
            steps.append((length, reach, added))
            reach = now
        if reach >> capacity & 1:
            break
    best, taken = reach.bit_length() - 1, {}
    for length, before, added in reversed(steps):
        if not before >> best & 1:
            k = next(i for i, bits in enumerate(added, 1) if bits >> best & 1)
            taken[length] = k
            best -= k * length
    return taken


def plan(lengths: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Windows as lists of indexes into lengths (1 to capacity). As in minimum bin slack each starts with the longest left, so that long ones aren't
    left to the end, and the programme fills the rest. Equal lengths go in their order."""
    by: dict[int, list[int]] = {}
    for i in range(len(lengths) - 1, -1, -1):
        by.setdefault(lengths[i], []).append(i)
    counts, order, windows = {k: len(v) for k, v in by.items()}, sorted(by), []

    def take(length: int, k: int) -> list[int]:
        counts[length] -= k
        if not counts[length]:
            del order[bisect_left(order, length)]
        return [by[length].pop() for _ in range(k)]

    while order:
        first = order[-1]
        window = take(first, 1)
        for length, k in sorted(fill(order, counts, capacity - first).items(), reverse=True):
            window += take(length, k)
        windows.append(window)
    return windows


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, with_ids: bool = True, remembered: int = REMEMBERED) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, doc_tokens, start, length, ids_crc32 and, if asked, ids: one row a piece. A text's ids are followed by END;
    a null text counts as empty, so each document has a piece. Whole texts are encoded, however long; repeated rows have pieces each; a null doc_id stays null; other columns are left out; an empty table gives an empty one."""

    def batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core; the library's threads would each hold memory
        tokens = tokens_of(tokenizer_path, remembered)
        for b in batches:
            for start, stop in portions([n or 0 for n in pc.binary_length(b["text"]).to_pylist()]):
                part, rows = b.slice(start, stop - start), []
                for doc_id, raw in zip(part["doc_id"].to_pylist(), tokens.encode(part["text"].cast(pa.binary()).to_pylist()), strict=True):
                    raw += END.to_bytes(4, "little")
                    n = len(raw) // 4
                    for start, length in cut(n, capacity):
                        own = raw[4 * start : 4 * (start + length)]
                        rows.append((doc_id, n, start, length, zlib.crc32(own), np.frombuffer(own, "<u4").astype(np.int32) if with_ids else None))
                doc, n, start, length, crc, ids = zip(*rows, strict=True)
                columns = [pa.array(doc, b.schema.field("doc_id").type), *(pa.array(x, pa.int64()) for x in (n, start, length, crc))]
                yield pa.RecordBatch.from_arrays(columns + ([pa.array(ids, pa.list_(pa.int32()))] if with_ids else []), ["doc_id", "doc_tokens", "start", "length", "ids_crc32"] + ["ids"] * with_ids)
        tokens.forget()

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(batch, f"doc_id {kind}, doc_tokens long, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)


def pack(parts: DataFrame, capacity: int = CAPACITY, group_docs: int = GROUP_DOCS) -> DataFrame:
    """Add sequence_id and offset to pieces(doc_id, start, length, ids_crc32, ...).

    Pieces that fill a window are a sequence alone. The others are dealt to groups by a hash of all that identifies them and a group is packed at
    once: it needs its lengths alone, so its memory is bounded by group_docs whatever the corpus. Copies of a document and repeated rows of one doc_id are pieces like others; other columns stay.
    Equal rows are counted first and then numbered, and the number is part of what is hashed, so that repeated rows spread over groups like others.
    parts is read twice, so it should be a written table. A sequence's id is its group's number in the upper bits and its place there in the lower 32. An empty table gives an empty one.
    """
    n = parts.count()
    groups = max(1, -(-n // group_docs))

    def one(group: pa.Table) -> pa.Table:
        group = group.take(pc.sort_indices(group, sort_keys=[(c, "ascending") for c in ("doc_id", "start", "ids_crc32", "length")]))
        lengths = group["length"].to_pylist()
        seq, off = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        base = group["_group"][0].as_py() << 32
        for k, window in enumerate(plan(lengths, capacity)):
            at = 0
            for i in window:
                seq[i], off[i] = base + k, at
                at += lengths[i]
        return group.drop_columns("_group").append_column("sequence_id", pa.array(seq)).append_column("offset", pa.array(off))

    own = parts.drop("sequence_id", "offset", "_copies", "_copy")
    counted = own.groupBy(*own.columns).agg(F.count("*").alias("_copies"))
    own = counted.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "_copies"))).withColumn("_group", F.pmod(F.xxhash64(F.lit(3), "doc_id", "start", "ids_crc32", "_copy"), F.lit(groups))).drop("_copies", "_copy")
    schema = own.drop("_group").schema.add("sequence_id", "long").add("offset", "long")
    return own.groupBy("_group").applyInArrow(one, schema)
