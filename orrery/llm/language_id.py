"""Language identification by rank-order profiles (Cavnar and Trenkle, 1994).

A document's most frequent letter n-grams are ranked and compared to each language's ranked profile: the distance is the
sum over the document's n-grams of how far out of place each is.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructType

from .common import trim

#: n-grams of 1 to 3 letters; those of a profile; those of a document.
ORDERS, PROFILE, TOP = 3, 400, 300
#: A profile is learned from about so many documents of each language, chosen by a hash of doc_id. This is the bound of what is learned from;
#: profiles of n-grams don't change noticeably beyond.
LEARN_DOCS = 1000
#: Languages that profiles are learned for, at most.
MOST_LANGUAGES = 1000
#: Below this score no profile resembles the document.
LEAST_SCORE = 0.1


@cache
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def gram_codes(text: str) -> np.ndarray:
    """The n-grams of a lower-cased text, each packed in a long of 21 bits a character. A run of letters is a word with one space on either
    side; n-grams don't reach over a space, and a space alone isn't one."""
    a = np.frombuffer(f" {text.lower()} ".encode("utf-32-le"), np.uint32)
    a = np.where(_letters()[a], a, 32).astype(np.int64)
    a = a[np.concatenate(([True], (a[1:] != 32) | (a[:-1] != 32)))]
    if len(a) < 3:
        return np.empty(0, np.int64)
    two = a[:-1] << 21 | a[1:]
    return np.concatenate([a[a != 32], two, (two[:-1] << 21 | a[2:])[a[1:-1] != 32]])


def ranked(codes: np.ndarray, counts: np.ndarray, top: int) -> np.ndarray:
    """The most frequent first; ties by code. codes are sorted."""
    return codes[np.argsort(-counts, kind="stable")[:top]]


#: Characters of a text that are counted at once, up to the next of BREAK: bounds what one very long text needs.
AT_ONCE = 1 << 20
BREAK = re.compile(r"[\s,;!?()\u3001\u3002\uff01\uff0c\uff1f]")


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of a whole text, sorted, and how often each occurs."""
    if len(text) <= AT_ONCE:
        return np.unique(gram_codes(text), return_counts=True)
    held, at = ([], []), 0
    while at < len(text):
        cut = BREAK.search(text, at + AT_ONCE)
        stop = cut.start() if cut else len(text)
        codes, counts = np.unique(gram_codes(text[at:stop]), return_counts=True)
        held = tuple([x] for x in _added([*held[0], codes], [*held[1], counts]))
        at = stop
    return held[0][0], held[1][0]


def document_profile(text: str | None, top: int = TOP) -> np.ndarray:
    return ranked(*gram_counts(text or ""), top)


class Profiles:
    """The languages' profiles as one table: rank of each n-gram in each language, PROFILE where it has none."""

    def __init__(self, by_lang: dict[str, np.ndarray], size: int = PROFILE):
        self.langs, self.size = sorted(by_lang), size
        self.codes = np.unique(np.concatenate([*by_lang.values(), np.empty(0, np.int64)])).astype(np.int64)
        self.ranks = np.full((len(self.codes) + 1, len(self.langs)), size, np.int64)
        for k, lang in enumerate(self.langs):
            self.ranks[np.searchsorted(self.codes, by_lang[lang]), k] = np.arange(len(by_lang[lang]))

    def distances(self, profile: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.codes, profile)
        at[at == len(self.codes)] = 0
        if len(self.codes):
            at[self.codes[at] != profile] = len(self.codes)
        place = self.ranks[at]
        return np.where(place == self.size, self.size, np.abs(place - np.arange(len(profile))[:, None])).sum(axis=0)

    def predict(self, text: str | None) -> tuple[str, float]:
        p = document_profile(text)
        if not len(p) or not self.langs:
            return "und", 0.0
        d = self.distances(p)
        k = int(d.argmin())  # ties: the first language in order
        return self.langs[k], float(min(1.0, max(0.0, 1 - d[k] / (self.size * len(p)))))


def learn(docs: DataFrame, learn_docs: int = LEARN_DOCS, size: int = PROFILE, most_languages: int = MOST_LANGUAGES) -> Profiles:
    """Profiles from docs(doc_id, text, lang) whose lang isn't null. About learn_docs documents of each language are learned from, chosen by
    a hash of doc_id and all of them where there are fewer; their n-grams are counted by partition, then summed and ranked; only the profiles
    come to the driver. More than most_languages values of lang are an error: they would all be profiles that each task holds."""
    known = docs.where("lang is not null and text is not null and doc_id is not null")
    found = known.groupBy("lang").agg(F.count("*").alias("n")).limit(most_languages + 1).collect()
    if len(found) > most_languages:
        raise ValueError(f"lang has more than {most_languages} values")
    share = {r["lang"]: min(1.0, learn_docs / r["n"]) for r in found}
    if not share:
        return Profiles({}, size)
    limit = F.create_map(*[F.lit(x) for kv in share.items() for x in kv])
    chosen = known.where(F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(1 << 30)) < limit[F.col("lang")] * (1 << 30)).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, tuple[list[np.ndarray], list[np.ndarray]]] = {}
        for b in batches:
            for lang, text in zip(b["lang"].to_pylist(), b["text"].to_pylist(), strict=True):
                codes, counts = gram_counts(text)
                held = total.setdefault(lang, ([], []))
                held[0].append(codes)
                held[1].append(counts)
                if len(held[0]) > 200:
                    total[lang] = tuple([x] for x in _added(*held))
        for lang, held in total.items():
            codes, counts = _added(*held)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes, pa.int64()), pa.array(counts, pa.int64())], ["lang", "code", "n"])
        trim()

    summed = chosen.mapInArrow(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    best = summed.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code"))).where(F.col("r") <= size)
    by: dict[str, list[int]] = {}
    for r in best.orderBy("lang", "r").collect():
        by.setdefault(r["lang"], []).append(r["code"])
    return Profiles({lang: np.array(codes, np.int64) for lang, codes in by.items()}, size)


def _added(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    found, at = np.unique(np.concatenate(codes), return_inverse=True)
    return found, np.bincount(at, np.concatenate(counts), len(found)).astype(np.int64)


def identify(docs: DataFrame, profiles: Profiles, keep: list[str] | None = None) -> DataFrame:
    """Add lang_pred and score (0 to 1: one less the distance as a share of the largest possible) to docs(text, ...).

    `und` and 0 where the text is null or has no letters. Repeated rows are judged alike; an empty table gives an empty one; columns named lang_pred
    or score are replaced. The whole text counts, however long. `keep` names the columns that the result
    needs besides (all, if None), so that texts don't travel back in vain.
    """
    own = docs.drop("lang_pred", "score")
    keep = own.columns if keep is None else keep
    kept = own.select(*keep)
    own = own.select(*keep, F.col("text").alias("__orrery_text"))

    def batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [profiles.predict(t) for t in b["__orrery_text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], [*b.schema.names[:-1], "lang_pred", "score"])
        trim()

    return own.mapInArrow(batch, StructType([*kept.schema.fields]).add("lang_pred", StringType()).add("score", DoubleType()))
