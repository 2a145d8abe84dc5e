"""The pipeline against plain versions of its stages, in Python and without the library, on the smallest tables."""

import math
import re
import zlib
from collections import Counter
from hashlib import md5

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as p
from orrery.llm import mixing, quality_rules
from orrery.llm.common import written
from orrery.llm.queries import tokenizer_path
from tests.llm.test_edges import LONG, plain_profile, plain_survivors

FOLDER = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_languages(rows):
    """Indexes of the rows that resemble a profile, of those with a letter."""
    learned = [r for r in rows if r["lang"] is not None and r["text"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1]
    profiles = {x: {g: k for k, g in enumerate(plain_profile([r["text"] for r in learned if r["lang"] == x], 400))} for x in {r["lang"] for r in learned}}
    kept = []
    for i, r in enumerate(rows):
        own = plain_profile([r["text"] or ""], 300)
        far = min(sum(abs(q[g] - k) if g in q else 400 for k, g in enumerate(own)) for q in profiles.values())
        if own and 1 - far / (400 * len(own)) >= 0.1:
            kept.append(i)
    return kept


def plain_quality(rows, min_docs=20):
    """(index, text that is left) of the rows that are kept."""
    norm = lambda line: " ".join(WORD.findall(line.lower()))
    lines = [[x for x in (r["text"] or "").split("\n") if WORD.search(x)] for r in rows]
    sets = [frozenset(map(norm, x)) for x in lines]
    hosts: dict = {}
    for r, s in zip(rows, sets, strict=True):
        if s:
            hosts.setdefault(r["source"], set()).add(s)
    above = {h: {x for x, n in Counter(x for s in docs for x in s).items() if n >= min_docs and n * 100 >= len(docs) * 2} for h, docs in hosts.items()}
    out = []
    for i, (r, own) in enumerate(zip(rows, lines, strict=True)):
        w = WORD.findall(r["text"] or "")
        grams = Counter(zip(w, w[1:], w[2:], strict=False))
        repeats = len({k for j, g in enumerate(zip(w, w[1:], w[2:], strict=False)) if grams[g] > 1 for k in (j, j + 1, j + 2)})
        bad = above.get(r["source"], set())
        gone = sum(len(WORD.findall(x)) for x in own if norm(x) in bad)
        if len(w) >= 50 and 100 * repeats <= 50 * len(w) and (len(w) - gone) * 100 >= len(w) * 50:
            out.append((i, "\n".join(x for x in r["text"].split("\n") if not (WORD.search(x) and norm(x) in bad))))
    return out


def plain_mix(rows):
    """Copies of each row (doc_id, text, source)."""
    sizes = [len(WORD.findall(t or "")) for _, t, _ in rows]
    by: dict = {}
    for n, r in zip(sizes, rows, strict=True):
        by[r[2]] = by.get(r[2], 0) + n
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(sorted(by, key=lambda s: (s is None, s or "")))}
    full: set = set()
    while True:
        rest = [s for s in by if s not in full]
        level = (1.5 * sum(by.values()) - sum(2 * by[s] for s in full)) / max(1, sum(weight[s] for s in rest))
        new = {s for s in rest if level * weight[s] >= 2 * by[s]}
        if not new:
            break
        full |= new
    copies = [0] * len(rows)
    for s in by:
        each = (2 if s in full else level * weight[s] / by[s]) if by[s] else 0
        u = int(md5(f"42:{s if s is not None else chr(0) + 'null'}".encode()).hexdigest()[:8], 16) / 2**32
        own = sorted((i for i, r in enumerate(rows) if r[2] == s), key=lambda i: (sizes[i], rows[i][0] is not None, rows[i][0] or 0))
        for k, i in enumerate(own):
            copies[i] = min(2, math.floor(each * (k + 1) + u) - math.floor(each * k + u))
    return copies


def sorted_rows(df):
    return sorted([(r["doc_id"], r["text"], r["lang"], r["source"]) for r in df.collect()], key=str)


def test_each_stage_equals_a_plain_version(spark):
    from tokenizers import Tokenizer

    docs = written(spark.read.parquet(f"{FOLDER}/documents.parquet"), "docs")
    (n1, f1), (n2, f2), (n3, f3), (n4, f4), (n5, f5) = p.STAGES
    rows = docs.collect()
    a = written(f1(spark, docs, FOLDER), n1)
    one = [rows[i] for i in plain_languages(rows)]
    assert sorted_rows(a) == sorted([(r["doc_id"], r["text"], r["lang"], r["source"]) for r in one], key=str) and a.columns == p.COLUMNS and 100 < len(one) <= len(rows)
    b = written(f2(spark, a, FOLDER), n2)
    one = a.collect()
    two = [(one[i]["doc_id"], t, one[i]["lang"], one[i]["source"]) for i, t in plain_quality(one)]
    assert sorted_rows(b) == sorted(two, key=str) and b.columns == p.COLUMNS and b.where(F.col("n_chars") != F.length("text")).count() == 0
    c = written(f3(spark, b, FOLDER), n3)
    left = plain_survivors([(r[0], r[1]) for r in two])
    assert sorted_rows(c) == sorted([two[i] for i in left], key=str) and c.columns == p.COLUMNS and len(left) < len(two)
    d = written(f4(spark, c, FOLDER), n4)
    three = [(r["doc_id"], r["text"], r["source"]) for r in c.collect()]
    copies = Counter({r[0]: n for r, n in zip(three, plain_mix(three), strict=True) if n})
    assert Counter(r["doc_id"] for r in d.collect()) == copies and d.columns == p.COLUMNS
    e = f5(spark, d, FOLDER).toPandas()
    tok, text = Tokenizer.from_file(tokenizer_path()), {r["doc_id"]: r["text"] for r in d.collect()}
    want = []
    for doc_id, n in copies.items():
        ids = np.array(tok.encode(text[doc_id], add_special_tokens=False).ids + [2], "<u4")
        want += [(doc_id, s, min(4096, len(ids) - s), zlib.crc32(ids[s : s + 4096].tobytes()), len(ids)) for s in range(0, len(ids), 4096)] * n
    assert sorted(e[["doc_id", "start", "length", "ids_crc32", "doc_tokens"]].itertuples(index=False, name=None)) == sorted(want)
    seq = e.sort_values(["sequence_id", "offset"])
    assert (seq["offset"] == seq.groupby("sequence_id")["length"].cumsum() - seq["length"]).all() and seq.groupby("sequence_id")["length"].sum().max() <= 4096


def test_quality_equals_a_plain_version_where_lines_go(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("length(text) < 20000").collect()
    docs = spark.createDataFrame(rows)
    want = {rows[i]["doc_id"]: t for i, t in plain_quality(rows, min_docs=3)}
    got = {r["doc_id"]: r["kept_text"] for r in quality_rules.judge(docs, min_docs=3).where("kept").select("doc_id", "kept_text").collect()}
    text = {r["doc_id"]: r["text"] for r in rows}
    assert got == want and any(text[i] != t for i, t in want.items())


def test_run_equals_its_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    for _, f in p.STAGES:
        docs = written(f(spark, docs, FOLDER), "stage")
    key = ["doc_id", "start", "length", "ids_crc32", "sequence_id", "offset"]
    a, b = docs.toPandas()[key], p.run(spark, FOLDER).toPandas()[key]
    pd.testing.assert_frame_equal(a.sort_values(key, ignore_index=True), b.sort_values(key, ignore_index=True))


ODD = [
    (1, " ".join(f"the word{k} of" for k in range(40)), "en", "a"), (1, " ".join(f"the word{k} of" for k in range(40)), "en", "a"), (2, None, None, None), (3, "", "de", None), (4, " \n\t ", None, "b"), (None, " ".join(f"and other{k} things" for k in range(50)), None, None),
    (5, LONG, "en", "a"), (6, "\n".join(" ".join(f"the {x}{k} was" for k in range(30)) for x in ("house", "river", "garden")), "en", "b"), (6, " ".join(f"one more{k} text" for k in range(60)), "en", "b"), (7, "12 34 !! " * 100, "en", "c"),
]


@pytest.mark.parametrize("extra", [[], ["sig", "row", "fp", "size", "rank", "start", "kept", "frequent", "n"]])
def test_stages_take_odd_rows(spark, extra):
    """Null ids, texts, languages and sources, empty and very long texts, rows that repeat, one id of two texts, columns whose names operators use."""
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in ODD], "doc_id long, text string, lang string, source string, n_chars long").withColumns({c: F.lit("x") for c in extra})
    ids = []
    for _, f in p.STAGES[:-1]:
        docs = written(f(spark, docs, FOLDER), "odd")
        assert docs.columns == p.COLUMNS
        ids.append(sorted(str(r["doc_id"]) for r in docs.collect()))
    assert set(ids[1]) <= set(ids[0])
    assert ids[2].count("1") == 1 and ids[2].count("6") == 2 and "None" in ids[2] and not {"2", "3", "4"} & set(ids[0])
    assert written(p.STAGES[-1][1](spark, docs, FOLDER), "odd").select("doc_id").distinct().count() == len(set(ids[3]))
    none = docs.limit(0)
    for _, f in p.STAGES:
        none = written(f(spark, none, FOLDER), "none")
        assert none.count() == 0


def test_mixing_equals_a_plain_version(spark):
    rows = [(r["doc_id"], r["text"], r["source"]) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    got = {r["doc_id"]: r["copies"] for r in mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got == {r[0]: n for r, n in zip(rows, plain_mix(rows), strict=True)}
