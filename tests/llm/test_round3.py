"""Alignment of tokenizers, suffix-array deduplication, whitening; schemas' words, all messages, repeated rows in packing."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from orrery.llm import alignment, chat_tools, induced_sorting, packing, suffix_dedup, whitening
from orrery.llm import queries as q
from orrery.llm.common import written

FOLDER = "/root/testdata/sf0.001"
A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"
COUNTS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
PIECES = ["a", "b", "the", " ", "  ", "\n", "\n\n", "\t", ".", ",", "'s", "é", "ö", "×", " ", "▁", "<|endoftext|>", "</s>", "12", "3.5", "日本", "🙂", "\r\n", ";\r", "é", "\x00", "...", "a" * 30, "!", "Straße", "\u0085", "\x1c", "{}", "ﬁ"]


@pytest.fixture(scope="module")
def tokenizers():
    return alignment.Tokenizers(q.tokenizer_path(A), q.tokenizer_path(B))


def plainly_aligned(tokenizers, texts):
    """Whole texts, cut where tokens of both end, by sets of places and loops over tokens."""
    rows, linked = [], []
    for t in texts:
        row, own = (0, 0, 0, 0, ""), Counter()
        if t:
            raw = (" " + t).encode()
            a, b = tokenizers.a.encode(" " + t, add_special_tokens=False).ids, tokenizers.b.encode(t)
            ab, bb = [tokenizers.a_bytes[i] for i in a], [tokenizers.b_bytes[i] for i in b]
            if b"".join(ab) == raw == b"".join(bb):
                ends_a, ends_b = (np.cumsum([len(x) for x in y]).tolist() for y in (ab, bb))
                groups, i, j = [], 0, 0
                for cut in sorted(set(ends_a) & set(ends_b)):
                    x, y = ends_a.index(cut, i) + 1, ends_b.index(cut, j) + 1
                    groups.append((a[i:x], b[j:y]))
                    i, j = x, y
                for x, y in groups:
                    own.update((m, n) for m in x for n in y)
                text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
                row = (len(a), len(b), len(groups), sum(own.values()), hashlib.sha256(text.encode()).hexdigest())
        rows.append(row)
        linked.append(own)
    counts, top = Counter(p for own in linked for p in own), defaultdict(int)
    for (a, _), n in counts.items():
        top[a] = max(top[a], n)
    return [(*r[:4], sum(n for p, n in own.items() if counts[p] == top[p[0]]), sum(n * counts[p] for p, n in own.items()), r[4]) for r, own in zip(rows, linked, strict=True)]


@pytest.mark.parametrize("most", [10**6, 0])
def test_alignment_equals_a_plain_version(spark, tokenizers, most):
    rng = random.Random(1)
    texts = [None, "", " ", "\n", "a", "a", "  a", *["".join(rng.choices(PIECES, k=rng.randint(1, 30))) for _ in range(1500)], "x" * 5000 + "y", "日本語" * 3000, "ab " * 5000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("n_a", F.lit("x")).repartition(3)
    got = alignment.score(alignment.links(df, q.tokenizer_path(A), q.tokenizer_path(B), remembered=300), most).orderBy("doc_id").collect()
    assert tokenizers.by_units and [tuple(r[c] for c in COUNTS) for r in got] == plainly_aligned(tokenizers, texts)
    assert alignment.score(alignment.links(df.limit(0), q.tokenizer_path(A), q.tokenizer_path(B))).count() == 0


def test_alignment_query(spark, tokenizers):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").orderBy("doc_id").collect()
    got = q.op11_alignment(spark, FOLDER).orderBy("doc_id").collect()
    assert [tuple(r[c] for c in COUNTS) for r in got] == plainly_aligned(tokenizers, [d["text"] for d in docs])


def test_owners_give_overlaps_and_cuts():
    overlaps, a, b = alignment.owners(np.array([2, 3, 1]), np.array([1, 1, 4]))
    assert overlaps.tolist() == [[0, 0], [0, 1], [1, 2], [2, 2]] and a.tolist() == [0, 1, 1] and b.tolist() == [0, 0, 1]


def test_wide_groups_are_counted_without_being_listed(monkeypatch):
    rng = np.random.default_rng(0)
    args = (rng.integers(0, 3, 6), np.array([2, 2, 1, 1, 2, 2]), rng.integers(0, 3, 5), np.array([1, 3, 2, 3, 1]), np.array([4, 2]), np.array([3, 2]))
    plain = alignment.align(*args)
    monkeypatch.setattr(alignment, "WIDE", 1)
    wide = alignment.align(*args)

    def summed(x):
        out = Counter()
        for s, p, n in zip(x.stretch.tolist(), x.pairs.tolist(), x.times.tolist(), strict=True):
            out[s, p] += n
        return out

    assert summed(plain) == summed(wide) and plain.texts == wide.texts


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 4), max_size=80), st.sampled_from([258, 5000]))
def test_suffix_arrays_and_common_prefixes(values, kinds):
    text = np.append(np.array(values, np.uint16), 0).astype(np.uint16)
    plain = text.tolist()
    want = sorted(range(len(plain)), key=lambda i: plain[i:])
    suffixes = induced_sorting.suffix_array(text, kinds)
    assert suffixes.tolist() == want
    shared, left = induced_sorting.common_prefixes(text, suffixes, separator=-1)
    for x, y in zip(want, want[1:], strict=False):
        assert left[y] == x and shared[y] == next(k for k in range(len(plain)) if plain[x + k] != plain[y + k])


def plainly_kept(texts, length):
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = True
        out.append(bytes(c for c, g in zip(t, gone, strict=False) if not g))
    return out


@pytest.mark.parametrize(("length", "gram", "shard"), [(400, 64, 1 << 20), (400, 64, 3000), (40, 8, 3000)])
def test_substrings_go_as_by_brute_force(spark, length, gram, shard):
    rows = suffix_dedup.remove_repeats(spark.read.parquet(f"{FOLDER}/documents.parquet"), ["doc_id", "text"], length, gram, shard).collect()
    texts = [r["text"].encode() for r in rows]
    assert [bytes(r["kept"]) for r in rows] == plainly_kept(texts, length)
    for r, t in zip(rows, texts, strict=True):
        assert r["n_bytes"] - len(r["kept"]) == sum(s["stop"] - s["start"] for s in r["removed"]) and all(a["stop"] < b["start"] for a, b in zip(r["removed"], r["removed"][1:], strict=False))


def test_suffix_dedup_query(spark):
    got = q.op12_suffix_dedup(spark, FOLDER).orderBy("doc_id").collect()
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").orderBy("doc_id").collect()
    kept = plainly_kept([d["text"].encode() for d in docs], 400)
    assert [r["kept_sha256"] for r in got] == [hashlib.sha256(k).hexdigest() for k in kept]
    assert [r["n_removed"] for r in got] == [len(d["text"].encode()) - len(k) for d, k in zip(docs, kept, strict=True)]


def test_substrings_of_odd_rows(spark):
    rng = random.Random(2)
    passage = "".join(rng.choices("abcdefgh ", k=60))
    noise = lambda n: "".join(rng.choices("ijklmnopqrstuvwxyz", k=n))
    # one passage in many texts with different surroundings, a short period, a text longer than a portion, copies, ids that repeat or are null
    texts = [noise(rng.randint(0, 90)) + passage + noise(rng.randint(0, 90)) for _ in range(300)] + ["ab" * 200, "x" * 30_000, noise(400_000), None, "", "tiny", "é" * 19, noise(90), *["copy " * 30] * 20]
    df = spark.createDataFrame([(i if i % 7 else None, t, "y") for i, t in enumerate(texts)], "doc_id long, text string, kept string").repartition(4)
    for shard in (1 << 20, 500):
        rows = suffix_dedup.remove_repeats(df, ["doc_id", "text", "kept"], 40, 8, shard).collect()
        assert len(rows) == len(texts) and [bytes(r["kept"]) for r in rows] == plainly_kept([(r["text"] or "").encode() for r in rows], 40)
    assert suffix_dedup.remove_repeats(df.limit(0), ["doc_id"]).count() == 0


def plainly_whitened(x):
    u = np.unique(x, axis=0)
    n, s = len(u), u.sum(0)
    c = u - s / n
    values, vectors = np.linalg.eigh(c.T @ c / n)
    return n, s, values[::-1], vectors[:, ::-1]


def test_whitening_query(spark):
    rows = q.op13_whitening(spark, FOLDER).toPandas().sort_values(["vec_id", "component"])
    v = spark.read.parquet(f"{FOLDER}/embeddings.parquet").orderBy("vec_id").toPandas()
    x = np.floor(np.stack(v["embedding"]).astype(float) * 256).astype(np.int64)
    n, s, values, vectors = plainly_whitened(x)
    white, want = rows["whitened"].to_numpy().reshape(-1, 4), (x - s / n) @ vectors[:, :4] / np.sqrt(values[:4])
    assert np.abs(white - want * np.sign((white * want).sum(0))).max() < 1e-9 and (rows["n"] == n).all()
    assert (rows["deviation"].to_numpy().reshape(-1, 4)[:, 0] == ((x * n - s) ** 2).sum(1)).all()
    assert np.abs(rows["explained"].to_numpy()[:4] / (values[:4] / values.sum()) - 1).max() < 1e-9 and rows["identity_error"].max() < 1e-9


def test_whitening_of_odd_rows(spark):
    rng = np.random.default_rng(3)
    good = [rng.normal(size=6).tolist() for _ in range(40)]
    bad = [None, [], [None] * 6, [float("nan")] * 6, [float("inf")] + [0.0] * 5, [1e300] + [0.0] * 5, [1.0, 2.0]]
    rows = [(i, e, "z") for i, e in enumerate(good + good[:5] + bad)] + [(None, good[0], "z")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, whitened string").repartition(5)
    out = whitening.whiten(df, ["vec_id"]).toPandas()
    assert len(out) == 46 * 4 and out["n"].unique().tolist() == [40] and out["identity_error"].max() < 1e-9
    one = whitening.whiten(df.where("vec_id = 0"), ["vec_id"]).toPandas()  # nothing varies
    assert one["whitened"].isna().all() and (one["explained"] == 0).all() and one["identity_error"].isna().all() and one["deviation"].tolist() == [0] * 4
    assert whitening.whiten(df.limit(0), ["vec_id"]).count() == 0
    flat = whitening.whiten(spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [4.0, 0.0])], "vec_id long, embedding array<double>"), ["vec_id"]).orderBy("vec_id", "component").toPandas()
    assert flat["whitened"].isna().tolist() == [False, True] * 3 and flat["explained"].round(12).tolist() == [1.0, 0.0] * 3


def test_whitening_keeps_precision_and_merges_a_tree(spark):
    rng = np.random.default_rng(4)
    x = (rng.normal(size=(3000, 5)) * [1e6, 1, 1, 1, 1] + 1e9).tolist()
    df = spark.createDataFrame(list(enumerate(x)), "vec_id long, embedding array<double>").repartition(70)  # more than FAN factors
    distinct = written(whitening.vectors(df, scale=1).select("x").distinct().repartition(70), "t")
    fit = whitening.fit(distinct, 5)
    n, s, values, _ = plainly_whitened(np.floor(np.array(x)).astype(np.int64))
    assert fit.n == n and fit.sums == s.tolist() and whitening.identity_error(distinct, fit) < 1e-4
    centred = np.floor(np.array(x)) - np.array([int(v) for v in s]) / n
    assert np.allclose(np.sort(fit.values)[::-1], np.linalg.svd(centred, compute_uv=False) ** 2 / n, rtol=1e-6)
    huge = spark.createDataFrame([(1, [3e18]), (2, [-3e18]), (3, [2.5e18])], "vec_id long, embedding array<double>")
    assert whitening.fit(written(whitening.vectors(huge, scale=1).select("x"), "t")).sums == [2_500_000_000_000_000_000]


def misfits(spark, schema, *values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(chat_tools.misfits(F.try_parse_json("v"), schema)).collect()]


@pytest.mark.parametrize(("schema", "fits", "fails"), [
    ({"type": "integer", "minimum": 0, "maximum": 10}, ["5", "5.0", "10", "0"], ["50", "-1", "5.5", '"5"']),
    ({"type": "number", "exclusiveMinimum": 0, "exclusiveMaximum": 1}, ["0.5"], ["0", "1"]),
    ({"type": "string", "minLength": 2, "maxLength": 3, "pattern": "^a"}, ['"ab"', '"abc"'], ['"a"', '"abcd"', '"ba"']),
    ({"enum": [1, "x", None, {"b": 1, "a": [2]}]}, ["1", "1.0", '"x"', "null", '{"a":[2],"b":1}'], ["2", '"1"', '{"a":[2]}']),
    ({"const": True}, ["true"], ["false", '"true"', "1"]),
    ({"type": "array", "minItems": 1, "maxItems": 2, "items": {"type": "integer"}}, ["[1]", "[1,2]"], ["[]", "[1,2,3]", '["x"]']),
    ({"anyOf": [{"type": "integer"}, {"type": "string", "maxLength": 1}]}, ["1", '"a"'], ['"ab"', "1.5"]),
    ({"type": "object", "properties": {"it's \"x\"": {"type": "integer"}}, "required": ["it's \"x\""], "additionalProperties": {"type": "string"}}, ['{"it\'s \\"x\\"": 1, "y": "z"}'], ['{"it\'s \\"x\\"": "1"}', "{}", '{"it\'s \\"x\\"": 1, "y": 2}']),
])
def test_words_of_schemas(spark, schema, fits, fails):
    got = misfits(spark, schema, *fits, *fails)
    assert [bool(x) for x in got] == [False] * len(fits) + [True] * len(fails), got


def test_unknown_words_of_schemas_are_errors():
    for schema in ({"type": "integer", "multipleOf": 3}, {"type": "date"}, {"properties": {"a": {"oneOf": []}}}):
        with pytest.raises(ValueError, match="aren't known"):
            chat_tools.misfits(F.lit(None), schema)


def test_every_message_is_in_its_place(spark):
    rows = [(1, 0, "system", "be brief"), (1, 1, "user", "hi"), (1, 2, "assistant", "ho"), (1, 3, None, None), (1, None, "system", "be brief"), (1, 0, "system", "be brief")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("json", F.lit("x"))
    _, _, others = chat_tools.turns(df)
    out = chat_tools.plain(others).collect()
    assert sorted((r["place"] is None, r["place"] or 0, r["json"]) for r in out) == sorted([(False, 0, '{"content":"be brief","role":"system"}')] * 2 + [(False, 3, '{"content":null,"role":null}'), (True, 0, '{"content":"be brief","role":"system"}')])


def test_equal_rows_spread_over_packing_groups(spark):
    rows = spark.range(100_000).select(F.lit(7).cast("long").alias("doc_id"), F.lit(9).cast("long").alias("doc_tokens"), F.lit(0).cast("long").alias("start"), F.lit(9).cast("long").alias("length"), F.lit(5).cast("long").alias("ids_crc32"))
    out = packing.pack(written(rows, "equal")).select(F.shiftright("sequence_id", 32).alias("g"), "sequence_id", "offset", "length")
    sizes = [r["count"] for r in out.groupBy("g").count().collect()]
    assert sum(sizes) == 100_000 and max(sizes) < 1.2 * packing.GROUP_DOCS
    used = [r["n"] for r in out.groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()]
    assert max(used) <= 4096 and out.select("sequence_id", "offset").distinct().count() == 100_000


def test_too_many_languages_are_an_error(spark):
    from orrery.llm import language_id

    df = spark.range(30).select(F.col("id").alias("doc_id"), F.lit("some text").alias("text"), F.col("id").cast("string").alias("lang"))
    with pytest.raises(ValueError, match="more than 20"):
        language_id.learn(df, most_languages=20)
    assert len(language_id.learn(df, most_languages=30).langs) == 30


def test_mixing_ties_go_by_content(spark):
    from orrery.llm import mixing

    rows = [(1, f"w{i} x y", "s", "l") for i in range(50)] + [(None, f"v{i} x y", "s", "l") for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    a, b = (sorted(r["text"] for r in mixing.emit(mixing.mix(d, keep=["text"])).collect()) for d in (df.repartition(3), df.orderBy(F.desc("text")).repartition(7)))
    assert a == b
