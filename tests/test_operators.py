"""Operators on rows made by hand."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from orrery.functions import repair, text, vectors
from orrery.operators import citations, diff, evaluate, evidence, findings, index, patch, retrieve, service, zones


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first()


def test_text_functions(spark):
    lit = F.lit
    r = one(
        spark, tok=text.tokens(lit("A bC d_e/F-1.x (y)")), lab=text.unquoted_label(lit(" 'a b' ")), odd=text.unquoted_label(lit("'")), empty=text.unquoted_label(lit('""')), short=text.shorten(lit("abcdef"), 3, "..."), esc=text.escape_html(lit("<a b='c'>&")),
        lang=text.language_name(lit("ja")), upper=text.language_name(lit("JA")), uk=text.language_name(lit("uk")), en=text.language_name(lit("en")), other=text.language_name(lit("xx")), model=text.embed_model(lit("openai:m:x")), over=text.overlap(F.array(lit("a"), lit("b"), lit("a")), F.array(lit("b"))), none=text.overlap(F.array().cast("array<string>"), F.array(lit("b"))),
        clean=text.clean_markup(lit("a<br/>b &amp;lt; <i>c</i>\n d")), safe=text.script_safe(lit("</x>")),
    )
    assert r["tok"] == ["bc", "d_e/f-1.x"] and r["lab"] == "a b" and r["odd"] == "'" and r["empty"] is None and r["short"] == "abc..." and r["esc"] == "&lt;a b=&#x27;c&#x27;&gt;&amp;"
    assert r["lang"] == "Japanese" and r["upper"] == "JA" and r["uk"] == "Ukrainian" and r["en"] == "EN" and r["other"] == "XX" and r["model"] == "m:x" and r["over"] == 0.5 and r["none"] == 0.0 and r["clean"] == "a b &lt; c d" and r["safe"] == "<\\/x>"
    assert text.clean_value("a%20&eacute;<b>x</b><br>y") == "a é x y" and text.clean_value(None) == ""


@pytest.mark.parametrize(("page", "want"), [
    ("<p>if a &lt; b and c &gt; d then caf&eacute;</p>", "if a < b and c > d then café"), ("a < b<br/> c <i title='x>y'>d</i >e", "a < b c d e"), ("<!DOCTYPE html><style>p{}</style>x<!-- <b>no</b> --><SCRIPT>s</script >y", "x y"),
    ("&#233;&#xE9;&#146;&#x1F600; &nope; &amp;lt; a&b; R&D &copy; &#0; &#55296;", "éé’😀 &nope; &lt; a&b; R&D © \ufffd \ufffd"), (" \u00a0<b> </b>&nbsp;x&nbsp;y ", "x\u00a0y"), ("", ""), ("<a href=\"x>y", "y"),
])
def test_page_text(spark, page, want):
    assert one(spark, t=text.page_text(F.lit(page)))["t"] == want


@pytest.mark.parametrize("answer", ['{"a": [1, 2]}', '```json\n{"a": [1, 2]}\n```', 'Sure: {"a": [1, 2,],}', '{"a": [1, 2], "b": {"c": "tru', '{"a": [1, 2], "b', '{"a": [1, 2]} trailing'])
def test_json_repair(answer):
    assert repair.loads(answer)["a"] == [1, 2]


def test_json_repair_gives_up(spark):
    with pytest.raises(ValueError):
        repair.loads("no json at all")
    assert one(spark, a=repair.repaired(F.lit("{'")), b=repair.repaired(F.lit('{"x":1,}')))["b"] == '{"x": 1}'


def test_vectors(spark):
    a, z = F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(0.0), F.lit(0.0))
    r = one(spark, n=vectors.norm(a), c=vectors.cosine(a, a), p=vectors.plain_cosine(a, z))
    assert r["n"] == 5 and abs(r["c"] - 1) < 1e-9 and r["p"] == 0


def test_chunk_spans(spark):
    def spans(total, size, overlap):
        return [(x["start"], x["stop"]) for x in one(spark, s=index.spans(F.lit(total), size, overlap))["s"]]

    assert spans(10, 4, 1) == [(0, 4), (3, 7), (6, 10)] == spans(10, 4, 4) and spans(5, 4, 3) == [(0, 4), (1, 5)] and spans(4, 4, 1) == [(0, 4)] and spans(0, 4, 1) == []
    for bad in ((0, 0), (4, -1)):
        with pytest.raises(ValueError):
            index.spans(F.lit(1), *bad)


def test_chunks_keep_every_character(spark):
    texts = ["über, (x) naïve — “q”!", "日本語のテキスト。", " lead  and trail \n", "", " \t", None, "a" * 5]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "stem long, text string").withColumns({"kb": F.lit("k"), "source": F.lit("s")})
    got = {}
    for r in index.chunks(docs, size=4, overlap=0).orderBy("chunk_id").collect():
        got[r["chunk_id"][0]] = got.get(r["chunk_id"][0], "") + r["text"]
    assert got == {str(i): t for i, t in enumerate(texts) if (t or "").strip()}


def test_chunks_by_a_tokenizer(spark):
    import base64

    import public_tokenizers
    import tiktoken

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")

    def load():
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
        return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    words = " ".join(f"word{i}, naïve {i}" for i in range(30))
    docs = spark.createDataFrame([("d", words), ("e", " "), ("f", "short")], "stem string, text string").withColumns({"kb": F.lit("k"), "source": F.lit("s")})
    got = index.token_chunks(docs, load, size=20, overlap=5).orderBy("chunk_id").collect()
    ids, enc = load().encode(words), load()
    starts = [k for k in range(0, len(ids), 15) if k == 0 or k + 5 < len(ids)]
    assert [(r["chunk_id"], r["token_count"], r["text"]) for r in got] == [*((f"d-{n:05d}", len(ids[k : k + 20]), enc.decode(ids[k : k + 20])) for n, k in enumerate(starts)), ("f-00000", len(enc.encode("short")), "short")]


def test_bm25_by_hand(spark):
    r = one(spark, i=index.idf(F.lit(3.0), F.lit(1.0)))
    assert abs(r["i"] - 0.980829) < 1e-6


def test_options_are_checked():
    for bad in ({"strategy": "x"}, {"reranker": "x"}, {"topk": 0}, {"candidates": 0}, {"min_score": 2}, {"rrf_k": 0}, {"mmr_lambda": -1}):
        with pytest.raises(retrieve.RetrievalError):
            retrieve.Options(**bad)


def ranked(spark, rows):
    return spark.createDataFrame([(1, "k", i, float(s), r) for r, (i, s) in enumerate(rows, 1)], "query_id int, kb string, chunk_id int, score double, rank int")


def test_fusion_by_hand(spark):
    out = {r["chunk_id"]: r["fused_score"] for r in retrieve.fuse(ranked(spark, [(1, 0.9), (2, 0.1)]), ranked(spark, [(1, 5), (3, 2)])).collect()}
    assert abs(out[1] - 0.311475) < 1e-6 and abs(out[2] - 0.3 / 62) < 1e-9 and abs(out[3] - 0.4 / 62) < 1e-9
    flat = retrieve.fuse(ranked(spark, [(1, 0.5)]), ranked(spark, [(2, 0.0)])).where("chunk_id = 1").first()
    assert abs(flat["fused_score"] - 0.104918) < 1e-6  # a constant list counts as 1


def test_zero_scores_fill_a_list(spark):
    d = spark.createDataFrame([("k", i, f"w{i} common") for i in range(6)], "kb string, chunk_id int, text string")
    q = spark.createDataFrame([(1, "w3")], "query_id int, text string")
    lens = index.lengths(d)
    out = retrieve.topk(retrieve.with_zeros(retrieve.bm25(q, index.postings(d), lens), q, lens, 3), 3).orderBy("rank").collect()
    assert [r["chunk_id"] for r in out] == [3, 0, 1] and out[1]["score"] == 0


def test_queries_go_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(8)
    v = spark.createDataFrame([("k", i, [float(x) for x in rng.standard_normal(4)]) for i in range(20)], "kb string, chunk_id int, embedding array<double>")
    q = v.select(F.col("chunk_id").alias("query_id"), "embedding")
    whole = {(r["query_id"], r["chunk_id"]): r["score"] for r in retrieve.dense(q, v).collect()}
    assert len(retrieve.blocks(q, 3)) > 5 and sum(b.count() for b in retrieve.blocks(q, 3)) == 20
    few = retrieve.blocks
    monkeypatch.setattr(retrieve, "blocks", lambda df: few(df, 3))
    assert {(r["query_id"], r["chunk_id"]): r["score"] for r in retrieve.dense(q, v).collect()} == whole and len(whole) == 400
    monkeypatch.setattr(retrieve, "MOST_BLOCKS", 2)
    with pytest.raises(retrieve.RetrievalError):
        few(q, 3)


def test_threshold_fallbacks(spark):
    df = spark.createDataFrame([(1, 1, 0.9), (1, 2, 0.1), (2, 1, 0.2), (2, 2, 0.1)], "request_id int, pos int, final_score double")
    key = lambda d: sorted((r["request_id"], r["pos"]) for r in d.collect())
    assert key(retrieve.threshold(df, 0.5)) == [(1, 1), (2, 1)] and key(retrieve.threshold(df, 0.5, keep_all=True)) == [(1, 1), (2, 1), (2, 2)]


def plain_mmr(rows, k, lam, cap):
    chosen, counts = [], {}
    rest = list(rows)
    while rest and len(chosen) < k:
        best, at = -1e9, None
        for i, (_, src, rel, v) in enumerate(rest):
            if src and cap > 0 and counts.get(src, 0) >= cap:
                continue
            div = max((np.dot(v, c[3]) / (np.linalg.norm(v) * np.linalg.norm(c[3]) + 1e-10) for c in chosen), default=0.0)
            if lam * rel - (1 - lam) * div > best + 1e-12:
                best, at = lam * rel - (1 - lam) * div, i
        if at is None:
            break
        counts[rest[at][1]] = counts.get(rest[at][1], 0) + 1
        chosen.append(rest.pop(at))
    return [c[0] for c in chosen]


@pytest.mark.parametrize("cap", [0, 1, 2])
def test_mmr_equals_a_plain_loop(spark, cap):
    rng = np.random.default_rng(cap)
    rows = sorted([(i, f"s{i % 4}" if i % 5 else "", round(float(rng.random()), 3), rng.standard_normal(6)) for i in range(25)], key=lambda r: -r[2])
    df = spark.createDataFrame([(1, i, s, rel, [float(x) for x in v], p) for p, (i, s, rel, v) in enumerate(rows)], "request_id int, chunk_id int, source string, final_score double, vector array<double>, pos int")
    assert [r["chunk_id"] for r in retrieve.mmr(df, 8, 0.7, cap).orderBy("mmr_rank").collect()] == plain_mmr(rows, 8, 0.7, cap)


def kb(spark):
    words = {"a1": "login password token", "a2": "sql injection query", "b1": "login throttling", "b2": "backup restore"}
    chunks = spark.createDataFrame([(c[0], c, f"{c[0]}.md", t) for c, t in words.items()], "kb string, chunk_id string, source string, text string")
    vec = spark.createDataFrame([(c[0], c, [float(i == j) for j in range(4)]) for i, c in enumerate(words)], "kb string, chunk_id string, embedding array<double>")
    return chunks, vec


def test_search_and_retrieve(spark):
    chunks, vec = kb(spark)
    q = spark.createDataFrame([("q0", "r", 0, "login", [1.0, 0.1, 0.3, 0.0]), ("q1", "r", 1, "sql query", [0.0, 1.0, 0.0, 0.2])], "query_id string, request_id string, query_pos int, text string, embedding array<double>")
    first = lambda strategy: {(r["query_id"], r["kb"]): r["chunk_id"] for r in retrieve.search(q, chunks, vec, 1, strategy).collect()}
    assert first("dense")[("q0", "a")] == "a1" and first("hybrid")[("q0", "b")] == "b1" and first("hybrid")[("q1", "a")] == "a2"
    req = spark.createDataFrame([("r", "login")], "request_id string, query string")
    results, cands = retrieve.retrieve(req, q, chunks, vec, retrieve.Options(topk=2, min_score=0.0, reranker="off"))
    assert cands.count() == 4 and results.count() == 2
    best = retrieve.retrieve(req, q, chunks, vec, retrieve.Options(topk=1, min_score=0.0, reranker="llm"), reranker=retrieve.overlap_reranker)[0].first()
    assert best["chunk_id"] == "b1" and best["rerank_score"] == 1.0

    def broken(query, texts):
        raise RuntimeError

    assert retrieve.retrieve(req, q, chunks, vec, retrieve.Options(topk=1, reranker="auto"), reranker=broken)[0].first()["rerank_score"] is None
    with pytest.raises(retrieve.RetrievalError):
        retrieve.retrieve(req, q, chunks, vec, retrieve.Options(reranker="llm"))
    assert retrieve.retrieve(req, q, chunks, vec, retrieve.Options(strategy="dense", topk=3))[0].count() == 3
    blocks = results.select("request_id", "pos", retrieve.context_block(F.col("kb"), F.col("chunk_id"), F.lit(0.5), F.col("source"), F.col("text")).alias("block"))
    assert retrieve.context_text(blocks).first()["context_text"].startswith("[KB:")


FINDING = "request_id int, pos int, title string, severity string, score double, references array<string>, confidence double, evidence_nodes array<string>, evidence_edges array<string>, why string"


def finding(pos, title="t", severity="Low", score=1.0, refs=("ASVS",), conf=None, nodes=("n",), edges=(), why="because"):
    return (1, pos, title, severity, score, list(refs), conf, list(nodes), list(edges), why)


def test_denoise(spark):
    rows = [finding(0, "A", "Medium", 5.0), finding(1, "a", "Medium", 5.0, nodes=("n",)), finding(2, "B", "High", 5.0), finding(3, refs=("owasp asvs",)), finding(4, refs=()), finding(5, conf=0.1), finding(6, nodes=()), finding(7, why="   no  "), finding(8, "C", "Low", 5.0, nodes=(), edges=("e",))]
    out = findings.denoise(spark.createDataFrame(rows, FINDING), 0.5, True, topn=4).orderBy("id").collect()
    assert [(r["id"], r["title"]) for r in out] == [("T001", "B"), ("T002", "C"), ("T003", "A")]  # the limit comes first: the fourth was a duplicate
    again = findings.denoise(spark.createDataFrame([finding(9)], FINDING).limit(0))
    assert again.count() == 0
    assert findings.denoise(spark.createDataFrame(rows, FINDING), topn=0).count() == 4


def test_citations(spark):
    cands = spark.createDataFrame([(1, "k", "c1", "s", "alpha beta", 0.9, 1), (1, "j", "c1", "s", "gamma", 0.95, 2), (1, "k", "c2", "s", "title text", 0.1, 3), (1, "k", "", "s", "x", 1.0, 4)], "request_id int, kb string, chunk_id string, source string, text string, final_score double, pos int")
    f = spark.createDataFrame([(1, 0, "title", "text", [], [], [("k", "", "c1"), ("k", "", "c1"), ("zz", "", "c1"), ("", "", "no")]), (1, 1, "title", "text", [], [], [])], "request_id int, pos int, title string, why string, stride array<string>, affected array<string>, rag_sources array<struct<kb:string,source:string,chunk_id:string>>")
    kept, dropped = citations.attach(f, cands, 0.0)
    got = {r["pos"]: [(s["kb"], s["chunk_id"], s["method"]) for s in r["rag_sources"]] for r in kept.collect()}
    assert got[0] == [("k", "c1", "llm"), ("j", "c1", "llm")] and got[1][0] == ("k", "c2", "auto") and len(got[1]) == 2 and dropped.count() == 0
    none, gone = citations.attach(f, cands.limit(0))
    assert none.count() == 0 and gone.first()["n"] == 2


def rect(spark, *rows):
    return spark.createDataFrame([("g", *r) for r in rows], "graph_id string, id string, name string, x double, y double, width double, height double")


def test_rectangles(spark):
    r = rect(spark, ("o", "O", 0.0, 0.0, 10.0, 10.0), ("i", "", 1.0, 1.0, 3.0, 3.0), ("p", "P", 0.0, 0.0, 10.0, 10.0), ("z", "Z", 5.0, 5.0, 0.0, 0.0), ("t", "T", 10.0, 0.0, 5.0, 5.0))
    parents = {x["id"]: (x["parent_id"], x["name"]) for x in zones.rect_parents(r).collect()}
    assert parents["o"] == (None, "O") and parents["p"][0] == "o" and parents["i"][0] in ("o", "p") and parents["i"][1] == "i" and parents["t"][0] is None
    pt = spark.createDataFrame([("g", "n", 10.0, 0.0), ("h", "m", 1.0, 1.0)], "graph_id string, node_id string, cx double, cy double")
    assert {x["zone_id"] for x in zones.points_in_rects(pt, r).collect()} == {"o", "p", "t"}
    assert {x["id"] for x in zones.holding_others(r).collect()} == {"o", "p"}


def test_rectangles_of_a_large_diagram(spark):
    rng = np.random.default_rng(6)
    rows = [(f"r{i}", f"R{i}", float(x), float(y), float(w), float(h)) for i, (x, y, w, h) in enumerate(zip(rng.integers(0, 300, 400), rng.integers(0, 300, 400), rng.integers(0, 120, 400), rng.integers(0, 120, 400), strict=True))]
    r = rect(spark, *rows)
    pts = [(f"p{i}", float(x), float(y)) for i, (x, y) in enumerate(rng.integers(-20, 450, (300, 2)))]
    got = {(x["node_id"], x["zone_id"]) for x in zones.points_in_rects(spark.createDataFrame([("g", *p) for p in pts], "graph_id string, node_id string, cx double, cy double"), r).collect()}
    assert got == {(p, i) for p, cx, cy in pts for i, _, x, y, w, h in rows if x <= cx <= x + w and y <= cy <= y + h} and got
    inside = lambda a, b: a[0] != b[0] and a[2] <= b[2] and a[3] <= b[3] and a[2] + a[4] >= b[2] + b[4] and a[3] + a[5] >= b[3] + b[5]
    larger = lambda a, b: a[4] * a[5] > b[4] * b[5] or (a[4] * a[5] == b[4] * b[5] and a[0] < b[0])
    want = {b[0]: min(((a[4] * a[5], a[0]) for a in rows if inside(a, b) and larger(a, b)), default=(0, None))[1] for b in rows}
    assert {x["id"]: x["parent_id"] for x in zones.rect_parents(r).collect()} == want
    sized = [a for a in rows if a[4] > 0 and a[5] > 0]
    assert sorted(x["id"] for x in zones.holding_others(r).collect()) == sorted(a[0] for a in sized if any(inside(a, b) for b in sized))


def test_zone_forest(spark):
    z = spark.createDataFrame([("g", "a", "A", None), ("g", "b", "B", "a"), ("g", "s", "S", "s"), ("g", "x", "X", "y"), ("g", "y", "Y", "x"), ("g", "u", "U", "gone")], "graph_id string, id string, name string, parent_id string")
    assert {r["id"]: r["depth"] for r in zones.depths(z).where("id in ('a','b','s','u')").collect()} == {"a": 0, "b": 1, "s": 0, "u": 0}
    assert {r["id"]: r["path"] for r in zones.paths(z).where("id in ('b','s')").collect()} == {"b": "A > B", "s": "S"}
    assert {r["id"] for r in zones.cyclic(z).collect()} == {"s", "x", "y"}


def test_zones_of_any_depth_and_number(spark):
    chain = spark.range(150).select(F.lit("g").alias("graph_id"), F.col("id"), F.when(F.col("id") > 0, F.col("id") - 1).alias("parent_id"), F.col("id").cast("string").alias("name"))
    assert {r["id"]: r["depth"] for r in zones.depths(chain).collect()} == {i: i for i in range(150)}
    assert zones.paths(chain).where("id = 149").first()["path"] == " > ".join(map(str, range(150))) and zones.cyclic(chain).count() == 0
    ring = spark.range(7).select(F.lit("r").alias("graph_id"), F.col("id"), F.when(F.col("id") < 5, F.pmod(F.col("id") + 1, F.lit(5))).otherwise(F.col("id") - 1).alias("parent_id"))
    up = zones.closure(ring)
    assert {(r["id"], r["ancestor"]): r["distance"] for r in up.collect()} == {(i, (i + d) % 5): d for i in range(5) for d in range(5)} | {(5, 5): 0, (6, 6): 0, (6, 5): 1} | {(5, (4 + d) % 5): 1 + d for d in range(5)} | {(6, (4 + d) % 5): 2 + d for d in range(5)}
    many = spark.range(1_200_000).select(F.expr("id div 2").alias("graph_id"), F.expr("id % 2").alias("id"), F.expr("if(id % 2 = 1, 0, null)").alias("parent_id"))
    assert zones.closure(many).count() == 1_800_000


def test_absolute_geometry(spark):
    c = spark.createDataFrame([("g", "a", None, 1.0, 2.0), ("g", "b", "a", 10.0, 20.0), ("g", "c", "d", 1.0, 1.0), ("g", "d", "c", 5.0, 5.0)], "graph_id string, id string, parent string, x double, y double")
    assert {r["id"]: (r["x"], r["y"]) for r in zones.absolute(c).collect()} == {"a": (1, 2), "b": (11, 22), "c": (6, 6), "d": (6, 6)}


def graph(spark):
    nodes = spark.createDataFrame([("g", 0, "a", "Web", "Z", ["z"]), ("g", 1, "b", "Db", None, []), ("g", 2, "c", "Web", None, [])], "graph_id string, node_pos int, id string, label string, zone string, zones array<string>")
    edges = spark.createDataFrame([("g", 0, "a", "b", "x", "e1"), ("g", 1, "a", "b", None, "e2"), ("g", 2, "b", "a", "y", None)], "graph_id string, edge_pos int, src string, dst string, label string, id string")
    return nodes, edges


def test_evidence(spark):
    nodes, edges = graph(spark)
    f = spark.createDataFrame([("g", "T1", 0, ["a", "zz", "a"], ["a->b:x", "a -> b", "b->a", "e1", "a->b: q", "q->r"]), ("g", "T2", 1, ["a"], [])], "graph_id string, id string, pos int, evidence_nodes array<string>, evidence_edges array<string>")
    assert {r["node_id"]: r["findings"] for r in evidence.to_nodes(f, nodes).collect()} == {"a": ["T1", "T1", "T2"], "b": [], "c": []}
    assert {r["ref"]: r["edge_pos"] for r in evidence.resolve_edges(f, edges).collect()} == {"a->b:x": 0, "a -> b": 1, "b->a": 2, "e1": 0, "a->b: q": 1, "q->r": None}


def test_new_ids_are_unique(spark):
    f = spark.createDataFrame([("g", p, i, "x") for p, i in enumerate(["T1", "T1", "T1-tt", "T1", "", None, "T2"])] + [("h", 0, "T1", "y")], "graph_id string, pos int, id string, title string")
    used = spark.createDataFrame([("g", "T2"), ("g", "T2-tt"), ("g", "T2-tt-1"), ("h", "T9")], "graph_id string, id string")
    out = evidence.unique_ids(f, used).orderBy("graph_id", "pos").collect()
    assert [r["new_id"] for r in out] == ["T1", "T1-tt", "T1-tt-tt", "T1-tt-1", "TT-threat", "TT-threat-tt", "T2-tt-2", "T1"] and {r["title"] for r in out} == {"x", "y"}
    full = spark.createDataFrame([("g", x) for x in ["A", "A-tt", *(f"A-tt-{k}" for k in range(1, 1001))]], "graph_id string, id string")
    with pytest.raises(Exception, match="no free id"):
        evidence.unique_ids(spark.createDataFrame([("g", 0, "A")], "graph_id string, pos int, id string"), full).collect()


def test_evidence_goes_to_cells(spark):
    nodes, edges = graph(spark)
    cells = spark.createDataFrame([("g", 0, "a", "cell", None, None, None), ("g", 1, "f1", "flow", "a", "b", "x"), ("g", 2, "f2", "flow", "a", "b", None)], "graph_id string, cell_pos int, id string, kind string, src string, dst string, label string")
    f = spark.createDataFrame([("g", "T1", 0, ["Web"], ["Web->Db:x"]), ("g", "T2", 1, ["b"], ["a->b:none"]), ("g", "T3", 2, ["nobody"], [])], "graph_id string, id string, pos int, evidence_nodes array<string>, evidence_edges array<string>")
    assert {(r["finding_id"], r["cell_id"]) for r in evidence.to_cells(f, nodes, edges, cells).collect()} == {("T1", "a"), ("T1", "f1"), ("T2", "f1"), ("T3", None)}


def test_patch_keeps_absent_and_takes_null(spark):
    z = spark.createDataFrame([("g", 0, "o", "Out", None), ("g", 1, "i", "In", "o"), ("g", 2, "e", "Else", None)], "graph_id string, zone_pos int, id string, name string, parent_id string")
    n = spark.createDataFrame([("g", "a", "A", "In", ["i"], "t", ["x"], None, "n"), ("g", "b", "B", None, [], None, [], True, None), ("g", "c", "C", None, [], None, [], None, None)], "graph_id string, id string, label string, zone string, zones array<string>, type string, data array<string>, auth boolean, notes string")
    h = spark.createDataFrame([("g", "a", {"type": None, "auth": "true"}, ["OUT", "e"], ["y", "x"]), ("g", "b", {"label": "BB", "zone": "else"}, None, None), ("g", "c", {}, ["new"], None), ("g", "zz", {"label": "no"}, None, None)], "graph_id string, id string, attrs map<string,string>, zones array<string>, data array<string>")
    out = {r["id"]: r.asDict() for r in patch.patch_nodes(n, h, z).collect()}
    a, b, c = out["a"], out["b"], out["c"]
    assert a["type"] is None and a["label"] == "A" and a["auth"] is True and a["data"] == ["x", "y"] and a["zones"] == ["o", "i"] and a["zone"] == "In" and a["notes"] == "n"
    assert b["label"] == "BB" and b["zones"] == ["e"] and b["zone"] == "Else" and b["auth"] is True and c["zones"] == ["new"] and c["zone"] == "new" and "zz" not in out


def test_diff(spark):
    b = spark.createDataFrame([(1, "x"), (2, "y"), (3, None)], "id int, v string")
    a = spark.createDataFrame([(1, "x"), (3, "z"), (4, "n")], "id int, v string")
    s = diff.sides(b, a, ["id"], ["v"])
    assert {r["id"]: (r["side"], r["changes"]) for r in s.collect()} == {1: ("same", []), 2: ("removed", []), 3: ("changed", ["v"]), 4: ("added", [])}
    assert diff.counts(s, "nodes").first().asDict() == {"nodes_added": 1, "nodes_removed": 1, "nodes_changed": 1}
    assert diff.sides(a, a, ["id"], ["v"]).where("side <> 'same'").count() == 0 and [r["id"] for r in diff.only_in(a, b, ["id"]).collect()] == [4]
    k = lambda label, present: one(spark, k=diff.edge_key(F.lit("a"), F.lit("b"), F.lit(label), F.lit(present)))["k"]
    assert (k("l", True), k(None, True), k(None, False)) == ("a->b:l", "a->b:None", "a->b:")


def test_evaluation(spark):
    e = spark.createDataFrame([("s", "E1", [1.0, 0.0], None), ("s", "E2", [1.0, 0.1], 0.0), ("s", "E3", [0.0, 1.0], 0.99)], "scenario string, id string, embedding array<double>, threshold double")
    a = spark.createDataFrame([("s", "A1", 0, [1.0, 0.0]), ("s", "A2", 1, [1.0, 0.0]), ("t", "A3", 0, [0.0, 1.0])], "scenario string, id string, pos int, embedding array<double>")
    m = evaluate.embedded_matches(e, a, 0.5)
    assert {r["id"]: r["actual_id"] for r in m.collect()} == {"E1": "A2", "E2": "A2"}  # the last of equal scores; many to one
    assert {r["id"] for r in evaluate.embedded_matches(e, a, 0.5, one_to_one=True).collect()} == {"E1"}
    rep = {r["scenario"]: (r["accepted"], r["outputs"], r["gold"], r["precision"], r["recall"], r["f1"]) for r in evaluate.report(e, a, m).collect()}
    assert rep == {"s": (2, 2, 3, 1.0, 0.6667, 0.8), "t": (0, 1, 0, 0.0, 0.0, 0.0), None: (2, 3, 3, 0.6667, 0.6667, 0.6667)}
    assert evaluate.manual(2, 4, 5)["f1"] == 0.4444
    with pytest.raises(ValueError):
        evaluate.manual(5, 4, 5)


def test_sliding_log_counts_admitted_only(spark):
    rows = [(i, f"2024-01-01 00:00:{s:02d}", "k") for i, s in enumerate([0, 1, 2, 3, 58])] + [(9, "2024-01-01 00:01:01", "k")]
    df = spark.createDataFrame(rows, "event_id int, ts string, key string").withColumn("ts", F.col("ts").cast("timestamp"))
    assert {r["event_id"]: r["admitted"] for r in service.sliding_log(df, 2, 60).collect()} == {0: True, 1: True, 2: False, 3: False, 4: False, 9: True}


def test_client_addresses(spark):
    ip = lambda host, fwd, real, **k: one(spark, x=service.client_ip(F.lit(host), F.lit(fwd), F.lit(real), **k))["x"]
    assert ip("10.1.2.3", "junk, 1.2.3.4, 5.6.7.8", None, proxies=["10.0.0.0/8"]) == "1.2.3.4" and ip("11.1.2.3", "1.2.3.4", None, proxies=["10.0.0.0/8"]) == "11.1.2.3"
    assert ip("h", "300.1.1.1", " ::1 ") == "::1" and ip("h", None, None) == "h" and ip("h", "1.1.1.1", None, trust=False) == "h"


def test_window_helper_is_constant_safe(spark):
    df = spark.createDataFrame([(1, 2.0), (1, 2.0), (2, 0.0), (2, 4.0)], "g int, v double")
    assert [r["n"] for r in df.select("g", "v", retrieve.minmax(F.col("v"), Window.partitionBy("g")).alias("n")).orderBy("g", "v").collect()] == [1.0, 1.0, 0.0, 1.0]
