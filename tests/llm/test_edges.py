"""Nulls in any column, empty and very long texts, ties and repeated rows, empty tables, clashing extra columns: a defined result for each operator."""

from hashlib import md5

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.llm import chat_tools, embedding_dedup, hilbert_sharding, language_id, mixing, packing, quality_rules, shingle_join, simhash, url_filters, warc
from orrery.llm import queries as q
from orrery.llm.common import components, fresh_path, global_rank, written

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "the and of it was for with that this " * 30_000
ROWS = [
    (1, "the cat and the dog of the house that was with it", "en", "a", 10), (2, None, "en", "a", None), (3, "", None, None, 0), (4, " \n\t ", "de", "b", 3), (5, LONG, "en", "a", len(LONG)),
    (6, "der hund und die katze und das haus ist mit dem", "de", "b", 10), (6, "der hund und die katze und das haus ist mit dem", "de", "b", 10), (None, "el perro y la casa", "es", "c", 5), (7, "12 34 !!", None, "", 2),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def clash(df, *names):
    return df.withColumns({n: F.lit("x") for n in names})


def test_global_rank_is_total(spark):
    df = spark.range(1000).withColumn("k", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 7))
    out = global_rank(df, [F.col("k").asc(), F.col("id").desc()], "t").toPandas().sort_values("rank")
    assert out["rank"].tolist() == list(range(1000))
    assert out.sort_values(["k", "id"], ascending=[True, False])["rank"].is_monotonic_increasing


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(1, 200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5000, 5000)]
    out = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert out == {i: 1 for i in range(1, 201)} | {1000 + i: 1000 for i in range(300)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_written_is_in_the_shared_folder(spark):
    folder = spark.conf.get("spark.checkpoint.dir")
    assert written(spark.range(3), "t")._orrery_path.startswith(folder.rstrip("/"))


def test_curve_is_hilbert():
    for d, b in ((2, 4), (3, 3)):
        n = 1 << (d * b)
        cells = np.stack([np.arange(n) >> (b * i) & ((1 << b) - 1) for i in range(d)], 1)
        at = hilbert_sharding.curve_index(cells, b)
        assert sorted(at) == list(range(n)) and (np.abs(np.diff(cells[np.argsort(at)], axis=0)).sum(1) == 1).all()


def test_sharding_edges(docs, none):
    out = hilbert_sharding.assign(clash(docs, "shard", "slot", "curve", "cell", "extra"), ["source", "lang", "n_chars"], shards=4).toPandas()
    assert len(out) == len(ROWS) and out.groupby("shard").size().tolist() == [3, 2, 2, 2] and set(out["extra"]) == {"x"}
    assert all(sorted(g["slot"]) == list(range(len(g))) for _, g in out.groupby("shard"))
    assert hilbert_sharding.assign(none, ["source", "n_chars"]).count() == 0
    wide = hilbert_sharding.assign(docs, ["source", "lang", "n_chars"], shards=4, bits=6).toPandas()  # beyond the table of cells
    assert len(wide) == len(ROWS)


def test_text_dimensions_count_whole(spark):
    rows = [(i, f"https://www.host-of-many-letters{i % 20}", i % 4, i) for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang long, n long").withColumn("lang", F.element_at(F.array(*[F.lit(x) for x in ("de", "en", "es", "fr")]), (F.col("lang") + 1).cast("int")))
    cells = hilbert_sharding.quantise(df, ["source", "lang", "n"]).select("source", "lang", "n", "__orrery_cell").toPandas()
    by = {c: cells.groupby(c)["__orrery_cell"].agg(lambda x, k=k: {int(v[k]) for v in x}) for k, c in enumerate(("source", "lang"))}
    assert all(len(x) == 1 for c in by.values() for x in c) and len({min(x) for x in by["source"]}) == 20 and sorted(min(x) for x in by["lang"])[-1] >= 24
    assert cells.sort_values("n")["__orrery_cell"].map(lambda v: v[2]).is_monotonic_increasing and cells["__orrery_cell"].map(lambda v: v[2]).nunique() >= 30


@pytest.mark.parametrize("bits", [2, 5, 6])
def test_order_equals_a_plain_curve(spark, bits):
    """The order against a curve walked by rotating and reflecting quadrants, which is another way to the same curve."""

    def walked(x, y, side):
        d, s = 0, side // 2
        while s:
            rx, ry = int(x & s > 0), int(y & s > 0)
            d += s * s * ((3 * rx) ^ ry)
            if not ry:
                if rx:
                    x, y = side - 1 - x, side - 1 - y
                x, y = y, x
            s //= 2
        return d

    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(i, float(rng.normal()), float(rng.normal())) for i in range(500)], "doc_id long, a double, b double")
    out = hilbert_sharding.assign(df, ["a", "b"], shards=8, bits=bits).toPandas().sort_values(["shard", "slot"])
    cells = hilbert_sharding.quantise(df, ["a", "b"], bits).toPandas().set_index("doc_id")["__orrery_cell"]
    one = [walked(int(cells[i][0]), int(cells[i][1]), 1 << bits) for i in out["doc_id"]]
    other = [walked(int(cells[i][1]), int(cells[i][0]), 1 << bits) for i in out["doc_id"]]
    assert one == sorted(one) or other == sorted(other)


def test_a_filter_reads_few_shards(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "source", "lang", "n_chars")
    out = hilbert_sharding.assign(df, ["source", "lang", "n_chars"], shards=64).toPandas()
    boxes = out.groupby("shard").agg({"source": set, "lang": set, "n_chars": ["min", "max"]})
    hits = lambda c, v: sum(v in s for s in boxes[(c, "set")])
    by_source, by_lang = (np.mean([hits(c, v) for v in out[c].dropna().unique()]) / 64 for c in ("source", "lang"))
    assert by_source < 0.5 and by_lang < 0.6, (by_source, by_lang)


def test_shards_are_written(spark, docs):
    path = fresh_path(spark, "shards")
    hilbert_sharding.write_shards(hilbert_sharding.assign(docs, ["source", "n_chars"], shards=2), path)
    assert spark.read.parquet(path).groupBy("shard").count().count() == 2


URLS = [("http://WWW.Example.com/en/x?q#f", "www.example.com", "/en/x", "www.example.com/en/", "allow"), ("https://a.example.com/en/", "a.example.com", "/en/", "example.com/en/", "block"), ("x://example.com/en", "example.com", "/en", "com/", "allow"),
        ("no scheme", "", "", None, "allow"), (None, "", "", None, "allow"), ("", "", "", None, "allow"), ("ftp://notcom/fr/", "notcom", "/fr/", None, "allow"), ("h://b.net/fr/1", "b.net", "/fr/1", "net/fr/", "block"), ("h://b.net", "b.net", "", None, "allow"), ("h://com/", "com", "/", "com/", "allow"), ("a://b.com/://c", "b.com", "/://c", "com/", "allow")]


def test_url_filters_edges(spark):
    rows = [(i, u[0], "x", "y") for i, u in enumerate(URLS)] + [(0, URLS[0][0], "x", "y")]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, verdict string")
    for inline in (64, 0):
        out = url_filters.judge(pages, q.RULES, inline=inline).orderBy("page_id").collect()
        assert [(r["host"], r["path"], r["rule"], r["verdict"]) for r in out] == [URLS[0][1:], *(u[1:] for u in URLS)]
        assert url_filters.judge(pages.limit(0), q.RULES, inline=inline).count() == 0


@pytest.mark.parametrize("n", [3, 64, 65, 400])
def test_url_index_equals_all_rules_tried(spark, n):
    import re

    rng = np.random.default_rng(n)
    words = [f"w{k}" for k in range(40)]
    rules = [url_filters.Rule.prefix(f"{words[rng.integers(40)]}.com/{words[rng.integers(40)]}/", ["allow", "block"][k % 2]) for k in range(n - 2)]
    rules += [url_filters.Rule("any", "block", r"/w1\b.*w2\b", ("w1", "w2")), url_filters.Rule("bare", "block", r"secret\d", ())]
    urls = [f"http://{words[rng.integers(40)]}.{words[rng.integers(40)]}.com/{words[rng.integers(40)]}/{words[rng.integers(40)]}{'secret1' if i % 50 == 0 else ''}" for i in range(500)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    want = []
    for u in urls:
        text = u.removeprefix("http://")
        fits = [(len(r.name), -k, r.name, r.verdict) for k, r in enumerate(rules) if re.search(r.pattern, text)]
        want.append(max(fits)[2:] if fits else (None, "allow"))
    for inline in (0, 64, 1000):
        assert [(r["rule"], r["verdict"]) for r in url_filters.judge(pages, rules, inline=inline).orderBy("page_id").collect()] == want
    assert any(w[0] for w in want)


def test_url_rules_of_any_pattern(spark):
    rules = [url_filters.Rule("ads", "block", r"/ads/\d+", ("ads",)), url_filters.Rule("any", "block", r"secret", ())]
    pages = spark.createDataFrame([(1, "http://a.b/ads/12"), (2, "http://a.b/ads/x"), (3, "http://a.b/my-secret")], "page_id long, url string")
    assert [r["rule"] for r in url_filters.judge(pages, rules).orderBy("page_id").collect()] == ["ads", None, "any"]


def test_language_id_edges(docs, none):
    profiles = language_id.learn(docs)
    out = language_id.identify(clash(docs, "lang_pred", "score"), profiles).toPandas()
    by = out.groupby("doc_id", dropna=False)["lang_pred"].first().to_dict()
    assert by[1] == "en" and by[6] == "de" and by[5] == "en" and [by[i] for i in (2, 3, 4, 7)] == ["und"] * 4 and len(out) == len(ROWS)
    assert language_id.identify(none, language_id.learn(none)).count() == 0
    assert language_id.Profiles({}).predict("word") == ("und", 0.0)


def plain_profile(texts, top):
    """The most frequent n-grams of words between single spaces, ties by length and characters."""
    from collections import Counter

    grams = Counter()
    for t in texts:
        for word in "".join(c if c.isalpha() else " " for c in t.lower()).split():
            s = f" {word} "
            grams.update(word)
            grams.update(s[i : i + 2] for i in range(len(s) - 1))
            grams.update(s[i : i + 3] for i in range(len(s) - 2))
    return sorted(grams, key=lambda g: (-grams[g], len(g), g))[:top]


def test_language_id_equals_a_plain_version(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    rows = docs.collect()
    profiles = {x: {g: k for k, g in enumerate(plain_profile([r["text"] for r in rows if r["lang"] == x], 400))} for x in {r["lang"] for r in rows} - {None}}
    found = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.identify(docs, language_id.learn(docs), ["doc_id"]).collect()}
    for r in rows:
        own = plain_profile([r["text"] or ""], 300)
        far = {x: sum(abs(p[g] - k) if g in p else 400 for k, g in enumerate(own)) for x, p in profiles.items()}
        best = min(sorted(far), key=far.get)
        assert found[r["doc_id"]] == ((best, pytest.approx(max(0, 1 - far[best] / (400 * len(own))))) if own else ("und", 0.0))


def test_long_texts_are_counted_in_pieces(monkeypatch):
    text = "Ὀδυσσεὺς, der Maß (l'été) 漢字、仮名 ΣΑΣ naïve " * 50
    want = language_id.gram_counts(text)
    monkeypatch.setattr(language_id, "AT_ONCE", 17)
    got = language_id.gram_counts(text)
    assert (got[0] == want[0]).all() and (got[1] == want[1]).all()


def test_shingles_of_long_texts_are_hashed_in_pieces(monkeypatch):
    text = " ".join(f"Word{k}" for k in range(500)).encode() + b" tail" + b"x" * 100
    for t in (text, b"", b" \n ", b"a b", b"a b c", text + b" "):
        monkeypatch.setattr(simhash, "AT_ONCE", 1 << 20)
        want = simhash.shingle_hashes(t, 3)
        monkeypatch.setattr(simhash, "AT_ONCE", 13)
        assert (simhash.shingle_hashes(t, 3) == want).all() and len(want) == max(1 if t.split() else 0, len(t.split()) - 2)


def test_rank_order_distance():
    codes = lambda t: np.array([ord(c) for c in t])
    p = language_id.Profiles({"x": codes("abc"), "y": codes("cba")}, size=3)
    assert p.distances(codes("abd")).tolist() == [0 + 0 + 3, 2 + 0 + 3]


def test_warc_round_trip_and_revisits(spark):
    body = "x" * 100
    rows = [(2, "u\r\nv", body, "z"), (1, None, body, "z"), (None, "n", body, "z"), (3, "a", "x" * 99, "z"), (4, "a", "x" * 99, "z"), (5, "a", None, "z"), (6, "é", "WARC/1.1\r\n\r\n\r\n\r\né", "z"), (7, "l", LONG, "z")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, record_type string")
    path = fresh_path(spark, "warc")
    warc.write_archives(warc.classified(pages), path, archive_bytes=4 << 20)
    out = warc.read_archives(spark, path).toPandas().set_index("record_id", drop=False)
    assert len(out) == len(rows) and not (out["record_type"] == "gap").any()
    assert out.loc["1", "record_type"] == "response" and out.loc["2", "record_type"] == "revisit" and out.loc["2", "refers_to"] == "1" and out.loc["2", "payload_bytes"] == 100
    assert out.loc["6", "html"] == rows[6][2] and out.loc["7", "html"] == LONG and out.loc["5", "payload_bytes"] == 0 and (out.loc[["3", "4"], "record_type"] == "response").all()
    empty = fresh_path(spark, "warc")
    warc.write_archives(warc.classified(pages.limit(0)), empty)
    assert warc.read_archives(spark, empty).count() == 0


def record(body: bytes, kind="response") -> bytes:
    import hashlib

    return f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Block-Digest: sha256:{hashlib.sha256(body).hexdigest()}\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"


def test_salvage_takes_no_record_that_a_damaged_one_quotes():
    quoting = record(b"<pre>" + record(b"FAKE" * 30) + b"</pre>")
    data = record(b"first" * 20) + quoting.replace(b"</pre>", b"</prE>") + record(b"third" * 20)
    s = warc.Salvage(data)
    assert [r.block for r in s] == [b"first" * 20, b"third" * 20] and [(g.offset, g.length, g.reason) for g in s.gaps] == [(len(record(b"first" * 20)), len(quoting), "block digest differs")]
    zipped = warc.Salvage(warc.member(quoting.replace(b"</pre>", b"</prE>")) + warc.member(record(b"third" * 20)))
    assert [r.block for r in zipped] == [b"third" * 20] and len(zipped.gaps) == 1
    longer = record(b"a" * 50).replace(b"Content-Length: 50", b"Content-Length: 51") + record(b"b" * 50)  # a broken frame is searched for records
    assert [r.block for r in warc.Salvage(longer)] == [b"b" * 50]


def test_salvage_bounds_members_and_checks_payloads():
    big = warc.Salvage(warc.member(record(b"0" * 5_000_000)) + warc.member(record(b"x")))  # as long as its header says
    assert [len(r.block) for r in big] == [5_000_000, 1] and not big.gaps
    for lies, why in ((record(b"0" * 5_000_000).replace(b"Content-Length: 5000000", b"Content-Length: 7"), "more than a record"), (b"WARC/1.1\r\nX: " + b"0" * 5_000_000, "headers of more than")):
        bomb = warc.Salvage(warc.member(lies) + warc.member(record(b"x")))
        assert [r.block for r in bomb] == [b"x"] and why in bomb.gaps[0].reason and bomb.gaps[0].length == len(warc.member(lies))
    short = warc.Salvage(warc.member(record(b"0" * 50).replace(b"Content-Length: 50", b"Content-Length: 9999")) + warc.member(record(b"x")))
    assert [r.block for r in short] == [b"x"] and len(short.gaps) == 1
    head = b"WARC/1.0\r\nWARC-Type: response\r\n%sContent-Length: 3\r\n\r\nabc\r\n\r\n"
    right = b"ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"
    fine = [head % x for x in (b"", b"WARC-Payload-Digest: sha1:AAAA\r\n", b"WARC-Payload-Digest: sha256:" + right + b"\r\n", b"Payload-Length: 3\r\n", b"Content-Type: application/http\r\nWARC-Payload-Digest: sha256:00\r\n")]
    assert all(len(list(warc.Salvage(x))) == 1 for x in fine)
    for bad in (b"WARC-Payload-Digest: sha256:00\r\n", b"Payload-Length: 4\r\n", b"WARC-Block-Digest: sha256:00\r\n"):
        s = warc.Salvage(head % bad + record(b"x"))
        assert [r.block for r in s] == [b"x"] and s.gaps[0].length == len(head % bad)


def test_damaged_archives_are_read_on(spark, tmp_path):
    import glob

    pages = spark.createDataFrame([(i, f"http://a/{i}", f"<p>page {i}</p>" * 20, "more") for i in range(60)] + [(60, "http://b", LONG, "more")], "page_id long, url string, html string, uri string")
    path = tmp_path / "warc"
    warc.write_archives(warc.classified(pages).coalesce(1), f"file://{path}", classes=(1000, 10_000))
    assert sorted(p.name for p in path.iterdir()) == ["0", "2"]
    (file,) = glob.glob(f"{path}/0/part-*")
    data = bytearray(open(file, "rb").read())
    places = [m.start() for m in warc.VERSION.finditer(bytes(data))]
    data[places[10] + 4] ^= 1  # the version line of record 10
    data[places[20] - 30] ^= 1  # the payload of record 19
    del data[places[40] - 50 :]  # cut within record 39
    (path / "0" / "damaged.warc").write_bytes(bytes(data))
    out = warc.read_archives(spark, f"file://{path}").toPandas()
    hurt = out[out["archive"].str.endswith("damaged.warc")]
    rows = hurt[hurt["record_type"] != "gap"]
    whole = out[~out["archive"].str.endswith("damaged.warc")]
    assert sorted(whole["record_id"].astype(int)) == list(range(61)) and len(rows) == 37 and rows["html"].notna().all()
    order = whole[whole["archive"].str.contains("/0/")].sort_values("offset")["record_id"].tolist()
    assert rows.sort_values("offset")["record_id"].tolist() == [r for k, r in enumerate(order[:39]) if k not in (10, 19)]
    gaps = hurt[hurt["record_type"] == "gap"].sort_values("offset")
    assert gaps["offset"].tolist() == [places[10], places[19], places[39]] and gaps["length"].tolist() == [places[11] - places[10], places[20] - places[19], len(data) - places[39]]
    assert gaps["reason"].str.contains("version|digest|length|end").all()
    with pytest.raises(Exception, match="damaged archive"):
        warc.read_archives(spark, f"file://{path}", gaps="raise").select("record_type").collect()


@pytest.mark.parametrize("zipped", [False, True])
def test_salvage_goes_on_after_damage(zipped):
    parts = [record(b"first" * 20), record(b"second" * 20), record(b"third" * 20)]
    if zipped:
        parts = [warc.member(p) for p in parts]
    data = bytearray(b"".join(parts))
    data[len(parts[0]) + len(parts[1]) // 2] ^= 0xFF
    s = warc.Salvage(bytes(data))
    assert [r.block for r in s] == [b"first" * 20, b"third" * 20]
    assert [(g.offset, g.length) for g in s.gaps] == [(len(parts[0]), len(parts[1]))]
    cut = warc.Salvage(bytes(data[:-30]))
    assert [r.block for r in cut] == [b"first" * 20] and cut.gaps[-1].offset + cut.gaps[-1].length == len(data) - 30
    assert list(warc.Salvage(b"")) == [] and list(warc.Salvage(b"garbage")) == []


def test_quality_edges(spark, docs, none):
    out = quality_rules.judge(clash(docs, "kept", "n_words", "frequent", "_source")).toPandas()
    assert len(out) == len(ROWS) and out[out["doc_id"] == 2]["n_words"].tolist() == [0] and out[out["doc_id"] == 5]["n_repeat_words"].tolist() == [270_000]
    assert quality_rules.judge(none).count() == 0
    three = spark.createDataFrame([(1, "a b c d a b c")], "doc_id long, text string").select(quality_rules.base_metrics(F.col("text")).alias("m")).first()["m"]
    assert three["w"]["n_repeat_words"] == 6 and three["w"]["n_words"] == 7


def test_quality_removes_lines_that_many_documents_share(spark):
    boiler, own = "subscribe to our letter " * 15, "words of document {0} that say {0} things about {0} " * 1
    rows = [(i, boiler + "\n" + " ".join(f"w{i}x{k}" for k in range(60)), "h") for i in range(40)] + [(100, boiler + "\n" + own.format(100), "h")]
    same = "\n".join(" ".join(f"c{line}w{k}" for k in range(30)) for line in range(4))
    rows += [(200 + i, same, "h") for i in range(60)]  # copies are one document
    out = quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, source string"), min_docs=20, left_percent=60).toPandas().set_index("doc_id")
    assert (out["removed_words"].loc[:100] == 60).all() and out.loc[200:, "kept"].all() and not out.loc[100, "kept"]
    assert "subscribe" not in out.loc[1, "kept_text"] and (out.loc[200:, "removed_words"] == 0).all()


def test_quality_counts_documents_whose_smallest_line_hash_is_shared(spark):
    texts = [[f"text {i} holds line {k} alone" for k in range(3)] for i in range(24)]
    rest = min(md5(x.encode()).hexdigest() for t in texts for x in t)
    shared = next(x for x in (f"shared line {k}" for k in range(100_000)) if md5(x.encode()).hexdigest() < rest)
    rows = [(i, "\n".join([shared, *t]), "h") for i, t in enumerate(texts)] + [(100 + i, "\n".join(["lone", *texts[0]]), "h") for i in range(30)]
    found = quality_rules.frequent_lines(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert [(r["source"], r["frequent"]) for r in found] == [("h", [md5(shared.encode()).hexdigest()[:16]])]


def test_simhash_edges(docs, none):
    out = simhash.near_duplicates(clash(docs, "fp", "fingerprint", "component_id").select("doc_id", "text", "fp")).toPandas()
    by = out.groupby("doc_id", dropna=False)[["fingerprint", "component_id"]].first()
    assert len(out) == len(ROWS) and (by.loc[[2, 3, 4], "fingerprint"] == "0" * 16).all() and (by.loc[[2, 3, 4], "component_id"] == 2).all()
    assert by.loc[6, "component_id"] == 6 and simhash.near_duplicates(none).count() == 0


@pytest.mark.parametrize("hot", [4, 20_000])
def test_trie_join_finds_every_link(spark, hot):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**64, 60, dtype=np.uint64)
    near = [b ^ np.uint64(sum(1 << int(x) for x in rng.choice(64, k, replace=False))) for b in base[:30] for k in (1, 2, 3, 4)]
    low = np.arange(40, dtype=np.uint64) * np.uint64(7)  # many with one value of three blocks
    fps = np.unique(np.concatenate([base, np.array(near, np.uint64), low]))
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    found = {r["node"]: r["component"] for r in components(simhash.links(df, hot=hot)).collect()}
    from tests.llm.test_queries import components as brute

    ids = fps.view(np.int64).tolist()
    want = brute(fps, ids)
    got = [found.get(i, i) for i in ids]
    assert len(set(zip(got, want, strict=True))) == len(set(got)) == len(set(want))


def test_embedding_edges(spark):
    v = [1.0, 0.0, 0.5]
    rows = [(1, v, 1), (2, v, 1), (3, [2 * x for x in v], 1), (4, v, 2), (5, v, None), (6, None, 1), (7, [0.0, 0.0, 0.0], 1), (8, [1.0, float("nan"), 0.0], 1), (9, [1.0, None, 0.0], 1), (10, [float("inf"), 0.0, 0.0], 1), (None, v, 1), (11, [1.0, 0.0], 1), (12, [], 1), (2, v, 1)]
    df = clash(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), "n_links", "id", "home")
    out = {(r["vec_id"], r["label"]): (r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.near_duplicates(df).collect()}
    assert out[(1, 1)] == (3, 1, True) and out[(2, 1)] == (3, 1, False) and out[(3, 1)] == (3, 1, False) and out[(4, 2)] == (0, 4, True)
    assert all(out[(i, 1)] == (0, i, True) for i in (6, 7, 8, 9, 10, 11, 12)) and out[(5, None)] == (0, 5, True) and out[(None, 1)] == (0, None, None)
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize(("tile", "dense"), [(16, 8), (16, 1000), (4096, 8), (1, 1000)])
def test_embedding_tiles_equal_brute_force(spark, monkeypatch, tile, dense):
    monkeypatch.setattr(embedding_dedup, "TILE", tile)
    monkeypatch.setattr(embedding_dedup, "DENSE", dense)
    rng = np.random.default_rng(3)
    x = rng.standard_normal((12, 24)).repeat(12, axis=0) + 0.12 * rng.standard_normal((144, 24))
    df = spark.createDataFrame([(i, [float(a) for a in r], i % 2) for i, r in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup.near_duplicates(df).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = (u @ u.T >= 0.98) & (np.arange(144)[:, None] % 2 == np.arange(144)[None] % 2) & ~np.eye(144, dtype=bool)
    assert 0 < link.sum() and all(got[i][0] == link[i].sum() for i in range(144))
    root = np.arange(144)
    for _ in range(144):
        root = np.minimum(root, np.where(link, root[None], 999).min(axis=1))
    assert [got[i][1] for i in range(144)] == root.tolist()


CALLS = "conv_id long, call_id string, pos long, name string, arguments string, after array<string>"


def test_tool_calls_edges(spark):
    tool = chat_tools.Tool.of("f", {"type": "object", "properties": {"x": {"type": "integer"}, "s": {"type": "string"}, "l": {"type": "array"}}, "required": ["x"], "additionalProperties": False})
    calls = spark.createDataFrame([(1, "a", 0, "f", '{"s":"é\\n","x":1}', []), (1, "b", 1, "f", '{"x":"1"}', ["a"]), (1, "b", 2, "f", '{"x":2}', []), (1, "c", 3, "g", "{}", ["zz"]), (1, "d", 4, "f", "no json", None), (1, "n", 5, None, None, []),
                                   (2, "p", 0, "f", '{"x":1,"y":[]}', ["q"]), (2, "q", 1, "f", '{"x":1.5}', []), (3, "r", 0, "f", '{"x":1}', ["s"]), (3, "s", 1, "f", '{"x":1}', ["r"]), (None, "x", 0, "f", "{}", []), (4, None, 0, "f", "{}", [])], CALLS)
    results = spark.createDataFrame([(1, "a", 9, "ok"), (1, "a", 8, None), (1, "o", 1, "lost"), (None, "a", 1, "x")], "conv_id long, call_id string, pos long, content string")
    out = {(r["conv_id"], r["call_id"]): r for r in chat_tools.link(calls, results, [tool]).collect()}
    assert len(out) == 10
    a = out[(1, "a")]
    assert a["valid"] and a["status"] == "linked" and a["n_results"] == 2 and a["json"] == '{"arguments":{"s":"é\\n","x":1},"id":"a","name":"f","result":null}'
    assert out[(1, "b")]["errors"] == ["x is not integer"] and out[(1, "b")]["n_calls"] == 2 and out[(1, "c")]["errors"] == ["unknown tool", "unknown dependency zz"]
    assert out[(1, "d")]["errors"] == ["arguments are not an object"] and out[(1, "n")]["errors"] == ["arguments are not an object"] and out[(1, "o")]["status"] == "orphan"
    assert out[(2, "p")]["errors"] == ["unexpected y"] and out[(2, "q")]["errors"] == ["x is not integer"] and out[(2, "q")]["place"] < out[(2, "p")]["place"]
    assert out[(3, "r")]["errors"] == ["cyclic"] and out[(3, "r")]["place"] is None
    assert chat_tools.link(calls.limit(0), results.limit(0), [tool]).count() == 0


def test_tool_schemas_nest(spark):
    schema = {"type": "object", "required": ["to", "tags"], "properties": {
        "to": {"type": "object", "required": ["city"], "properties": {"city": {"type": "string", "enum": ["Oslo", "Rome"]}, "zip": {"type": ["string", "null"]}}, "additionalProperties": False},
        "tags": {"type": "array", "items": {"type": "object", "properties": {"n": {"type": "number"}}}}, "mode": {"enum": [1, "a", None]}}}
    cases = {
        '{"to":{"city":"Oslo","zip":null},"tags":[{"n":1.5},{}],"more":1}': [], '{"to":{"city":"Bonn","x":1},"tags":[{"n":"1"},3,{"n":"2"}]}': ["to.city is none of its values", "unexpected to.x", "tags[].n is not number", "tags[] is not object"],
        '{"to":[],"mode":2}': ["to is not object", "missing tags", "mode is none of its values"], '{"to":{"zip":5},"tags":"x","mode":null}': ["missing to.city", "to.zip is not string or null", "tags is not array"], "[1]": ["arguments are not an object"],
    }
    df = spark.createDataFrame([(a,) for a in cases], "a string").select("a", chat_tools.errors(F.lit("f"), F.col("a"), [chat_tools.Tool.of("f", schema)]).alias("e"))
    assert {r["a"]: sorted(r["e"]) for r in df.collect()} == {a: sorted(e) for a, e in cases.items()}


def plain_places(calls):
    """Levels by conversation and call, of calls (conv_id, call_id, pos, after)."""
    out = {}
    for conv in {c[0] for c in calls}:
        own = {c[1]: c for c in calls if c[0] == conv}
        deps = {i: {d for d in c[3] or [] if d in own} for i, c in own.items()}
        if all(own[d][2] < own[i][2] for i, ds in deps.items() for d in ds):
            out |= {(conv, i): c[2] for i, c in own.items()}
            continue
        level = {}
        while new := {i: max((level[d] + 1 for d in ds), default=0) for i, ds in deps.items() if i not in level and ds <= level.keys()}:
            level |= new
        out |= {(conv, i): n for i, n in level.items()}
    return out


@pytest.mark.parametrize("in_a_row", [0, 50])
def test_places_equal_a_plain_sort(spark, in_a_row):
    rng = np.random.default_rng(2)
    rows = [(1, f"c{i}", i, [f"c{i + 1}"]) for i in range(300)]  # a chain forwards
    rows += [(2, f"c{i}", i, [f"c{(i + 1) % 7}"]) for i in range(7)] + [(2, "behind", 9, ["c3"]), (2, "free", 10, None)]  # a ring
    rows += [(c, f"c{i}", i, [f"c{k}" for k in rng.choice(30, int(rng.integers(0, 3)), replace=False) if int(k) != i]) for c in (3, 4, 5) for i in range(30)]
    order = [int(x) for x in rng.permutation(40)]
    rows += [(6, f"c{i}", i, [f"c{order[k]}" for k in rng.choice(place, min(place, 3), replace=False)] if place else []) for place, i in enumerate(order)]
    rows += [(7, f"c{i}", i, [f"c{i - 1}"] if i else []) for i in range(5)]
    calls = spark.createDataFrame(rows, "conv_id long, call_id string, pos long, after array<string>")
    got = {(r["conv_id"], r["call_id"]): r["place"] for r in chat_tools.places(calls, in_a_row).collect()}
    assert got == plain_places(rows) and len(got) > 350


def test_packing_fills_windows_best():
    assert packing.fill([3, 5, 7], {3: 4, 5: 1, 7: 1}, 12) in ({7: 1, 5: 1}, {3: 4})
    assert packing.fill([4], {4: 2}, 11) == {4: 2} and packing.fill([], {}, 5) == {} and packing.fill([9], {9: 1}, 5) == {}
    rng = np.random.default_rng(0)
    for _ in range(30):
        lengths = rng.integers(1, 60, 12).tolist()
        counts = {x: lengths.count(x) for x in lengths}
        taken = packing.fill(sorted(counts), counts, 100)
        sums = {0}
        for x in lengths:
            sums |= {s + x for s in sums if s + x <= 100}
        assert sum(k * n for k, n in taken.items()) == max(sums) and all(n <= counts[k] for k, n in taken.items())
        windows = packing.plan(lengths, 100)
        assert sorted(i for w in windows for i in w) == list(range(12)) and all(sum(lengths[i] for i in w) <= 100 for w in windows)


def test_packing_edges(docs, none):
    parts = written(packing.pieces(clash(docs, "start", "length", "sequence_id"), q.tokenizer_path()), "p")
    out = packing.pack(parts).toPandas()
    assert set(out[out["doc_id"] == 2]["length"]) == {1} and out[out["doc_id"] == 6].shape[0] == 2 and out[out["doc_id"] == 5]["length"].max() == 4096
    assert all(len(i) == n for i, n in zip(out["ids"], out["length"], strict=True))
    assert packing.pack(written(packing.pieces(none, q.tokenizer_path(), with_ids=False), "p")).count() == 0


@pytest.mark.parametrize("text", ["Ünïcode’s DON'T don't 'tis it's. x--y!! 12ab <|endoftext|> a<|EndOfText|>. é. ÷× ıİ ß.  x\u3000y \x85z ab́c #tag... É, Ǆ 漢字 \x1cq", "", " ", LONG[:5000]])
def test_remembered_words_equal_the_tokenizer(text):
    from tokenizers import Tokenizer

    want = np.array(Tokenizer.from_file(q.tokenizer_path()).encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    assert packing.WordTokens(q.tokenizer_path()).encode([text.encode()]) == [want]


def test_mixing_edges(docs, none):
    out = mixing.mix(clash(docs, "size", "target", "copies", "rank")).toPandas()
    assert len(out) == len(ROWS) and out[out["doc_id"] == 2]["size"].tolist() == [0] and (out["copies"] <= 2).all() and out[out["source"].isna()]["target"].tolist() == [0.0]
    assert mixing.mix(none).count() == 0
    kept = mixing.emit(mixing.mix(docs, keep=["text", "lang"])).toPandas()
    assert len(kept) == out["copies"].sum() and set(kept.columns) >= {"doc_id", "text", "lang", "source"}


def test_many_sources_have_the_same_targets(spark):
    rng = np.random.default_rng(9)
    s = spark.createDataFrame([(f"s{i:03d}", int(rng.integers(0, 1000) ** 2)) for i in range(300)] + [(None, 7)], "source string, source_size long")
    few, many = ({r["source"]: (r["weight"], r["target"]) for r in mixing.targets(s, one_task=n).collect()} for n in (1000, 0))
    assert few == many and len(few) == 301
    assert mixing.targets(s.limit(0), one_task=-1).count() == 0


def test_targets_by_hand(spark):
    s = spark.createDataFrame([("a", 100), ("b", 1000), ("c", 10), (None, 50)], "source string, source_size long")
    t = {r["source"]: r["target"] for r in mixing.targets(s).collect()}
    # weights 3, 1, 2, 3; the share is 1740: c, a and null fill at 20, 200 and 100, b takes the rest
    assert t == {"a": 200.0, "c": 20.0, None: 100.0, "b": 1420.0}


def plain_survivors(rows):
    """Indexes of rows (doc_id, text): the first by doc_id, nulls last, of each component of Jaccard similarities of 0.8 or more."""
    words = [t.lower().split() for _, t in rows]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in words]
    root = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            if len(a & sets[j]) * 5 >= len(a | sets[j]) * 4:
                x, y = root[i], root[j]
                root = [y if r == x else r for r in root]
    return {min((k for k in range(len(rows)) if root[k] == r), key=lambda k: (rows[k][0] is None, rows[k][0] or 0)) for r in set(root)}


@pytest.mark.parametrize("frequent", [1, 5])
def test_edited_copies_go_and_others_stay(spark, frequent, monkeypatch):
    monkeypatch.setattr(shingle_join, "SAMPLE", 2)
    monkeypatch.setattr(shingle_join, "FREQUENT", frequent)
    rng = np.random.default_rng(5)
    passage, rows = [f"p{k}" for k in range(60)], []
    for i in range(12):
        text = [f"w{i}x{k}" for k in range(int(rng.integers(30, 200)))] + passage
        for edits in (0, 0, 1, 2, 3, 4, 6, 9, 12):
            copy = list(text)
            for at in rng.choice(len(copy), edits, replace=False):
                copy[at] = f"e{rng.integers(1 << 30)}"
            rows.append((len(rows), " ".join(copy[int(rng.integers(0, 6)) :])))
    rows = [rows[k] for k in rng.permutation(len(rows))]
    want = {rows[k][0] for k in plain_survivors(rows)}
    found = shingle_join.survivors(spark.createDataFrame(rows, "doc_id long, text string")).toPandas()["doc_id"].tolist()
    assert sorted(found) == sorted(want) and 12 < len(want) < len(rows)
    near = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).where("doc_id = component_id").count()
    assert near > len(want)  # three bits leave edited copies


def test_edited_copies_are_chosen_by_row(spark):
    import corpus_pipeline

    a, b, c = (" ".join(f"{x}{k}" for k in range(40)) for x in "abc")
    rows = [(1, a), (2, a), (2, b), (3, c), (3, c), (None, c), (None, "lone " + " ".join(f"d{k}" for k in range(40))), (None, "lone " + " ".join(f"d{k}" for k in range(40)))]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = [(r["doc_id"], r["text"][:2]) for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()]
    assert sorted(out, key=str) == sorted([(1, "a0"), (2, "b0"), (3, "c0"), (None, "lo")], key=str)
    assert corpus_pipeline.drop_near_duplicates(spark, docs.limit(0), "").count() == 0
