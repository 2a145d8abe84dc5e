"""Client addresses against the standard library, SQL functions against the column functions, reports of pairs against one pair's, table function."""

import json
from ipaddress import ip_address, ip_network

import pytest
from pyspark.sql import functions as F

from orrery.functions import sql
from orrery.functions.text import overlap, tokens, unquoted_label
from orrery.functions.vectors import cosine
from orrery.operators import diff, findings, index, service
from orrery.sources import exports

TEXTS = [
    "1.2.3.4", "01.2.3.4", "1.2.3", "256.1.1.1", "1.2.3.4.5", " 9.9.9.9\t", "", None, "::", "::1", "1::", "::::", ":::", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "1:2:3:4::5:6:7:8", "1:2:3:4:5:6:7:8:9", "2001:0DB8:0:0::00:A",
    "2001:db8:0:0:1:0:0:1", "0:0:0:1:0:0:0:0", "1:0:0:2:0:0:0:3", "fe80::1%eth0", "fe80::1%", "fe80::1%a%b", "::ffff:1.2.3.4", "::FFFF:102:304", "::1.2.3.4", "1:2:3:4:5:6:1.2.3.4", "1:2:3:4:5:6:7:1.2.3.4", "::01.2.3.4", "g::1", "12345::", "1.2.3.4::", ":1:2:3:4:5:6:7", "a", "-1.2.3.4", "1.2.3.4/8", "0:0:0:0:0:0:0:0", "0.0.0.0",
]


def plain(text):
    try:
        return str(ip_address((text or "").strip()))
    except ValueError:
        return None


def test_addresses_are_as_the_standard_library_has_them(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string")
    got = [r[0] for r in df.orderBy("i").select(service.address(F.col("t"))).collect()]
    assert {t: g for t, g in zip(TEXTS, got, strict=True)} == {t: plain(t) for t in TEXTS}


@pytest.mark.parametrize("network", ["10.0.0.0/8", "10.1.2.3", "0.0.0.0/0", "2001:db8::/32", "2001:db8:8::/45", "::/0", "::ffff:0:0/96", "fe80::1", "no network", "10.0.0.0/40"])
def test_networks(spark, network):
    hosts = ["10.1.2.3", "11.0.0.1", "2001:db8:9::1", "2001:DB8:10::", "2001:db9::", "::ffff:1.2.3.4", "fe80::1", "fe80::1%x", "nobody", None, "", "::"]
    df = spark.createDataFrame([(i, h) for i, h in enumerate(hosts)], "i int, h string")
    got = [r[0] for r in df.orderBy("i").select(service.in_network(F.col("h"), network)).collect()]

    def want(host):
        try:
            return ip_address(host or "") in ip_network(network, strict=False)
        except ValueError:
            return False

    assert got == [want(h) for h in hosts]


@pytest.mark.parametrize(("host", "forwarded", "real", "proxies", "trust", "want"), [
    ("10.0.0.1", "203.0.113.9, 10.0.0.1", None, ["10.0.0.1"], True, "203.0.113.9"),
    ("10.0.0.1", "203.0.113.9", None, ["10.0.0.2"], True, "10.0.0.1"),
    ("10.0.0.1", "203.0.113.9", None, None, False, "10.0.0.1"),
    (None, "203.0.113.9", None, None, True, None),
    ("", "203.0.113.9", None, None, True, ""),
    ("peer", "203.0.113.9", None, None, True, "203.0.113.9"),
    ("peer", "203.0.113.9", None, ["::/0", "0.0.0.0/0"], True, "peer"),
    ("2001:db8::5", "x, 2001:DB8:0::A", None, ["bad", "2001:db8::/32"], True, "2001:db8::a"),
    ("10.0.0.1", "x", "y, ::FFFF:1.2.3.4", ["10.0.0.0/24"], True, str(ip_address("::ffff:1.2.3.4"))),
    ("10.0.0.1", None, None, ["10.0.0.0/24"], True, "10.0.0.1"),
])
def test_client_addresses(spark, host, forwarded, real, proxies, trust, want):
    df = spark.createDataFrame([(host, forwarded, real)], "h string, f string, r string")
    assert df.select(service.client_ip(F.col("h"), F.col("f"), F.col("r"), trust, proxies)).first()[0] == want


def test_sql_functions_are_the_column_functions(spark):
    sql.register(spark)
    texts = ["The cat, the CAT a/b", "", None, ' "x y" ', "'x'", '"', '""', "'a\"", "  ", "a\n'b'\n", "ä ö"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").withColumn("tt", tokens(F.col("t")))
    out = df.selectExpr("*", "orrery_tokens(t) AS a", "orrery_unquoted(t) AS b", "orrery_overlap(tt, array('the', 'x')) AS c").withColumns({"d": unquoted_label(F.col("t")), "e": overlap(F.col("tt"), F.array(F.lit("the"), F.lit("x")))})
    for r in out.collect():
        assert r["a"] == r["tt"] and r["b"] == r["d"] and r["c"] == r["e"], r
    n = spark.createDataFrame([(2, 3, 10, 7, 5.5), (1, 10, 10, 0, 1.0)], "tf long, df long, n long, l long, avg double")
    for r in n.selectExpr("*", "orrery_bm25(tf, df, n, l, avg) AS a", "orrery_idf(n, df) AS b").withColumns({"c": index.bm25_term(*[F.col(x) for x in ("tf", "df", "n", "l", "avg")]), "d": index.idf(F.col("n"), F.col("df"))}).collect():
        assert abs(r["a"] - r["c"]) < 1e-12 and abs(r["b"] - r["d"]) < 1e-12
    v = spark.createDataFrame([([1.0, 2.0], [2.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>")
    for r in v.selectExpr("*", "orrery_cosine(a, b) AS c").withColumn("d", cosine(F.col("a"), F.col("b"))).collect():
        assert abs(r["c"] - r["d"]) < 1e-12
    f = spark.createDataFrame([("T", ["b", "a"], None)], "title string, evidence_nodes array<string>, evidence_edges array<string>")
    r = f.select(findings.signature().alias("a"), F.expr("orrery_signature(title, evidence_nodes, evidence_edges)").alias("b")).first()
    assert r["a"] == r["b"]
    plan = df.selectExpr("orrery_tokens(t)")._jdf.queryExecution().toString()
    assert "Python" not in plan and "orrery_tokens" not in plan.split("== Optimized Logical Plan ==")[1].split("Project")[1].split("AS")[0]


def test_chunks_as_a_table_function(spark):
    sql.register(spark)
    docs = spark.createDataFrame([("k", "s", "d1", "one two, three four five"), ("k", "s", "d2", "   "), ("k", "s", "d3", None), ("q", None, "d4", " x\ny. ")], "kb string, source string, stem string, text string")
    docs.createOrReplaceTempView("some_docs")
    for size, over in ((2, 1), (3, 3), (100, 0)):
        got = spark.sql(f"SELECT kb, source, chunk_id, chunk_index, token_count, text FROM orrery_chunks(TABLE(some_docs), {size}, {over})").collect()
        want = index.chunks(docs, size=size, overlap=over).select("kb", "source", "chunk_id", "chunk_index", "token_count", "text").collect()
        assert sorted(map(tuple, got), key=str) == sorted(map(tuple, want), key=str)
    with pytest.raises(Exception, match="chunk size"):
        spark.sql("SELECT * FROM orrery_chunks(TABLE(some_docs), 0, 0)").collect()


def sided(spark, rows, fields):
    b = spark.createDataFrame([(p, *r) for p, side, r in rows if "b" in side], ["pair_id", *fields])
    a = spark.createDataFrame([(p, *r) for p, side, r in rows if "a" in side], ["pair_id", *fields])
    return diff.sides(b, a, ["pair_id", fields[0]], fields[1:]), diff.sides(b, a, ["pair_id", *fields])


def test_reports_of_pairs_are_the_reports_of_each(spark):
    nodes, _ = sided(spark, [(1, "b", ("n1", "A|x", "t")), (1, "a", ("n2", "B", "t")), (1, "ba", ("n3", "C", "t")), (2, "ba", ("n1", "A", "t")), (2, "b", ("n5", "E", "t"))], ["id", "label", "type"])
    ids = {"n1": "A|x", "n2": "B", "n3": "C", "n5": "E"}
    name = F.create_map(*[F.lit(x) for kv in ids.items() for x in kv])
    nodes = nodes.withColumns({"name": name[F.col("id")], "label": name[F.col("id")], "type": F.lit("t")})
    _, edges = sided(spark, [(1, "a", ("n1", "n2", "q")), (2, "ba", ("n1", "n1", "q"))], ["src", "dst", "label"])
    _, found = sided(spark, [(1, "ba", ("T1", "x", "High")), (2, "b", ("T2", "y", "Low")), (2, "a", ("T3", "z", "Low"))], ["id", "title", "severity"])
    edges, found = edges.withColumn("name", F.concat_ws(" ", "src", "dst", "label")), found.withColumn("name", F.col("title"))
    rows = lambda df, fields: df.withColumn("row", F.create_map(*[x for f in fields for x in (F.lit(f), F.col(f))]))
    three = [rows(nodes, ["id", "label", "type"]), rows(edges, ["src", "dst", "label"]), rows(found, ["id", "title", "severity"])]
    out = {r["pair_id"]: r for r in diff.pair_reports(*three, spark.createDataFrame([(1, "told")], "pair_id long, narrative string")).collect()}
    for pair in (1, 2):
        own = [x.where(F.col("pair_id") == pair) for x in (nodes, edges, found)]
        assert json.loads(out[pair]["changes"]) == json.loads(exports.diff_changes(*own))
        assert out[pair]["markdown"].split() == exports.diff_markdown(*own, "told" if pair == 1 else "").split()
        assert out[pair]["nodes_removed"] == 1 and out[pair]["threats_added"] == pair - 1
