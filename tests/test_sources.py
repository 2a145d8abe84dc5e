"""Graph sources on small texts of our own."""

import base64
import json
import zlib
from urllib.parse import quote

import pytest
from pyspark.sql import functions as F

from orrery.sources import config, documents, drawio, graphs, image, ir, mermaid, threat_dragon


def texts(spark, *rows):
    return spark.createDataFrame([(str(i), t) for i, t in enumerate(rows)], "graph_id string, text string")


def edges(g):
    return [(r["src"], r["dst"], r["label"]) for r in g.edges.orderBy("graph_id", "edge_pos").collect()]


LINES = {
    "A --> B": [("A", "B", None)], "A -> B": [("A", "B", None)], "A ---> B": [("A", "B", None)], "A ==> B": [("A", "B", None)], "A -.-> B": [("A", "B", None)], "A <--> B": [("A", "B", None), ("B", "A", None)],
    "A <-->|x| B": [("A", "B", "x"), ("B", "A", "x")], "A -->|l| B": [("A", "B", "l")], "A --> B |l|": [("A", "B", "l")], "A -- l --> B": [("A", "B", "l")], 'A["x y"] --> B(("z"));': [("A", "B", None)], "A:::c --> B[[q]]": [("A", "B", None)],
    "A —-> B": [("A", "B", None)], "A -→ B": [("A", "B", None)], "A --> B %% note": [("A", "B", None)], "A --> B --> C": [], "A & B --> C": [], "A --- B": [], "A ----> B": [("A", "B", "-")], "A -- x -- B --> C": [("A", "C", "x -- B")], "%% A --> B": [], "": [],
}


def test_mermaid_lines(spark):
    g = mermaid.parse(texts(spark, *LINES))
    found = {}
    for r in g.edges.orderBy("graph_id", "edge_pos").collect():
        found.setdefault(int(r["graph_id"]), []).append((r["src"], r["dst"], r["label"]))
    assert {line: found.get(i, []) for i, line in enumerate(LINES)} == LINES


def test_mermaid_subgraphs_labels_and_metrics(spark):
    text = 'end\nA[One]\nsubgraph X["Outer"]\n  B{{Two}} --> A\nsubgraph in\nC[(Three)]\nend\nD --> C\nend\nend\nE --> A(New)\n'
    g = mermaid.parse(texts(spark, text))
    nodes = {r["id"]: (r["label"], r["zones"], r["zone"]) for r in g.nodes.collect()}
    assert nodes == {"A": ("New", ["zone_0"], '"Outer"'), "B": ("Two", ["zone_0"], '"Outer"'), "C": ("Three", ["zone_0", "zone_1"], "in"), "D": ("D", ["zone_0"], '"Outer"'), "E": ("E", [], None)}
    assert [(r["id"], r["name"], r["parent_id"]) for r in g.zones.orderBy("zone_pos").collect()] == [("zone_0", '"Outer"', None), ("zone_1", "in", "zone_0")]
    m = g.metrics.first()
    assert (m["total_lines"], m["edge_candidates"], m["edges_parsed"], m["node_labels_parsed"], m["import_success_rate"]) == (11, 3, 3, 2, 1.0)
    assert [r["id"] for r in g.nodes.orderBy("node_pos").collect()] == ["A", "B", "C", "D", "E"]


MODEL = '<mxGraphModel><root><mxCell id="0"/><mxCell id="1" parent="0"/><mxCell id="a" value="&lt;b&gt;A&lt;br/&gt;x&lt;/b&gt;" vertex="1" parent="1"><mxGeometry x="1" y="2" width="3" height="4"/></mxCell><mxCell id="b" vertex="1" parent="1"/><mxCell id="c" vertex="1" parent="1"/><mxCell id="e" edge="1" source="a" target="b" parent="1"/></root></mxGraphModel>'


def packed(xml):
    c = zlib.compressobj(9, zlib.DEFLATED, -15)
    return base64.b64encode(c.compress(quote(xml).encode()) + c.flush()).decode().rstrip("=")


@pytest.mark.parametrize("body", [MODEL, quote(MODEL), packed(MODEL), base64.b64encode(MODEL.encode()).decode()])
def test_drawio_payloads(spark, body):
    g = drawio.parse(texts(spark, f'<mxfile xmlns="urn:x"><diagram id="p" name="P">{body}</diagram></mxfile>'))
    assert {r["id"]: r["label"] for r in g.nodes.collect()} == {"a": "A x", "b": "b"}
    assert edges(g) == [("a", "b", None)]


def test_drawio_pages_and_errors(spark):
    page = lambda i, n: f'<diagram id="{i}" name="{n}"><mxGraphModel><root><mxCell id="{n}1" value="{n}" vertex="1"/></root></mxGraphModel></diagram>'
    t = texts(spark, f"<mxfile>{page('i', 'first')}{page('first', 'second')}</mxfile>", "<no xml")
    for want, label in ((None, "first"), ("first", "second"), ("second", "second"), ("1", "second"), ("9", "first"), (" ", "first")):
        assert [r["label"] for r in drawio.parse(t, want).nodes.collect()] == [label]
    assert drawio.parse(t).errors.count() == 1


def test_threat_dragon_sniffing(spark):
    good = '{"version":"2.1","detail":{"diagrams":[{"cells":[{"id":"a"}]}]}}'
    rows = [good, good.replace("2.1", "1.6"), '{"detail":{"diagrams":[{"cells":[]}]}}', '{"detail":{"diagrams":[]}}', "[]", "x", good.replace('"version":"2.1",', "")]
    out = texts(spark, *rows).select(graphs.looks_like_threat_dragon(F.col("text")).alias("x")).collect()
    assert [r["x"] for r in out] == [True, False, False, False, False, False, True]
    assert threat_dragon.parse(texts(spark, "{")).errors.count() == 1


IR = {"nodes": {"a": {"id": "a", "label": " A ", "zones": ["in", "out", "in"], "auth": True, "data": ["x", ""], "type": " "}, "b": {"label": "B", "zone": "z"}}, "edges": [{"src": "a", "dst": "b", "data": ["d"]}], "zones": {"in": {"name": "In", "parent_id": "out"}, "out": {"name": "Out"}}}


def test_ir_accepts_and_normalises(spark):
    g = ir.parse(texts(spark, json.dumps(IR)), strict=True)
    n = {r["id"]: r.asDict() for r in g.nodes.collect()}
    assert n["a"]["zones"] == ["out", "in"] and n["a"]["zone"] == "In" and n["a"]["data"] == ["x"] and n["a"]["type"] is None and n["a"]["auth"] is True and n["b"]["zone"] == "z"
    assert g.metrics.first()["import_success_rate"] == 1.0


@pytest.mark.parametrize(
    "change",
    [
        lambda d: d["nodes"]["a"].update(id="z"), lambda d: d["nodes"]["a"].update(label=""), lambda d: d["nodes"]["a"].update(zones=["nope"]), lambda d: d["nodes"]["a"].update(zones="in"), lambda d: d["nodes"]["a"].update(auth="yes"), lambda d: d["nodes"]["a"].update(data="x"),
        lambda d: d["edges"].append({"src": "a", "dst": "q"}), lambda d: d["edges"].append({"src": "a"}), lambda d: d["edges"].append(3), lambda d: d["zones"]["out"].update(parent_id="in"), lambda d: d["zones"]["out"].update(parent_id="q"), lambda d: d["zones"]["out"].update(name=" "),
        lambda d: d.update(threat_dragon={"a": 1}), lambda d: d.update(nodes=[]), lambda d: d.update(edges={}),
    ],
)
def test_ir_rejects(spark, change):
    d = json.loads(json.dumps(IR))
    change(d)
    with pytest.raises(ir.ValidationError):
        ir.parse(texts(spark, json.dumps(d)), strict=True)


def test_ir_rejects_no_json(spark):
    assert [r["error"] for r in ir.violations(texts(spark, "{", "[]")).orderBy("graph_id").collect()] == ["invalid JSON", "not a JSON object"]


def test_image_answers(spark):
    box = lambda x, y, w, h: {"x": x, "y": y, "width": w, "height": h}
    a = {"zones": [{"id": "o", "name": "Out", "bounds": box(0, 0, 100, 100)}, {"id": "i", "name": "In", "bounds": box(10, 10, 20, 20)}], "nodes": [{"id": "n", "label": "N", "bounds": box(12, 12, 2, 2)}, {"id": "m", "zone": "o"}, {"label": "x"}], "edges": [{"src": "n", "dst": "m"}, {"src": "n"}]}
    g = image.parse(texts(spark, json.dumps(a)))
    assert {r["id"]: (r["zones"], r["zone"], r["label"]) for r in g.nodes.collect()} == {"n": (["o", "i"], "In", "N"), "m": (["o"], "Out", "m")}
    assert edges(g) == [("n", "m", None)] and g.metrics.first()["edge_candidates"] == 2


def test_load_dispatches(spark):
    assert edges(graphs.load("mermaid", texts(spark, "A-->B"))) == [("A", "B", None)]
    with pytest.raises(ValueError):
        graphs.load("nope", texts(spark, ""))


def test_files_and_images(spark, tmp_path):
    (tmp_path / "a.mmd").write_text("A-->B\n")
    (tmp_path / "b.png").write_bytes(b"\x89PNG")
    assert edges(mermaid.parse(graphs.files(spark, str(tmp_path), "*.mmd"))) == [("A", "B", None)]
    out = image.extract(spark, str(tmp_path), lambda data, kind: json.dumps({"nodes": [{"id": kind}]}))
    assert [r["id"] for r in image.parse(out).nodes.collect()] == ["image/png"]


def test_documents_and_knowledge_bases(spark, tmp_path):
    raw = tmp_path / "raw"
    raw.mkdir()
    (raw / "a.html").write_text("<p>one&nbsp;two</p><script>no</script>")
    (raw / "b.md").write_bytes(b"three \xff four")
    (raw / "c.pdf").write_bytes(b"%PDF")
    (raw / "d.exe").write_bytes(b"x")
    got = {r["source"].rsplit("/", 1)[1]: r["text"] for r in documents.read(spark, str(raw), pdf=lambda b: "page").collect()}
    assert got == {"a.html": "one\u00a0two", "b.md": "three  four", "c.pdf": "page"}
    d = spark.createDataFrame([("k1", "s1", "d1", "a b c d e f"), ("k1", "s2", "d2", "g h"), ("k2", "s3", "d3", "i"), ("k2", "s4", "d4", " ")], "kb string, source string, stem string, text string")
    path = str(tmp_path / "kb")

    def embed(col):
        return col.map(lambda t: [float(len(t)), 1.0])

    documents.build_kb(d, path, embed, size=4, overlap=1)
    documents.build_kb(d.where("kb = 'k2'"), path, embed, size=4, overlap=1)
    kb = documents.load_kb(spark, path, ["k1"])
    assert [(r["chunk_id"], r["text"]) for r in kb["chunks"].orderBy("chunk_id").collect()] == [("d1-00000", "a b c d"), ("d1-00001", " d e f"), ("d2-00000", "g h")]
    assert kb["vectors"].count() == 3 and [r["kb"] for r in documents.list_kbs(spark, path).collect()] == ["k1", "k2"]
    meta = {r["kb"]: (r["num_documents"], r["num_chunks"]) for r in documents.load_kb(spark, path)["meta"].collect()}
    assert meta == {"k1": (2, 3), "k2": (2, 1)}
    documents.remove_kb(spark, path, "k1")
    assert [r["kb"] for r in documents.list_kbs(spark, path).collect()] == ["k2"]
    for bad in ("../x", "", "a/b", "k1"):
        with pytest.raises(documents.DocumentError):
            documents.remove_kb(spark, path, bad)


def test_context_documents(spark):
    d = spark.createDataFrame([("b", " x y "), ("a", "z")], "source string, text string")
    c = documents.context(d)
    assert documents.context_summary(c).first().asDict() == {"count": 2, "token_count": 3, "sources": "a, b"}
    assert documents.numbered_blocks(c).first()[0] == "[Document 1: a]\nz\n\n[Document 2: b]\nx y"
    with pytest.raises(Exception, match="empty"):
        documents.context(spark.createDataFrame([("a", " ")], "source string, text string")).collect()
    with pytest.raises(Exception, match="limit"):
        d.select(documents.token_limit(F.col("text"), 1)).collect()


def test_gold_and_reports(spark, tmp_path):
    (tmp_path / "web").mkdir()
    (tmp_path / "web" / "expected_threats.json").write_text(json.dumps({"expected": [{"id": "E1", "title": "t", "why": "w", "stride": ["S"], "detection": {"threshold": 0.4}}, {"id": "E2", "title": "u"}]}))
    g = documents.gold(spark, str(tmp_path), ["web"])
    assert {(r["scenario"], r["id"], r["threshold"]) for r in g.collect()} == {("web", "E1", 0.4), ("web", "E2", None)}
    with pytest.raises(documents.DocumentError):
        documents.gold(spark, str(tmp_path), ["nope"])
    (tmp_path / "r.json").write_text(json.dumps({"count": 1, "threats": [{"id": "T001", "title": "x"}], "graph": {"nodes": [{"id": "n"}]}}))
    r = documents.reports(spark, str(tmp_path / "r.json")).first()
    assert r["threats"][0]["id"] == "T001" and r["graph"]["nodes"][0]["id"] == "n"


def test_config():
    text = '{"security": {"rate_limit": {"requests_per_minute": "${N:-7}", "trusted_proxies": "a, b", "scope": "$S", "enabled": "no"}, "request_limits": {"allowed_image_types": ""}, "auth": {"mode": "none"}}, "engine": {"model": {"params": {"t": 1}, "aws_region": "x"}, "allowed_inputs": ["ir"]}, "server": {"port": "81"}, "other": 1}'
    c = config.load(text, {"S": "api_key", "REDIS_URL": "redis://r"})
    limit = c.security.rate_limit
    assert limit.requests_per_minute == 7 and limit.trusted_proxies == ["a", "b"] and limit.scope == "api_key" and not limit.enabled and c.security.request_limits.max_text_chars == 200_000 and len(c.security.request_limits.allowed_image_types) == 3
    assert c.server.port == 81 and c.engine.allowed_inputs == ["ir"] and c.engine.model.params == {"t": 1} and c.engine.model.aws_region == "x" and c.queue.redis_url == "redis://r" and c.observability.redact.input_content
    assert config.load("{}", {"SERVE_API_KEYS": "k1, k2"}).security.auth.api_keys == ["k1", "k2"]
    for bad in ("{}", '{"security": {"auth": {"mode": "none"}}, "queue": {"backend": "x"}}'):
        with pytest.raises(config.ConfigError):
            config.load(bad, {})
    assert config.provider_ready(config.Model(), {}) == "OPENAI_API_KEY is required" and config.provider_ready(config.Model(), {"OPENAI_API_KEY": "x"}) is None and config.provider_ready(config.Model(provider="Ollama"), {}, images=True)


def test_no_knowledge_base_is_left_out_of_many(spark):
    docs = spark.range(10_050).select(F.concat(F.lit("kb"), "id").alias("kb"))
    chunks = docs.withColumn("chunk_id", F.col("kb")).unionByName(spark.createDataFrame([("other", "other")], "kb string, chunk_id string"))
    assert documents.of_bases(chunks, docs).count() == 10_050
