"""A whole analysis with a model that is a plain function."""

import json

import pytest
from pyspark.sql import functions as F

from orrery.functions import prompts
from orrery.operators import hints, retrieve
from orrery.plans import analyse
from orrery.sources import exports, graphs


def model(system, user):
    t = {"title": "Spoofing", "severity": "High", "score": "7", "why": "no login on it", "evidence": {"nodes": ["A"], "edges": ["A->B"]}, "confidence": "0.9", "references": ["ASVS V2"], "stride": ["S"], "recommended_action": "add one"}
    return "```json\n" + json.dumps({"threats": [t, t, {"title": "weak", "why": "x"}]}) + "\n```"


def test_analysis(spark):
    texts = spark.createDataFrame([("g", "A[Web] --> B[(Db)]")], "graph_id string, text string")
    g = graphs.load("mermaid", texts)
    assert json.loads(analyse.skeleton(g).first()["json"])["edges"] == [{"from": "A", "to": "B"}]
    found = analyse.conclude(analyse.ask(g, model))
    assert [(r["id"], r["title"], r["score"]) for r in found.collect()] == [("T001", "Spoofing", 7.0)]
    out = analyse.report(found, g, ["json", "markdown", "nope"])
    assert set(out) == {"json", "markdown"} and json.loads(out["json"].first()["json"])["count"] == 1
    assert analyse.ask(g, model, limit=3).first()["error"].startswith("prompt has")


HINTS = {"nodes": {"A": {"label": None, "type": "browser", "zone": "DMZ", "auth": True, "data": ["pw", 3]}, "B": {"zones": "no list", "notes": "db"}, "zz": {"label": "x"}, "bad": 1}, "edges": [{"from": "A", "to": "B", "protocol": "https", "data": ["x"]}, {"from": "A"}, {"from": "B", "to": "A", "protocol": "no"}]}


def test_hints_become_patches(spark):
    g = graphs.load("mermaid", spark.createDataFrame([("g", "subgraph Out\nA[Web] -->|calls| B[(Db)]\nend"), ("h", "A --> B")], "graph_id string, text string"))
    answers = spark.createDataFrame([("g", json.dumps(HINTS)), ("h", None)], "request_id string, answer string")
    out = hints.merge(g, answers)
    nodes = {(r["graph_id"], r["id"]): r.asDict() for r in out.nodes.collect()}
    a, b = nodes[("g", "A")], nodes[("g", "B")]
    assert a["label"] is None and a["type"] == "browser" and a["auth"] is True and a["data"] == ["3", "pw"] and a["zones"] == ["zone_0"] and a["zone"] == "Out" and b["notes"] == "db" and b["zones"] == ["zone_0"] and b["label"] == "Db"
    assert nodes[("h", "A")]["label"] == "A" and len(nodes) == 4
    edges = {r["graph_id"]: (r["protocol"], r["data"]) for r in out.edges.collect()}
    assert edges == {"g": ("https", ["x"]), "h": (None, [])}


def test_a_whole_analysis_of_several_formats(spark):
    seen = []

    def knowing(system, user):
        seen.append((system, user))
        if system == prompts.HINTS_SYSTEM:
            return json.dumps({"nodes": {"A": {"type": "hinted"}}, "edges": []})
        if system == prompts.RERANK_SYSTEM:
            return json.dumps({"scores": [{"idx": 0, "score": 2}, {"idx": "x", "score": 1}, 3]})
        if "broken" in user:
            return "nothing"
        return json.dumps({"threats": [{"title": "T", "why": "no login on it", "evidence": {"nodes": ["A"]}, "rag_sources": [{"kb": "k", "chunk_id": "c1"}]}]})

    dragon = {"version": "2.0", "detail": {"diagrams": [{"cells": [{"id": "A", "shape": "process", "data": {"type": "tm.Process", "name": "Web"}, "position": {"x": 0, "y": 0}, "size": {"width": 5, "height": 5}}]}]}}
    inputs = {
        "mermaid": spark.createDataFrame([("m", "A[login page] --> B"), ("bad", "A[broken] --> B")], "graph_id string, text string"), "threat-dragon": spark.createDataFrame([("t", json.dumps(dragon))], "graph_id string, text string"),
        "ir": spark.createDataFrame([("i", '{"nodes":{"A":{"label":"Web"}},"edges":[]}'), ("no", "{")], "graph_id string, text string"),
    }
    chunks = spark.createDataFrame([("k", f"c{i}", "s.md", f"login text {i}") for i in range(3)], "kb string, chunk_id string, source string, text string")
    vectors = chunks.select("kb", "chunk_id", F.array(F.lit(1.0), F.length("chunk_id").cast("double")).alias("embedding"))
    kb = analyse.Knowledge(chunks, vectors, lambda df: df.withColumn("embedding", F.array(F.lit(1.0), F.lit(0.5))), retrieve.Options(topk=2, min_score=0.0))
    out = analyse.analyse(inputs, knowing, infer_hints=True, kb=kb, documents="all about it", formats=["json", "markdown", "html", "threat-dragon"])
    assert {(r["request_id"], r["id"], r["title"]) for r in out.findings.collect()} == {(g, "T001", "T") for g in "mti"}
    assert all(r["rag_sources"][0]["chunk_id"] == "c1" for r in out.findings.collect()) and {r["graph_id"] for r in out.errors.collect()} >= {"bad", "no"}
    assert {r["type"] for r in out.graph.nodes.where("id = 'A' and graph_id in ('m', 'i')").collect()} == {"hinted"}
    model_out = json.loads(out.reports["threat-dragon"].first()["json"])
    assert model_out["detail"]["diagrams"][0]["cells"][0]["data"]["threats"][0]["status"] == "Open" and out.reports["html"].count() == 4 and out.reports["markdown"].count() == 3
    with pytest.raises(analyse.AnalysisError):
        analyse.analyse({"mermaid": inputs["mermaid"]}, knowing, formats=["threat-dragon"])
    with pytest.raises(analyse.AnalysisError):
        analyse.analyse({"visio": inputs["mermaid"]}, knowing)


def test_prompts_list_candidates(spark):
    cands = F.array(*[F.struct(F.lit(f"c{i}").alias("chunk_id"), F.lit("k").alias("kb"), F.lit(None).cast("string").alias("source")) for i in range(40)])
    p = spark.range(1).select(prompts.findings_prompt(F.lit("{}"), F.lit("passage"), F.lit(None).cast("string"), "de", cands).alias("a"), prompts.findings_prompt(F.lit("{}"), F.lit(None).cast("string"), F.lit("doc"), "en", cands).alias("b"), prompts.hints_prompt(F.lit("{}"), "uk").alias("c")).first()
    assert p["a"].count("- chunk_id=") == 30 and "- chunk_id=c0 kb=k source=None" in p["a"] and "German" in p["a"] and "Citations" not in p["b"] and "doc" in p["b"] and "Ukrainian" in p["c"]
    assert "Japanese" in prompts.diff_prompt("{}", "ja") and "Write all" not in prompts.diff_prompt("{}")


def test_reranker_choice():
    a, b = (lambda q, t: []), (lambda q, t: [])
    assert retrieve.choose_reranker("auto", a, b) == ("local", a) and retrieve.choose_reranker("auto", None, b) == ("llm", b) and retrieve.choose_reranker("auto") == ("off", None) and retrieve.choose_reranker("off", a) == ("off", None)
    for mode in ("local", "llm", "x"):
        with pytest.raises(retrieve.RetrievalError):
            retrieve.choose_reranker(mode)
    calls = []
    score = prompts.model_reranker(lambda s, u: calls.append(u) or json.dumps({"scores": [{"idx": 1, "score": 0.5}, {"idx": 0, "score": 7}, {"idx": 9, "score": 1}, {"score": 1}]}), batch=2)
    assert score("q", ["a\nb", "c" * 2000, "d"]) == [1.0, 0.5, 1.0] and len(calls) == 2 and "[0] a b" in calls[0] and "c" * 1200 + "..." in calls[0]


def test_changes_for_a_prompt(spark):
    n = spark.createDataFrame([("added", "a", "A", None), ("same", "b", "B", "t")], "side string, id string, label string, type string")
    e = spark.createDataFrame([("removed", "a", "b", None)], "side string, src string, dst string, label string")
    f = spark.createDataFrame([], "side string, id string, title string, severity string")
    out = json.loads(exports.diff_changes(n, e, f))
    assert out["graph_changes"]["added_nodes"] == [{"id": "a", "label": "A", "type": ""}] and out["graph_changes"]["edges_removed"] == 1 and out["threat_changes"]["threats_added"] == 0


def test_calls_are_repeated_and_checked():
    answers = iter(["no", '{"threats": 1}', '{"threats": []}'])
    assert prompts.ask_json(lambda: next(answers), prompts.has_findings, attempts=3) == {"threats": []}
    with pytest.raises(prompts.AnswerError):
        prompts.ask_json(lambda: "[]", prompts.has_hints)
    assert prompts.has_scores({"scores": [1]}) and prompts.token_limit("local") == 12_000 and prompts.token_limit("x", 5) == 5
    assert prompts.report_formats(["HTML", "html", "x"]) == ["html"] and prompts.report_formats(None) == ["json", "markdown"]
    with pytest.raises(ValueError):
        prompts.report_formats(["x"])


def test_rerank_prompt(spark):
    r = spark.range(1).select(prompts.rerank_prompt(F.lit("q"), F.array(F.lit("abcd"), F.lit("e")), 2).alias("p")).first()
    assert r["p"] == "Query: q\n[0] ab...\n[1] e"
