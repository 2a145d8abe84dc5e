"""Reports and streams."""

import io
import json
import zipfile

from pyspark.sql import functions as F

from orrery.operators import diff
from orrery.sources import exports, threat_dragon
from orrery.streaming import service
from orrery.tables import settings

FINDINGS = "graph_id string, pos int, id string, title string, stride array<string>, severity string, score double, affected array<string>, why string, references array<string>, recommended_action string, evidence_nodes array<string>, evidence_edges array<string>, confidence double, rag_sources array<struct<kb:string,source:string,chunk_id:string,score:double,method:string>>"
MODEL = {"version": "2.0", "detail": {"diagrams": [{"cells": [{"id": "a", "shape": "process", "data": {"type": "tm.Process", "name": "Web", "hasOpenThreats": False}}, {"id": "b", "data": {"type": "tm.Store", "name": "Db", "threats": [{"id": "T1", "status": "Closed"}]}}, {"id": "f", "shape": "flow", "source": {"cell": "a"}, "target": {"cell": "b"}, "labels": ["q"], "data": {"type": "tm.Flow"}}]}]}}


def found(spark):
    src = [("k", "s", "c", 0.5, "auto")]
    rows = [("0", 0, "T1", "On web <x>", ["S"], "High", 8.0, ["Web"], "why\nso", ["ASVS"], "act", ["Web"], ["a->b:q"], None, src), ("0", 1, "T2", "Anywhere", [], "Low", 1.0, [], "w", [], "act", ["none"], [], 0.5, [])]
    return spark.createDataFrame(rows, FINDINGS)


def model(spark):
    texts = spark.createDataFrame([("0", json.dumps(MODEL))], "graph_id string, text string")
    return texts, threat_dragon.parse(texts)


def test_report_json_markdown_html(spark):
    texts, g = model(spark)
    graph = exports.graph_json(g.nodes, g.edges, g.zones)
    doc = json.loads(exports.report_json(found(spark), g.metrics, graph, generated_at="now").first()["json"])
    assert doc["count"] == 2 and doc["threats"][0]["evidence"] == {"nodes": ["Web"], "edges": ["a->b:q"]} and doc["threats"][0]["confidence"] is None and doc["graph"]["edges"][0].keys() == {"src", "dst", "label", "protocol", "data"}
    md = exports.report_markdown(found(spark)).first()["markdown"]
    assert "| T1 | On web <x> | High | 8.0 |" in md and "- kb=k, source=s, chunk=c, score=0.500, method=auto" in md
    html = exports.report_html(found(spark), g.nodes, g.edges, graph).first()["html"]
    assert "On web &lt;x&gt;" in html and "why<br>so" in html and "a &rarr; b : q" in html
    assert exports.report_paths("/x/a.mmd", "out")["md"] == "out/a_report.md"
    assert zipfile.ZipFile(io.BytesIO(exports.zipped("j", {"json": "{}", "markdown": "#"}))).namelist() == ["j.json", "j.md"]


def test_findings_go_into_the_model(spark):
    texts, g = model(spark)
    doc = json.loads(exports.threat_dragon(texts, found(spark), g.nodes, g.edges).first()["json"])
    d = doc["detail"]["diagrams"][0]
    a, b, f = d["cells"]
    assert [t["id"] for t in a["data"]["threats"]] == ["T1-tt"] and a["data"]["hasOpenThreats"] is True and a["data"]["threats"][0]["title"].startswith("[Generated] ")
    assert [t["id"] for t in b["data"]["threats"]] == ["T1"] and b["data"]["hasOpenThreats"] is False and [t["id"] for t in f["data"]["threats"]] == ["T1-tt"] and [t["id"] for t in d["threats"]] == ["T2"]
    assert "RAG Sources: s#c" in a["data"]["threats"][0]["description"]


def test_diff_markdown(spark):
    b = spark.createDataFrame([("a|b",)], "name string")
    s = diff.sides(b, b.limit(0), ["name"])
    assert "- removed: a/b" in exports.diff_markdown(s, s.limit(0), s.limit(0), "told")


STORE = {k.replace(".", "__"): v for k, v in service.STATE_STORE.items()}


def run(stream, name, spark):
    with settings(spark, **STORE):
        q = stream.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name).collect()


def source(spark, tmp_path, rows, schema):
    path = str(tmp_path / "in")
    spark.createDataFrame(rows, schema).withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.parquet(path)
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)


def test_window_counts_stream(spark, tmp_path):
    rows = [(1, "2024-01-01 00:00:01", "k"), (2, "2024-01-01 00:00:02", "k"), (3, "2024-01-01 01:00:00", "k")]
    out = run(service.window_counts(source(spark, tmp_path, rows, "event_id int, ts string, key string"), 1), "w", spark)
    assert [(r["key"], r["n"], r["admitted"], r["rejected"]) for r in out] == [("k", 2, 1, 1)]


def test_sliding_log_stream(spark, tmp_path):
    rows = [(i, f"2024-01-01 00:00:{s:02d}", "k") for i, s in enumerate([0, 1, 2, 59])] + [(9, "2024-01-01 00:01:01", "k"), (10, "2024-01-01 01:00:00", "end")]  # the last moves the watermark
    out = run(service.sliding_log(source(spark, tmp_path, rows, "event_id int, ts string, key string"), 2), "s", spark)
    assert {r["event_id"]: r["admitted"] for r in out} == {0: True, 1: True, 2: False, 3: False, 9: True}


def test_job_states_stream_and_upsert(spark, tmp_path):
    rows = [("j", "2024-01-01 00:00:00", "queued"), ("j", "2024-01-01 00:00:05", "running"), ("i", "2024-01-01 00:00:00", "queued")]
    states = service.job_states(source(spark, tmp_path, rows, "job_id string, ts string, status string"))
    path = str(tmp_path / "out")
    with settings(spark, **STORE):
        q = service.upsert(states, path, str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {r["job_id"]: r["status"] for r in service.latest(spark, path).collect()} == {"j": "running", "i": "queued"}
    folder = str(tmp_path / "in")
    for k in range(2):  # two more batches, each of one job
        spark.createDataFrame([(f"n{k}", "2024-01-01 00:01:00", "queued")], "job_id string, ts string, status string").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(folder)
        with settings(spark, **STORE):
            q = service.upsert(service.job_states(spark.readStream.schema(spark.read.parquet(folder).schema).parquet(folder)), path, str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert {r["job_id"]: r["status"] for r in service.latest(spark, path).collect()} == {"j": "running", "i": "queued", "n0": "queued", "n1": "queued"}
    assert service.latest(spark, str(tmp_path / "nothing")).count() == 0


def test_queue_is_a_stream(spark, tmp_path):
    (tmp_path / "q").mkdir()
    (tmp_path / "q" / "a.json").write_text('{"job_id": "a", "ts": "2024-01-01T00:00:00Z", "status": "queued", "payload": "{}"}\n')
    assert [r["job_id"] for r in run(service.jobs(spark, str(tmp_path / "q")), "jobs", spark)] == ["a"]
