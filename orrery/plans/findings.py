"""Queries of findings. Orders are findings of their customers' requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.operators import findings
from orrery.plans.registry import query, table
from orrery.sources import exports


def orders(spark, sf_dir) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    none = F.array().cast("array<string>")
    return o.select(
        F.col("o_custkey").alias("request_id"), k.alias("pos"), k.cast("string").alias("id"), F.concat("o_orderpriority", F.lit(" "), F.when(k % 2 == 0, F.lower("o_orderstatus")).otherwise(F.col("o_orderstatus"))).alias("title"),
        F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "High").when(F.col("o_orderpriority") == "3-MEDIUM", "Medium").otherwise("Low").alias("severity"), F.floor(F.col("o_totalprice") / 50000).cast("double").alias("score"),
        F.array(F.when(k % 3 == 0, F.lit("owasp asvs V2")).otherwise(F.lit("CWE-1"))).alias("references"), F.when(k % 5 != 0, (k % 10) / 10.0).alias("confidence"),
        F.when(k % 7 != 0, F.array(F.lit("b"), F.lit("a"))).otherwise(none).alias("evidence_nodes"), F.when(k % 4 == 0, F.array(F.lit("a->b"))).otherwise(none).alias("evidence_edges"),
        F.when(k % 11 == 0, F.lit("  short\n")).otherwise(F.lit("reason enough")).alias("why"),
    )


FINDINGS = """f AS (SELECT o_custkey AS request_id, o_orderkey AS pos, o_orderpriority || ' ' || CASE WHEN o_orderkey % 2 = 0 THEN lower(o_orderstatus) ELSE o_orderstatus END AS title,
CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'High' WHEN o_orderpriority = '3-MEDIUM' THEN 'Medium' ELSE 'Low' END AS severity, floor(o_totalprice / 50000) AS score, o_orderkey % 3 = 0 AS asvs,
CASE WHEN o_orderkey % 5 <> 0 THEN (o_orderkey % 10) / 10.0::DOUBLE END AS confidence, o_orderkey % 7 <> 0 AS en, o_orderkey % 4 = 0 AS ee, o_orderkey % 11 <> 0 AS reason FROM orders)"""


@query(f"WITH {FINDINGS} SELECT request_id, pos FROM f WHERE asvs AND coalesce(confidence >= 0.3, true) AND (en OR ee) AND reason")
def finding_filter(spark, sf_dir):
    """P1, Q3."""
    return orders(spark, sf_dir).where(findings.keep(0.3, require_asvs=True)).select("request_id", "pos")


def denoised(order: str, first: str) -> str:
    kept = "SELECT * FROM f WHERE coalesce(confidence >= 0.3, true) AND (en OR ee) AND reason"
    limit = f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY {order}) AS r FROM {{}}) WHERE r <= 5"
    dedup = f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY request_id, lower(title), en, ee ORDER BY {order}) AS s FROM {{}}) WHERE s = 1"
    a, b = (limit, dedup) if first == "limit" else (dedup, limit)
    return f"WITH {FINDINGS}, k AS ({kept}), a AS ({a.format('k')}), b AS ({b.format('a')}) SELECT request_id, pos, printf('T%03d', row_number() OVER (PARTITION BY request_id ORDER BY {order})) AS id, title, severity, score FROM b"


@query(denoised("score DESC, severity, title, pos", "limit"))
def finding_denoise(spark, sf_dir):
    """P1, T1, W5, W4, F27, Q1, Q2."""
    out = findings.denoise(orders(spark, sf_dir), 0.3, require_asvs=False, topn=5)
    return out.select("request_id", "pos", "id", "title", "severity", "score")


@query(denoised("score DESC, CASE severity WHEN 'High' THEN 0 WHEN 'Medium' THEN 1 ELSE 2 END, title, pos", "dedup"))
def finding_denoise_fixed(spark, sf_dir):
    """C5 with its options: duplicates go before the limit, severities rank by weight."""
    out = findings.denoise(orders(spark, sf_dir), 0.3, require_asvs=False, topn=5, dedup_first=True, ranked_severity=True)
    return out.select("request_id", "pos", "id", "title", "severity", "score")


@query("""WITH o AS (SELECT o_custkey AS request_id, o_orderkey AS k, o_orderpriority, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS pos FROM orders)
SELECT request_id, pos::INTEGER AS pos, '' AS id, CASE k % 8 WHEN 0 THEN 'Untitled' WHEN 1 THEN 'Untitled' WHEN 2 THEN 'Untitled' WHEN 3 THEN '  ' WHEN 4 THEN '7' ELSE o_orderpriority END AS title, CASE k % 4 WHEN 0 THEN 'Medium' WHEN 1 THEN 'None' WHEN 2 THEN '' ELSE 'High' END AS severity,
CASE WHEN k % 5 = 0 THEN 4.0 ELSE (k % 9)::DOUBLE END AS score, CASE k % 6 WHEN 0 THEN NULL WHEN 1 THEN NULL WHEN 2 THEN 1.0 WHEN 3 THEN 2.0 ELSE 0.5 END::DOUBLE AS confidence, CASE WHEN k % 3 = 0 THEN 'No specific action provided' ELSE ' do' END AS recommended_action,
CASE WHEN k % 7 = 0 THEN '' ELSE 'S,None,3,True' END AS stride, CASE WHEN k % 2 = 0 THEN '/s/c1/0.0 kb//c2/0.25' ELSE '' END AS sources, CASE WHEN k % 10 = 0 THEN '' ELSE 'n' || k END AS nodes FROM o WHERE pos < 12""")
def answer_projection(spark, sf_dir):
    """The orders of a customer as a model's answer, in which each field comes in several types; 12 of them count."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")

    def one_of(n: int, *cases) -> Column:
        """The case of k modulo n; the last one for what is left, nothing for None."""
        out = F.lit(cases[-1]) if isinstance(cases[-1], str) else cases[-1]
        for i, c in reversed(list(enumerate(cases[:-1]))):
            out = F.when(k % n == i, F.lit(c)).otherwise(out)
        return out

    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    fields = {
        "title": one_of(8, None, '""', "null", '"  "', "7", quoted(F.col("o_orderpriority"))),
        "severity": one_of(4, None, "null", '""', '"High"'),
        "score": F.when(k % 5 == 0, '"n/a"').when(k % 2 == 0, (k % 9).cast("string")).otherwise(quoted((k % 9).cast("string"))),
        "confidence": one_of(6, '"high"', '"0.5"', "true", "2", "0.5"),
        "recommended_action": one_of(3, "[]", '" do"'),
        "stride": one_of(7, "{}", '["S",null,3,true]'),
        "rag_sources": F.when(k % 2 == 0, '[{"source":"s","chunk_id":" c1 "},{"kb":"x","chunk_id":"  "},"c3",{"kb":"kb","chunk_id":"c2","score":"0.25"}]').otherwise('{"chunk_id":"c"}'),
        "evidence": F.when(k % 10 == 0, "null").otherwise(F.concat(F.lit('{"nodes":["n'), k.cast("string"), F.lit('"]}'))),
    }
    threat = F.concat(F.lit("{"), F.concat_ws(",", *[F.concat(F.lit(f'"{name}":'), c) for name, c in fields.items()]), F.lit("}"))
    a = o.groupBy(F.col("o_custkey").alias("request_id")).agg(F.transform(F.sort_array(F.collect_list(F.struct(k.alias("k"), threat.alias("t")))), lambda x: x["t"]).alias("t"))
    out = findings.from_answers(a.select("request_id", F.concat(F.lit('{"threats":['), F.array_join("t", ","), F.lit("]}")).alias("answer")))
    cited = F.array_join(F.transform("rag_sources", lambda s: F.concat_ws("/", s["kb"], s["source"], s["chunk_id"], s["score"].cast("string"))), " ")
    return out.select("request_id", "pos", "id", "title", "severity", "score", "confidence", "recommended_action", F.array_join("stride", ",").alias("stride"), cited.alias("sources"), F.array_join("evidence_nodes", ",").alias("nodes"))


@query("""WITH o AS (SELECT o_custkey AS graph_id, o_orderkey::VARCHAR AS id, o_orderpriority AS title, o_orderstatus AS severity, (o_orderkey % 9)::DOUBLE AS score, o_orderkey AS o FROM orders)
SELECT graph_id, md5('# Threat Analysis Report' || chr(10) || chr(10) || '> This report was generated with the help of a model and may contain errors; review it before use.' || chr(10) || chr(10) || '## Threat Summary' || chr(10) || chr(10) || '| ID | Threat | Severity | Score |' || chr(10) || '|----|---------|---------|-------|' || chr(10)
|| string_agg('| ' || id || ' | ' || title || ' | ' || severity || ' | ' || printf('%.1f', score) || ' |' || chr(10), '' ORDER BY o) || chr(10) || '## Threat Details' || chr(10) || chr(10)
|| string_agg('### ' || id || ': ' || title || chr(10) || chr(10) || '**Severity:** ' || severity || chr(10) || chr(10) || '**Score:** ' || printf('%.1f', score) || chr(10) || chr(10) || '**STRIDE:** S, T' || chr(10) || chr(10) || '**Affected Components:** ' || chr(10) || chr(10) || '**Why:** so' || chr(10) || chr(10)
|| '**Recommended Actions:**' || chr(10) || chr(10) || 'act' || chr(10) || chr(10) || '---' || chr(10) || chr(10), '' ORDER BY o)) AS md5 FROM o GROUP BY 1""")
def report_markdown(spark, sf_dir):
    """K2: a report of each customer's orders."""
    o = table(spark, sf_dir, "orders")
    none = F.array().cast("array<string>")
    sources = F.array().cast("array<struct<kb:string,source:string,chunk_id:string,score:double,method:string>>")
    f = o.select(F.col("o_custkey").alias("graph_id"), F.col("o_orderkey").alias("pos"), F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderpriority").alias("title"), F.col("o_orderstatus").alias("severity"), (F.col("o_orderkey") % 9).cast("double").alias("score"), F.array(F.lit("S"), F.lit("T")).alias("stride"), none.alias("affected"), F.lit("so").alias("why"), none.alias("references"), sources.alias("rag_sources"), F.lit("act").alias("recommended_action"))
    return exports.report_markdown(f).select("graph_id", F.md5("markdown").alias("md5"))


@query("""SELECT n_regionkey AS graph_id, '{"nodes":[' || string_agg('{"id":"n' || n_nationkey || '","label":"' || n_name || '","zone":"r","zones":["r' || n_regionkey || '"],"zone_path":["' || r_name || '"],"type":null,"data":[],"auth":null,"notes":null}', ',' ORDER BY n_nationkey) || '],"edges":[]}' AS json FROM nation JOIN region ON r_regionkey = n_regionkey GROUP BY 1""")
def prompt_json(spark, sf_dir):
    """Regions as graphs of nations."""
    none = F.array().cast("array<string>")
    z = F.concat(F.lit("r"), F.col("n_regionkey").cast("string"))
    n = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("graph_id"), F.col("n_nationkey").alias("node_pos"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("id"), F.col("n_name").alias("label"), F.lit("r").alias("zone"), F.array(z).alias("zones"), F.lit(None).cast("string").alias("type"), none.alias("data"), F.lit(None).cast("boolean").alias("auth"), F.lit(None).cast("string").alias("notes"))
    e = n.select("graph_id", F.lit(0).alias("edge_pos"), F.lit("").alias("src"), F.lit("").alias("dst"), F.lit("").alias("label"), F.lit("").alias("protocol"), none.alias("data")).limit(0)
    zones = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("graph_id"), F.lit(0).alias("zone_pos"), F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("id"), F.col("r_name").alias("name"), F.lit(None).cast("string").alias("parent_id"))
    return exports.prompt_json(n, e, zones)
