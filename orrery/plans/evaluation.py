"""Queries of evaluation: the embeddings whose ids are divisible by 100 are the stated gold items, all embeddings of a label are the outputs of its scenario."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from orrery.operators import evaluate
from orrery.plans.registry import query, table

THRESHOLD = 0.3
MATCH = """e AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
s AS (SELECT a.label AS scenario, a.vec_id AS id, b.vec_id AS actual_id, round(list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))), 9) AS score FROM e a JOIN e b ON a.label = b.label WHERE a.vec_id % 100 = 0 AND b.vec_id % 100 <> 0),
m AS (SELECT scenario, id, max((score, actual_id)) AS m FROM s WHERE score >= 0.3 GROUP BY 1, 2)"""


def both(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("label").alias("scenario"), F.col("vec_id").alias("id"), F.col("vec_id").alias("pos"), "embedding", F.lit(None).cast("double").alias("threshold"))
    return e.where(F.col("id") % 100 == 0), e.where(F.col("id") % 100 != 0).drop("threshold")


@query(f"WITH {MATCH} SELECT scenario, id, m[2] AS actual_id, m[1] AS score FROM m")
def eval_matches(spark, sf_dir):
    """J14, F3, Q11, X7."""
    return evaluate.embedded_matches(*both(spark, sf_dir), THRESHOLD)


@query(f"""WITH {MATCH}, c AS (SELECT label AS scenario, count(*) FILTER (vec_id % 100 = 0) AS gold, count(*) FILTER (vec_id % 100 <> 0) AS outputs FROM embeddings GROUP BY 1), a AS (SELECT scenario, count(*) AS accepted FROM m GROUP BY 1),
g AS (SELECT c.scenario, sum(coalesce(accepted, 0))::BIGINT AS accepted, sum(outputs)::BIGINT AS outputs, sum(gold)::BIGINT AS gold FROM c LEFT JOIN a ON a.scenario = c.scenario GROUP BY GROUPING SETS ((c.scenario), ())),
p AS (SELECT *, CASE WHEN outputs = 0 THEN 0.0 ELSE accepted::DOUBLE / outputs END AS p, CASE WHEN gold = 0 THEN 0.0 ELSE accepted::DOUBLE / gold END AS r FROM g)
SELECT scenario, accepted, outputs, gold, round(p, 4) AS precision, round(r, 4) AS recall, round(CASE WHEN p + r = 0 THEN 0.0 ELSE 2 * p * r / (p + r) END, 4) AS f1 FROM p""")
def eval_prf_by_scenario(spark, sf_dir):
    """Scenarios and the micro average."""
    expected, actual = both(spark, sf_dir)
    return evaluate.report(expected, actual, evaluate.embedded_matches(expected, actual, THRESHOLD))


@query(f"""WITH {MATCH}, r AS (SELECT scenario, id, m[2] AS actual_id, m[1] AS score, row_number() OVER (PARTITION BY scenario, m[2] ORDER BY m[1] DESC, id) AS r FROM m) SELECT scenario, id, actual_id, score FROM r WHERE r = 1""")
def eval_one_to_one(spark, sf_dir):
    """J14 with each output taken once (Q10)."""
    return evaluate.embedded_matches(*both(spark, sf_dir), THRESHOLD, one_to_one=True)


FEATURES = "0123456789abcdefghijklmnopqrstuvwxyz"


def counted(texts: pd.Series) -> pd.Series:
    """A stand-in for a model: how often each of FEATURES is in a text, lower-cased."""
    return texts.map(lambda t: [float(t.lower().count(c)) for c in FEATURES])


@query(f"""WITH t AS (SELECT c_custkey AS id, 'n' || c_nationkey AS scenario, list_transform(string_split('{FEATURES}', ''), lambda c: (length(lower(c_name || ' ' || c_mktsegment)) - length(replace(lower(c_name || ' ' || c_mktsegment), c, '')))::DOUBLE) AS e FROM customer),
s AS (SELECT a.scenario, a.id, b.id AS actual_id, round(list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))), 9) AS score, CASE WHEN a.id % 20 = 0 THEN 0.999 ELSE 0.95 END AS least FROM t a JOIN t b USING (scenario) WHERE a.id % 10 = 0 AND b.id % 10 <> 0),
m AS (SELECT scenario, id, max((score, actual_id)) AS m FROM s WHERE score >= least GROUP BY 1, 2), g AS (SELECT scenario, list_sort(list(id::VARCHAR) FILTER (m IS NOT NULL)) AS hit, list_sort(list(id::VARCHAR) FILTER (m IS NULL)) AS miss FROM t LEFT JOIN m USING (scenario, id) WHERE id % 10 = 0 GROUP BY 1),
c AS (SELECT scenario, count(*) FILTER (id % 10 = 0) AS gold, count(*) FILTER (id % 10 <> 0) AS outputs FROM t GROUP BY 1), a AS (SELECT scenario, count(*) AS accepted FROM m GROUP BY 1),
n AS (SELECT scenario, sum(coalesce(accepted, 0))::BIGINT AS accepted, sum(outputs)::BIGINT AS outputs, sum(gold)::BIGINT AS gold FROM c LEFT JOIN a USING (scenario) GROUP BY GROUPING SETS ((scenario), ())),
p AS (SELECT *, CASE WHEN outputs = 0 THEN 0.0 ELSE accepted::DOUBLE / outputs END AS p, CASE WHEN gold = 0 THEN 0.0 ELSE accepted::DOUBLE / gold END AS r FROM n),
f AS (SELECT *, CASE WHEN p + r = 0 THEN 0.0 ELSE 2 * p * r / (p + r) END AS f1 FROM p)
SELECT scenario, CASE WHEN scenario IS NULL THEN 'TOTAL' ELSE '[' || scenario || ']' END || ' accepted=' || accepted || '/' || gold || ' outputs=' || outputs || format(' precision={{:.4f}} recall={{:.4f}} f1={{:.4f}}', round(p, 4), round(r, 4), round(f1, 4))
|| CASE WHEN len(hit) > 0 THEN chr(10) || '  matched : ' || array_to_string(hit, ', ') ELSE '' END || CASE WHEN len(miss) > 0 THEN chr(10) || '  missing : ' || array_to_string(miss, ', ') ELSE '' END AS line FROM f LEFT JOIN g USING (scenario)""")
def eval_benchmark(spark, sf_dir):
    """The customers of a nation as a scenario, every tenth of them gold, the others outputs; metrics and ids as text."""
    c = table(spark, sf_dir, "customer").select(F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("scenario"), F.col("c_custkey").alias("id"), F.col("c_custkey").alias("pos"), F.col("c_name").alias("title"), F.col("c_mktsegment").alias("why"))
    gold = c.where("id % 10 = 0").withColumn("threshold", F.when(F.col("id") % 20 == 0, 0.999))
    matches, told = evaluate.benchmark(gold, c.where("id % 10 <> 0"), counted, 0.95)
    return evaluate.benchmark_text(matches, told)
