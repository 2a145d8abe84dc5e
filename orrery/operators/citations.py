"""Citations of findings: own claims validated against the retrieved candidates, then filled up."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from orrery.functions.text import clamp, overlap, tokens
from orrery.operators.retrieve import minmax, threshold


def query_text() -> Column:
    """F18."""
    return F.concat("title", F.lit("\n"), "why", F.lit("\nSTRIDE: "), F.array_join("stride", ", "), F.lit("\nAffected: "), F.array_join("affected", ", "))


def source(kb: Column, src: Column, chunk: Column, score: Column, method: str) -> Column:
    """F28."""
    text = lambda c: F.coalesce(c, F.lit(""))
    return F.struct(text(kb).alias("kb"), text(src).alias("source"), text(chunk).alias("chunk_id"), clamp(F.coalesce(score, F.lit(0.0))).alias("score"), F.lit(method).alias("method"))


def validated(findings: DataFrame, cands: DataFrame, most: int = 2) -> DataFrame:
    """(request_id, finding_pos, n, kb, chunk_id, source, score): each claim's best candidate: of the named kb if that has the chunk, else of any; by score. Distinct, in the order of claims, `most` at most."""
    claims = findings.select("request_id", F.col("pos").alias("finding_pos"), F.posexplode("rag_sources").alias("claim", "c")).where("c.chunk_id <> ''")
    claims = claims.select("request_id", "finding_pos", "claim", F.col("c.chunk_id").alias("chunk_id"), F.col("c.kb").alias("_kb"))
    hit = claims.join(cands, ["request_id", "chunk_id"])
    best = Window.partitionBy("request_id", "finding_pos", "claim").orderBy((F.coalesce("_kb", F.lit("")) == F.col("kb")).desc(), F.col("final_score").desc(), "pos")
    hit = hit.withColumn("_r", F.row_number().over(best)).where("_r = 1")
    once = hit.withColumn("_d", F.row_number().over(Window.partitionBy("request_id", "finding_pos", "kb", "chunk_id").orderBy("claim"))).where("_d = 1")
    n = F.row_number().over(Window.partitionBy("request_id", "finding_pos").orderBy("claim"))
    return once.withColumn("n", n).where(F.col("n") <= most).select("request_id", "finding_pos", "n", "kb", "chunk_id", "source", F.col("final_score").alias("score"))


def backfill(findings: DataFrame, cands: DataFrame, own: DataFrame, most: int = 2, reranker: Callable | None = None) -> DataFrame:
    """For findings with fewer than `most`: the best other candidates by .7 of their match with the finding's text and .3 of their own score. The match is the share of the text's tokens, or
    the reranker's scores normalised over the candidates. Candidates of a request are bounded by retrieval."""
    have = own.groupBy("request_id", "finding_pos").agg(F.max("n").alias("have"))
    need = findings.select("request_id", F.col("pos").alias("finding_pos"), query_text().alias("q")).join(have, ["request_id", "finding_pos"], "left").withColumn("have", F.coalesce("have", F.lit(0))).where(F.col("have") < most)
    pairs = need.withColumn("_t", tokens(F.col("q"))).join(cands.withColumn("_c", tokens(F.col("text"))), "request_id")
    rest = pairs.join(own.select("request_id", "finding_pos", "kb", "chunk_id"), ["request_id", "finding_pos", "kb", "chunk_id"], "left_anti")
    match = overlap(F.col("_t"), F.col("_c"))
    if reranker is not None:
        rest = _reranked(rest.drop("_t", "_c"), reranker)
        match = F.when(F.count("raw").over(Window.partitionBy("request_id", "finding_pos")) > 0, minmax(F.coalesce("raw", F.lit(0.0)), Window.partitionBy("request_id", "finding_pos"))).otherwise(overlap(tokens(F.col("q")), tokens(F.col("text"))))
    scored = rest.withColumn("score", F.round(0.7 * match + 0.3 * F.col("final_score"), 9))
    n = F.row_number().over(Window.partitionBy("request_id", "finding_pos").orderBy(F.col("score").desc(), "pos")) + F.col("have")
    return scored.withColumn("n", n).where(F.col("n") <= most).select("request_id", "finding_pos", "n", "kb", "chunk_id", "source", "score")


def _reranked(pairs: DataFrame, fn: Callable) -> DataFrame:
    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos", ignore_index=True)
        try:
            raw = [float(x) for x in fn(pdf["q"].iloc[0], pdf["text"].fillna("").tolist())]
        except Exception:
            raw = []
        return pdf.assign(raw=pd.array([raw[i] if i < len(raw) else (0.0 if raw else None) for i in range(len(pdf))], dtype="Float64"))

    return pairs.groupBy("request_id", "finding_pos").applyInPandas(one, StructType([*pairs.schema, StructField("raw", DoubleType())]))


def attach(findings: DataFrame, cands: DataFrame, min_score: float = 0.0, most: int = 2, reranker: Callable | None = None) -> tuple[DataFrame, DataFrame]:
    """C4: findings(request_id, pos, title, why, stride, affected, rag_sources, ...), candidates(request_id, kb, chunk_id, source, text, final_score, pos) ->
    (findings with citations, dropped: request_id, n). Findings without any are dropped."""
    usable = threshold(cands, max(0.0, min_score), keep_all=True).where(F.coalesce("chunk_id", F.lit("")) != "")
    own = validated(findings, usable, most)
    auto = backfill(findings, usable, own, most, reranker)
    cite = lambda df, method: df.select("request_id", "finding_pos", F.struct("n", source(F.col("kb"), F.col("source"), F.col("chunk_id"), F.col("score"), method).alias("s")).alias("x"))
    listed = cite(own, "llm").unionByName(cite(auto, "auto")).groupBy("request_id", "finding_pos").agg(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["s"]).alias("rag_sources"))
    out = findings.drop("rag_sources").join(listed.withColumnRenamed("finding_pos", "pos"), ["request_id", "pos"])
    dropped = findings.join(listed.select("request_id", F.col("finding_pos").alias("pos")), ["request_id", "pos"], "left_anti").groupBy("request_id").agg(F.count("*").alias("n"))
    return out, dropped
