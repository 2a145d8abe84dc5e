"""Findings: projection of model answers, filter, order, limit, deduplication, numbering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions.text import strip

MAX_ANSWERS, MIN_WHY = 12, 6
# What a finding has where the answer says nothing.
TITLE, SEVERITY, SCORE, ACTION = "Untitled", "Medium", 4.0, "No specific action provided"
SOURCE = "struct<kb:string,source:string,chunk_id:string,score:double,method:string>"
SEVERITY_RANK = {"high": 0, "medium": 1, "low": 2}


def texts(c: str) -> Column:
    return F.coalesce(F.col(c), F.array().cast("array<string>"))


def field(v: Column, name: str) -> Column:
    """A field of an object as a variant; null where it is missing, a variant of null where it is null."""
    return F.try_variant_get(v, f"$.{name}", "variant")


def is_kind(v: Column, pattern: str) -> Column:
    return F.coalesce(F.rlike(F.schema_of_variant(v), F.lit(f"^({pattern})")), F.lit(False))


NUMBER = "BIGINT|DOUBLE|FLOAT|DECIMAL"


def said(v: Column) -> Column:
    """Any value as text."""
    text = F.try_variant_get(v, "$", "string")
    return F.when(is_kind(v, "VOID"), F.lit("None")).when(is_kind(v, "BOOLEAN"), F.initcap(text)).otherwise(text)


def items(v: Column) -> Column:
    return F.when(is_kind(v, "ARRAY"), F.try_variant_get(v, "$", "array<variant>")).otherwise(F.array().cast("array<variant>"))


def given(v: Column) -> Column:
    """Neither missing nor null, false, zero or empty."""
    zero = is_kind(v, NUMBER) & (F.try_variant_get(v, "$", "double") == 0)
    text = F.try_variant_get(v, "$", "string")
    empty = (is_kind(v, "STRING") & (text == "")) | (is_kind(v, "BOOLEAN") & (text == "false")) | (is_kind(v, "ARRAY") & (F.size(items(v)) == 0))
    return v.isNotNull() & ~is_kind(v, "VOID|OBJECT<>") & ~F.coalesce(zero | empty, F.lit(False))


def text_or(v: Column, default: str) -> Column:
    return F.when(given(v), said(v)).otherwise(F.lit(default))


def all_said(v: Column) -> Column:
    return F.transform(items(v), said)


def number(v: Column) -> Column:
    """A number, also one in quotes; true counts as 1. Null for anything else."""
    return F.when(is_kind(v, "BOOLEAN"), F.try_variant_get(v, "$", "boolean").cast("int").cast("double")).when(is_kind(v, NUMBER + "|STRING"), F.try_variant_get(v, "$", "string").try_cast("double"))


def source(v: Column) -> Column:
    """A citation; its score is 0 where it gives none."""
    return F.struct(
        text_or(field(v, "kb"), "").alias("kb"), text_or(field(v, "source"), "").alias("source"), strip(text_or(field(v, "chunk_id"), "")).alias("chunk_id"),
        F.when(given(field(v, "score")), number(field(v, "score"))).otherwise(F.lit(0.0)).alias("score"), F.lit(None).cast("string").alias("method"),
    ).cast(SOURCE)


def from_answers(answers: DataFrame) -> DataFrame:
    """answers(request_id, answer: JSON with `threats`) -> findings(request_id, pos, ...): the first 12 of each answer, with defaults.

    Types count: a confidence is a JSON number or null, not one in quotes. An empty title, reason or action is as good as none, one of spaces isn't. Citations are
    objects with a chunk_id, stripped. Findings have no id before they are numbered. Elements that are no objects get all defaults; an answer that is no JSON has no findings.
    """
    threats = F.try_variant_get(F.try_parse_json("answer"), "$.threats", "array<variant>")
    each = answers.select("request_id", F.posexplode(F.slice(threats, 1, MAX_ANSWERS)).alias("pos", "t"))
    t = F.col("t")
    confidence = field(t, "confidence")
    return each.select(
        "request_id",
        "pos",
        F.lit("").alias("id"),
        text_or(field(t, "title"), TITLE).alias("title"),
        all_said(field(t, "stride")).alias("stride"),
        F.coalesce(said(field(t, "severity")), F.lit(SEVERITY)).alias("severity"),
        F.coalesce(number(field(t, "score")), F.lit(SCORE)).alias("score"),
        all_said(field(t, "affected")).alias("affected"),
        text_or(field(t, "why"), "").alias("why"),
        all_said(field(t, "references")).alias("references"),
        text_or(field(t, "recommended_action"), ACTION).alias("recommended_action"),
        all_said(F.try_variant_get(t, "$.evidence.nodes", "variant")).alias("evidence_nodes"),
        all_said(F.try_variant_get(t, "$.evidence.edges", "variant")).alias("evidence_edges"),
        F.when(is_kind(confidence, NUMBER + "|BOOLEAN"), number(confidence)).alias("confidence"),
        F.filter(F.transform(F.filter(items(field(t, "rag_sources")), lambda s: is_kind(s, "OBJECT")), source), lambda s: s["chunk_id"] != "").alias("rag_sources"),
    )


def keep(min_confidence: float = 0.0, require_asvs: bool = True) -> Column:
    """What a finding must have: a reference to ASVS if asked for, confidence enough where one is given, some evidence, a reason of six characters."""
    asvs = F.exists(texts("references"), lambda r: F.contains(F.upper(r), F.lit("ASVS"))) if require_asvs else F.lit(True)
    sure = F.coalesce(F.col("confidence") >= min_confidence, F.lit(True))
    evidence = (F.size(texts("evidence_nodes")) > 0) | (F.size(texts("evidence_edges")) > 0)
    return asvs & sure & evidence & (F.length(strip(F.coalesce("why", F.lit("")))) >= MIN_WHY)


def signature() -> Column:
    """F27."""
    return F.struct(F.lower("title").alias("title"), F.sort_array(texts("evidence_nodes")).alias("nodes"), F.sort_array(texts("evidence_edges")).alias("edges"))


def severity_rank(c: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in SEVERITY_RANK.items() for x in kv])[F.lower(c)], F.lit(len(SEVERITY_RANK)))


def order(ranked_severity: bool = False) -> list[Column]:
    """Score, then severity by the alphabet (by its rank, if asked for: Q2), then title; pos breaks ties."""
    severity = severity_rank(F.col("severity")) if ranked_severity else F.col("severity")
    return [F.col("score").desc(), severity.asc(), F.col("title").asc(), F.col("pos").asc()]


def denoise(findings: DataFrame, min_confidence: float = 0.0, require_asvs: bool = True, topn: int | None = None, by: str = "request_id", dedup_first: bool = False, ranked_severity: bool = False) -> DataFrame:
    """Filter, order, limit, deduplicate, number. The limit comes before deduplication (Q1) unless dedup_first; no limit for None and 0. Lists are bounded by the answers they come from (P15), one a request."""
    own = findings.where(keep(min_confidence, require_asvs))

    def limit(df: DataFrame) -> DataFrame:
        return df if not topn else df.withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy(*order(ranked_severity)))).where(F.col("_r") <= topn).drop("_r")

    def dedup(df: DataFrame) -> DataFrame:
        return df.withColumn("_s", F.row_number().over(Window.partitionBy(by, signature()).orderBy(*order(ranked_severity)))).where("_s = 1").drop("_s")

    out = limit(dedup(own)) if dedup_first else dedup(limit(own))
    return out.withColumn("id", F.format_string("T%03d", F.row_number().over(Window.partitionBy(by).orderBy(*order(ranked_severity)))))
