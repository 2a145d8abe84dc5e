"""Operators as functions of SQL (X8, X1): temporary functions whose bodies the optimiser puts into the query, so that a query written in SQL alone stays in the JVM, and chunks as a table function."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

from orrery.functions.text import TOKEN
from orrery.operators.index import UNIT, B, K1

#: Signature, type and body of each function. Bodies are what the column functions of the same operators compute.
FUNCTIONS = {
    "orrery_tokens(text STRING)": ("ARRAY<STRING>", rf"transform(filter(regexp_extract_all(coalesce(text, ''), r'{TOKEN}', 0), t -> length(t) > 1), t -> lower(t))"),  # F1
    "orrery_idf(n BIGINT, df BIGINT)": ("DOUBLE", "ln(1 + (n - df + 0.5D) / (df + 0.5D))"),  # F5
    "orrery_bm25(tf BIGINT, df BIGINT, n BIGINT, doc_len BIGINT, avgdl DOUBLE)": (
        "DOUBLE", f"ln(1 + (n - df + 0.5D) / (df + 0.5D)) * (tf * {K1 + 1}D) / (tf + {K1}D * ({1 - B}D + {B}D * greatest(1, doc_len) / avgdl))",
    ),  # F5
    "orrery_strip(text STRING)": ("STRING", r"regexp_replace(text, r'^\s+|\s+$', '')"),
    "orrery_unquoted(text STRING)": (
        "STRING",
        r"nullif(regexp_replace(regexp_replace(regexp_replace(text, r'^\s+|\s+$', ''), r'(?s)^([\x22\x27])(.*)\1$', '$2'), r'^\s+|\s+$', ''), '')",
    ),  # F10
    "orrery_overlap(query ARRAY<STRING>, text ARRAY<STRING>)": ("DOUBLE", "CASE WHEN size(array_distinct(query)) = 0 THEN 0D ELSE size(array_intersect(array_distinct(query), text)) / size(array_distinct(query)) END"),  # U6
    "orrery_signature(title STRING, nodes ARRAY<STRING>, edges ARRAY<STRING>)": (
        "STRUCT<title: STRING, nodes: ARRAY<STRING>, edges: ARRAY<STRING>>",
        "named_struct('title', lower(title), 'nodes', sort_array(coalesce(nodes, cast(array() AS ARRAY<STRING>))), 'edges', sort_array(coalesce(edges, cast(array() AS ARRAY<STRING>))))",
    ),  # F27
    "orrery_cosine(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>)": (
        "DOUBLE",
        "aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x) / ((sqrt(aggregate(transform(a, x -> x * x), 0D, (s, x) -> s + x)) + 1e-10D) * (sqrt(aggregate(transform(b, x -> x * x), 0D, (s, x) -> s + x)) + 1e-10D))",
    ),  # F2
}


class Chunks:
    """X1 as a table function: orrery_chunks(TABLE(...), size, overlap) over a table with the columns stem and text; its other columns come through. Rows are dealt by stem and keep their order within it, so that each
    task cuts its own documents."""

    @staticmethod
    def analyze(table: AnalyzeArgument, size: AnalyzeArgument, overlap: AnalyzeArgument) -> AnalyzeResult:
        if not table.isTable:
            raise ValueError("the first argument is a table")
        columns = {f.name for f in table.dataType.fields}
        if missing := {"stem", "text"} - columns:
            raise ValueError(f"the table has no {' and no '.join(sorted(missing))}")
        if not (size.isConstantExpression and overlap.isConstantExpression) or size.value <= 0 or overlap.value < 0:
            raise ValueError("chunk size must be a positive and overlap a constant that isn't negative")
        own = [f for f in table.dataType.fields if f.name not in ("stem", "text", "chunk_id", "chunk_index", "token_count")]
        new = [StructField("chunk_id", StringType()), StructField("chunk_index", IntegerType()), StructField("token_count", IntegerType()), StructField("text", StringType())]
        return AnalyzeResult(StructType([*own, *new]), partitionBy=[PartitioningColumn("stem")], orderBy=[OrderingColumn("text")])

    def eval(self, table: Row, size: int, overlap: int) -> Iterator[tuple]:
        row = table.asDict()
        text = row.pop("text") or ""
        stem = row.pop("stem")
        for name in ("chunk_id", "chunk_index", "token_count"):
            row.pop(name, None)
        units = [m.group() for m in PATTERN.finditer(text)] if text.strip(" \t\n\x0b\f\r") else []
        step = size - (size // 4 if overlap >= size else overlap)
        for k in range(-(-max(0, len(units) - size) // step) + 1 if units else 0):
            own = units[k * step : k * step + size]
            yield (*row.values(), f"{stem}-{k:05d}", k, len(own), "".join(own))


PATTERN = re.compile(UNIT)


def register(spark: SparkSession) -> None:
    """Make the functions known to a session."""
    for signature, (kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURNS {kind} RETURN ({body})")
    spark.udtf.register("orrery_chunks", F.udtf(Chunks))
