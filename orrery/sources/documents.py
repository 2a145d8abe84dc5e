"""Documents and knowledge bases."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.functions.text import page_text, raw_tokens, strip
from orrery.operators import index

SUFFIXES = r"\.(pdf|html|htm|md|markdown|txt|text)$"
KB_NAME = r"[A-Za-z0-9][A-Za-z0-9._-]*"
#: So many names of knowledge bases are broadcast at most; more are joined.
FEW_BASES = 10_000


class DocumentError(ValueError):
    pass


def check_kb_name(name: str) -> str:
    """P20: a name of one path part."""
    if not re.fullmatch(KB_NAME, name):
        raise DocumentError(f"not a name of a knowledge base: {name!r}")
    return name


def read(spark: SparkSession, path: str, pdf: Callable[[bytes], str] | None = None) -> DataFrame:
    """(source, text): files under path of the known kinds, sorted by whoever reads; HTML without markup, PDF by the given function (without it, PDF files are an error), others as UTF-8."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).where(F.rlike(F.lower("path"), F.lit(SUFFIXES)))
    text = F.replace(F.expr("make_valid_utf8(cast(content as string))"), F.lit("\ufffd"), F.lit(""))  # bytes that are no UTF-8 go
    is_pdf, is_html = F.endswith(F.lower("path"), F.lit(".pdf")), F.rlike(F.lower("path"), F.lit(r"\.html?$"))
    out = files.select(F.col("path").alias("source"), "content", F.when(is_html, page_text(text)).otherwise(text).alias("text"), is_pdf.alias("_pdf"))
    if pdf is None:
        return out.select("source", F.when(F.col("_pdf"), F.raise_error(F.concat(F.lit("no PDF reader for "), "source"))).otherwise(F.col("text")).alias("text"))

    @F.pandas_udf("string")
    def pages(content: pd.Series) -> pd.Series:
        return content.map(lambda c: pdf(bytes(c)))

    return out.where("not _pdf").select("source", "text").unionByName(out.where("_pdf").select("source", pages("content").alias("text")))


def context(docs: DataFrame) -> DataFrame:
    """(source, text, token_count) of docs(source, text), trimmed; empty ones are an error."""
    text = strip(F.coalesce("text", F.lit("")))
    fine = F.when(text == "", F.raise_error(F.concat(F.lit("empty context document "), "source"))).otherwise(text)
    return docs.select("source", fine.alias("text")).withColumn("token_count", F.size(raw_tokens(F.col("text"))))


def context_summary(docs: DataFrame) -> DataFrame:
    """Count, tokens in all, sources in order."""
    return docs.agg(F.count("*").alias("count"), F.coalesce(F.sum("token_count"), F.lit(0)).cast("long").alias("token_count"), F.array_join(F.sort_array(F.collect_list("source")), ", ").alias("sources"))


def context_block(n: Column, source: Column, text: Column) -> Column:
    """F20."""
    return F.concat(F.lit("[Document "), n.cast("string"), F.lit(": "), source, F.lit("]\n"), text)


def token_limit(text: Column, limit: int) -> Column:
    """the number of tokens, or an error beyond the limit; text is never cut."""
    n = F.size(raw_tokens(text))
    return F.when(n > limit, F.raise_error(F.concat(F.lit("prompt has "), n.cast("string"), F.lit(f" tokens; the limit is {limit}")))).otherwise(n)


def of_bases(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """The chunks of all knowledge bases that docs name; the names are broadcast only when a count shows that they are few."""
    names = docs.select("kb").distinct()
    return chunks.join(F.broadcast(names) if names.count() <= FEW_BASES else names, "kb", "left_semi")


def build_kb(docs: DataFrame, path: str, embed: Callable[[pd.Series], pd.Series], size: int = index.CHUNK_TOKENS, overlap: int = index.CHUNK_OVERLAP, model: str = "hashing") -> None:
    """docs(kb, source, stem, text) -> chunks, vectors, postings and meta, each a table partitioned by kb; a kb that exists is replaced, others stay.

    X2: embed takes a column of texts and gives one of vectors; each distinct text is embedded once.
    """
    spark = docs.sparkSession
    chunked = index.chunks(docs.where("trim(coalesce(text, '')) <> ''"), size=size, overlap=overlap)

    @F.pandas_udf("array<float>")
    def vector(text: pd.Series) -> pd.Series:
        return embed(text)

    def put(df: DataFrame, name: str) -> None:
        df.write.partitionBy("kb").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(f"{path}/{name}")

    put(chunked, "chunks")
    kept = of_bases(spark.read.parquet(f"{path}/chunks"), docs).select(*chunked.columns)
    if kept.isEmpty():
        raise DocumentError("no document gave a chunk")
    unique = kept.select("text").distinct().withColumn("embedding", vector("text"))
    put(kept.select("kb", "chunk_id", "text").join(unique, "text").select("kb", "chunk_id", "embedding"), "vectors")
    put(index.postings(kept), "postings")
    put(index.kb_meta(kept, docs).withColumns({"embedding_model": F.lit(model), "chunk_tokens": F.lit(size), "chunk_overlap": F.lit(overlap), "updated_at": F.current_timestamp()}), "meta")


TABLES = {
    "chunks": "source string, chunk_id string, chunk_index int, token_count int, text string, kb string",
    "vectors": "chunk_id string, embedding array<float>, kb string",
    "postings": "chunk_id string, term string, tf long, kb string",
    "meta": "num_documents long, num_chunks long, bm25_avgdl double, bm25_vocab_size long, embedding_model string, chunk_tokens int, chunk_overlap int, updated_at timestamp, kb string",
}


def load_kb(spark: SparkSession, path: str, names: list[str] | None = None) -> dict[str, DataFrame]:
    """The tables of some knowledge bases (all, if None); chunks and vectors meet by chunk_id."""
    keep = lambda df: df if names is None else df.where(F.col("kb").isin([check_kb_name(n) for n in names]))
    return {t: keep(spark.read.schema(columns).parquet(f"{path}/{t}")) for t, columns in TABLES.items()}


def list_kbs(spark: SparkSession, path: str) -> DataFrame:
    """The catalogue, by name."""
    return spark.read.schema(TABLES["meta"]).parquet(f"{path}/meta").orderBy("kb")


def remove_kb(spark: SparkSession, path: str, name: str) -> None:
    """K7."""
    check_kb_name(name)
    gone = False
    for t in TABLES:
        p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{t}/kb={name}")
        gone |= p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    if not gone:
        raise DocumentError(f"no knowledge base {name!r}")


FINDING = "id string, title string, stride array<string>, severity string, score double, affected array<string>, why string, recommended_action string, references array<string>, evidence struct<nodes: array<string>, edges: array<string>>, confidence double"
REPORT = (
    f"generated_at string, count long, threats array<struct<{FINDING}>>, graph struct<nodes: array<struct<id: string, label: string, zone: string, zones: array<string>, type: string>>, "
    "edges array<struct<src: string, dst: string, label: string, protocol: string>>, zones array<struct<id: string, name: string, parent_id: string>>>"
)


def reports(spark: SparkSession, path: str) -> DataFrame:
    """Report files, with empty lists for what is missing."""
    schema = REPORT.replace("edges array<", "edges: array<").replace("zones array<struct<id", "zones: array<struct<id")
    return spark.read.schema(schema).option("multiLine", True).json(path).withColumn("path", F.input_file_name())


GOLD = "scenario string, diagram string, expected array<struct<id: string, title: string, stride: array<string>, components: array<string>, why: string, detection: struct<threshold: double, similarity_threshold: double>>>"


def gold(spark: SparkSession, root: str, only: list[str] | None = None) -> DataFrame:
    """(scenario, id, title, why, stride, components, threshold) of all <root>/<scenario>/expected_threats.json, or of those named; unknown names are an error."""
    own = spark.read.schema(GOLD).option("multiLine", True).json(f"{root}/*/expected_threats.json").withColumn("scenario", F.regexp_extract(F.input_file_name(), r"([^/]+)/expected_threats\.json$", 1))
    if only:
        known = {r[0] for r in own.select("scenario").distinct().collect()}  # one row a scenario folder
        if missing := sorted(set(only) - known):
            raise DocumentError(f"unknown scenarios: {', '.join(missing)}")
        own = own.where(F.col("scenario").isin(only))
    return own.select("scenario", F.explode("expected").alias("e")).select("scenario", "e.id", "e.title", "e.why", "e.stride", "e.components", F.coalesce("e.detection.threshold", "e.detection.similarity_threshold").alias("threshold"))


def numbered_blocks(docs: DataFrame) -> DataFrame:
    """one text of all context documents (few: they fit a prompt), numbered by source."""
    one = docs.agg(F.sort_array(F.collect_list(F.struct("source", "text"))).alias("_d"))
    return one.select(F.array_join(F.transform("_d", lambda x, i: context_block(i + 1, x["source"], x["text"])), "\n\n").alias("context"))
