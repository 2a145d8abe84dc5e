"""A corpus pipeline: language identification, quality rules, near-duplicate removal, mixing and packing.

Each stage takes what its predecessor kept, as a written table; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm import language_id, mixing, packing, quality_rules, shingle_join
from orrery.llm.common import scratch, small_batches, table, written
from orrery.llm.queries import tokenizer_path, trained

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Words of which a packing worker remembers the ids: fewer than alone, since executors hold what earlier stages took.
REMEMBERED = 60_000


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents in none of the languages: those without letters and those that resemble no profile."""
    small_batches(spark)
    found = language_id.identify(docs, language_id.learn(trained(docs)), COLUMNS)
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= language_id.LEAST_SCORE)).select(COLUMNS)


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that fail the base rules or are depleted; the others lose the lines above the limit."""
    out = quality_rules.judge(docs.select(COLUMNS)).where("kept")
    return out.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.length("kept_text").cast("long").alias("n_chars"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (a Jaccard similarity of 0.8 or more of five-word shingles) the document with the smallest doc_id stays: SimHash links,
    verified, and an exact join for the pairs that they can't reach."""
    small_batches(spark)
    return shingle_join.survivors(docs.select(COLUMNS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document so many times as the mix takes it."""
    return mixing.emit(mixing.mix(docs, keep=["text", "lang", "n_chars"])).select(COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their place in the sequences."""
    small_batches(spark)
    return packing.pack(written(packing.pieces(docs, tokenizer_path(), with_ids=False, remembered=REMEMBERED), "pieces"))


STAGES = [
    ("language_id", identify_language),
    ("quality_rules", apply_quality_rules),
    ("simhash", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]
#: The fingerprints, profiles and packing have no SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with scratch() as keep:
            docs = keep(written(stage(spark, docs, sf_dir), f"stage-{name}"))
    return STAGES[-1][1](spark, docs, sf_dir)
