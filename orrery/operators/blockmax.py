"""Block-max postings (A3, T2, K6): an inverted index whose postings lie by term in blocks of chunks, each with the largest score in it, and top-k that passes over blocks.

Blocks are aligned: a block is the same chunks for every term. What the asked terms' largest scores in a block add up to bounds the scores of its chunks, so once some block has given k scores, no block
with a smaller bound than the k-th of them is read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions.text import tokens
from orrery.operators import index
from orrery.operators.retrieve import asked_terms, topk
from orrery.tables import scratch, written

#: Chunks of a block; blocks that a query's first scores come from.
BLOCK_CHUNKS, FIRST_BLOCKS = 64, 4
#: Asked terms up to which they are a filter that the scan of the index takes.
PUSHED_TERMS = 1000
#: By how much rounded scores can exceed a bound.
SLACK = 1e-6
SCHEMA = "term string, block long, df long, top double, postings array<struct<chunk_id:{id},score:double>>, kb {kb}"


def signature(terms: Column) -> Column:
    """A value that chunks with common terms tend to share, so that they come into the same blocks: the smallest hash of a term."""
    return F.array_min(F.transform(terms, lambda t: F.xxhash64(t)))


def blocked(chunked: DataFrame, block_chunks: int = BLOCK_CHUNKS) -> DataFrame:
    """chunks(kb, chunk_id, text) -> kb, chunk_id, terms, doc_len, block, as a written table. Chunks are range partitioned by kb and signature; a partition's rows are cut into blocks."""
    n = int(chunked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = chunked.select("kb", "chunk_id", tokens(F.col("text")).alias("terms")).withColumn("_s", signature(F.col("terms")))
    placed = own.repartitionByRange(n, "kb", "_s", "chunk_id").sortWithinPartitions("kb", "_s", "chunk_id").withColumn("_at", F.monotonically_increasing_id())
    block = F.shiftright("_at", 33) * F.lit(1 << 33) + F.floor(F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) / block_chunks)
    return written(placed.select("kb", "chunk_id", "terms", F.size("terms").cast("long").alias("doc_len"), block.cast("long").alias("block")), "blocked-chunks")


def postings(chunked: DataFrame, block_chunks: int = BLOCK_CHUNKS) -> DataFrame:
    """The index of chunks(kb, chunk_id, text): term, block, df (chunks of the kb that have the term), top (the largest score in the block), postings (chunk_id, score), kb; sorted by term within partitions.

    A score is what the term adds to the chunk's BM25 score for any query. A term that all chunks have lies in as many rows as there are blocks, so nothing grows with its frequency but their number.
    """
    with scratch() as keep:
        own = keep(blocked(chunked, block_chunks))
        each = own.select("kb", "block", "chunk_id", "doc_len", F.explode("terms").alias("term")).groupBy("kb", "term", "block", "chunk_id", "doc_len").agg(F.count("*").alias("tf"))
        lists = keep(written(each.groupBy("kb", "term", "block").agg(F.collect_list(F.struct("chunk_id", "tf", "doc_len")).alias("own")), "term-blocks"))  # block_chunks at most
    df = lists.groupBy("kb", "term").agg(F.sum(F.size("own")).alias("df"))
    score = lambda x: F.struct(x["chunk_id"].alias("chunk_id"), index.bm25_term(x["tf"], F.col("df"), F.col("n_chunks"), x["doc_len"], F.col("avgdl")).alias("score"))
    scored = lists.join(df, ["kb", "term"]).join(index.kb_stats(own), "kb").withColumn("postings", F.transform("own", score))
    top = F.array_max(F.transform("postings", lambda x: x["score"]))
    return scored.select("term", "block", "df", top.alias("top"), "postings", "kb").sortWithinPartitions("kb", "term", "block")


def asked(posts: DataFrame, queries: DataFrame, most: int = PUSHED_TERMS) -> tuple[DataFrame, DataFrame]:
    """(queries' terms, the index's rows of them): up to `most` distinct terms are a filter of the scan, more a semi join."""
    terms = asked_terms(queries)
    distinct = terms.select("term").distinct()
    some = [r[0] for r in distinct.limit(most + 1).collect()]
    return terms, posts.where(F.col("term").isin(some)) if len(some) <= most else posts.join(distinct, "term", "left_semi")


def bounds(posts: DataFrame, terms: DataFrame) -> DataFrame:
    """(query_id, kb, block, bound, n): what no score of the block exceeds, by the blocks' heads alone (a scan without postings), and its postings of asked terms."""
    return posts.select("kb", "term", "block", "top").join(terms, "term").groupBy("query_id", "kb", "block").agg(F.sum("top").alias("bound"))


def _scores(posts: DataFrame, terms: DataFrame, wanted: DataFrame) -> DataFrame:
    """query_id, kb, chunk_id, score of the wanted(query_id, kb, block)."""
    rows = posts.select("kb", "term", "block", "postings").join(terms, "term").join(wanted.select("query_id", "kb", "block"), ["query_id", "kb", "block"], "left_semi")
    return rows.select("query_id", "kb", F.inline("postings")).groupBy("query_id", "kb", "chunk_id").agg(F.sum("score").alias("score"))


def search(queries: DataFrame, posts: DataFrame, k: int, first_blocks: int = FIRST_BLOCKS) -> tuple[DataFrame, DataFrame]:
    """queries(query_id, text) over an index -> (topk()'s rows for the chunks that share a term with the query, as full scoring gives them; blocks: query_id, kb, block, bound, visited).

    First each query's blocks of the greatest bounds are scored, which gives its k-th score so far in each kb; then the blocks that could still beat it.
    """
    terms, own = asked(posts, queries)
    with scratch() as keep:
        w = Window.partitionBy("query_id", "kb").orderBy(F.col("bound").desc(), "block")
        heads = keep(written(bounds(own, terms).withColumn("first", F.row_number().over(w) <= first_blocks), "block-bounds"))
        begun = keep(written(topk(_scores(own, terms, heads.where("first")), k), "first-scores"))
    least = begun.where(F.col("rank") == k).select("query_id", "kb", F.col("score").alias("least"))
    visited = F.col("first") | F.coalesce(F.col("bound") + SLACK >= F.col("least"), F.lit(True))
    seen = heads.join(least, ["query_id", "kb"], "left").withColumn("visited", visited).drop("least")
    more = _scores(own, terms, seen.where("visited and not first")).withColumn("score", F.round("score", 6))
    return topk(begun.drop("rank").unionByName(more), k), seen.drop("first")
