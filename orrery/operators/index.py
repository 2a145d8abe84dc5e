"""Text index: terms, chunks, BM25 statistics."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.functions.text import strip, tokens

K1, B = 1.5, 0.75
CHUNK_TOKENS, CHUNK_OVERLAP = 800, 80


def postings(chunks: DataFrame, *, kb: str = "kb", chunk: str = "chunk_id", text: str = "text", terms: DataFrame | None = None) -> DataFrame:
    """A1: (kb, chunk_id, term, tf), counted with map-side combination: a chunk's tokens lie in one row, so what is shuffled are the postings themselves. With terms(term) only those of them,
    filtered before they are counted, each with doc_len, the chunk's number of tokens."""
    own = chunks.select(F.col(kb).alias("kb"), F.col(chunk).alias("chunk_id"), tokens(F.col(text)).alias("_t"))
    if terms is None:
        return own.select("kb", "chunk_id", F.explode("_t").alias("term")).groupBy("kb", "chunk_id", "term").agg(F.count("*").alias("tf"))
    each = own.select("kb", "chunk_id", F.size("_t").cast("long").alias("doc_len"), F.explode("_t").alias("term")).join(terms, "term", "left_semi")
    return each.groupBy("kb", "chunk_id", "doc_len", "term").agg(F.count("*").alias("tf"))


def lengths(chunks: DataFrame, *, kb: str = "kb", chunk: str = "chunk_id", text: str = "text") -> DataFrame:
    """(kb, chunk_id, doc_len): tokens of each chunk, no shuffle."""
    return chunks.select(F.col(kb).alias("kb"), F.col(chunk).alias("chunk_id"), F.size(tokens(F.col(text))).cast("long").alias("doc_len"))


def term_stats(posts: DataFrame) -> DataFrame:
    """A2: (kb, term, df). Postings are distinct, so a count is a distinct count."""
    return posts.groupBy("kb", "term").agg(F.count("*").alias("df"))


def kb_stats(lens: DataFrame) -> DataFrame:
    """A2: (kb, n_chunks, avgdl): every chunk counts as one token long at least."""
    total = F.sum(F.greatest(F.lit(1).cast("long"), "doc_len")).cast("double")
    return lens.groupBy("kb").agg(F.count("*").alias("n_chunks"), (total / F.count("*")).alias("avgdl"))


def idf(n: Column, df: Column) -> Column:
    """F5."""
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def bm25_term(tf: Column, df: Column, n: Column, length: Column, avgdl: Column) -> Column:
    """what one term adds to a chunk's score."""
    return idf(n, df) * (tf * (K1 + 1)) / (tf + K1 * (1 - B + B * F.greatest(F.lit(1), length) / avgdl))


def spans(total: Column, size: int = CHUNK_TOKENS, overlap: int = CHUNK_OVERLAP) -> Column:
    """Array of (start, stop) of overlapping windows over `total` tokens.

    An overlap that reaches the size counts as a quarter of it. The window that reaches the end is the last; no tokens, no window.
    """
    if size <= 0 or overlap < 0:
        raise ValueError("chunk size must be positive and overlap not negative")
    step = size - (size // 4 if overlap >= size else overlap)
    last = F.greatest(F.lit(0), F.ceil((total - size) / step)).cast("int")
    windows = F.transform(F.sequence(F.lit(0), last), lambda k: F.struct((k * step).alias("start"), F.least(k * step + size, total).cast("int").alias("stop")))
    return F.when(total > 0, windows).otherwise(F.array().cast("array<struct<start:int,stop:int>>"))


#: A unit of chunks: a token run, or one other character, each with the white space before it; or the white space at the end. Units joined are the text.
UNIT = r"[ \t\n\x0B\f\r]*(?:[A-Za-z0-9_:/.-]+|[^ \t\n\x0B\f\rA-Za-z0-9_:/.-])|[ \t\n\x0B\f\r]+"


def chunks(docs: DataFrame, *, kb: str = "kb", source: str = "source", text: str = "text", stem: str = "stem", size: int = CHUNK_TOKENS, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """Documents -> kb, source, chunk_id (`stem-00000`), chunk_index, token_count, text.

    A chunk's text is its stretch of the document, with every character. The unit is the token run or a single other character (token_chunks cuts by a model's tokenizer). Documents of
    white space alone give no chunk. No shuffle: each document is cut in its own row.
    """
    units = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(UNIT), F.lit(0))
    units = F.when(strip(F.col(text)) != "", units).otherwise(F.array().cast("array<string>"))
    own = docs.select(F.col(kb).alias("kb"), F.col(source).alias("source"), F.col(stem).cast("string").alias("_stem"), units.alias("_t"))
    cut = own.select("kb", "source", "_stem", "_t", F.posexplode(spans(F.size("_t"), size, overlap)).alias("chunk_index", "_s"))
    piece = F.slice("_t", F.col("_s.start") + 1, F.col("_s.stop") - F.col("_s.start"))
    return cut.select("kb", "source", F.format_string("%s-%05d", "_stem", "chunk_index").alias("chunk_id"), "chunk_index", (F.col("_s.stop") - F.col("_s.start")).alias("token_count"), F.array_join(piece, "").alias("text"))


def token_chunks(docs: DataFrame, load: Callable[[], Any], *, kb: str = "kb", source: str = "source", text: str = "text", stem: str = "stem", size: int = CHUNK_TOKENS, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """X1 by a model's tokenizer: as chunks(), with the tokens of what load() gives on the executors, an object with encode(text) and decode(ids), such as tiktoken's encodings."""
    spans(F.lit(0), size, overlap)
    step = size - (size // 4 if overlap >= size else overlap)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load()
        for b in batches:
            rows = []
            for i, (s, t) in enumerate(zip(b["_stem"].to_pylist(), b["_text"].to_pylist(), strict=True)):
                ids = tokenizer.encode(t) if (t or "").strip() else []
                starts = [k * step for k in range(-(-max(0, len(ids) - size) // step) + 1)]
                rows += [(i, f"{s}-{k:05d}", k, len(ids[at : at + size]), tokenizer.decode(ids[at : at + size])) for k, at in enumerate(starts) if ids]
            at, names, index, count, texts = zip(*rows, strict=True) if rows else ([],) * 5
            at = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([b["kb"].take(at), b["source"].take(at), pa.array(names, pa.string()), pa.array(index, pa.int32()), pa.array(count, pa.int32()), pa.array(texts, pa.string())], ["kb", "source", "chunk_id", "chunk_index", "token_count", "text"])

    own = docs.select(F.col(kb).alias("kb"), F.col(source).alias("source"), F.col(stem).cast("string").alias("_stem"), F.col(text).alias("_text"))
    kinds = dict(own.dtypes)
    return own.mapInArrow(cut, f"kb {kinds['kb']}, source {kinds['source']}, chunk_id string, chunk_index int, token_count int, text string")


def kb_meta(chunked: DataFrame, docs: DataFrame) -> DataFrame:
    """Kb, num_chunks, num_documents (all files seen, empty ones too), bm25_avgdl, bm25_vocab_size."""
    stats = kb_stats(lengths(chunked)).withColumnRenamed("n_chunks", "num_chunks").withColumnRenamed("avgdl", "bm25_avgdl")
    vocab = postings(chunked).select("kb", "term").distinct().groupBy("kb").agg(F.count("*").alias("bm25_vocab_size"))
    files = docs.groupBy("kb").agg(F.count("*").alias("num_documents"))
    return files.join(stats, "kb", "left").join(vocab, "kb", "left").fillna(0, ["num_chunks", "bm25_avgdl", "bm25_vocab_size"])
