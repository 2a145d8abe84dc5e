"""Hybrid retrieval: BM25, dense search, rank fusion, normalisation, thresholds, diversity.

Only ids and scores travel through ranking; texts are joined to what is left.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from orrery.functions.text import tokens
from orrery.functions.vectors import dot, norm
from orrery.operators import index
from orrery.tables import scratch, written

STRATEGIES, RERANKERS = ("dense", "hybrid"), ("off", "local", "llm", "auto")
#: Rows up to which a table of queries is sent to all tasks; more make blocks, so many at most.
BROADCAST_QUERIES, MOST_BLOCKS = 10_000, 1000


class RetrievalError(ValueError):
    pass


@dataclass(frozen=True)
class Options:
    """Checked when made."""

    strategy: str = "hybrid"
    reranker: str = "auto"
    topk: int = 8
    candidates: int = 40
    min_score: float = 0.25
    rrf_k: int = 60
    mmr_lambda: float = 0.7
    max_per_source: int = 2
    dense_rrf: float = 0.30
    sparse_rrf: float = 0.40
    dense_raw: float = 0.10
    sparse_raw: float = 0.20

    def __post_init__(self):
        checks = [
            (self.strategy in STRATEGIES, f"strategy must be one of {STRATEGIES}"),
            (self.reranker in RERANKERS, f"reranker must be one of {RERANKERS}"),
            (self.topk > 0, "topk must be positive"),
            (self.candidates > 0, "candidates must be positive"),
            (0 <= self.min_score <= 1, "min_score must be between 0 and 1"),
            (self.rrf_k > 0, "rrf_k must be positive"),
            (0 <= self.mmr_lambda <= 1, "mmr_lambda must be between 0 and 1"),
        ]
        for ok, what in checks:
            if not ok:
                raise RetrievalError(what)


def few(df: DataFrame, most: int = BROADCAST_QUERIES) -> DataFrame:
    """Marked for broadcast if it has at most `most` rows, which a count of so many and one more checks; else as it is."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def minmax(value: Column, window) -> Column:
    """Into [0, 1] within the window's list; all 1 where the list is constant."""
    low, high = F.min(value).over(window), F.max(value).over(window)
    return F.when(high - low < 1e-10, F.lit(1.0)).otherwise((value - low) / (high - low))


def rrf(rank: Column, k: int) -> Column:
    """W2."""
    return 1.0 / (k + rank)


def blocks(queries: DataFrame, most: int = BROADCAST_QUERIES) -> list[DataFrame]:
    """The stated set of queries(query_id, ...) as tables that are sent to all tasks, of at most `most` rows each by a count."""
    n = queries.count()
    if n <= most:
        return [F.broadcast(queries)]
    parts = -(-2 * n // most)
    while True:
        if parts > MOST_BLOCKS:
            raise RetrievalError(f"{n} queries at once make more than {MOST_BLOCKS} blocks")
        block = F.pmod(F.xxhash64("query_id"), F.lit(parts))
        if queries.groupBy(block).count().agg(F.max("count")).first()[0] <= most:
            return [F.broadcast(queries.where(block == k)) for k in range(parts)]
        parts *= 2


def asked_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term): the distinct terms of each query, marked for broadcast where they are few."""
    return few(queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term")))


def bm25(queries: DataFrame, posts: DataFrame, lens: DataFrame) -> DataFrame:
    """A3: queries(query_id, text), postings, lengths -> query_id, kb, chunk_id, score for the chunks that share a term with the query.

    Postings of terms that no query asks for go first. What a posting adds to a score is the same for all queries, so it is computed before the join with them, and the sum has
    map-side combination. Postings that carry doc_len need no join with the lengths.
    """
    asked = asked_terms(queries)
    own = posts.join(asked.select("term").distinct(), "term", "left_semi")
    if "doc_len" not in own.columns:
        own = own.join(lens, ["kb", "chunk_id"])
    each = index.bm25_term(F.col("tf"), F.col("df"), F.col("n_chunks"), F.col("doc_len"), F.col("avgdl"))
    adds = own.join(index.term_stats(own), ["kb", "term"]).join(index.kb_stats(lens), "kb").select("kb", "chunk_id", "term", each.alias("adds"))
    return adds.join(asked, "term").groupBy("query_id", "kb", "chunk_id").agg(F.sum("adds").alias("score"))


def bm25_texts(queries: DataFrame, chunked: DataFrame, lens: DataFrame | None = None) -> DataFrame:
    """A3 over chunks(kb, chunk_id, text) that have no index yet: only asked terms are counted, and a chunk's length goes along with them. Their postings are read twice, so they are a written table; `lens` are the
    chunks' lengths, if they are at hand."""
    with scratch() as keep:
        posts = keep(written(index.postings(chunked, terms=asked_terms(queries).select("term").distinct()), "asked-postings"))
    return bm25(queries, posts, index.lengths(chunked) if lens is None else lens)


def checked(queries: DataFrame) -> DataFrame:
    """queries(query_id, embedding) -> query_id, _q, _n (its norm). A query without direction (a zero vector, or one with entries that are null or not finite) is an error."""
    q = queries.select("query_id", F.col("embedding").alias("_q"), norm(F.col("embedding")).alias("_n"))
    fine = F.coalesce((F.col("_n") > 0) & (F.col("_n") < float("inf")), F.lit(False))  # NaN counts as larger than all
    return q.withColumn("_n", F.when(fine, F.col("_n")).otherwise(F.raise_error(F.concat(F.lit("the embedding of query "), F.coalesce(F.col("query_id").cast("string"), F.lit("null")), F.lit(" has no direction"))).cast("double")))


def dense(queries: DataFrame, vectors: DataFrame) -> DataFrame:
    """queries(query_id, embedding), vectors(kb, chunk_id, embedding) -> query_id, kb, chunk_id, score: each query against each vector.

    The stated set of queries is sent to the vectors in blocks whose size is checked, so vectors aren't shuffled. clusters.search() gives the best of each query without comparing all.
    """
    q = checked(queries)
    v = vectors.select("kb", "chunk_id", "embedding", norm(F.col("embedding")).alias("_m"))
    score = dot(F.col("embedding"), F.col("_q")) / ((F.col("_m") + 1e-10) * (F.col("_n") + 1e-10))
    return reduce(DataFrame.unionByName, [v.join(block, F.lit(True)).select("query_id", "kb", "chunk_id", score.alias("score")) for block in blocks(q)])


def topk(scores: DataFrame, k: int, by: tuple[str, ...] = ("query_id", "kb"), digits: int = 6) -> DataFrame:
    """The k highest scores of each list with their 1-based rank; ties by kb and chunk. Scores are rounded, so that engines agree on ties.

    Spark cuts each task's rows to k before the shuffle.
    """
    ties = [F.col(c) for c in ("kb", "chunk_id")]
    w = Window.partitionBy(*by).orderBy(F.col("score").desc(), *ties)
    return scores.withColumn("score", F.round("score", digits)).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def with_zeros(sparse: DataFrame, queries: DataFrame, lens: DataFrame, k: int) -> DataFrame:
    """Q7: chunks that share no term with a query have the score 0 and still fill its list up to k. Only the first k chunks of each kb can be needed
    besides those with a score, since ties go by chunk."""
    sparse = written(sparse, "sparse-scores")  # read three times
    w = Window.partitionBy("kb").orderBy("chunk_id")
    hit = sparse.select("query_id", "kb", "chunk_id")
    per = sparse.groupBy("query_id", "kb").agg(F.count("*").alias("_n"))
    first = lens.select("kb", "chunk_id").withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= 2 * k).drop("_r")
    wide = reduce(DataFrame.unionByName, [first.join(block, F.lit(True)) for block in blocks(queries.select("query_id"))])
    more = wide.join(hit, ["query_id", "kb", "chunk_id"], "left_anti").join(per.where(F.col("_n") >= k), ["query_id", "kb"], "left_anti")
    return sparse.unionByName(more.withColumn("score", F.lit(0.0)))


def fuse(dense_top: DataFrame, sparse_top: DataFrame, opts: Options = Options()) -> DataFrame:
    """Two ranked lists (query_id, kb, chunk_id, score, rank) -> query_id, kb, chunk_id, dense_score, sparse_score, fused_score."""
    key = ["query_id", "kb", "chunk_id"]
    w = Window.partitionBy("query_id", "kb")
    d = dense_top.select(*key, F.col("score").alias("dense_score"), F.col("rank").alias("dr"), minmax(F.col("score"), w).alias("dn"))
    s = sparse_top.select(*key, F.col("score").alias("sparse_score"), F.col("rank").alias("sr"), minmax(F.col("score"), w).alias("sn"))
    one = lambda rank, n, a, b: F.coalesce(a * rrf(rank, opts.rrf_k) + b * n, F.lit(0.0))
    fused = one(F.col("dr"), F.col("dn"), opts.dense_rrf, opts.dense_raw) + one(F.col("sr"), F.col("sn"), opts.sparse_rrf, opts.sparse_raw)
    both = d.join(s, key, "full")
    return both.select(*key, F.coalesce("dense_score", F.lit(0.0)).alias("dense_score"), F.coalesce("sparse_score", F.lit(0.0)).alias("sparse_score"), fused.alias("fused_score"))


def fuse_queries(fused: DataFrame) -> DataFrame:
    """A4: (request_id, query_pos, query_id, kb, chunk_id, scores) -> one row a request and chunk: fused scores add up, the others' maximum (0 at least), the queries that hit in order."""
    zero = F.lit(0.0)
    hits = F.array_distinct(F.transform(F.sort_array(F.collect_list(F.struct("query_pos", "query_id"))), lambda x: x["query_id"]))
    return fused.groupBy("request_id", "kb", "chunk_id").agg(
        F.sum("fused_score").alias("fused_score"), F.greatest(zero, F.max("dense_score")).alias("dense_score"), F.greatest(zero, F.max("sparse_score")).alias("sparse_score"), hits.alias("query_hits")
    )


def candidates(fused: DataFrame, k: int, digits: int = 6) -> DataFrame:
    """The k best of each request, with `pos`, their place."""
    w = Window.partitionBy("request_id").orderBy(F.col("fused_score").desc(), "kb", "chunk_id")
    return fused.withColumn("fused_score", F.round("fused_score", digits)).withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= k)


def threshold(scored: DataFrame, min_score: float, by: tuple[str, ...] = ("request_id",), score: str = "final_score", order: tuple[str, ...] = ("pos",), keep_all: bool = False) -> DataFrame:
    """P2 (P3 with keep_all): rows of at least min_score; where a list has none, its first row (all its rows)."""
    w = Window.partitionBy(*by)
    none = F.coalesce(F.max(score).over(w) < min_score, F.lit(True))
    first = F.lit(True) if keep_all else F.row_number().over(w.orderBy(*order)) == 1
    out = scored.withColumns({"_none": none, "_first": first})
    return out.where((F.col(score) >= min_score) | (F.col("_none") & F.col("_first"))).drop("_none", "_first")


def final_scores(cands: DataFrame) -> DataFrame:
    """candidates, with rerank_raw where a reranker ran -> rerank_score and final_score: .8 of the normalised rerank score and .2 of the normalised fused one, or the fused one alone."""
    w = Window.partitionBy("request_id")
    own = cands if "rerank_raw" in cands.columns else cands.withColumn("rerank_raw", F.lit(None).cast("double"))
    reranked = F.count("rerank_raw").over(w) > 0
    norm_rerank, norm_fused = minmax(F.coalesce("rerank_raw", F.lit(0.0)), w), minmax(F.col("fused_score"), w)
    out = own.withColumns({"rerank_score": F.when(reranked, norm_rerank), "_f": norm_fused})
    return out.withColumn("final_score", F.when(F.col("rerank_score").isNotNull(), 0.8 * F.col("rerank_score") + 0.2 * F.col("_f")).otherwise(F.col("_f"))).drop("_f", "rerank_raw")


def overlap_reranker(query: str, texts: list[str]) -> list[float]:
    """X3 without a model: the share of the query's tokens that a text has."""
    import re

    from orrery.functions.text import TOKEN

    def terms(t):
        return {x.lower() for x in re.findall(TOKEN, t or "") if len(x) > 1}

    q = terms(query)
    return [len(q & terms(t)) / max(1, len(q)) for t in texts]


def choose_reranker(mode: str, local: Callable | None = None, llm: Callable | None = None) -> tuple[str, Callable | None]:
    """(backend, function): auto takes the local one if there is one, else the model's, else none; a backend that is asked for by name and isn't there is an error."""
    if mode not in RERANKERS:
        raise RetrievalError(f"reranker must be one of {RERANKERS}")
    by = {"local": local, "llm": llm}
    if mode == "off":
        return "off", None
    if mode == "auto":
        return next(((k, f) for k, f in by.items() if f is not None), ("off", None))
    if by[mode] is None:
        raise RetrievalError(f"reranker {mode} asked for but none given")
    return mode, by[mode]


def rerank(cands: DataFrame, requests: DataFrame, fn: Callable[[str, list[str]], list[float]], required: bool = False, text_chars: int = 3500) -> DataFrame:
    """Adds rerank_raw by fn(query, texts) for the candidates of each request (a bounded number: Options.candidates). requests(request_id, query).

    If fn fails the request goes on without, unless required. P18: scores that are missing or not numbers count as 0.
    """

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos", ignore_index=True)
        try:
            got = list(fn(pdf["query"].iloc[0], [(t or "")[:text_chars] for t in pdf["text"]]))
            raw = [float(got[i]) if i < len(got) and got[i] is not None else 0.0 for i in range(len(pdf))]
        except Exception:
            if required:
                raise
            raw = [None] * len(pdf)
        return pdf.drop(columns="query").assign(rerank_raw=pd.array(raw, dtype="Float64"))

    own = cands.join(requests.select("request_id", "query"), "request_id")
    return own.groupBy("request_id").applyInPandas(one, StructType([*own.drop("query").schema, StructField("rerank_raw", DoubleType())]))


def mmr(cands: DataFrame, k: int, trade: float = 0.7, max_per_source: int = 2, by: str = "request_id", order: tuple[str, ...] = ("final_score", "pos"), digits: int = 9) -> DataFrame:
    """Maximal marginal relevance: (by, source, final_score, vector, pos, ...) -> at most k rows of each request with `mmr_rank`.

    Greedy: the next row has the highest trade * score - (1 - trade) * largest cosine to those chosen, rounded to `digits`; the first wins ties; rows of a source that
    has max_per_source chosen are passed over (0: no cap; a source that is null or empty has none). A request's candidates, a bounded number, are one array, and the choice is a fold over k steps
    whose state holds the places chosen and each candidate's largest cosine to them.
    """
    c = F.col
    lows = [(-c(x)).alias(x) if x != "pos" else c(x) for x in order]
    row = F.struct(*lows, F.struct(*[c(x) for x in cands.columns if x != by]).alias("row"), norm(c("vector")).alias("length"))
    lists = cands.groupBy(by).agg(F.array_sort(F.collect_list(row)).alias("_c"))
    # what the fold looks at, by place
    lists = lists.select(by, F.transform("_c", lambda x: x["row"]).alias("_c"), F.transform("_c", lambda x: F.struct(x["row"]["source"].alias("source"), x["row"]["final_score"].cast("double").alias("score"), x["row"]["vector"].alias("vector"), x["length"].alias("length"))).alias("_v"))
    none = F.array().cast("array<int>")
    start = F.struct(none.alias("chosen"), F.transform("_v", lambda x: F.lit(0.0)).alias("nearest"))
    at = lambda i: F.get(c("_v"), i)

    def step(state: Column, _: Column) -> Column:
        chosen, nearest = state["chosen"], state["nearest"]

        def value(x: Column, i: Column) -> Column:
            taken = F.size(F.filter(chosen, lambda j: at(j)["source"] == x["source"]))
            full = (F.coalesce(x["source"].cast("string"), F.lit("")) != "") & (taken >= max_per_source) if max_per_source > 0 else F.lit(False)
            score = F.round(trade * x["score"] - (1 - trade) * F.get(nearest, i), digits)
            return F.when(~F.array_contains(chosen, i) & ~full, F.struct(score.alias("value"), (-i).alias("i")))

        def take(best: Column) -> Column:
            new = -best["i"]
            b = at(new)
            near = F.transform("_v", lambda x, i: let_max(F.get(nearest, i), dot(x["vector"], b["vector"]) / (x["length"] * b["length"] + 1e-10), F.size(chosen) == 0))
            return F.struct(F.concat(chosen, F.array(new)).alias("chosen"), near.alias("nearest"))

        best = F.array_max(F.transform("_v", value))
        return F.element_at(F.transform(F.array(best), lambda x: F.when(x.isNull(), state).otherwise(take(x))), 1)

    def let_max(before: Column, now: Column, first: Column) -> Column:
        return F.when(first, now).otherwise(F.greatest(before, now))

    folded = lists.withColumn("_s", F.aggregate(F.sequence(F.lit(1), F.lit(k)), start, step))
    out = folded.select(by, "_c", F.posexplode("_s.chosen").alias("_n", "_i")).select(by, (c("_n") + 1).alias("mmr_rank"), F.get("_c", "_i").alias("_r"))
    return out.select(*[c(by) if x == by else c("_r")[x].alias(x) for x in cands.columns], "mmr_rank")


def context_block(kb: Column, chunk_id: Column, score: Column, source: Column, text: Column) -> Column:
    """one passage of a prompt's context."""
    return F.format_string("[KB:%s | chunk:%s | score:%.3f | source:%s]\n%s\n", kb, chunk_id, score, source, F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", ""))


def context_text(blocks: DataFrame, by: str = "request_id", pos: str = "pos", block: str = "block") -> DataFrame:
    """the blocks of each request in order, one text."""
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(pos, block))), lambda x: x[block]), "\n")
    return blocks.groupBy(by).agg(F.regexp_replace(joined, r"^\s+|\s+$", "").alias("context_text"))


def search(queries: DataFrame, chunked: DataFrame, vectors: DataFrame, k: int = 8, strategy: str = "dense", opts: Options = Options()) -> DataFrame:
    """queries(query_id, text, embedding) over a knowledge base, dense or hybrid -> query_id, kb, chunk_id, scores, rank."""
    d = topk(dense(queries, vectors), k)
    if strategy == "dense":
        return d.select("query_id", "kb", "chunk_id", F.col("score").alias("dense_score"), F.lit(0.0).alias("sparse_score"), F.col("score").alias("fused_score"), F.col("score").alias("final_score"), "rank")
    lens = written(index.lengths(chunked), "lengths")
    s = topk(with_zeros(bm25_texts(queries, chunked, lens), queries, lens, k), k)
    fused = fuse(d, s, opts)
    w = Window.partitionBy("query_id", "kb").orderBy(F.col("fused_score").desc(), "chunk_id")
    out = fused.withColumn("fused_score", F.round("fused_score", 6)).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return out.withColumn("final_score", F.col("fused_score"))


def retrieve(requests: DataFrame, queries: DataFrame, chunked: DataFrame, vectors: DataFrame, opts: Options = Options(), reranker: Callable | None = None) -> tuple[DataFrame, DataFrame]:
    """requests(request_id, query), queries(request_id, query_pos, query_id, text, embedding) -> (results, ranked candidates).

    Many queries, many knowledge bases: fusion by query and base, sums over queries, the best candidates, reranking, the threshold, diversity.
    Dense strategy: the best of all bases by cosine alone, without threshold, diversity or cap (Q28).
    """
    if opts.strategy == "dense":
        hits = topk(dense(queries.where("query_pos = 0"), vectors), opts.topk).join(queries.select("query_id", "request_id"), "query_id")
        w = Window.partitionBy("request_id").orderBy(F.col("score").desc(), "kb", "chunk_id")
        ranked = hits.select("request_id", "kb", "chunk_id", F.col("score").alias("final_score"), F.row_number().over(w).alias("pos"))
        ranked = ranked.join(chunked.select("kb", "chunk_id", "source", "text"), ["kb", "chunk_id"])
        return ranked.where(F.col("pos") <= opts.topk), ranked
    each = max(opts.topk, opts.candidates)
    lens = written(index.lengths(chunked), "lengths")
    d = topk(dense(queries, vectors), each)
    s = topk(with_zeros(bm25_texts(queries, chunked, lens), queries, lens, each), each)
    fused = fuse(d, s, opts).join(queries.select("query_id", "request_id", "query_pos"), "query_id")
    cands = candidates(fuse_queries(fused), opts.candidates).join(chunked.select("kb", "chunk_id", "source", "text"), ["kb", "chunk_id"])
    if reranker is not None and opts.reranker != "off":
        cands = rerank(cands, requests, reranker, required=opts.reranker in ("local", "llm"))
    elif opts.reranker in ("local", "llm"):
        raise RetrievalError(f"reranker {opts.reranker} asked for but none given")
    ranked = threshold(final_scores(cands), opts.min_score)
    with_vectors = ranked.join(vectors.select("kb", "chunk_id", F.col("embedding").alias("vector")), ["kb", "chunk_id"])
    return mmr(with_vectors, opts.topk, opts.mmr_lambda, opts.max_per_source).drop("vector"), ranked
