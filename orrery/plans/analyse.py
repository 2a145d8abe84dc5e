"""A whole analysis over many diagrams at once: parse, infer hints, retrieve, find, cite, denoise, report. The model and its answers are data: answers are a table that can be kept and read again."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.functions import prompts
from orrery.operators import citations, findings, flows, hints, retrieve
from orrery.sources import exports, graphs
from orrery.tables import written


class AnalysisError(ValueError):
    pass


@dataclass(frozen=True)
class Knowledge:
    """What is retrieved from: chunks(kb, chunk_id, source, text) and vectors(kb, chunk_id, embedding); embed adds `embedding` to a table with `text`. local: a reranker besides the model's."""

    chunks: DataFrame
    vectors: DataFrame
    embed: Callable[[DataFrame], DataFrame]
    options: retrieve.Options = retrieve.Options()
    local: Callable | None = None


@dataclass(frozen=True)
class Result:
    """findings(request_id, ...), reports by format, errors(graph_id, error) of files and answers, the graph that was analysed."""

    findings: DataFrame
    reports: dict[str, DataFrame]
    errors: DataFrame
    graph: graphs.Graph


def skeleton(graph: graphs.Graph) -> DataFrame:
    """(graph_id, json): ids and labels of nodes, ends and labels of edges."""
    n = graph.nodes.groupBy("graph_id").agg(exports.in_order("node_pos", "id", "label").alias("nodes"))
    e = graph.edges.groupBy("graph_id").agg(exports.in_order("edge_pos", F.col("src").alias("from"), F.col("dst").alias("to"), "label").alias("edges"))
    return n.join(e, "graph_id", "left").select("graph_id", F.to_json(F.struct("nodes", "edges")).alias("json"))


def infer(graph: graphs.Graph, model: Callable[[str, str], str], lang: str = "en", limit: int = prompts.TOKEN_LIMITS["hosted"]) -> DataFrame:
    """(request_id, answer, error): a model's hints for each graph, asked once and kept as a table."""
    asked = skeleton(graph).select(F.col("graph_id").alias("request_id"), prompts.hints_prompt(F.col("json"), lang).alias("prompt"))
    return written(prompts.answers(asked, model, prompts.HINTS_SYSTEM, limit), "hints")


def passages(graph: graphs.Graph, kb: Knowledge, model: Callable[[str, str], str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(context: request_id, context_text; candidates: request_id, kb, chunk_id, source, text, final_score, pos), retrieved by the queries of each graph."""
    queries = flows.graph_queries(graph.nodes, graph.edges).select(F.col("graph_id").alias("request_id"), "query_pos", F.concat_ws("#", "graph_id", "query_pos").alias("query_id"), F.col("query").alias("text"))
    queries = written(kb.embed(queries), "queries")
    _, fn = retrieve.choose_reranker(kb.options.reranker if kb.options.strategy == "hybrid" else "off", kb.local, prompts.model_reranker(model) if model else None)
    requests = queries.where("query_pos = 0").select("request_id", F.col("text").alias("query"))
    options = kb.options if fn is not None else retrieve.Options(**{**vars(kb.options), "reranker": "off"})
    best, cands = retrieve.retrieve(requests, queries, kb.chunks, kb.vectors, options, fn)
    best, cands = written(best, "passages"), written(cands, "candidates")
    place = "mmr_rank" if "mmr_rank" in best.columns else "pos"
    blocks = best.select("request_id", F.col(place).alias("pos"), retrieve.context_block(F.col("kb"), F.col("chunk_id"), F.col("final_score"), F.col("source"), F.col("text")).alias("block"))
    return retrieve.context_text(blocks), cands


def ask(
    graph: graphs.Graph, model: Callable[[str, str], str], context: DataFrame | None = None, lang: str = "en", limit: int = prompts.TOKEN_LIMITS["hosted"], documents: str | None = None, candidates: DataFrame | None = None
) -> DataFrame:
    """(request_id, answer, error) for each graph; context(request_id, context_text) are retrieved passages, candidates(request_id, chunk_id, kb, source, pos) what may be cited, documents a text for all graphs."""
    own = exports.prompt_json(graph.nodes, graph.edges, graph.zones).select(F.col("graph_id").alias("request_id"), "json")
    own = own.join(context, "request_id", "left") if context is not None else own.withColumn("context_text", F.lit(None).cast("string"))
    listed = None
    if candidates is not None:
        first = candidates.where(F.col("pos") <= prompts.MOST_CANDIDATES)
        own = own.join(first.groupBy("request_id").agg(exports.in_order("pos", "chunk_id", "kb", "source").alias("listed")), "request_id", "left")
        listed = F.col("listed")
    return prompts.answers(own.select("request_id", prompts.findings_prompt(F.col("json"), F.col("context_text"), F.lit(documents).cast("string"), lang, listed).alias("prompt")), model, limit=limit)


def conclude(answers: DataFrame, candidates: DataFrame | None = None, min_confidence: float = 0.5, require_asvs: bool = False, topn: int | None = 10, min_score: float = 0.0, reranker: Callable | None = None) -> DataFrame:
    """Answers -> findings: projected, cited where there are candidates (findings without a citation go then), denoised and numbered."""
    found = findings.from_answers(answers.where("answer is not null"))
    if candidates is not None:
        found, _ = citations.attach(found, candidates, min_score, reranker=reranker)
    return findings.denoise(found, min_confidence, require_asvs, topn)


def report(found: DataFrame, graph: graphs.Graph, formats: list[str] | None = None, models: DataFrame | None = None) -> dict[str, DataFrame]:
    """One table (graph_id, text) a format. models(graph_id, text) are the Threat Dragon files, to which alone that format applies."""
    own = found.withColumnRenamed("request_id", "graph_id")
    tree = exports.graph_json(graph.nodes, graph.edges, graph.zones)
    made = {
        "json": lambda: exports.report_json(own, graph.metrics, tree),
        "markdown": lambda: exports.report_markdown(own),
        "html": lambda: exports.report_html(own, graph.nodes, graph.edges, tree),
        "threat-dragon": lambda: exports.threat_dragon(models, own, graph.nodes, graph.edges),
    }
    asked = prompts.report_formats(formats)
    if "threat-dragon" in asked and models is None:
        raise AnalysisError("reports as Threat Dragon models need Threat Dragon inputs")
    return {f: made[f]() for f in asked}


def tabled(graph: graphs.Graph) -> graphs.Graph:
    """A graph whose tables are written: they are read many times, and plans on top of a parser's would grow without end."""
    return graphs.Graph(*[written(getattr(graph, n), n) for n in ("nodes", "edges", "zones", "metrics", "errors")])


def together(parts: list[graphs.Graph]) -> graphs.Graph:
    """Graphs of several formats as one; their ids must differ."""
    both = lambda name: reduce(lambda a, b: a.unionByName(b), [getattr(g, name) for g in parts])
    return graphs.Graph(*[both(n) for n in ("nodes", "edges", "zones", "metrics", "errors")])


def analyse(
    inputs: dict[str, DataFrame], model: Callable[[str, str], str], *, infer_hints: bool = False, kb: Knowledge | None = None, documents: str | None = None, lang: str = "en", min_confidence: float = 0.5,
    require_asvs: bool = False, topn: int | None = 10, formats: list[str] | None = None, limit: int = prompts.TOKEN_LIMITS["hosted"], allowed: tuple[str, ...] = ("mermaid", "drawio", "threat-dragon", "ir", "image"),
) -> Result:
    """Inputs by format (texts(graph_id, text), for images what a model read in them) -> findings and reports of all. Each model call is one row of a written table; a graph whose call fails has an error and no findings,
    the others go on. A report as a Threat Dragon model is made for inputs of that format, and asked for without any is an error."""
    if unknown := sorted(set(inputs) - set(allowed)):
        raise AnalysisError(f"input formats not allowed: {', '.join(unknown)}")
    if not inputs:
        raise AnalysisError("no inputs")
    graph, told = together([tabled(graphs.load(f, t)) for f, t in inputs.items()]), []
    if infer_hints:
        hinted = infer(graph, model, lang, limit)
        graph = tabled(hints.merge(graph, hinted))
        told.append(hinted)
    context, cands, reranker = None, None, None
    if kb is not None:
        context, cands = passages(graph, kb, model)
        reranker = retrieve.choose_reranker(kb.options.reranker, kb.local, prompts.model_reranker(model))[1]
    answers = written(ask(graph, model, context, lang, limit, documents, cands), "answers")
    told.append(answers)
    found = written(conclude(answers, cands, min_confidence, require_asvs, topn, kb.options.min_score if kb else 0.0, reranker), "findings")
    failed = [t.where("error is not null").select(F.col("request_id").alias("graph_id"), "error") for t in told]
    errors = reduce(lambda a, b: a.unionByName(b), [graph.errors.select("graph_id", "error"), *failed])
    return Result(found, report(found, graph, formats, inputs.get("threat-dragon")), errors, graph)
