"""Shared parts of the graph sources: whole files as rows, format detection, tables of a graph, import metrics."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

IMAGES = r"\.(png|jpg|jpeg|gif|bmp|webp)$"
SUFFIXES = {"mermaid": ".mmd", "drawio": ".drawio", "threat-dragon": ".json", "ir": ".json"}
TEXTS = "cast(array() as array<string>)"


@dataclass(frozen=True)
class Graph:
    """nodes(graph_id, node_pos, id, label, zone, zones, type, data, auth, notes), edges(graph_id, edge_pos, src, dst, label, protocol, data, id), zones(graph_id, zone_pos, id, name, parent_id),
    metrics(graph_id, total_lines, edge_candidates, edges_parsed, node_label_candidates, node_labels_parsed, import_success_rate), errors(graph_id, error)."""

    nodes: DataFrame
    edges: DataFrame
    zones: DataFrame
    metrics: DataFrame
    errors: DataFrame


class LazyGraph(Graph):
    """A Graph whose tables are planned when they are first asked for, by functions of the same names: a query that reads the edges alone doesn't pay for the nodes."""

    def __init__(self, **makers: Callable[[], DataFrame]):
        object.__setattr__(self, "_makers", makers)

    def __getattribute__(self, name: str):
        makers = object.__getattribute__(self, "__dict__").get("_makers", {})
        if name in makers and name not in object.__getattribute__(self, "__dict__"):
            object.__setattr__(self, name, makers[name]())
        return object.__getattribute__(self, name)


def files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(graph_id, text): each file under path as a row; its path is the id."""
    return spark.read.option("wholetext", True).option("pathGlobFilter", glob).option("recursiveFileLookup", True).text(path).select(F.input_file_name().alias("graph_id"), F.col("value").alias("text"))


def lines(text: Column) -> Column:
    """A text's lines; what follows the last line end is a line only if it isn't empty."""
    cut = F.split(text, r"\r\n|\r|\n", -1)
    return F.when(F.element_at(cut, -1) == "", F.slice(cut, 1, F.size(cut) - 1)).otherwise(cut)


def looks_like_threat_dragon(text: Column) -> Column:
    """A model of version 2 (or none) whose first diagram has cells."""
    v = F.try_parse_json(text)
    version = F.coalesce(F.try_variant_get(v, "$.version", "string"), F.lit(""))
    cells = F.coalesce(F.to_json(F.try_variant_get(v, "$.detail.diagrams[0].cells", "variant")), F.lit("null"))
    return F.coalesce(v.isNotNull() & ((version == "") | F.startswith(version, F.lit("2."))) & ~cells.isin("null", "[]", "{}", '""', "0", "false"), F.lit(False))


def input_format(name: Column, text: Column) -> Column:
    """By suffix; JSON only where its content looks like a model; null for anything else."""
    n = F.lower(name)
    return (
        F.when(F.rlike(n, F.lit(r"\.(mmd|mermaid)$")), "mermaid")
        .when(F.rlike(n, F.lit(r"\.(drawio|xml)$")), "drawio")
        .when(F.rlike(n, F.lit(r"\.json$")) & looks_like_threat_dragon(text), "threat-dragon")
        .when(F.rlike(n, F.lit(IMAGES)), "image")
    )


def upload_format(name: Column) -> Column:
    """The service's variant: JSON is never looked into, and images are of four kinds (Q20)."""
    n = F.lower(name)
    return F.when(F.rlike(n, F.lit(r"\.(mmd|mermaid)$")), "mermaid").when(F.rlike(n, F.lit(r"\.(drawio|xml)$")), "drawio").when(F.endswith(n, F.lit(".json")), "threat-dragon").when(F.rlike(n, F.lit(r"\.(png|jpg|jpeg|webp)$")), "image")


def suffix(fmt: Column) -> Column:
    """F31."""
    out = F.lit(".txt")
    for k, v in SUFFIXES.items():
        out = F.when(fmt == k, F.lit(v)).otherwise(out)
    return out


def success_rate(edges_parsed: Column, labels_parsed: Column, edge_candidates: Column, label_candidates: Column) -> Column:
    """A8, F7."""
    return F.bround((edges_parsed + labels_parsed) / F.greatest(F.lit(1), edge_candidates + label_candidates), 3)


def metrics(graphs: DataFrame, counts: dict[str, DataFrame]) -> DataFrame:
    """graphs(graph_id, total_lines) with each of the counts' tables (graph_id, n) as a column, 0 where it has none."""
    out = graphs
    for name, df in counts.items():
        out = out.join(df.groupBy("graph_id").agg(F.sum("n").alias(name)), "graph_id", "left").withColumn(name, F.coalesce(name, F.lit(0)).cast("long"))
    return rated(out)


def rated(out: DataFrame) -> DataFrame:
    return out.withColumn("import_success_rate", success_rate(F.col("edges_parsed"), F.col("node_labels_parsed"), F.col("edge_candidates"), F.col("node_label_candidates")))


def ones(df: DataFrame) -> DataFrame:
    return df.select("graph_id", F.lit(1).alias("n"))


_LOADERS: dict[str, Callable[..., Graph]] = {}


def register(fmt: str):
    def add(fn):
        _LOADERS[fmt] = fn
        return fn

    return add


def load(fmt: str, texts: DataFrame, **options) -> Graph:
    """S3: texts(graph_id, text) of one format -> a graph's tables."""
    from orrery.sources import drawio, image, ir, mermaid, threat_dragon  # noqa: F401  they register themselves

    if fmt not in _LOADERS:
        raise ValueError(f"unknown input format {fmt!r}: one of {sorted(_LOADERS)}")
    return _LOADERS[fmt](texts, **options)
