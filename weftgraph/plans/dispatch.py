"""Search by kind: a registry of functions from a query and tables to ranked context."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import graph, lexical, search

_KINDS: dict[str, Callable[..., DataFrame]] = {}


def use_search(kind: str, function: Callable[..., DataFrame]) -> None:
    """Registers a kind of search: a function that returns id, text and score."""
    _KINDS[kind] = function


def kinds() -> list[str]:
    return sorted(_KINDS)


def run(kind: str, **arguments) -> DataFrame:
    """Runs a kind of search; an unknown one is an error."""
    if kind not in _KINDS:
        raise ValueError(f"no such search: {kind}; there are {', '.join(kinds())}")
    return _KINDS[kind](**arguments)


def context(found: DataFrame) -> DataFrame:
    """One row: the texts of what was found in order of score, joined by line breaks; empty if there is none."""
    return found.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "id", "text"))), lambda x: x["text"]), "\n").alias("context"))


def _chunks(vectors: DataFrame, texts: DataFrame, vector: list[float], k: int = 10) -> DataFrame:
    return search.nearest(vectors, vector, k).join(texts, "id").select("id", "text", (-F.col("distance")).alias("score"))


def _lexical(texts: DataFrame, query: str, k: int = 10) -> DataFrame:
    return lexical.search(texts, query, k).select("id", "text", "score")


def _triplets(vectors: DataFrame, nodes: DataFrame, edges: DataFrame, vector: list[float], k: int = 5, wide: int = 100) -> DataFrame:
    hits = search.nearest(vectors, vector, wide, normalised=True).select("id", "distance")
    around = graph.touching(edges, F.broadcast(hits.select("id")))
    none = hits.where(F.lit(False)).select(F.col("id").cast("string").alias("id"), "distance")
    best = graph.top_triplets(around, hits, none, k)
    named = graph.triplets(nodes, best).select("src", "rel", "dst", "text")
    return best.join(named, ["src", "rel", "dst"]).select(F.concat_ws("|", "src", "rel", "dst").alias("id"), "text", (-F.col("score")).alias("score"))


for _kind, _function in (("CHUNKS", _chunks), ("SUMMARIES", _chunks), ("RAG_COMPLETION", _chunks), ("CHUNKS_LEXICAL", _lexical), ("GRAPH_COMPLETION", _triplets), ("INSIGHTS", _triplets)):
    use_search(_kind, _function)
