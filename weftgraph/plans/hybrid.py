"""Hybrid queries: a frozen description that becomes one DataFrame, from vector candidates over the graph around them to ranked results."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import graph, search


@dataclass(frozen=True)
class HybridQuery:
    vector: tuple[float, ...] | None = None
    start: str | None = None
    types: tuple[str, ...] | None = None
    excluded_types: tuple[str, ...] = ()
    relations: tuple[str, ...] | None = None
    top_k: int = 50
    max_results: int = 10
    depth: int = 2
    threshold: float | None = None
    vector_weight: float = 0.7
    graph_weight: float = 0.3
    valid_only: bool = False

    def __post_init__(self):
        if self.vector is None and self.start is None:
            raise ValueError("a vector or a start is needed")
        if abs(self.vector_weight + self.graph_weight - 1) > 0.01:
            raise ValueError("weights must sum to 1")
        if not 0 < self.top_k <= 1000 or not 0 < self.max_results <= 500:
            raise ValueError("top_k is up to 1000 and max_results up to 500")


class HybridQueryBuilder:
    """Builds a HybridQuery step by step."""

    def __init__(self):
        self._fields: dict = {}

    def _with(self, **fields) -> HybridQueryBuilder:
        self._fields |= fields
        return self

    def with_vector(self, vector) -> HybridQueryBuilder:
        return self._with(vector=tuple(vector))

    def with_types(self, *types: str) -> HybridQueryBuilder:
        return self._with(types=types)

    def without_types(self, *types: str) -> HybridQueryBuilder:
        return self._with(excluded_types=types)

    def with_relations(self, *relations: str) -> HybridQueryBuilder:
        return self._with(relations=relations)

    def with_top_k(self, k: int) -> HybridQueryBuilder:
        return self._with(top_k=k)

    def with_max_results(self, n: int) -> HybridQueryBuilder:
        return self._with(max_results=n)

    def with_depth(self, depth: int) -> HybridQueryBuilder:
        return self._with(depth=depth)

    def with_threshold(self, threshold: float) -> HybridQueryBuilder:
        return self._with(threshold=threshold)

    def with_weights(self, vector: float, graph: float) -> HybridQueryBuilder:
        return self._with(vector_weight=vector, graph_weight=graph)

    def with_valid_only(self) -> HybridQueryBuilder:
        return self._with(valid_only=True)

    def vector_only(self) -> HybridQueryBuilder:
        return self._with(vector_weight=1.0, graph_weight=0.0, start=None)

    def graph_only(self, start: str) -> HybridQueryBuilder:
        return self._with(vector_weight=0.0, graph_weight=1.0, start=start, vector=None)

    def build(self) -> HybridQuery:
        return HybridQuery(**self._fields)


def run(query: HybridQuery, vectors: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, similarity, centrality, score, explanation of the best results. vectors: id, type, vector. If only valid entities are wanted, nodes need a column ontology_valid."""
    if query.relations is not None:
        edges = edges.where(F.col("rel").isin(list(query.relations)))
    if query.vector is not None:
        if query.valid_only:
            vectors = vectors.join(nodes.where("ontology_valid").select("id"), "id", "left_semi")
        found = search.most_similar(vectors, list(query.vector), query.top_k, query.threshold, list(query.types) if query.types is not None else None).select("id", "type", "similarity")
    else:
        start = nodes.where(F.col("id") == query.start).select("id")
        found = graph.reached(edges, start, query.depth).join(nodes.select("id", "type"), "id").select("id", "type", F.lit(0.0).alias("similarity"))
    if query.valid_only:
        found = found.join(nodes.where("ontology_valid").select("id"), "id", "left_semi")
    if query.excluded_types:
        found = found.where(~F.col("type").isin(list(query.excluded_types)))
    seeds = found.orderBy(F.desc("similarity"), "id").limit(10).select("id")
    around = edges if query.graph_weight == 0 else graph.subgraph(nodes, edges, seeds, query.depth)[1]
    scores = search.centrality(around)
    return search.ranked(found.drop("type"), scores, query.vector_weight, query.graph_weight, query.max_results)


def with_fields(query: HybridQuery, **fields) -> HybridQuery:
    return replace(query, **fields)
