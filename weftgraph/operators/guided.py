"""Answers from an ontology-guided context: the intent of a question sets how near and how far the context reaches, and what isn't good enough is left out."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import graph, rag, search

#: Least similarity and steps over relations, by intent.
INTENTS = {"factual": (0.8, 1), "exploratory": (0.6, 3), "analytical": (0.7, 3), "comparative": (0.7, 2), "procedural": (0.75, 2)}
RELEVANCE, VALIDITY = 0.7, 0.9
REFUSAL = "There is not enough reliable context to answer this."


@dataclass(frozen=True)
class Context:
    """entities: id, type, name, content, relevance, validity, hop."""

    entities: DataFrame
    intent: str

    def good(self, relevance: float = RELEVANCE, validity: float = VALIDITY) -> DataFrame:
        return self.entities.where((F.col("relevance") >= relevance) & (F.col("validity") >= validity))

    def averages(self) -> DataFrame:
        """One row: n, mean relevance and validity (0 without entities)."""
        return self.entities.agg(F.count("*").alias("n"), F.coalesce(F.avg("relevance"), F.lit(0.0)).alias("relevance"), F.coalesce(F.avg("validity"), F.lit(0.0)).alias("validity"))


def retrieved(vectors: DataFrame, entities: DataFrame, edges: DataFrame, vector: list[float], intent: str = "factual", types: list[str] | None = None, most: int = 20, decay: float = 0.8) -> Context:
    """The nearest entities by the intent's threshold, and what is within its steps of them, whose relevance is that of the nearest start times decay for each step.
    entities: id, type, name, content, validity."""
    least, depth = INTENTS[intent]
    hits = graph.cut(search.most_similar(vectors, vector, most, least, types).select("id", F.col("similarity").alias("relevance"), F.lit(0).alias("hop")))
    step = graph.both_ways(edges).select("id", "other").distinct()
    seen = frontier = hits
    for hop in range(1, depth + 1):
        near = step.join(frontier.select("id", "relevance"), "id").groupBy(F.col("other").alias("id")).agg((F.max("relevance") * decay).alias("relevance"))
        frontier = graph.cut(near.join(seen, "id", "left_anti").withColumn("hop", F.lit(hop)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    found = entities.join(seen, "id")
    if types is not None:
        found = found.where(F.col("type").isin(types))
    return Context(found.orderBy(F.desc("relevance"), "id").limit(most), intent)


def simple_answer(context: DataFrame) -> DataFrame:
    """One row, answer: the first three of 'name: content' by relevance."""
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("relevance")).alias("r"), "id", F.concat_ws(": ", "name", "content").alias("t")))), 1, 3)
    return context.agg(F.array_join(F.transform(best, lambda x: x["t"]), " ").alias("answer"))


def answered(context: Context, answer: Callable[[DataFrame], DataFrame] = simple_answer) -> DataFrame:
    """One row: answer, confidence, risk, n_sources, warnings. Only good context is used; without any the answer is a refusal. answer: from entities to one row with the answer, such as a model."""
    good = context.good()
    text = answer(good).select("answer")
    claimed = rag.claims(text.select(F.lit(0).alias("id"), F.col("answer").alias("text")))
    links = rag.provenance(claimed, good.select(F.col("id").alias("entity_id"), "name", "content"))
    grounded = rag.grounded(claimed, links)
    told = grounded.agg(F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("c"), F.count_if(~F.col("is_grounded")).alias("u"), F.count("*").alias("n"))
    size = good.agg(F.count("*").alias("n_sources"), F.coalesce(F.avg("validity"), F.lit(0.0)).alias("v"))
    row = text.join(told, F.lit(True)).join(size, F.lit(True))
    none = F.col("n_sources") == 0
    warnings = F.array_compact(F.array(F.when(none, "no reliable context"), F.when(~none & (F.col("u") > 0), "statements without support"), F.when(~none & (F.col("n_sources") < 3), "few sources")))
    return row.select(
        F.when(none, REFUSAL).otherwise(F.col("answer")).alias("answer"),
        F.when(none, 0.0).otherwise((F.col("c") + F.col("v")) / 2).alias("confidence"),
        F.when(none, 1.0).otherwise(rag.risk(F.col("u"), F.lit(0), F.col("n"))).alias("risk"),
        "n_sources",
        warnings.alias("warnings"),
    )


def explained(answers: DataFrame) -> DataFrame:
    """answers with an explanation as JSON, and whether they can be trusted."""
    trust = rag.trustworthy(F.col("confidence"), F.col("risk"), F.size("warnings"))
    return answers.withColumn("is_trustworthy", trust).withColumn("explanation", F.to_json(F.struct("confidence", "risk", "n_sources", "warnings")))
