"""Retrieval over several rounds, context built from triplets, and retrieval by time.

Models that would write the next question or an answer are functions that the caller passes in."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import graph
from .graph import cut

TRIPLET = ["src", "rel", "dst"]


def rounds(retrieve: Callable[[object], DataFrame], query: object, follow_up: Callable[[DataFrame, int], object | None], most: int = 4) -> DataFrame:
    """Triplets of a query and of up to most further ones, each made from what was found so far; equal triplets once, with the first round that found them (src, rel, dst,
    round). Ends before if there is no further query."""
    found = cut(retrieve(query).select(*TRIPLET).distinct().withColumn("round", F.lit(0)))
    for k in range(1, most + 1):
        query = follow_up(found, k)
        if query is None:
            break
        new = retrieve(query).select(*TRIPLET).distinct().join(found, TRIPLET, "left_anti")
        found = cut(found.unionByName(new.withColumn("round", F.lit(k))))
    return found


def extended(retrieve: Callable[[object], DataFrame], query: object, follow_up: Callable[[DataFrame, int], object], most: int = 4) -> DataFrame:
    """Like rounds(), until a round finds nothing new."""
    size = -1

    def grown(found: DataFrame, k: int) -> object | None:
        nonlocal size
        n = found.count()
        size, before = n, size
        return None if n == before else follow_up(found, k)

    return rounds(retrieve, query, grown, most)


def around_ends(edges: DataFrame) -> tuple[Callable[[DataFrame], DataFrame], Callable[[DataFrame, int], DataFrame]]:
    """A retriever of the edges at given ids, and the follow-up that asks for the ends of what the last round found."""

    def ends(found: DataFrame, k: int) -> DataFrame:
        return found.where(F.col("round") == k - 1).select(F.explode(F.array("src", "dst")).alias("id")).distinct()

    return lambda ids: graph.touching(edges, ids), ends


def as_text(nodes: DataFrame, triplets: DataFrame, name: str = "name", content: str = "text", empty: str = "") -> DataFrame:
    """One row, text: the nodes' names and contents, then the connections by name, for a model's prompt."""
    ids = triplets.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    own = nodes.join(ids, "id", "left_semi").select("id", F.coalesce(F.col(name), F.col("id")).alias("n"), F.coalesce(F.col(content), F.lit("")).alias("t"))
    parts = own.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", F.concat(F.lit("Node: "), "n", F.when(F.col("t") != "", F.concat(F.lit("\n"), "t")).otherwise("")).alias("x")))), lambda v: v["x"]), "\n").alias("a"))
    named = triplets.join(own.select(F.col("id").alias("src"), F.col("n").alias("sn")), "src").join(own.select(F.col("id").alias("dst"), F.col("n").alias("dn")), "dst")
    lines = named.agg(F.array_join(F.array_sort(F.collect_set(F.concat(F.col("sn"), F.lit(" --["), F.col("rel"), F.lit("]--> "), F.col("dn")))), "\n").alias("b"))
    return parts.join(lines, F.lit(True)).select(F.when(F.col("a") == "", F.lit(empty)).otherwise(F.concat_ws("\n\n", F.concat(F.lit("Nodes:\n"), "a"), F.concat(F.lit("Connections:\n"), "b"))).alias("text"))


def context_graph(triplets: DataFrame) -> DataFrame:
    """One row for display: nodes and edges of triplets as JSON arrays, each once."""
    ids = triplets.select(F.explode(F.array("src", "dst")).alias("id")).distinct().agg(F.to_json(F.array_sort(F.collect_list(F.struct("id")))).alias("nodes"))
    edges = triplets.select(*TRIPLET).distinct().agg(F.to_json(F.array_sort(F.collect_list(F.struct(*TRIPLET)))).alias("edges"))
    return ids.join(edges, F.lit(True))


def per_entity(edges: DataFrame, node_scores: DataFrame, k: int = 5, penalty: float = graph.PENALTY) -> DataFrame:
    """For each query the k best triplets: query, src, rel, dst, score. node_scores: query, id, distance. One plan for all queries; the scores are
    stored, as they are read four times."""
    s = graph.cut(node_scores).select("query", F.col("id").alias("at"), "distance")
    hit = edges.join(s.withColumnRenamed("at", "src"), "src").select("query", *TRIPLET).unionByName(edges.join(s.withColumnRenamed("at", "dst"), "dst").select("query", *TRIPLET)).distinct()
    scored = hit
    for end in ("src", "dst"):
        scored = scored.join(s.select("query", F.col("at").alias(end), F.col("distance").alias(f"d_{end}")), ["query", end], "left")
    total = F.coalesce("d_src", F.lit(penalty)) + F.coalesce("d_dst", F.lit(penalty)) + F.lit(penalty)
    return graph.first_k(scored.select("query", *TRIPLET, total.alias("score")), ["query"], ["score", *TRIPLET], k)


def second_hop(edges: DataFrame, hits: DataFrame, first: str, second: str) -> DataFrame:
    """From hits over one relation to parts, and where such a part has another relation, over that to what it describes: id, other, via (first or second)."""
    one = edges.where(F.col("rel") == first).join(hits.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("src").alias("id"), F.col("dst").alias("mid"))
    two = edges.where(F.col("rel") == second).select(F.col("src").alias("mid"), F.col("dst").alias("other"))
    joined = one.join(two, "mid", "left")
    return joined.select("id", F.coalesce("other", "mid").alias("other"), F.when(F.col("other").isNull(), first).otherwise(second).alias("via")).distinct()


def graph_schema(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """What a query over the graph may name: kind (node or relation), label, n, and for relations the pairs of types at their ends."""
    labels = nodes.groupBy(F.col("type").alias("label")).agg(F.count("*").alias("n")).select(F.lit("node").alias("kind"), "label", F.lit("").alias("ends"), "n")
    ends = graph.with_ends(nodes, edges, "type").groupBy("rel", F.concat_ws(" -> ", "src_type", "dst_type").alias("e")).agg(F.count("*").alias("n"))
    rels = ends.groupBy(F.col("rel").alias("label")).agg(F.array_join(F.array_sort(F.collect_list("e")), ", ").alias("ends"), F.sum("n").alias("n"))
    return labels.unionByName(rels.select(F.lit("relation").alias("kind"), "label", "ends", "n"))


def top_events(events: DataFrame, scores: DataFrame, k: int = 5, since: Column | None = None, until: Column | None = None, at: str = "ts", order: str = "id") -> DataFrame:
    """The k events of a closed range of time (either side may be open) of the smallest distance; events without one come last, ties by id. scores: id, distance."""
    if since is not None:
        events = events.where(F.col(at) >= since)
    if until is not None:
        events = events.where(F.col(at) <= until)
    return events.join(scores.select("id", "distance"), "id", "left").orderBy(F.asc_nulls_last("distance"), order).limit(k)


def asked_range(text: Column) -> Column:
    """The range of time that a question names by dates (2024-01-10) or years: a struct of since and until, null where it names none."""
    dates = F.array_sort(F.regexp_extract_all(text, F.lit(r"\b([12][0-9]{3}-[01][0-9]-[0-3][0-9])\b"), F.lit(1)))
    years = F.array_sort(F.regexp_extract_all(text, F.lit(r"\b([12][0-9]{3})\b(?!-)"), F.lit(1)))
    low = F.coalesce(F.get(dates, 0), F.concat(F.get(years, 0), F.lit("-01-01")))
    high = F.coalesce(F.get(dates, F.size(dates) - 1), F.concat(F.get(years, F.size(years) - 1), F.lit("-12-31")))
    return F.when(low.isNotNull(), F.struct(F.try_to_timestamp(low).cast("date").alias("since"), F.try_to_timestamp(high).cast("date").alias("until")))


def top_entities(results: DataFrame, n: int = 10, types: list[str] | None = None) -> DataFrame:
    """The first n results by score (ties by id), of some types."""
    if types is not None:
        results = results.where(F.col("type").isin(types))
    return results.orderBy(F.desc("score"), "id").limit(n)
