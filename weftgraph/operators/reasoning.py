"""Inference over relations: transitive chains, symmetric and inverse relations, cardinality."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import cut


def transitive(edges: DataFrame, rels: list[str], starts: DataFrame | None = None, max_depth: int = 3) -> DataFrame:
    """Edges that follow from chains of two to max_depth edges of one transitive relation and don't exist yet: src, dst, rel, depth (of the shortest chain).

    Frontiers of distinct (start, end) pairs are joined with the edges, so chains aren't enumerated path by path."""
    own = edges.where(F.col("rel").isin(rels)).select("src", "dst", "rel").distinct()
    step = own.select(F.col("src").alias("mid"), F.col("dst").alias("next"), "rel")
    first = own if starts is None else own.join(starts.select(F.col("id").alias("src")), "src", "left_semi")
    seen = frontier = cut(first.withColumn("depth", F.lit(1)))
    for depth in range(2, max_depth + 1):
        longer = frontier.select("src", F.col("dst").alias("mid"), "rel").join(step, ["mid", "rel"]).where("src <> next").select("src", F.col("next").alias("dst"), "rel").distinct()
        frontier = cut(longer.join(seen, ["src", "dst", "rel"], "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen.where("depth > 1").join(own, ["src", "dst", "rel"], "left_anti")


def symmetric(edges: DataFrame, rels: list[str]) -> DataFrame:
    """Reverse edges of symmetric relations that don't exist yet: src, dst, rel."""
    own = edges.where(F.col("rel").isin(rels)).select("src", "dst", "rel").distinct()
    return own.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "rel").join(own, ["src", "dst", "rel"], "left_anti")


def inverse(edges: DataFrame, pairs: dict[str, str]) -> DataFrame:
    """Edges that inverse relations imply and that don't exist yet: src, dst, rel."""
    both = pairs | {b: a for a, b in pairs.items()}
    named = F.create_map(*[F.lit(x) for kv in both.items() for x in kv])
    implied = edges.where(F.col("rel").isin(list(both))).select(F.col("dst").alias("src"), F.col("src").alias("dst"), named[F.col("rel")].alias("rel")).distinct()
    return implied.join(edges, ["src", "dst", "rel"], "left_anti")


def cardinality_violations(nodes: DataFrame, edges: DataFrame, rules: list[tuple[str, str, int, int | None]]) -> DataFrame:
    """rules: (type, relation, least, most or None). Nodes whose number of outgoing edges breaks a rule: id, rel, n, least, most."""
    table = nodes.sparkSession.createDataFrame(rules, "type string, rel string, least int, most int")
    counts = edges.groupBy(F.col("src").alias("id"), "rel").agg(F.count("*").alias("n"))
    checked = nodes.select("id", "type").join(F.broadcast(table), "type").join(counts, ["id", "rel"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return checked.where((F.col("n") < F.col("least")) | (F.col("n") > F.col("most"))).select("id", "rel", "n", "least", "most")


def reasoned(vectors: DataFrame, edges: DataFrame, entity, transitive_rels: list[str], symmetric_rels: list[str], target_types: list[str], mode: str = "hybrid", max_depth: int = 3, k: int = 5) -> DataFrame:
    """What can be inferred about an entity, by its relations, by near vectors, or both: kind, src, rel, dst, confidence. vectors: id, type, vector."""
    from . import search

    parts = []
    if mode in ("graph_only", "hybrid", "sequential"):
        start = edges.sparkSession.createDataFrame([(entity,)], edges.select(F.col("src").alias("id")).schema)
        chains = transitive(edges, transitive_rels, start, max_depth).select(F.lit("transitive").alias("kind"), "src", "rel", "dst", F.lit(1.0).alias("confidence"))
        reverse = symmetric(edges.where((F.col("src") == entity) | (F.col("dst") == entity)), symmetric_rels)
        parts += [chains, reverse.select(F.lit("symmetric").alias("kind"), "src", "rel", "dst", F.lit(1.0).alias("confidence"))]
    if mode in ("vector_only", "hybrid", "sequential"):
        near = search.suggested_relations(vectors, entity, target_types, k)
        parts.append(near.select(F.lit("suggested").alias("kind"), F.lit(entity).alias("src"), F.lit("RELATED_TO").alias("rel"), F.col("id").alias("dst"), "confidence"))
    if not parts:
        raise ValueError(f"no such mode: {mode}")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def hops(vectors: DataFrame, edges: DataFrame, entity, n: int = 2, k: int = 5, max_frontier: int = 10_000) -> DataFrame:
    """Entities reached in n steps, each to neighbours by relation and to the k nearest vectors: id, hop (the first). Frontiers are counted and broadcast in blocks."""
    from . import search
    from .graph import both_ways

    seen = frontier = cut(vectors.where(F.col("id") == entity).select("id", F.lit(0).alias("hop")))
    for hop in range(1, n + 1):
        linked = both_ways(edges).join(frontier, "id", "left_semi").select(F.col("other").alias("id"))
        near = search.batch_nearest(vectors, vectors.join(frontier, "id", "left_semi"), k + 1, max_frontier).select("id")
        frontier = cut(linked.union(near).distinct().join(seen, "id", "left_anti").withColumn("hop", F.lit(hop)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen
