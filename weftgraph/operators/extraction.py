"""A knowledge graph from what was extracted from chunks: entities and relations of each chunk become typed nodes and edges, canonical by an ontology.

Extraction itself is a function that the caller passes in; a chunk's extraction is a struct of nodes (id, name, type, description) and edges (source, target, relation)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import node_id, relation_name
from .matching import closest

EXTRACTION = "struct<nodes:array<struct<id:string,name:string,type:string,description:string>>,edges:array<struct<source:string,target:string,relation:string>>>"


def extracted(chunks: DataFrame, extract: Callable[[Column], Column], rounds: int = 1, text: str = "text") -> DataFrame:
    """chunks with a column extraction: extract(text), in further rounds with what was found put together, of which edges without both ends in the same chunk are left out."""
    found = extract(F.col(text))
    for _ in range(rounds - 1):
        again = extract(F.col(text))
        found = F.struct(F.array_union(found["nodes"], again["nodes"]).alias("nodes"), F.array_union(found["edges"], again["edges"]).alias("edges"))
    return checked(chunks.withColumn("extraction", found.cast(EXTRACTION)))


def checked(chunks: DataFrame) -> DataFrame:
    """chunks whose extraction keeps only edges between nodes of the chunk."""
    ids = F.transform("extraction.nodes", lambda n: n["id"])
    inside = F.filter("extraction.edges", lambda e: F.array_contains(ids, e["source"]) & F.array_contains(ids, e["target"]))
    return chunks.withColumn("extraction", F.col("extraction").withField("edges", inside))


def proper_names(text: Column) -> Column:
    """A stand-in for a model: proper nouns as nodes, and an edge between each and the next one in the same text."""
    names = F.array_distinct(F.regexp_extract_all(text, F.lit(r"[A-Z][a-z]+(?: [A-Z][a-z]+)*"), F.lit(0)))
    nodes = F.transform(names, lambda n: F.struct(relation_name(n).alias("id"), n.alias("name"), F.lit("Name").alias("type"), F.lit("").alias("description")))
    pairs = F.when(F.size(names) > 1, F.zip_with(F.slice(names, 1, F.size(names) - 1), F.slice(names, 2, F.size(names) - 1), lambda a, b: F.struct(relation_name(a).alias("source"), relation_name(b).alias("target"), F.lit("followed_by").alias("relation"))))
    return F.struct(nodes.alias("nodes"), F.coalesce(pairs, F.array().cast("array<struct<source:string,target:string,relation:string>>")).alias("edges"))


def expanded(chunks: DataFrame, vocabulary: dict[str, list[str]] | None = None, chunk_col: str = "chunk_id") -> tuple[DataFrame, DataFrame]:
    """Nodes (id, type, name, description) and edges (src, rel, dst), each once: entities (type Entity) and their types (EntityType), edges is_a from entity to type, contains from chunk to entity,
    and the extracted relations. vocabulary: by classes and individuals, the names that an ontology knows; what is close to one takes its name. An entity keeps the least of its descriptions."""
    each = chunks.select(F.col(chunk_col).cast("string").alias("chunk"), F.explode("extraction.nodes").alias("n")).select("chunk", F.col("n.id").alias("local"), "n.name", "n.type", "n.description")
    for column, kind in (("type", "classes"), ("name", "individuals")):
        if vocabulary and vocabulary.get(kind):
            each = closest(each, vocabulary[kind], column).withColumn(column, F.coalesce("match", column)).drop("match")
    each = each.withColumn("id", node_id(F.col("name"))).withColumn("type_id", node_id(F.col("type")))
    entities = each.groupBy("id").agg(F.min("name").alias("name"), F.min("description").alias("description")).select("id", F.lit("Entity").alias("type"), "name", "description")
    types = each.groupBy(F.col("type_id").alias("id")).agg(F.min("type").alias("name")).select("id", F.lit("EntityType").alias("type"), "name", F.lit("").alias("description"))
    ends = each.select("chunk", "local", "id")
    told = chunks.select(F.col(chunk_col).cast("string").alias("chunk"), F.explode("extraction.edges").alias("e")).select("chunk", F.col("e.source").alias("source"), F.col("e.target").alias("target"), relation_name(F.col("e.relation")).alias("rel"))
    for end, out in (("source", "src"), ("target", "dst")):
        told = told.join(ends.select("chunk", F.col("local").alias(end), F.col("id").alias(out)), ["chunk", end])
    edges = each.select(F.col("id").alias("src"), F.lit("is_a").alias("rel"), F.col("type_id").alias("dst")).unionByName(each.select(F.col("chunk").alias("src"), F.lit("contains").alias("rel"), F.col("id").alias("dst"))).unionByName(told.select("src", "rel", "dst"))
    return entities.unionByName(types).dropDuplicates(["id"]), edges.distinct()


def with_ontology_edges(edges: DataFrame, ontology_edges: DataFrame) -> DataFrame:
    """Edges and those of an ontology, each once."""
    return edges.unionByName(ontology_edges.select("src", "rel", "dst")).distinct()


def existing(edges: DataFrame, stored: DataFrame) -> DataFrame:
    """Those of the edges that are stored, by one key (src, rel, dst)."""
    return edges.join(stored, ["src", "rel", "dst"], "left_semi")


def event_entities(events: DataFrame, attributes: str = "attributes", id_col: str = "id") -> tuple[DataFrame, DataFrame]:
    """Entities and edges of events' attributes (a map from relation to name): nodes (id, name), edges (src, rel, dst); null and empty names are left out."""
    each = events.select(F.col(id_col).cast("string").alias("src"), F.explode(attributes).alias("rel", "name")).where(F.trim("name") != "")
    rows = each.withColumn("dst", node_id(F.trim("name")))
    return rows.groupBy(F.col("dst").alias("id")).agg(F.min(F.trim("name")).alias("name")), rows.select("src", relation_name(F.col("rel")).alias("rel"), "dst").distinct()
