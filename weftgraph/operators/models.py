"""Nested records as graph elements and back, edge properties, vector collections, and a ledger of changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def flattened(rows: DataFrame, node_type: str, key: str, types: dict[str, tuple[str, str]] | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, type, properties as JSON) and edges (src, dst, rel) of nested rows. types: for each nested field (a struct or an array of structs) its node type
    and key; the field's name is the relation. Equal nodes count once."""
    types = types or {}
    plain = [f.name for f in rows.schema.fields if f.name not in types]
    own = F.concat(F.lit(f"{node_type}:"), F.col(key).cast("string"))
    nodes = rows.select(own.alias("id"), F.lit(node_type).alias("type"), F.to_json(F.struct(*plain)).alias("properties"))
    edges = None
    for name, (inner_type, inner_key) in types.items():
        items = F.col(name) if isinstance(rows.schema[name].dataType, T.ArrayType) else F.array(name)
        each = rows.select(own.alias("src"), F.explode(items).alias("x")).where("x is not null")
        inner = F.concat(F.lit(f"{inner_type}:"), F.col(f"x.{inner_key}").cast("string"))
        nodes = nodes.unionByName(each.select(inner.alias("id"), F.lit(inner_type).alias("type"), F.to_json("x").alias("properties")))
        new = each.select("src", inner.alias("dst"), F.lit(name).alias("rel"))
        edges = new if edges is None else edges.unionByName(new)
    if edges is None:
        edges = nodes.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit("").alias("rel")).where(F.lit(False))
    return nodes.dropDuplicates(["id"]), edges.distinct()


def nested(nodes: DataFrame, edges: DataFrame, rel: str, name: str = "items") -> DataFrame:
    """Nodes with the ids that an outgoing relation leads to, as a sorted array; all of them stay."""
    targets = edges.where(F.col("rel") == rel).groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_set("dst")).alias(name))
    return nodes.join(targets, "id", "left").withColumn(name, F.coalesce(name, F.array().cast("array<string>")))


def edge_properties(source: Column, target: Column, relation: Column, weight: Column, weights: Column) -> Column:
    """A map of an edge's properties as strings, its named weights as weight_..."""
    base = F.create_map(F.lit("source_node_id"), source, F.lit("target_node_id"), target, F.lit("relationship_name"), relation)
    named = F.transform_values(F.transform_keys(weights, lambda k, v: F.concat(F.lit("weight_"), k)), lambda k, v: v.cast("string"))
    out = F.map_concat(base, F.coalesce(named, F.create_map().cast("map<string,string>")))
    return F.when(weight.isNotNull(), F.map_concat(out, F.create_map(F.lit("weight"), weight.cast("string")))).otherwise(out)


def roots(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that no edge leads to."""
    return nodes.join(edges.select(F.col("dst").alias("id")), "id", "left_anti")


def collected(rows: DataFrame, node_type: str, key: str, index_fields: list[str]) -> DataFrame:
    """Index rows of a type's fields: collection (type_field), id, text; null and empty ones are left out."""
    wide = rows.select(F.col(key).cast("string").alias("id"), *[F.trim(F.col(f).cast("string")).alias(f"{node_type}_{f}") for f in index_fields])
    return wide.unpivot("id", [f"{node_type}_{f}" for f in index_fields], "collection", "text").where("text <> ''")


def new_chunks(chunks: DataFrame, index: DataFrame) -> DataFrame:
    """Chunks (id, text) that an index (id, text) lacks or holds with another text."""
    known = index.select("id", F.md5("text").alias("__hash"))
    return chunks.join(known, "id", "left").where(F.col("__hash").isNull() | (F.col("__hash") != F.md5("text"))).drop("__hash")


def ledger(edges: DataFrame, creator: str, user: str) -> DataFrame:
    """A ledger row for each written edge."""
    return edges.select(F.col("src").alias("source_node_id"), F.col("dst").alias("destination_node_id"), F.lit(creator).alias("creator_function"), F.lit(user).alias("user_id"), F.current_timestamp().alias("created_at"), F.lit(None).cast("timestamp").alias("deleted_at"))


def revoked(rows: DataFrame, removed: DataFrame) -> DataFrame:
    """A ledger with the time of deletion set for removed edges (source_node_id, destination_node_id)."""
    gone = removed.select("source_node_id", "destination_node_id").distinct().withColumn("__gone", F.lit(True))
    out = rows.join(gone, ["source_node_id", "destination_node_id"], "left")
    return out.withColumn("deleted_at", F.when(F.col("__gone") & F.col("deleted_at").isNull(), F.current_timestamp()).otherwise(F.col("deleted_at"))).drop("__gone")


def own_properties(rows: DataFrame) -> DataFrame:
    """rows without their nested fields (structs, and arrays or maps of them)."""

    def is_nested(kind: T.DataType) -> bool:
        if isinstance(kind, T.ArrayType):
            return is_nested(kind.elementType)
        return isinstance(kind, T.StructType) or isinstance(kind, T.MapType) and is_nested(kind.valueType)

    return rows.select(*[F.col(f"`{f.name}`") for f in rows.schema.fields if not is_nested(f.dataType)])


def copied_schema(schema: T.StructType, include: dict[str, str] | None = None, exclude: tuple[str, ...] = ()) -> T.StructType:
    """A schema with some fields more (name to type) and some less."""
    kept = [f for f in schema.fields if f.name not in exclude and f.name not in (include or {})]
    return T.StructType([*kept, *(T.StructField(k, T._parse_datatype_string(v)) for k, v in (include or {}).items())])


def serialised(rows: DataFrame, key: str) -> DataFrame:
    """Each row as JSON: key, json. Times in ISO form, decimals as numbers, bytes as base 64; nulls are left out."""
    return rows.select(key, F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns]), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss"}).alias("json"))
