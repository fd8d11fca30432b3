"""Relational tables as a property graph, and the catalog that this takes: Spark tables carry no keys."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Table:
    """A table's key, its references (column: table), and the columns that become value nodes."""

    name: str
    key: str | None
    references: dict[str, str] = field(default_factory=dict)
    values: tuple[str, ...] = ()


CATALOG = (
    Table("region", "r_regionkey", {}, ("r_name",)),
    Table("nation", "n_nationkey", {"n_regionkey": "region"}, ("n_name",)),
    Table("customer", "c_custkey", {"c_nationkey": "nation"}, ("c_mktsegment",)),
    Table("supplier", "s_suppkey", {"s_nationkey": "nation"}, ()),
    Table("part", "p_partkey", {}, ("p_brand", "p_type")),
    Table("orders", "o_orderkey", {"o_custkey": "customer"}, ("o_orderstatus", "o_orderpriority")),
)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _row_id(table: str, column: str):
    return F.concat(F.lit(f"{table}:"), F.col(column).cast("string"))


def _all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def row_nodes(spark: SparkSession, sf_dir: str, catalog: tuple[Table, ...] = CATALOG) -> DataFrame:
    """id, type, name of a node for each row; nothing is deduplicated, as keys are unique."""
    return _all([read(spark, sf_dir, t.name).select(_row_id(t.name, t.key).alias("id"), F.lit(t.name).alias("type"), _row_id(t.name, t.key).alias("name")) for t in catalog if t.key])


def foreign_key_edges(spark: SparkSession, sf_dir: str, catalog: tuple[Table, ...] = CATALOG) -> DataFrame:
    """src, dst, rel of an edge for each reference that isn't null."""
    return _all(
        [read(spark, sf_dir, t.name).where(F.col(c).isNotNull()).select(_row_id(t.name, t.key).alias("src"), _row_id(to, c).alias("dst"), F.lit(c).alias("rel")) for t in catalog if t.key for c, to in t.references.items()]
    )


def migrated_nodes(spark: SparkSession, sf_dir: str, catalog: tuple[Table, ...] = CATALOG, with_values: bool = True) -> DataFrame:
    """Nodes for tables, rows and distinct column values: id, type, name."""
    tables = spark.createDataFrame([(f"table:{t.name}", "table", t.name) for t in catalog], "id string, type string, name string")
    parts = [tables, row_nodes(spark, sf_dir, catalog)]
    if with_values:
        parts += [
            read(spark, sf_dir, t.name).select(c).where(F.col(c).isNotNull()).distinct().select(F.concat(F.lit(f"{t.name}:{c}:"), F.col(c)).alias("id"), F.lit("value").alias("type"), F.col(c).alias("name"))
            for t in catalog
            for c in t.values
        ]
    return _all(parts)


def migrated_edges(spark: SparkSession, sf_dir: str, catalog: tuple[Table, ...] = CATALOG, with_values: bool = True) -> DataFrame:
    """Edges from rows to their table, to column values, and by references: src, dst, rel."""
    parts = [foreign_key_edges(spark, sf_dir, catalog)]
    for t in catalog:
        rows = read(spark, sf_dir, t.name)
        parts.append(rows.select(_row_id(t.name, t.key).alias("src"), F.lit(f"table:{t.name}").alias("dst"), F.lit("is_part_of").alias("rel")))
        if with_values:
            parts += [rows.where(F.col(c).isNotNull()).select(_row_id(t.name, t.key).alias("src"), F.concat(F.lit(f"{t.name}:{c}:"), F.col(c)).alias("dst"), F.lit(c).alias("rel")) for c in t.values]
    return _all(parts)


def schema_edges(spark: SparkSession, catalog: tuple[Table, ...] = CATALOG, database: str = "database") -> DataFrame:
    """The graph of the schema alone: tables belong to the database; each reference is a relationship node between two tables."""
    rows = [(f"table:{t.name}", database, "is_part_of") for t in catalog]
    for t in catalog:
        for c, to in t.references.items():
            rows += [(f"table:{t.name}", f"relationship:{t.name}.{c}", "has_relationship"), (f"table:{to}", f"relationship:{t.name}.{c}", "has_relationship"), (f"table:{t.name}", f"table:{to}", "foreign_key")]
    return spark.createDataFrame(rows, "src string, dst string, rel string")


def relationship_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items have no key, so they are edges from orders to parts and suppliers, summed over equal ends."""
    lines = read(spark, sf_dir, "lineitem")
    one = lambda c, to: lines.groupBy(_row_id("orders", "l_orderkey").alias("src"), _row_id(to, c).alias("dst")).agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity")).withColumn("rel", F.lit(c))
    return one("l_partkey", "part").unionByName(one("l_suppkey", "supplier"))


def profile(spark: SparkSession, sf_dir: str, catalog: tuple[Table, ...] = CATALOG) -> DataFrame:
    """Rows, columns, key and references of each table."""
    parts = []
    for t in catalog:
        df = read(spark, sf_dir, t.name)
        parts.append(df.agg(F.count("*").alias("n_rows")).select(F.lit(t.name).alias("table_name"), "n_rows", F.lit(len(df.columns)).alias("n_columns"), F.lit(t.key).alias("primary_key"), F.lit(len(t.references)).alias("n_references")))
    return _all(parts)


def filtered_rows(df: DataFrame, **equal) -> DataFrame:
    """Rows whose columns equal a value, or one of a list of values; all conditions hold."""
    for c, v in equal.items():
        df = df.where(F.col(c).isin(list(v)) if isinstance(v, (list, tuple, set)) else F.col(c) == v)
    return df
