"""Tables of the session's catalog as stores: creation, insertion, deletion by key, listing and dropping.

Deletion writes the rest as a new table and swaps the names, so a reader never sees half of it and a lost executor costs a task."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_NAME = re.compile(r"^[A-Za-z_][A-Za-z0-9_]*$")


def full_name(table: str, schema: str = "default") -> str:
    """A quoted name; an error if a part is no plain word."""
    if not _NAME.match(table) or not _NAME.match(schema):
        raise ValueError(f"no plain names: {schema}, {table}")
    return f"`{schema}`.`{table}`"


def create_table(spark: SparkSession, table: str, columns: str, schema: str = "default", partition: list[str] | None = None) -> None:
    """Creates schema and table unless they exist. columns: as in 'id long, name string'."""
    name = full_name(table, schema)
    spark.sql(f"CREATE SCHEMA IF NOT EXISTS `{schema}`")
    by = f" PARTITIONED BY ({', '.join(partition)})" if partition else ""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet{by}")


def insert(rows: DataFrame, table: str, schema: str = "default") -> None:
    """Appends rows by the names of the table's columns."""
    name = full_name(table, schema)
    rows.select(*rows.sparkSession.table(name).columns).write.insertInto(name)


def tables(spark: SparkSession, schema: str = "default") -> list[str]:
    """Names of the tables of a schema, in order; none if there is no such schema."""
    return sorted(t.name for t in spark.catalog.listTables(schema) if not t.isTemporary) if spark.catalog.databaseExists(schema) else []


def delete_where(spark: SparkSession, table: str, condition: Column, schema: str = "default") -> int:
    """Deletes rows for which a condition holds; how many."""
    name = full_name(table, schema)
    rows = spark.table(name)
    gone = rows.where(condition).count()
    if gone:
        fresh = f"{table}_{uuid.uuid4().hex[:8]}"
        rows.where(~F.coalesce(condition, F.lit(False))).write.format("parquet").saveAsTable(full_name(fresh, schema))
        spark.sql(f"DROP TABLE {name}")
        spark.sql(f"ALTER TABLE {full_name(fresh, schema)} RENAME TO {name}")
    return gone


def delete_by_id(spark: SparkSession, table: str, value: object, schema: str = "default", key: str = "id") -> int:
    return delete_where(spark, table, F.col(key) == F.lit(value), schema)


def drop_table(spark: SparkSession, table: str, schema: str = "default") -> None:
    spark.sql(f"DROP TABLE IF EXISTS {full_name(table, schema)}")


def drop_schema(spark: SparkSession, schema: str) -> None:
    """Drops a schema with all of its tables."""
    full_name("x", schema)
    spark.sql(f"DROP SCHEMA IF EXISTS `{schema}` CASCADE")


def sole_referrers(rows: DataFrame, key: str, reference: Column) -> DataFrame:
    """Which rows alone refer to what they refer to (so it may go with them): key, sole_referrer."""
    counts = rows.groupBy(reference.alias("__r")).agg(F.count("*").alias("__n"))
    joined = rows.select(key, reference.alias("__own")).join(counts, F.col("__own").eqNullSafe(F.col("__r")))
    return joined.select(key, (F.col("__n") == 1).alias("sole_referrer"))
