"""Writing the audit log: typed events as rows of one schema, appended to a table, and counts over it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .versioning import severity

SCHEMA = "event_type string, actor string, resource_type string, resource_id string, action string, description string, severity string, success boolean, details map<string,string>, ts timestamp"
_COLUMNS = [c.split(" ")[0] for c in SCHEMA.split(", ")]


def events(rows: DataFrame, event_type: Column, actor: Column, resource_type: str, resource_id: Column, action: Column, description: Column, ts: Column, success: Column | None = None, level: Column | None = None, details: dict[str, Column] | None = None) -> DataFrame:
    """A log row for each row. level: info if all is well and a warning if not, unless given."""
    ok = F.lit(True) if success is None else F.coalesce(success, F.lit(False))
    more = F.create_map(*[x for k, v in (details or {}).items() for x in (F.lit(k), v.cast("string"))]) if details else F.create_map().cast("map<string,string>")
    values = [event_type, F.coalesce(actor.cast("string"), F.lit("unknown")), F.lit(resource_type), resource_id.cast("string"), action, description, F.when(ok, "info").otherwise("warning") if level is None else level, ok, F.map_filter(more, lambda k, v: v.isNotNull()), ts.cast("timestamp")]
    return rows.select(*[v.alias(c) for v, c in zip(values, _COLUMNS, strict=True)])


def entity_operations(rows: DataFrame, operation: str, entity_id: str, actor: str, ts: str, before: str | None = None, after: str | None = None, success: str | None = None) -> DataFrame:
    """Events of creating, changing or deleting entities, with their states as JSON if given."""
    states = {k: F.to_json(c) for k, c in (("before", before), ("after", after)) if c}
    return events(rows, F.lit(f"entity_{operation}"), F.col(actor), "entity", F.col(entity_id), F.lit(operation), F.concat(F.lit(f"{operation} entity "), F.col(entity_id).cast("string")), F.col(ts), F.col(success) if success else None, None, states)


def query_events(rows: DataFrame, query: str, actor: str, results: str, milliseconds: str, ts: str) -> DataFrame:
    text = F.concat(F.lit("query: "), F.substring(F.col(query), 1, 100))
    return events(rows, F.lit("query"), F.col(actor), "query", F.md5(query), F.lit("execute"), text, F.col(ts), None, None, {"results_count": F.col(results), "execution_time_ms": F.col(milliseconds)})


def rag_events(rows: DataFrame, query: str, actor: str, confidence: str, risk: str, n_context: str, ts: str) -> DataFrame:
    """Answers: a risk of 0.5 or more is a warning."""
    return events(rows, F.lit("rag"), F.col(actor), "answer", F.md5(query), F.lit("generate"), F.concat(F.lit("answer to: "), F.substring(F.col(query), 1, 100)), F.col(ts), None, F.when(F.col(risk) >= 0.5, "warning").otherwise("info"), {"confidence": F.col(confidence), "hallucination_risk": F.col(risk), "context_entities": F.col(n_context)})


def migration_events(rows: DataFrame, migration: str, actor: str, status: str, n: str, seconds: str, ts: str) -> DataFrame:
    level = F.when(F.col(status) == "failed", "error").otherwise("info")
    return events(rows, F.lit("migration"), F.col(actor), "ontology", F.col(migration), F.col(status), F.concat_ws(" ", F.lit("migration"), F.col(migration).cast("string"), F.col(status)), F.col(ts), F.col(status) != "failed", level, {"entities_migrated": F.col(n), "duration_seconds": F.col(seconds)})


def security_events(rows: DataFrame, kind: str, actor: str, success: str, ts: str) -> DataFrame:
    """Failed authentication is critical, another failure a warning."""
    ok = F.coalesce(F.col(success), F.lit(False))
    return events(rows, F.col(kind), F.col(actor), "security", F.lit(None), F.col(kind), F.concat_ws(" ", F.col(kind), F.when(ok, "succeeded").otherwise("failed")), F.col(ts), ok, severity(F.col(kind), ok))


def append(log: DataFrame, path: str) -> None:
    """Appends events to the log at a path, dealt into a folder for each day."""
    log.withColumn("day", F.to_date("ts")).write.mode("append").partitionBy("day").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"{SCHEMA}, day date").parquet(path)


def stats(log: DataFrame) -> DataFrame:
    """One row: n_events, n_failed, n_actors, first and last time."""
    return log.agg(F.count("*").alias("n_events"), F.count_if(~F.col("success")).alias("n_failed"), F.countDistinct("actor").alias("n_actors"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
