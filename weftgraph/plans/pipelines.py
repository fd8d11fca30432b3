"""Pipelines of tasks over DataFrames, with run records and items that are skipped once done."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Task = Callable[[DataFrame], DataFrame]
STARTED, COMPLETED, ERRORED = "STARTED", "COMPLETED", "ERRORED"
RUN_SCHEMA = "run_id long, pipeline string, dataset string, status string, created_at timestamp, message string"


@dataclass(frozen=True)
class Pipeline:
    """Named tasks, each from DataFrame to DataFrame; together one plan."""

    name: str
    tasks: tuple[Task, ...]

    def __call__(self, items: DataFrame) -> DataFrame:
        return reduce(lambda df, task: df.transform(task), self.tasks, items)


def pending(items: DataFrame, done: DataFrame, key: str, pipeline: str, dataset: str) -> DataFrame:
    """Items that a pipeline hasn't completed in a dataset yet. done: key, pipeline, dataset, status."""
    finished = done.where((F.col("pipeline") == pipeline) & (F.col("dataset") == dataset) & (F.col("status") == COMPLETED)).select(key)
    return items.join(finished, key, "left_anti")


def may_run(runs: DataFrame, pipeline: str, dataset: str) -> bool:
    """Whether the latest run of a pipeline on a dataset neither runs nor has completed."""
    last = runs.where((F.col("pipeline") == pipeline) & (F.col("dataset") == dataset)).orderBy(F.desc("created_at"), F.desc("run_id")).select("status").first()
    return last is None or last["status"] not in (STARTED, COMPLETED)


def run(pipeline: Pipeline, items: DataFrame, path: str, runs_path: str, dataset: str, run_id: int) -> DataFrame:
    """Runs a pipeline, writes its rows below a path (a second try replaces the first) and appends its start and end to the run records."""
    spark = items.sparkSession

    def record(status: str, message: str | None = None) -> None:
        row = spark.createDataFrame([(run_id, pipeline.name, dataset, status, message)], "run_id long, pipeline string, dataset string, status string, message string")
        row.withColumn("created_at", F.current_timestamp()).select(*[c.split()[0] for c in RUN_SCHEMA.split(", ")]).write.mode("append").parquet(runs_path)

    record(STARTED)
    target = f"{path}/dataset={dataset}/run={run_id}"
    try:
        pipeline(items).write.mode("overwrite").parquet(target)
    except Exception as e:
        record(ERRORED, str(e)[:500])
        raise
    record(COMPLETED)
    return spark.read.parquet(target)


def runs(spark: SparkSession, runs_path: str) -> DataFrame:
    return spark.read.schema(RUN_SCHEMA).parquet(runs_path)


def default_tasks(chunk: Task, extract: Task, store: Task, summarise: Task | None = None) -> tuple[Task, ...]:
    """The tasks from documents to a graph: chunks, extraction, summaries if wanted, and what stores them."""
    return tuple(t for t in (chunk, extract, summarise, store) if t is not None)


def temporal_tasks(chunk: Task, events: Task, extract: Task, store: Task) -> tuple[Task, ...]:
    """Like default_tasks(), with events and their times before the entities."""
    return chunk, events, extract, store


def add(known: DataFrame, documents: DataFrame, dataset: str, text: str = "text") -> DataFrame:
    """known (content_hash, dataset, text) with documents that the dataset lacks, by content, each once."""
    new = documents.select(F.md5(text).alias("content_hash"), F.lit(dataset).alias("dataset"), F.col(text).alias("text")).dropDuplicates(["content_hash"])
    return known.unionByName(new.join(known, ["content_hash", "dataset"], "left_anti").select(*known.columns))


def memify(nodes: DataFrame, edges: DataFrame, extract: Callable[[DataFrame, DataFrame], DataFrame], enrich: tuple[Task, ...]) -> DataFrame:
    """Enrichment of a graph: extract() takes rows from nodes and edges, and tasks go over them."""
    return reduce(lambda df, task: df.transform(task), enrich, extract(nodes, edges))


def subgraph_chunks(nodes: DataFrame, edges: DataFrame, chunk_type: str = "DocumentChunk", text: str = "text") -> DataFrame:
    """Texts of a graph's chunks: id, text; for memify()."""
    return nodes.where((F.col("type") == chunk_type) & (F.length(F.trim(text)) > 0)).select("id", text)


def triplet_index(nodes: DataFrame, edges: DataFrame, embed: Callable | None = None, name: str = "name") -> DataFrame:
    """Triplets as rows to be indexed: id, text, and a vector if an embedder of Columns is given."""
    from ..functions.ids import uuid5
    from ..operators.graph import triplets

    rows = triplets(nodes, edges, name).select(uuid5(F.concat("src", "rel", "dst")).alias("id"), "text")
    return rows if embed is None else rows.withColumn("vector", embed(F.col("text")))
