"""Structured Streaming over event logs: windows with late data, sessions, audit ingestion, and question-and-answer state with a time to live."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

TTL_SECONDS = 86_400


def event_stream(spark: SparkSession, path: str, schema, files_per_batch: int = 1) -> DataFrame:
    """A stream of the Parquet files below a path."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def windowed_counts(events: DataFrame, size: str = "1 day", slide: str | None = None, lateness: str = "1 hour") -> DataFrame:
    """Events of each type in each window; rows later than the watermark are dropped by a stream. Works on batches too."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return events.withWatermark("ts", lateness).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "6 hours", lateness: str = "1 hour") -> DataFrame:
    """Sessions of each user, which end with a gap."""
    w = F.session_window("ts", gap)
    return events.withWatermark("ts", lateness).groupBy(w.alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def recent_entries(entries: DataFrame, key: str, ts: str, text: str, last_n: int = 5, ttl_seconds: int = TTL_SECONDS, lateness: str = "1 hour") -> DataFrame:
    """The last entries of each session after each batch that has some: key, n, entries (joined by line breaks). State lives for ttl_seconds of event time
    after the last write."""
    source = entries.select(F.col(key).alias("key"), F.col(ts).alias("ts"), F.col(text).alias("text")).withWatermark("ts", lateness)

    def updated(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = list(zip(*state.get, strict=True)) if state.exists else []
        for pdf in batches:
            held += list(zip(pdf["ts"].astype("int64") // 1000, pdf["text"], strict=True))
        held = sorted(held)[-last_n:]
        state.update(([int(t) for t, _ in held], [x for _, x in held]))
        state.setTimeoutTimestamp(max(int(held[-1][0]) // 1000, state.getCurrentWatermarkMs()) + 1000 * ttl_seconds)
        yield pd.DataFrame({"key": [k[0]], "n": [len(held)], "entries": ["\n".join(x for _, x in held)]})

    kind = dict(source.dtypes)["key"]
    return source.groupBy("key").applyInPandasWithState(updated, f"key {kind}, n long, entries string", "times array<long>, texts array<string>", "update", GroupStateTimeout.EventTimeTimeout)


def ingested(stream: DataFrame, path: str, checkpoint: str, id_col: str = "event_id") -> StreamingQuery:
    """Writes a stream's events to Parquet, once each within a batch, and ends when all input at hand is done."""

    def write(batch: DataFrame, number: int) -> None:
        batch.dropDuplicates([id_col]).write.mode("overwrite").parquet(f"{path}/batch={number}")  # the same batch again replaces itself

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
