"""Times as node properties. Times without a zone count as UTC, whatever the session's zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .ids import uuid5


def epoch_millis(ts: Column) -> Column:
    """Milliseconds since 1970 of a time without a zone."""
    return F.unix_millis(F.convert_timezone(F.lit("UTC"), F.current_timezone(), ts).cast("timestamp"))


def parts(ts: Column) -> Column:
    """A struct of a timestamp node: id, time_at, year to second, timestamp_str."""
    millis = epoch_millis(ts)
    fields = [F.year(ts).alias("year"), F.month(ts).alias("month"), F.day(ts).alias("day"), F.hour(ts).alias("hour"), F.minute(ts).alias("minute"), F.second(ts).alias("second")]
    return F.struct(uuid5(millis.cast("string")).alias("id"), millis.alias("time_at"), *fields, F.date_format(ts, "yyyy-MM-dd HH:mm:ss").alias("timestamp_str"))


def placed(time_from: Column, time_to: Column) -> Column:
    """How an event lies in time: during an interval if both ends are known, at a time if one is, else null."""
    return F.when(time_from.isNotNull() & time_to.isNotNull(), "during").when(time_from.isNotNull() | time_to.isNotNull(), "at")
