"""Versions of entities, as-of reads, differences, and the audit log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def versions(changes: DataFrame, entity: str, ts: str, tie: str) -> DataFrame:
    """changes with version_number from 1, by time (ties by another column), of each entity."""
    return changes.withColumn("version_number", F.row_number().over(Window.partitionBy(entity).orderBy(ts, tie)))


def latest(history: DataFrame, entity: str, n: int | None = 1) -> DataFrame:
    """The last n versions of each entity."""
    w = Window.partitionBy(entity).orderBy(F.desc("version_number"))
    return history.withColumn("__rank", F.row_number().over(w)).where(F.col("__rank") <= n).drop("__rank")


def as_of(changes: DataFrame, entity: str, ts: str, tie: str, moment: Column) -> DataFrame:
    """Each entity's row that was current at a moment. One aggregation, without a sort of the history."""
    columns = [c for c in changes.columns if c != entity]
    best = F.max(F.struct(ts, tie, *[c for c in columns if c not in (ts, tie)])).alias("v")
    return changes.where(F.col(ts) <= moment).groupBy(entity).agg(best).select(entity, *[F.col(f"v.{c}").alias(c) for c in columns])


def as_of_join(left: DataFrame, right: DataFrame, key: str, left_ts: str, right_ts: str, value: str, bucket: str = "month") -> DataFrame:
    """left with the latest value of right at or before each row's time: value. A union and a running last value take the place of
    a range join. They run by key and bucket of time, so that one key's long history is dealt over tasks; what a bucket begins with is the last value of the buckets before it, which
    come as one row for each key and bucket."""
    kind = dict(right.dtypes)[value]
    at = lambda c: F.date_trunc(bucket, F.col(c).cast("timestamp_ntz"))
    a = left.select(F.col(key).alias("__key"), at(left_ts).alias("__bucket"), F.col(left_ts).alias("__ts"), F.lit(1).alias("__side"), F.struct(*left.columns).alias("__row"), F.lit(None).cast(kind).alias("__value"))
    b = right.where(F.col(value).isNotNull()).select(F.col(key).alias("__key"), at(right_ts).alias("__bucket"), F.col(right_ts).alias("__ts"), F.lit(0).alias("__side"), F.lit(None).cast(a.schema["__row"].dataType).alias("__row"), F.col(value).alias("__value"))
    ends = b.groupBy("__key", "__bucket").agg(F.max(F.struct("__ts", "__value"))["__value"].alias("__last"))
    buckets = a.select("__key", "__bucket").distinct().join(ends, ["__key", "__bucket"], "full")
    before = Window.partitionBy("__key").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = buckets.withColumn("__carried", F.last("__last", ignorenulls=True).over(before)).select(F.col("__key").alias("__k"), F.col("__bucket").alias("__b"), "__carried")
    within = Window.partitionBy("__key", "__bucket").orderBy("__ts", "__side").rowsBetween(Window.unboundedPreceding, 0)
    running = a.unionByName(b).withColumn("__value", F.last("__value", ignorenulls=True).over(within)).where("__side = 1")
    joined = running.join(carried, F.col("__key").eqNullSafe(F.col("__k")) & F.col("__bucket").eqNullSafe(F.col("__b")), "left")
    return joined.select("__row.*", F.coalesce("__value", "__carried").alias(value))


def property_changes(old: Column, new: Column) -> Column:
    """An array of (name, change, old_value, new_value) between two maps of strings; null counts as absent. Ordered by name."""
    names = F.array_sort(F.array_union(F.coalesce(F.map_keys(old), F.array().cast("array<string>")), F.coalesce(F.map_keys(new), F.array().cast("array<string>"))))
    change = lambda a, b: F.when(a.isNull() & b.isNotNull(), "added").when(a.isNotNull() & b.isNull(), "removed").when(a != b, "modified")
    rows = F.transform(names, lambda k: F.struct(k.alias("name"), change(F.try_element_at(old, k), F.try_element_at(new, k)).alias("change"), F.try_element_at(old, k).alias("old_value"), F.try_element_at(new, k).alias("new_value")))
    return F.filter(rows, lambda x: x["change"].isNotNull())


def differences(history: DataFrame, entity: str, properties: str) -> DataFrame:
    """history with the changes of each version against the one before: changes, description."""
    w = Window.partitionBy(entity).orderBy("version_number")
    out = history.withColumn("changes", property_changes(F.lag(properties).over(w), F.col(properties)))
    return out.withColumn("description", description(F.col("changes")))


def description(changes: Column) -> Column:
    """The first three names that changed, and an ellipsis if there are more."""
    names = F.array_join(F.slice(F.transform(changes, lambda x: x["name"]), 1, 3), ", ")
    return F.when(F.size(changes) > 3, F.concat(names, F.lit("..."))).otherwise(names)


def changes_between(history: DataFrame, ts: str, since: Column | None = None, until: Column | None = None, kinds: list[str] | None = None, kind: str = "change_type") -> DataFrame:
    """Versions in a closed range of time, of some kinds."""
    if since is not None:
        history = history.where(F.col(ts) >= since)
    if until is not None:
        history = history.where(F.col(ts) <= until)
    return history if kinds is None else history.where(F.col(kind).isin(kinds))


def restored(history: DataFrame, entity: str, version: int, ts: Column, kind: str = "change_type") -> DataFrame:
    """history with a version more for each entity that has the given one: that version's content, as a restoration."""
    last = history.groupBy(entity).agg((F.max("version_number") + 1).alias("__next"))
    new = history.where(F.col("version_number") == version).join(last, entity).withColumn("version_number", F.col("__next")).withColumn(kind, F.lit("restore")).withColumn("ts", ts).drop("__next")
    return history.unionByName(new.select(*history.columns))


def audit_report(events: DataFrame, kind: str, actor: str, severity: str) -> DataFrame:
    """Counts by kind, by actor ('unknown' if null) and by severity in one pass: dimension, value, n."""
    rows = events.select(F.col(kind).alias("k"), F.coalesce(F.col(actor).cast("string"), F.lit("unknown")).alias("a"), F.col(severity).alias("s"))
    sets = rows.groupingSets([["k"], ["a"], ["s"]], "k", "a", "s").agg(F.grouping_id().alias("g"), F.count("*").alias("n"))
    return sets.select(F.when(F.col("g") == 3, "type").when(F.col("g") == 5, "actor").otherwise("severity").alias("dimension"), F.when(F.col("g") == 3, F.col("k")).when(F.col("g") == 5, F.col("a")).otherwise(F.col("s")).alias("value"), "n")


def severity(kind: Column, success: Column) -> Column:
    """Of a security event: failed authentication is critical, another failure a warning."""
    return F.when(~success & (kind == "auth_failure"), "critical").when(~success, "warning").otherwise("info")


def query_log(events: DataFrame, ts: str, since: Column | None = None, until: Column | None = None, tags: list[str] | None = None, limit: int = 100, **equal) -> DataFrame:
    """Events that fulfil all conditions (tags: any of them), the latest first."""
    events = changes_between(events, ts, since, until)
    for c, v in equal.items():
        events = events.where(F.col(c).isin(v) if isinstance(v, list) else F.col(c) == v)
    if tags is not None:
        events = events.where(F.arrays_overlap("tags", F.array(*map(F.lit, tags))))
    return events.orderBy(F.desc(ts), events.columns[0]).limit(limit)
