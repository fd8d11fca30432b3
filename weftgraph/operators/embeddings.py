"""Embeddings of entities as records (entity_id, kind, model, dimensions, vector), and a stand-in embedder of hashed words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokens

KEY = ["entity_id", "kind"]


def _let(value: Column, of) -> Column:
    """of(value), where value is computed once however often it comes up."""
    return F.element_at(F.transform(F.array(value), of), 1)


def hashed(text: Column, dimensions: int = 64) -> Column:
    """A deterministic vector of a text, of length 1: words are hashed to places with a sign and counted. Without words all places are 0. A model's function may take its place."""
    words = F.transform(tokens(text, ()), lambda w: F.struct(F.pmod(F.xxhash64(w), F.lit(dimensions)).cast("int").alias("at"), F.when(F.pmod(F.xxhash64(w, F.lit("sign")), F.lit(2)) == 0, 1.0).otherwise(-1.0).alias("sign")))
    sums = F.aggregate(words, F.array_repeat(F.lit(0.0), dimensions), lambda s, w: F.transform(s, lambda x, i: x + F.when(i == w["at"], w["sign"]).otherwise(0.0)))
    norm = lambda s: F.sqrt(F.aggregate(s, F.lit(0.0), lambda t, x: t + x * x))
    return _let(sums, lambda s: _let(norm(s), lambda n: F.transform(s, lambda x: F.when(n > 0, x / n).otherwise(F.lit(0.0)))))


def problems(records: DataFrame) -> DataFrame:
    """Records that break a rule: entity_id, kind, issue (no vector, or another length than dimensions says)."""
    issue = F.when(F.col("vector").isNull() | (F.size("vector") == 0), "no vector").when(F.size("vector") != F.col("dimensions"), "wrong length")
    return records.withColumn("issue", issue).where("issue is not null").select(*KEY, "issue")


def without_embedding(entities: DataFrame, records: DataFrame) -> DataFrame:
    """Entities (entity_id) that have no embedding."""
    return entities.join(records, "entity_id", "left_anti")


def of(records: DataFrame, ids: DataFrame, kind: str | None = None) -> DataFrame:
    """Records of some entities, and of one kind if it is given."""
    found = records.join(ids, "entity_id", "left_semi")
    return found if kind is None else found.where(F.col("kind") == kind)


def replaced(records: DataFrame, new: DataFrame) -> DataFrame:
    """Records with new ones instead of all of the same entities'."""
    return records.join(new, "entity_id", "left_anti").unionByName(new)


def added(entities: DataFrame, records: DataFrame, new: DataFrame, ts: Column) -> tuple[DataFrame, DataFrame]:
    """New records instead of those of the same entity and kind; their entities (entity_id, version, updated_at) get a version more. Records of unknown entities are left out."""
    known = new.join(entities, "entity_id", "left_semi").dropDuplicates(KEY)
    touched = known.select("entity_id").distinct().withColumn("__new", F.lit(True))
    out = entities.join(touched, "entity_id", "left")
    out = out.withColumn("version", F.col("version") + F.when(F.col("__new"), 1).otherwise(0)).withColumn("updated_at", F.when(F.col("__new"), ts).otherwise(F.col("updated_at"))).drop("__new")
    return out.select(*entities.columns), records.join(known, KEY, "left_anti").unionByName(known)
