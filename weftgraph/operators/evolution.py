"""Ontologies that change: compatibility, change logs, migration plans, and migrations of entities that can be tried, counted and taken back."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ontology import Ontology, evolution, migrated, next_version

LEVELS = ("patch", "minor", "major")
COMPATIBILITY = {"patch": "fully compatible", "minor": "backward compatible", "major": "breaking"}


def compatibility(old: Ontology, new: Ontology) -> str:
    """By the gravest change."""
    return COMPATIBILITY[max((c[2] for c in evolution(old, new)), key=LEVELS.index, default="patch")]


def change_table(spark: SparkSession, old: Ontology, new: Ontology) -> DataFrame:
    """element, change, severity."""
    return spark.createDataFrame(evolution(old, new), "element string, change string, severity string")


def change_log(changes: DataFrame) -> DataFrame:
    """A line for each kind of change: change, severity, n, text (the elements in order)."""
    return changes.groupBy("change", "severity").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("element")), ", ").alias("text"))


@dataclass(frozen=True)
class Plan:
    """Steps as ontology.migrated() takes them, for entities of some types (all if none)."""

    from_version: str
    to_version: str
    steps: tuple[tuple, ...] = ()
    types: tuple[str, ...] = ()
    warnings: tuple[str, ...] = ()
    downtime: bool = False

    @property
    def reversible(self) -> bool:
        return all(s[0] in ("add", "rename") for s in self.steps)

    def reverse(self) -> Plan:
        """The plan that takes this one back; an error if a step loses what it changes."""
        if not self.reversible:
            raise ValueError("steps that remove or transform values can't be taken back")
        back = [("remove", s[1]) if s[0] == "add" else ("rename", s[2], s[1]) for s in reversed(self.steps)]
        return Plan(self.to_version, self.from_version, tuple(back), self.types, (), self.downtime)


@dataclass
class MigrationBuilder:
    """Builds a plan step by step."""

    from_version: str
    to_version: str
    steps: list[tuple] = field(default_factory=list)
    types: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)
    downtime: bool = False

    def for_type(self, name: str) -> MigrationBuilder:
        self.types.append(name)
        return self

    def add(self, name: str, default: object) -> MigrationBuilder:
        self.steps.append(("add", name, default))
        return self

    def remove(self, name: str) -> MigrationBuilder:
        self.steps.append(("remove", name))
        self.warnings.append(f"values of {name} are lost")
        return self

    def rename(self, name: str, to: str) -> MigrationBuilder:
        self.steps.append(("rename", name, to))
        return self

    def transform(self, name: str, function) -> MigrationBuilder:
        """function: from Column to Column."""
        self.steps.append(("transform", name, function))
        return self

    def requires_downtime(self) -> MigrationBuilder:
        self.downtime = True
        return self

    def build(self) -> Plan:
        return Plan(self.from_version, self.to_version, tuple(self.steps), tuple(self.types), tuple(self.warnings), self.downtime)


def planned(old: Ontology, new: Ontology, from_version: str, defaults: dict[str, str] | None = None) -> Plan:
    """A plan from the changes of properties: added ones get their default (empty if there is none), removed ones go; what else is breaking becomes a warning."""
    steps, warnings = [], []
    changes = evolution(old, new)
    for element, change, severity in changes:
        name = element.rsplit(".", 1)[-1]
        if change in ("property added", "required property added"):
            steps.append(("add", name, (defaults or {}).get(name, "")))
        elif change == "property removed":
            steps.append(("remove", name))
            warnings.append(f"values of {name} are lost")
        elif severity == "major":
            warnings.append(f"{element}: {change}")
    return Plan(from_version, next_version(from_version, changes), tuple(steps), (), tuple(warnings), any(c[2] == "major" for c in changes))


def applied(rows: DataFrame, plan: Plan, type_col: str = "type", properties: str = "properties", version_col: str = "version") -> DataFrame:
    """rows with a plan's steps applied to the entities it is for, which get its version; others stay. One transformation of the whole table: batches are Spark's matter."""
    concerned = F.col(type_col).isin(list(plan.types)) if plan.types else F.lit(True)
    concerned = F.coalesce(concerned & (F.col(version_col) == plan.from_version), F.lit(False))
    after = migrated(rows.withColumn("__before", F.col(properties)), list(plan.steps), properties)
    chosen = F.when(concerned, F.col(properties)).otherwise(F.col("__before"))
    return after.withColumn(properties, chosen).withColumn(version_col, F.when(concerned, F.lit(plan.to_version)).otherwise(F.col(version_col))).drop("__before")


def dry_run(rows: DataFrame, plan: Plan, type_col: str = "type", properties: str = "properties", version_col: str = "version") -> DataFrame:
    """What a plan would do: type, n, n_concerned, n_changed."""
    key = "__at"
    before = rows.withColumn(key, F.map_entries(properties))
    after = applied(before, plan, type_col, properties, version_col)
    changed = F.array_sort(F.map_entries(properties)) != F.array_sort(key)
    return after.groupBy(type_col).agg(F.count("*").alias("n"), F.count_if(F.col(version_col) == plan.to_version).alias("n_concerned"), F.count_if(changed).alias("n_changed"))


def rolled_back(rows: DataFrame, plan: Plan, type_col: str = "type", properties: str = "properties", version_col: str = "version") -> DataFrame:
    """rows as they were before a plan, if all of its steps can be taken back."""
    return applied(rows, plan.reverse(), type_col, properties, version_col)
