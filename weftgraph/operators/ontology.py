"""Ontologies: types with inherited properties, constraints and relations, and checks of entities against them as Column predicates."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_CASTS = {"string": "string", "integer": "long", "float": "double", "boolean": "boolean", "datetime": "timestamp", "uuid": "string", "any": "string"}


@dataclass(frozen=True)
class Constraint:
    """kind: regex, range, enum, length or custom (a function from Column to Column). Ends are inclusive; a regex is anchored at the beginning."""

    kind: str
    value: object

    def check(self, c: Column) -> Column:
        if self.kind == "regex":
            return c.rlike(f"^(?:{self.value})")
        if self.kind == "enum":
            return c.isin(list(self.value))
        if self.kind == "custom":
            return self.value(c)
        size = F.length(c) if self.kind == "length" else c.cast("double")
        low, high = self.value
        out = F.lit(True)
        if low is not None:
            out = out & (size >= low)
        if high is not None:
            out = out & (size <= high)
        return out


@dataclass(frozen=True)
class Property:
    kind: str = "string"
    required: bool = False
    constraints: tuple[Constraint, ...] = ()


@dataclass(frozen=True)
class EntityType:
    properties: dict[str, Property] = field(default_factory=dict)
    parents: tuple[str, ...] = ()
    abstract: bool = False


@dataclass(frozen=True)
class RelationType:
    """Empty sources or targets allow any type; subtypes are allowed with their parents."""

    sources: tuple[str, ...] = ()
    targets: tuple[str, ...] = ()
    least: int = 0
    most: int | None = None
    symmetric: bool = False
    transitive: bool = False
    inverse_of: str | None = None


@dataclass(frozen=True)
class Ontology:
    entities: dict[str, EntityType]
    relations: dict[str, RelationType]

    def ancestors(self, name: str) -> list[str]:
        """The type and all types above it, nearest first."""
        out, queue = [], [name]
        while queue:
            t = queue.pop(0)
            if t not in out:
                out.append(t)
                queue += self.entities[t].parents if t in self.entities else ()
        return out

    def properties(self, name: str) -> dict[str, Property]:
        """Own properties and inherited ones; the nearest definition counts."""
        found: dict[str, Property] = {}
        for t in self.ancestors(name):
            for k, v in (self.entities[t].properties if t in self.entities else {}).items():
                found.setdefault(k, v)
        return found

    def problems(self) -> list[str]:
        """What is wrong with the ontology itself: unknown parents or end types, cycles, inverses that don't exist."""
        out = [f"{t}: unknown parent {p}" for t, e in self.entities.items() for p in e.parents if p not in self.entities]
        out += [f"{t}: inherits from itself" for t, e in self.entities.items() if any(t in self.ancestors(p) for p in e.parents)]
        for r, d in self.relations.items():
            out += [f"{r}: unknown type {t}" for t in (*d.sources, *d.targets) if t not in self.entities]
            if d.inverse_of is not None and d.inverse_of not in self.relations:
                out.append(f"{r}: unknown inverse {d.inverse_of}")
        return sorted(out)

    @staticmethod
    def from_dict(data: dict) -> Ontology:
        """Builds an ontology from plain data, as read from JSON."""
        entities = {
            t: EntityType(
                {k: Property(p.get("type", "string"), p.get("required", False), tuple(Constraint(c["type"], c["value"]) for c in p.get("constraints", ()))) for k, p in e.get("properties", {}).items()},
                tuple(e.get("inherits_from", ())),
                e.get("abstract", False),
            )
            for t, e in data.get("entity_types", {}).items()
        }
        relations = {
            r: RelationType(tuple(d.get("sources", ())), tuple(d.get("targets", ())), d.get("least", 0), d.get("most"), d.get("symmetric", False), d.get("transitive", False), d.get("inverse_of"))
            for r, d in data.get("relation_types", {}).items()
        }
        return Ontology(entities, relations)

    def to_dict(self) -> dict:
        """The inverse of from_dict()."""
        return {
            "entity_types": {
                t: {
                    "properties": {k: {"type": p.kind, "required": p.required, "constraints": [{"type": c.kind, "value": c.value} for c in p.constraints]} for k, p in e.properties.items()},
                    "inherits_from": list(e.parents),
                    "abstract": e.abstract,
                }
                for t, e in self.entities.items()
            },
            "relation_types": {
                r: {"sources": list(d.sources), "targets": list(d.targets), "least": d.least, "most": d.most, "symmetric": d.symmetric, "transitive": d.transitive, "inverse_of": d.inverse_of}
                for r, d in self.relations.items()
            },
        }

    def closure(self) -> list[tuple[str, str]]:
        """(type, ancestor) pairs, each type with itself as well."""
        return [(t, a) for t in self.entities for a in self.ancestors(t)]

    def allowed(self) -> list[tuple[str, str, str]]:
        """(relation, source type, target type) for every pair that a relation allows."""
        above = {t: set(self.ancestors(t)) for t in self.entities}
        return [(r, s, t) for r, d in self.relations.items() for s in self.entities for t in self.entities if (not d.sources or above[s] & set(d.sources)) and (not d.targets or above[t] & set(d.targets))]


def errors(ontology: Ontology, name: str) -> Column:
    """An array of messages for rows of a type whose columns are its properties."""
    found = []
    for k, p in ontology.properties(name).items():
        c = F.col(k)
        if p.required:
            found.append(F.when(c.isNull(), F.lit(f"{k}: missing")))
        kind = _CASTS.get(p.kind, "string")
        if kind != "string":
            found.append(F.when(c.isNotNull() & c.try_cast(kind).isNull(), F.lit(f"{k}: not {p.kind}")))
        found += [F.when(c.isNotNull() & ~x.check(c), F.lit(f"{k}: {x.kind}")) for x in p.constraints]
    return F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")


def validated(rows: DataFrame, ontology: Ontology, name: str) -> DataFrame:
    """rows with validation_errors and ontology_valid."""
    out = rows.withColumn("validation_errors", errors(ontology, name))
    return out.withColumn("ontology_valid", F.size("validation_errors") == 0)


def invalid_relations(nodes: DataFrame, edges: DataFrame, ontology: Ontology) -> DataFrame:
    """Edges without an end, of an unknown relation or between types that it doesn't allow: src, dst, rel, issue."""
    spark = nodes.sparkSession
    known = F.broadcast(spark.createDataFrame([(r,) for r in ontology.relations], "rel string").withColumn("known", F.lit(True)))
    fits = F.broadcast(spark.createDataFrame(ontology.allowed(), "rel string, src_type string, dst_type string").withColumn("fits", F.lit(True)))
    ended = edges
    for end in ("src", "dst"):
        ended = ended.join(nodes.select(F.col("id").alias(end), F.col("type").alias(f"{end}_type")), end, "left")
    checked = ended.join(known, "rel", "left").join(fits, ["rel", "src_type", "dst_type"], "left")
    missing = F.col("src_type").isNull() | F.col("dst_type").isNull()
    issue = F.when(missing, "missing end").when(F.col("known").isNull(), "unknown relation").when(F.col("fits").isNull(), "types not allowed")
    return checked.withColumn("issue", issue).where("issue is not null").select("src", "dst", "rel", "issue")


def evolution(old: Ontology, new: Ontology) -> list[tuple[str, str, str]]:
    """Changes between two ontologies: (element, change, severity), severity being major, minor or patch. Every field of types, properties and relations is compared."""
    out = []
    for kind, a, b in (("entity", old.entities, new.entities), ("relation", old.relations, new.relations)):
        out += [(f"{kind}:{x}", "removed", "major") for x in a.keys() - b.keys()] + [(f"{kind}:{x}", "added", "minor") for x in b.keys() - a.keys()]
    for t in old.entities.keys() & new.entities.keys():
        a, b = old.entities[t], new.entities[t]
        p, q = a.properties, b.properties
        out += [(f"entity:{t}.{x}", "property removed", "major") for x in p.keys() - q.keys()]
        out += [(f"entity:{t}.{x}", "required property added" if q[x].required else "property added", "major" if q[x].required else "minor") for x in q.keys() - p.keys()]
        for x in p.keys() & q.keys():
            if p[x].kind != q[x].kind:
                out.append((f"entity:{t}.{x}", "property type changed", "major"))
            if p[x].required != q[x].required:
                out.append((f"entity:{t}.{x}", "property newly required" if q[x].required else "property no longer required", "major" if q[x].required else "minor"))
            more, fewer = set(map(repr, q[x].constraints)) - set(map(repr, p[x].constraints)), set(map(repr, p[x].constraints)) - set(map(repr, q[x].constraints))
            out += [(f"entity:{t}.{x}", "constraints tightened", "major")] if more else [(f"entity:{t}.{x}", "constraints relaxed", "minor")] if fewer else []
        if set(a.parents) != set(b.parents):
            out.append((f"entity:{t}", "parents changed", "major" if set(a.parents) - set(b.parents) else "minor"))
        if a.abstract != b.abstract:
            out.append((f"entity:{t}", "made abstract" if b.abstract else "no longer abstract", "major" if b.abstract else "minor"))
    for r in old.relations.keys() & new.relations.keys():
        a, b = old.relations[r], new.relations[r]
        for end in ("sources", "targets"):
            x, y = set(getattr(a, end)), set(getattr(b, end))
            if x != y:
                narrower = bool(y) and (not x or bool(x - y))
                out.append((f"relation:{r}", f"{end} narrowed" if narrower else f"{end} widened", "major" if narrower else "minor"))
        if (a.least, a.most) != (b.least, b.most):
            tighter = b.least > a.least or b.most is not None and (a.most is None or b.most < a.most)
            out.append((f"relation:{r}", "cardinality tightened" if tighter else "cardinality relaxed", "major" if tighter else "minor"))
        out += [(f"relation:{r}", f"{k} changed", "minor") for k in ("symmetric", "transitive", "inverse_of") if getattr(a, k) != getattr(b, k)]
    return sorted(out)


def next_version(version: str, changes: list[tuple[str, str, str]]) -> str:
    """The semantic version after changes."""
    major, minor, patch = map(int, version.split("."))
    kinds = {c[2] for c in changes}
    if "major" in kinds:
        return f"{major + 1}.0.0"
    return f"{major}.{minor + 1}.0" if "minor" in kinds else f"{major}.{minor}.{patch + 1}"


def _mapped(function, m: Column, name: str, of) -> Column:
    """A map function whose lambda is also told whether the key is the given one."""
    return function(m, lambda k, v: of(k == name, k, v))


def migrated(rows: DataFrame, steps: list[tuple], properties: str = "properties") -> DataFrame:
    """Applies steps to a map column: ('add', name, default), ('remove', name), ('rename', name, new name), ('transform', name, function of Column)."""
    for kind, name, *more in steps:
        m = F.col(properties)
        if kind == "add":
            rows = rows.withColumn(properties, F.when(F.map_contains_key(m, name), m).otherwise(F.map_concat(m, F.create_map(F.lit(name), F.lit(more[0])))))
        elif kind == "remove":
            rows = rows.withColumn(properties, _mapped(F.map_filter, m, name, lambda same, k, v: ~same))
        elif kind == "rename":
            to = F.lit(more[0])
            rows = rows.withColumn(properties, _mapped(F.transform_keys, m, name, lambda same, k, v, to=to: F.when(same, to).otherwise(k)))
        elif kind == "transform":
            f = more[0]
            rows = rows.withColumn(properties, _mapped(F.transform_values, m, name, lambda same, k, v, f=f: F.when(same, f(v)).otherwise(v)))
        else:
            raise ValueError(f"no such step: {kind}")
    return rows
