"""Ontologies in RDF as a table of triples (s, p, o): readers, lookup by local name, closest names, and the part of an ontology around a node."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import cut
from .matching import CUTOFF, closest_in, named

RDF, RDFS, OWL = "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "http://www.w3.org/2000/01/rdf-schema#", "http://www.w3.org/2002/07/owl#"
TYPE, SUBCLASS, CLASS, OBJECT_PROPERTY = f"{RDF}type", f"{RDFS}subClassOf", f"{OWL}Class", f"{OWL}ObjectProperty"
_SCHEMA = "s string, p string, o string"
_XML_BASE = "{http://www.w3.org/XML/1998/namespace}base"


def triples_of_xml(text: str) -> Iterator[tuple[str, str, str]]:
    """The triples of an RDF/XML document: typed nodes, resources and literals, nested nodes, parts without a name as _:n. Raises ValueError if it isn't XML."""
    try:
        root = ET.fromstring(text)
    except ET.ParseError as e:
        raise ValueError(f"no RDF/XML: {e}") from e
    base, blank = root.get(_XML_BASE, ""), 0
    plain = lambda tag: tag[1:].replace("}", "") if tag[0] == "{" else tag
    full = lambda uri: uri if "://" in uri else base + uri

    def node(x: ET.Element) -> tuple[str, list[tuple[str, str, str]]]:
        nonlocal blank
        if x.get(f"{{{RDF}}}about") is not None:
            s = full(x.get(f"{{{RDF}}}about"))
        elif x.get(f"{{{RDF}}}ID") is not None:
            s = f"{base}#{x.get(f'{{{RDF}}}ID')}"
        else:
            blank += 1
            s = f"_:{blank}"
        out = [] if plain(x.tag) == f"{RDF}Description" else [(s, TYPE, plain(x.tag))]
        for c in x:
            p = plain(c.tag)
            if c.get(f"{{{RDF}}}resource") is not None:
                out.append((s, p, full(c.get(f"{{{RDF}}}resource"))))
            elif len(c):
                for inner in c:
                    o, more = node(inner)
                    out += [(s, p, o), *more]
            elif (c.text or "").strip():
                out.append((s, p, c.text.strip()))
        return s, out

    for x in root if plain(root.tag) == f"{RDF}RDF" else [root]:
        yield from node(x)[1]


def read_xml(spark: SparkSession, path: str) -> DataFrame:
    """Triples of RDF/XML files, once each. A file is one document and is parsed whole by one task."""

    def each(batches):
        import pandas as pd

        for pdf in batches:
            yield pd.DataFrame([t for text in pdf["value"] for t in triples_of_xml(text)], columns=["s", "p", "o"])

    return spark.read.text(path, wholetext=True).mapInPandas(each, _SCHEMA).distinct()


def read_ntriples(spark: SparkSession, path: str) -> DataFrame:
    """Triples of N-Triples files, once each; what isn't a triple is left out. Split by lines, so files may be of any size."""
    line = r"^\s*(?:<([^>]*)>|(_:\S+))\s+<([^>]*)>\s+(?:<([^>]*)>|(_:\S+)|\"((?:[^\"\\]|\\.)*)\"\S*)\s*\.\s*$"
    part = lambda i: F.regexp_extract("value", line, i)
    return spark.read.text(path).where(F.col("value").rlike(line)).select(F.concat(part(1), part(2)).alias("s"), part(3).alias("p"), F.concat(part(4), part(5), part(6)).alias("o")).distinct()


def lookup(triples: DataFrame) -> DataFrame:
    """Classes and individuals by their local name: category (classes or individuals), key, uri. Of equal keys the least uri counts."""
    classes = triples.where((F.col("p") == TYPE) & (F.col("o") == CLASS)).select(F.col("s").alias("uri")).distinct()
    ones = triples.where(F.col("p") == TYPE).join(classes.withColumnRenamed("uri", "o"), "o", "left_semi").select(F.col("s").alias("uri")).distinct()
    both = classes.withColumn("category", F.lit("classes")).unionByName(ones.withColumn("category", F.lit("individuals")))
    return both.groupBy("category", named(F.col("uri")).alias("key")).agg(F.min("uri").alias("uri"))


def matched(names: DataFrame, table: DataFrame, category: str, column: str = "name", cutoff: float = CUTOFF) -> DataFrame:
    """names with the closest key of a category (match) and its uri, null if none is close enough. The keys stay distributed and are stored once, as they are read several times."""
    known = cut(table.where(F.col("category") == category).select("key", "uri"))
    keyed = names.withColumn("__key", F.replace(F.lower(F.trim(column)), F.lit(" "), F.lit("_")))
    found = closest_in(keyed, known.select("key"), "__key", cutoff).drop("__key")
    return found.join(known.select(F.col("key").alias("match"), "uri"), "match", "left").select(*names.columns, "match", "uri")


def around(triples: DataFrame, start: str, directed: bool = True) -> tuple[DataFrame, DataFrame]:
    """What can be reached from a uri by types, superclasses and object properties (against them too unless directed): nodes (uri, key, depth) and edges (src, rel, dst)."""
    properties = triples.where((F.col("p") == TYPE) & (F.col("o") == OBJECT_PROPERTY)).select(F.col("s").alias("p"))
    steps = triples.where(F.col("p").isin(TYPE, SUBCLASS) & ~F.col("o").isin(CLASS, OBJECT_PROPERTY, f"{OWL}NamedIndividual")).unionByName(triples.join(properties, "p", "left_semi").select("s", "p", "o")).distinct()
    steps = cut(steps)
    seen = frontier = cut(steps.sparkSession.createDataFrame([(start, 0)], "uri string, depth int"))
    depth = 0
    while not frontier.isEmpty():
        depth += 1
        out = steps.join(frontier.select(F.col("uri").alias("s")), "s", "left_semi").select(F.col("o").alias("uri"))
        if not directed:
            out = out.union(steps.join(frontier.select(F.col("uri").alias("o")), "o", "left_semi").select("s"))
        frontier = cut(out.distinct().join(seen, "uri", "left_anti").withColumn("depth", F.lit(depth)))
        seen = seen.unionByName(frontier)
    inside = steps.join(seen.select(F.col("uri").alias("s")), "s", "left_semi").join(seen.select(F.col("uri").alias("o")), "o", "left_semi")
    return seen.select("uri", named(F.col("uri")).alias("key"), "depth"), inside.select(F.col("s").alias("src"), named(F.col("p")).alias("rel"), F.col("o").alias("dst"))
