import datetime
import difflib
import json
import random

import pytest
from pyspark.sql import functions as F

from weftgraph.functions import ids, text
from weftgraph.operators import audit, catalog, chunking, embeddings, evolution, extraction, graph, guided, matching, models, rag, rdf, retrieval, versioning
from weftgraph.operators.ontology import EntityType, Ontology, Property, RelationType
from weftgraph.plans import hybrid
from weftgraph.sources import files, tables

XML = """<?xml version="1.0"?><rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:owl="http://www.w3.org/2002/07/owl#" xmlns:rdfs="http://www.w3.org/2000/01/rdf-schema#" xmlns:e="http://e.org/#" xml:base="http://e.org/">
<owl:Class rdf:about="http://e.org/#Car"><rdfs:subClassOf rdf:resource="http://e.org/#Vehicle"/></owl:Class><owl:Class rdf:about="http://e.org/#Vehicle"/>
<owl:Class rdf:ID="Maker"/><owl:ObjectProperty rdf:about="http://e.org/#made_by"/>
<e:Car rdf:about="http://e.org/#Audi A4"><e:made_by><e:Maker rdf:about="http://e.org/#Audi AG"/></e:made_by><rdfs:label>Audi A4</rdfs:label></e:Car>
<rdf:Description rdf:about="http://e.org/#Audi AG"><rdfs:label>Audi</rdfs:label></rdf:Description></rdf:RDF>"""


def test_rdf_is_read_and_looked_up(spark, tmp_path):
    (tmp_path / "o.owl").write_text(XML)
    triples = rdf.read_xml(spark, f"file://{tmp_path}/o.owl").cache()
    assert triples.count() == 10 and triples.where(f"s = 'http://e.org/#Maker' AND p = '{rdf.TYPE}'").count() == 1
    (tmp_path / "o.nt").write_text("".join(f"<{r.s}> <{r.p}> " + (f"<{r.o}>" if "://" in r.o else json.dumps(r.o)) + " .\n" for r in triples.collect()) + "# a remark\n")
    assert rdf.read_ntriples(spark, f"file://{tmp_path}/o.nt").exceptAll(triples).count() == 0 == triples.exceptAll(rdf.read_ntriples(spark, f"file://{tmp_path}/o.nt")).count()
    known = rdf.lookup(triples)
    assert {(r.category, r.key) for r in known.collect()} == {("classes", "car"), ("classes", "vehicle"), ("classes", "maker"), ("individuals", "audi_a4"), ("individuals", "audi_ag")}
    names = spark.createDataFrame([("Audi A44",), ("audi a4",), ("boat",)], "name string")
    assert {r.name: r.match for r in rdf.matched(names, known, "individuals").collect()} == {"Audi A44": "audi_a4", "audi a4": "audi_a4", "boat": None}
    nodes, edges = rdf.around(triples, "http://e.org/#Audi A4")
    assert {r.key: r.depth for r in nodes.collect()} == {"audi_a4": 0, "car": 1, "audi_ag": 1, "vehicle": 2, "maker": 2}
    assert {r.rel for r in edges.collect()} == {"type", "subclassof", "made_by"}
    assert {r.key for r in rdf.around(triples, "http://e.org/#Maker", False)[0].collect()} == {"maker", "audi_ag", "audi_a4", "car", "vehicle"}
    with pytest.raises(ValueError):
        list(rdf.triples_of_xml("no xml"))


def test_tables_of_the_catalog(spark):
    schema = f"s{random.randrange(10**9)}"
    try:
        tables.create_table(spark, "people", "id long, name string", schema)
        tables.insert(spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "name string, id long"), "people", schema)
        assert tables.tables(spark, schema) == ["people"] and tables.tables(spark, "nowhere") == []
        assert tables.delete_by_id(spark, "people", 2, schema) == 1 and tables.delete_by_id(spark, "people", 9, schema) == 0
        assert sorted(r.id for r in spark.table(tables.full_name("people", schema)).collect()) == [1, 3]
        tables.drop_table(spark, "people", schema)
        assert tables.tables(spark, schema) == []
    finally:
        tables.drop_schema(spark, schema)
    with pytest.raises(ValueError):
        tables.full_name("a; drop")
    rows = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y"), (4, None)], "id long, at string")
    assert {r.id: r.sole_referrer for r in tables.sole_referrers(rows, "id", F.col("at")).collect()} == {1: False, 2: False, 3: True, 4: True}


def test_plans_are_built_and_taken_back(spark):
    old = Ontology({"A": EntityType({"x": Property("string"), "z": Property("string")})}, {})
    new = Ontology({"A": EntityType({"x": Property("integer"), "y": Property("string", True)})}, {})
    assert evolution.compatibility(old, old) == "fully compatible" and evolution.compatibility(old, new) == "breaking"
    plan = evolution.planned(old, new, "1.2.3", {"y": "none"})
    assert plan.to_version == "2.0.0" and plan.steps == (("add", "y", "none"), ("remove", "z")) and plan.downtime and len(plan.warnings) == 2 and not plan.reversible
    with pytest.raises(ValueError):
        plan.reverse()
    narrower = Ontology({}, {"r": RelationType(("A",))})
    assert evolution.compatibility(Ontology({}, {"r": RelationType()}), narrower) == "breaking" and evolution.compatibility(narrower, Ontology({}, {"r": RelationType()})) == "backward compatible"
    rows = spark.createDataFrame([("A", "1.0.0", {"x": "1"}), ("B", "1.0.0", {"x": "2"}), ("A", "0.1.0", {"x": "3"}), (None, "1.0.0", {"x": "4"})], "type string, version string, properties map<string,string>")
    one = evolution.MigrationBuilder("1.0.0", "1.1.0").for_type("A").rename("x", "w").requires_downtime().build()
    assert sorted((r.version, *r.properties.items()) for r in evolution.applied(rows, one).collect()) == [("0.1.0", ("x", "3")), ("1.0.0", ("x", "2")), ("1.0.0", ("x", "4")), ("1.1.0", ("w", "1"))]
    assert sorted(evolution.rolled_back(evolution.applied(rows, one), one).collect(), key=str) == sorted(rows.collect(), key=str)


def test_audit_events_are_appended(spark, tmp_path):
    at = datetime.datetime(2024, 1, 1, 12)
    rows = spark.createDataFrame([("q", "u", 3, 1.5, at, True, 0.7), ("r", None, 0, 9.0, at, False, 0.1)], "q string, u string, n int, ms double, ts timestamp, ok boolean, risk double")
    path = f"file://{tmp_path}/log"
    audit.append(audit.query_events(rows, "q", "u", "n", "ms", "ts"), path)
    audit.append(audit.rag_events(rows, "q", "u", "risk", "risk", "n", "ts"), path)
    audit.append(audit.migration_events(rows.withColumn("status", F.when(F.col("ok"), "completed").otherwise("failed")), "q", "u", "status", "n", "ms", "ts"), path)
    log = audit.read(spark, path)
    assert {(r.event_type, r.severity) for r in log.collect()} == {("query", "info"), ("rag", "warning"), ("rag", "info"), ("migration", "info"), ("migration", "error")}
    s = audit.stats(log).first()
    assert (s.n_events, s.n_failed, s.n_actors, s.first_ts) == (6, 1, 2, at)


def test_guided_answers_refuse_without_context(spark):
    entities = spark.createDataFrame([(1, "t", "Oslo", "Oslo is a city in Norway", 1.0), (2, "t", "Bergen", "Bergen is rainy", 0.2)], "id long, type string, name string, content string, validity double")
    vectors = spark.createDataFrame([(1, "t", [1.0, 0.0]), (2, "t", [0.0, 1.0])], "id long, type string, vector array<double>")
    edges = spark.createDataFrame([(1, 2, "near")], "src long, dst long, rel string")
    good = guided.explained(guided.answered(guided.retrieved(vectors, entities, edges, [1.0, 0.0]))).first()
    assert good.answer == "Oslo: Oslo is a city in Norway" and good.n_sources == 1 and good.confidence > 0.9 and good.risk == 0 and json.loads(good.explanation)["warnings"] == ["few sources"]
    none = guided.answered(guided.retrieved(vectors, entities, edges, [-1.0, 0.0])).first()
    assert (none.answer, none.confidence, none.risk) == (guided.REFUSAL, 0.0, 1.0)
    assert guided.retrieved(vectors, entities, edges, [1.0, 0.0]).averages().first().n == 2


def test_extraction_is_checked_and_canonical(spark):
    given = F.from_json(F.lit('{"nodes":[{"id":"a","name":"Jon Smith","type":"Persn","description":"d"},{"id":"b","name":"Oslo","type":"City","description":""}],"edges":[{"source":"a","target":"b","relation":"Lives In"},{"source":"a","target":"x","relation":"knows"}]}'), extraction.EXTRACTION)
    chunks = spark.createDataFrame([("c1", "t"), ("c2", "t")], "chunk_id string, text string")
    found = extraction.extracted(chunks, lambda c: given)
    assert all(len(r.extraction.edges) == 1 for r in found.collect())
    nodes, edges = extraction.expanded(found, {"classes": ["person", "City", "Person"], "individuals": ["John Smith"]})
    assert {(r.type, r.name) for r in nodes.collect()} == {("Entity", "John Smith"), ("Entity", "Oslo"), ("EntityType", "Person"), ("EntityType", "City")}
    assert sorted(r.rel for r in edges.collect()) == ["contains"] * 4 + ["is_a"] * 2 + ["lives_in"]
    assert extraction.existing(edges, edges.where("rel = 'is_a'")).count() == 2


def test_provenance_equals_brute_force(spark):
    rnd = random.Random(3)
    words = "the a of rare words that stand in long texts alpha beta gamma delta".split()
    some = lambda n: " ".join(rnd.choice(words) + rnd.choice(["", "", ",", "!"]) for _ in range(n)).strip()
    claims = [(i, 0, some(rnd.randint(1, 9))) for i in range(120)] + [(500, 0, ""), (501, 0, "...")]
    entities = [(i, some(rnd.randint(0, 2)), some(rnd.randint(0, 12))) for i in range(60)]
    bare = lambda t: [w for w in (x.strip(",!.").lower() for x in t.split()) if w]
    expected = set()
    for i, k, c in claims:
        for e, name, content in entities:
            a, b, n = bare(c), bare(content), bare(name)
            inside = lambda x, y: f" {' '.join(x)} " in f" {' '.join(y)} "
            if a and b and (inside(a, b) or inside(b, a)):
                expected.add((i, e, "quote"))
            elif a and len(set(a) & set(b)) / max(len(set(a)), len(set(b))) > 0.4:
                expected.add((i, e, "paraphrase"))
            elif n and inside(n, a):
                expected.add((i, e, "mention"))
    found = rag.provenance(spark.createDataFrame(claims, "id long, claim_index int, claim string"), spark.createDataFrame(entities, "entity_id long, name string, content string"))
    assert {(r.id, r.entity_id, r.kind) for r in found.collect()} == expected and len({x[2] for x in expected}) == 3


def test_as_of_join_equals_brute_force(spark):
    rnd = random.Random(5)
    day = lambda: datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=rnd.randrange(24 * 400))
    left = [(i, rnd.choice([1, 2, 3, None]), day()) for i in range(200)]
    right = [(k, t, v) for v, (k, t) in enumerate(sorted({(rnd.choice([1, 2]), day()) for _ in range(60)}))]
    found = versioning.as_of_join(spark.createDataFrame(left, "id long, k int, ts timestamp_ntz"), spark.createDataFrame(right, "k int, ts timestamp_ntz, v int"), "k", "ts", "ts", "v")
    for r in found.collect():
        assert r.v == max(((t, v) for k, t, v in right if k == r.k and t <= r.ts), default=(None, None))[1]
    assert found.count() == 200


def test_long_paths_and_triangles(spark, monkeypatch):
    calls, own = [], graph.cut
    monkeypatch.setattr(graph, "cut", lambda df: calls.append(1) or own(df))
    path = spark.createDataFrame([(i, i + 1, "r") for i in range(1000)], "src long, dst long, rel string").coalesce(1)
    assert {r.component for r in graph.components(spark.range(1001), path).collect()} == {0} and len(calls) <= 25
    rnd = random.Random(1)
    pairs = {(a, b) for a in range(40) for b in range(a + 1, 40) if rnd.random() < (0.9 if a == 0 else 0.2)}
    near = {x: {b if a == x else a for a, b in pairs if x in (a, b)} for x in range(40)}
    for r in graph.clustering(spark.createDataFrame([(a, b, "r") for a, b in pairs] + [(3, 3, "r")], "src long, dst long, rel string")).collect():
        n = sum((min(a, b), max(a, b)) in pairs for a in near[r.id] for b in near[r.id] if a < b)
        assert r.triangles == n and abs(r.coefficient - 2 * n / (len(near[r.id]) * (len(near[r.id]) - 1))) < 1e-12


def test_document_deletion_by_role(spark):
    edges = [("c1", "d1", "is_part_of"), ("c2", "d2", "is_part_of"), ("c1", "own", "contains"), ("c1", "both", "contains"), ("c2", "both", "contains"), ("own", "t1", "is_a"), ("both", "t2", "is_a"), ("s1", "c1", "made_from")]
    e = spark.createDataFrame(edges, "src string, dst string, rel string")
    nodes = spark.createDataFrame([(x,) for x in "d1 d2 c1 c2 own both t1 t2 s1".split()], "id string")
    left, rest, counts = graph.without_document(nodes, e, "d1")
    assert {r.id for r in left.collect()} == {"d2", "c2", "both", "t2"} and rest.count() == 3
    assert {r.role: r.n for r in counts.collect()} == {"document": 1, "chunk": 1, "summary": 1, "orphan_entity": 1, "orphan_type": 1}


def test_closest_names_equal_the_standard_library(spark):
    rnd = random.Random(2)
    known = ["".join(rnd.choice("abcd") for _ in range(rnd.randint(2, 7))) for _ in range(60)]
    names = ["".join(rnd.choice("abcd") for _ in range(rnd.randint(1, 8))) for _ in range(150)] + [None]
    for r in matching.closest(spark.createDataFrame([(n,) for n in names], "name string"), known).collect():
        assert r.match == (r.name if r.name is None or r.name in known else next(iter(difflib.get_close_matches(r.name, sorted(set(known)), 1, 0.8)), None))


def test_chunkers_join_to_the_text(spark):
    rnd = random.Random(7)
    for _ in range(200):
        t = "".join(rnd.choice(["word ", "x", "\n", "\n\n", "\ndef f", "é", " "]) for _ in range(rnd.randint(0, 60)))
        for most in (1, 5, 20):
            for parts in (list(chunking.characters_of(t, most)), list(chunking.code_of(t, most))):
                assert "".join(p[1] for p in parts) == t and all(0 < p[2] <= most for p in parts) and [p[0] for p in parts] == list(range(len(parts)))
    assert all(len(c) <= 20 for _, c, _, _ in chunking.characters_of("a b c " * 40, 20, 5))
    texts = ["one two, three", "", "  a b", "x!" * 30]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for r in df.select("i", "t", *[chunking.trimmed(F.col("t"), n).alias(f"n{n}") for n in (0, 1, 2, 100)]).collect():
        assert r.n100 == r.t and r.t.startswith(r.n2) and r.n0.strip() == ""
    assert df.select(chunking.trimmed(F.col("t"), 2).alias("x")).collect()[0].x == "one two"


def test_small_functions(spark):
    row = spark.range(1).select(
        ids.valid_dataset_name(F.lit("a_b")).alias("a"), ids.valid_dataset_name(F.lit("a.b")).alias("b"), ids.parsed_id(F.lit("{6BA7B812-9DAD-11D1-80B4-00C04FD430C8}")).alias("c"), chunking.word_size(F.lit("x")).alias("e"), catalog.chosen_search(F.lit("How are A and B related?")).alias("f"),
        ids.dataset_id(F.lit("n"), F.lit(1), F.lit(None)).alias("g"), retrieval.asked_range(F.lit("in 2023 and 2024")).alias("h"), retrieval.asked_range(F.lit("once")).alias("i"),
    ).first()
    assert (row.a, row.b, row.c.value, row.c.is_uuid, row.e, row.f) == (True, False, "6ba7b812-9dad-11d1-80b4-00c04fd430c8", True, 1, "GRAPH_COMPLETION")
    assert row.h.since == datetime.date(2023, 1, 1) and row.h.until == datetime.date(2024, 12, 31) and row.i is None
    rows = spark.createDataFrame([(1, (2, 3), [4], datetime.datetime(2024, 1, 2, 3, 4, 5))], "a int, b struct<c:int,d:int>, e array<int>, f timestamp")
    assert models.own_properties(rows).columns == ["a", "e", "f"] and models.copied_schema(rows.schema, {"g": "string"}, ("b",)).names == ["a", "e", "f", "g"]
    assert json.loads(models.serialised(rows, "a").first().json)["f"] == "2024-01-02T03:04:05"
    assert text.loaded_patterns([{"entity_name": "X", "regex": "a+"}]) == {"X": "a+"}
    for bad in ([{"entity_name": "X"}], [{"entity_name": "X", "regex": "("}]):
        with pytest.raises(ValueError):
            text.loaded_patterns(bad)
    one = spark.createDataFrame([("x.bin", bytearray(b"\x89PNG\r\n")), ("y.bin", bytearray(b"%PDF-1")), ("z.CSV", bytearray(b"a"))], "n string, c binary")
    assert [r.k for r in one.select(files.guessed_kind(F.col("n"), F.col("c")).alias("k")).collect()] == ["image", "pdf", "table"]


def test_valid_entities_alone(spark):
    vectors = spark.createDataFrame([("a", "t", [1.0, 0.0]), ("b", "t", [0.9, 0.1])], "id string, type string, vector array<double>")
    nodes = spark.createDataFrame([("a", "t", False), ("b", "t", True)], "id string, type string, ontology_valid boolean")
    edges = spark.createDataFrame([("a", "b", "r")], "src string, dst string, rel string")
    q = hybrid.HybridQueryBuilder().with_vector([1.0, 0.0])
    assert {r.id for r in hybrid.run(q.build(), vectors, nodes, edges).collect()} == {"a", "b"}
    assert {r.id for r in hybrid.run(q.with_valid_only().build(), vectors, nodes, edges).collect()} == {"b"}


def test_embeddings(spark):
    v = spark.createDataFrame([("one two two",), ("",)], "t string").select(embeddings.hashed(F.col("t"), 16).alias("v")).collect()
    assert abs(sum(x * x for x in v[0].v) - 1) < 1e-9 and v[1].v == [0.0] * 16
    records = spark.createDataFrame([(1, "content", [1.0]), (2, "content", [1.0])], "entity_id long, kind string, vector array<double>")
    assert embeddings.of(records, spark.range(1, 2).withColumnRenamed("id", "entity_id"), "content").count() == 1
    assert [r.entity_id for r in embeddings.without_embedding(spark.range(1, 4).withColumnRenamed("id", "entity_id"), records).collect()] == [3]
