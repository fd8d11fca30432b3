import uuid

import pytest
from pyspark.sql import functions as F

from weftgraph.functions import ids, text
from weftgraph.operators import catalog, chunking, evaluation, feedback, graph, lexical, matching, models, ontology, rag, reasoning, search, versioning
from weftgraph.plans import dispatch, pipelines
from weftgraph.plans.hybrid import HybridQueryBuilder
from weftgraph.sources import files
from weftgraph.streaming import events

TEXT = "This is a sentence. And another one! Is this the third?\nA new paragraph begins here; it goes on … and ends。 Last words without a stop"


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_uuid5_equals_the_standard_library(spark):
    names = ["Alice", "O'Brien in Zürich", "漢字 x", ""]
    found = table(spark, [(n,) for n in names], "n string").select("n", ids.uuid5(F.col("n")).alias("u"), ids.node_id(F.col("n")).alias("v")).collect()
    for r in found:
        assert r.u == str(uuid.uuid5(uuid.NAMESPACE_OID, r.n))
        assert r.v == str(uuid.uuid5(uuid.NAMESPACE_OID, r.n.lower().replace(" ", "_").replace("'", "")))


def golden(spark, connected=True):
    nodes = ["doc", "chunk", "a", "b", "type"] + ([] if connected else ["doc2", "chunk2", "c", "type2"])
    edges = [("chunk", "doc", "is_part_of"), ("chunk", "a", "contains"), ("chunk", "b", "contains"), ("a", "type", "is_a"), ("b", "type", "is_a")]
    edges += [("chunk", "chunk", "contains")] if connected else [("chunk2", "doc2", "is_part_of"), ("chunk2", "c", "contains"), ("c", "type2", "is_a")]
    return table(spark, [(n, "t", n) for n in nodes], "id string, type string, name string"), table(spark, edges, "src string, dst string, rel string")


def test_golden_metrics(spark):
    r = graph.metrics(*golden(spark)).first()
    assert (r.num_nodes, r.num_edges, r.mean_degree, r.edge_density, r.num_components, r.largest_component, r.num_selfloops) == (5, 6, 2.4, 0.3, 1, 5, 1)
    r = graph.metrics(*golden(spark, False)).first()
    assert (r.num_nodes, r.num_edges, round(r.mean_degree, 4), round(r.edge_density, 4), r.num_components, r.largest_component) == (9, 8, 1.7778, 0.1111, 2, 5)
    nodes, edges = golden(spark)
    paths = graph.path_lengths(edges, nodes).collect()
    assert max(p.distance for p in paths) == 3 and sum(p.distance for p in paths) / len(paths) == 1.6
    assert all(r.coefficient == 0 for r in graph.clustering(edges).collect())


def test_triplet_ranking_and_penalties(spark):
    edges = table(spark, [("1", "2", "edge1"), ("2", "3", "edge2"), ("3", "4", "edge3")], "src string, dst string, rel string")
    nodes = table(spark, [("1", 0.9), ("2", 0.8), ("3", 0.7), ("4", 0.6)], "id string, distance double")
    rels = table(spark, [("edge1", 0.85), ("edge2", 0.75), ("edge3", 0.65)], "id string, distance double")
    assert [r.rel for r in graph.top_triplets(edges, nodes, rels, 2).collect()] == ["edge3", "edge2"]
    none = nodes.where("id = 'x'")
    assert [r.score for r in graph.top_triplets(edges, none, none, 1).collect()] == [3 * graph.PENALTY]


def test_document_subgraph_and_deletion(spark):
    edges = table(
        spark,
        [("c1", "d1", "is_part_of"), ("c2", "d2", "is_part_of"), ("c1", "shared", "contains"), ("c2", "shared", "contains"), ("c1", "own", "contains")],
        "src string, dst string, rel string",
    )
    found = {(r.id, r.role) for r in graph.document_subgraph(edges, "d1").collect()}
    assert found == {("d1", "document"), ("c1", "chunk"), ("own", "orphan_entity")}
    nodes = table(spark, [(n, "t", n) for n in ("c1", "c2", "d1", "d2", "shared", "own")], "id string, type string, name string")
    left, kept = graph.without_nodes(nodes, edges, table(spark, [("c1",), ("own",)], "id string"))
    assert {r.id for r in left.collect()} == {"c2", "d1", "d2", "shared"} and kept.count() == 2
    assert graph.checked_edges(nodes, edges, table(spark, [("d1", "d2", "x"), ("d1", "nobody", "x"), ("c1", "d1", "is_part_of")], edges.schema)).count() == 6


def test_upsert_keeps_the_last_and_the_time_of_creation(spark):
    old = table(spark, [("a", 1, 1, "x"), ("b", 1, 1, "y")], "id string, created_at int, updated_at int, name string")
    new = table(spark, [("a", 2, 2, "p", 1), ("a", 3, 3, None, 2), ("c", 2, 2, "z", 1)], "id string, created_at int, updated_at int, name string, seq int")
    found = {tuple(r) for r in graph.merged_nodes(old, new, order="seq").collect()}
    assert found == {("a", 1, 3, None), ("b", 1, 1, "y"), ("c", 2, 2, "z")}


def test_chains(spark):
    edges = table(spark, [("a", "b", "R"), ("b", "c", "R"), ("c", "d", "R"), ("d", "a", "R"), ("a", "c", "R"), ("a", "b", "S"), ("b", "c", "S")], "src string, dst string, rel string")
    found = {(r.src, r.dst, r.depth) for r in reasoning.transitive(edges, ["R"], table(spark, [("a",)], "id string"), 3).collect()}
    assert found == {("a", "d", 2)}
    assert reasoning.transitive(edges, ["S"]).count() == 1
    assert {(r.src, r.dst) for r in reasoning.symmetric(edges, ["S"]).collect()} == {("b", "a"), ("c", "b")}


@pytest.mark.parametrize("most", [1, 3, 8, 100])
def test_chunks_join_to_the_text(most):
    for t in (TEXT, "", "word", "a. b. c.\n\nd", " lead and trail "):
        assert "".join(w for w, _ in chunking.words_of(t)) == t
        for batch in (True, False):
            parts = list(chunking.paragraphs_of(t, most, batch))
            assert "".join(p for _, p, _, _ in parts) == t
            assert [k for k, *_ in parts] == list(range(len(parts))) and all(n <= most for _, _, n, _ in parts)
    assert [c for _, c, _, _ in chunking.rows_of("a: 1, b: 2, c: 3\n\na: 4", 2)] == ["a: 1, b: 2", "c: 3", "a: 4"]


def test_overlapping_chunks():
    t = " ".join(f"w{k}." for k in range(40))
    parts = [c for _, c, _, _ in chunking.overlapping_of(t, 10, 0.4)]
    assert all(a.split()[-1] in b for a, b in zip(parts, parts[1:], strict=False)) and set(" ".join(parts).split()) == set(t.split())


def test_windows(spark):
    r = table(spark, [("abcdefghij",)], "t string").select(chunking.exact_windows(F.col("t"), 4, 1).alias("a"), chunking.exact_windows(F.lit(""), 4).alias("b")).first()
    assert r.a == ["abcd", "defg", "ghij", "j"] and r.b == []


def test_lexical_scores(spark):
    chunks = table(spark, [("1", "apple banana banana"), ("2", "apple cherry"), ("3", "the of"), ("4", "")], "id string, text string")
    assert [(r.id, round(r.score, 3)) for r in lexical.search(chunks, "banana apple").collect()] == [("1", 1.0), ("2", 0.333)]
    assert [(r.id, round(r.score, 3)) for r in lexical.search(chunks, "banana apple", scorer=lexical.multiset_jaccard).collect()] == [("1", 0.667), ("2", 0.333)]


def test_answer_metrics(spark):
    rows = table(spark, [("1", "Paris is big", "paris"), ("2", "", ""), ("3", "a", ""), ("4", " Yes ", "yes")], "id string, a string, g string")
    assert {r.id: round(r.f1, 3) for r in text.token_f1(rows, "id", "a", "g").collect()} == {"1": 0.5, "2": 1.0, "3": 0.0, "4": 1.0}
    assert {r.id: r.e for r in rows.select("id", text.exact_match(F.col("a"), F.col("g")).alias("e")).collect()} == {"1": 0.0, "2": 1.0, "3": 0.0, "4": 1.0}
    assert text.frequent_words(table(spark, [("1", "b a b, c a b d")], "id string, t string"), "id", "t").first().words == "b, c, d"


def test_grounding(spark):
    context = table(spark, [("e1", "Alpha", "Alpha is the first letter of the alphabet."), ("e2", "Beta", "Beta tests come late.")], "entity_id string, name string, content string")
    answers = table(spark, [("q", "Alpha is the first letter of the alphabet. Beta is odd. Nothing known here.")], "id string, text string")
    claimed = rag.claims(answers)
    links = {(r.claim_index, r.entity_id): (r.kind, r.confidence) for r in rag.provenance(claimed, context).collect()}
    assert links == {(0, "e1"): ("quote", 0.95), (1, "e2"): ("mention", 0.6)}
    r = rag.coverage(rag.grounded(claimed, rag.provenance(claimed, context))).first()
    assert (round(r.coverage, 3), r.n_claims) == (0.667, 3)
    risk = table(spark, [(0, 0, 0), (0, 0, 4), (3, 1, 4), (1, 0, 4)], "u int, c int, n int").select(rag.risk(F.col("u"), F.col("c"), F.col("n")).alias("r")).collect()
    assert [round(x.r, 3) for x in risk] == [1.0, 0.0, 0.75, 0.15]


def test_hallucinations_and_corrections(spark):
    context = table(spark, [("e1", "Alpha", "Alpha is the first letter of the alphabet.")], "entity_id string, name string, content string")
    claimed = rag.claims(table(spark, [("q", "Alpha is the first letter of the alphabet. Zorro is odd. nothing known here.")], "id string, text string"))
    links = rag.provenance(claimed, context)
    found = rag.detections(rag.grounded(claimed, links), rag.fabricated(rag.mentions(claimed), context))
    assert {r.claim_index: (r.detection, r.severity) for r in found.collect()} == {0: (None, None), 1: ("fabricated_entity", "critical"), 2: ("ungrounded", "warning")}
    r = rag.answer_risks(found).first()
    assert round(r.risk, 6) == round(0.6 * 2 / 3 + 0.4 / 3 + 0.2, 6) and not r.is_trustworthy
    assert rag.annotated(rag.grounded(claimed, links), rag.citation_numbers(links)).first().text == "Alpha is the first letter of the alphabet. [1] Zorro is odd. nothing known here."
    assert rag.corrected(found).first().text == "Alpha is the first letter of the alphabet. nothing known here. Some statements were removed, as nothing supports them."


def test_reasoning_modes(spark):
    v = table(spark, [("a", "t", [1.0, 0.0]), ("b", "t", [0.9, 0.1]), ("c", "u", [0.0, 1.0])], "id string, type string, vector array<float>")
    edges = table(spark, [("a", "b", "R"), ("b", "c", "R"), ("a", "c", "S")], "src string, dst string, rel string")
    kinds = lambda mode: {(r.kind, r.dst) for r in reasoning.reasoned(v, edges, "a", ["R"], ["S"], ["u"], mode).collect()}
    assert kinds("graph_only") == {("transitive", "c"), ("symmetric", "a")} and kinds("vector_only") == {("suggested", "c")}
    assert kinds("hybrid") == kinds("graph_only") | kinds("vector_only")
    with pytest.raises(ValueError):
        kinds("nonsense")
    assert {(r.id, r.hop) for r in reasoning.hops(v, edges.where("rel = 'R'"), "a", 2, 1).collect()} == {("a", 0), ("b", 1), ("c", 2)}


def test_ontologies(spark):
    P, C = ontology.Property, ontology.Constraint
    one = ontology.Ontology({"A": ontology.EntityType({"x": P("integer", True)}), "B": ontology.EntityType({"y": P("string", False, (C("enum", ("p", "q")),))}, ("A",))}, {"r": ontology.RelationType(("A",), ("B",))})
    rows = table(spark, [("1", "p"), (None, "z"), ("u", None)], "x string, y string")
    assert [r.validation_errors for r in ontology.validated(rows, one, "B").collect()] == [[], ["y: enum", "x: missing"], ["x: not integer"]]
    assert ("r", "B", "B") in one.allowed() and ("r", "B", "A") not in one.allowed()
    two = ontology.Ontology({"A": ontology.EntityType({"x": P("integer", True), "z": P(required=True)})}, {})
    changes = ontology.evolution(one, two)
    assert ("entity:B", "removed", "major") in changes and ontology.next_version("1.2.3", changes) == "2.0.0" and ontology.next_version("1.2.3", []) == "1.2.4"
    with pytest.raises(ValueError):
        ontology.migrated(rows, [("nonsense", "x")])


def test_versions(spark):
    maps = table(spark, [("e", 1, {"a": "1", "b": "2"}), ("e", 2, {"a": "1", "c": "3"})], "id string, version_number int, p map<string,string>")
    r = versioning.differences(maps, "id", "p").where("version_number = 2").first()
    assert [(c.name, c.change) for c in r.changes] == [("b", "removed"), ("c", "added")] and r.description == "b, c"
    history = maps.withColumn("ts", F.lit("2024-01-01").cast("timestamp")).withColumn("change_type", F.lit("update"))
    again = versioning.restored(history, "id", 1, F.current_timestamp()).where("version_number = 3").first()
    assert again.p == {"a": "1", "b": "2"} and again.change_type == "restore"


def test_hybrid_queries_are_checked():
    with pytest.raises(ValueError):
        HybridQueryBuilder().build()
    with pytest.raises(ValueError):
        HybridQueryBuilder().with_vector([1.0]).with_weights(0.9, 0.9).build()
    assert HybridQueryBuilder().graph_only("x").build().graph_weight == 1


def test_vector_search(spark):
    v = table(spark, [("a", "t", [1.0, 0.0]), ("b", "t", [0.0, 1.0]), ("c", "u", [1.0, 1.0]), ("z", "u", [0.0, 0.0])], "id string, type string, vector array<float>")
    assert {r.id: r.distance for r in search.nearest(v, [1.0, 0.0], None).collect()} == {"a": 0.0, "c": 1.0, "z": 1.0, "b": 2.0} and search.nearest(v, [1.0, 0.0], 0).count() == 0
    assert [r.distance for r in search.nearest(v, [1.0, 0.0], 1, normalised=True).collect()] == [0.0]
    assert [r.id for r in search.most_similar(v, [1.0, 0.0], 10, 0.5).collect()] == ["a", "c"]
    with pytest.raises(KeyError):
        search.vector_of(v, "nobody")
    best = [{(r.query, r.id, r.rank) for r in search.batch_nearest(v, v, 2, max_queries=n).collect()} for n in (1, 2, 100)]
    assert best[0] == best[1] == best[2] and len(best[0]) == 2 * v.count()


def test_bootstrap(spark):
    rows = table(spark, [("m", float(k % 10)) for k in range(200)] + [("m", None)], "metric string, score double")
    r = catalog.bootstrap(rows, "metric", "score", samples=300).first()
    assert r["mean"] == 4.5 and 3.8 < r.low < 4.5 < r.high < 5.2


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("hello")
    (tmp_path / "b.csv").write_text('id,name\n1,"x, y"\n')
    (tmp_path / "c.bin").write_bytes(b"a\x00b")
    assert files.read_any(spark, str(tmp_path / "a.txt")).first().text == "hello"
    assert files.read_any(spark, str(tmp_path / "b.csv")).first().text == "id: 1, name: x, y"
    assert {r.extension: r.is_text for r in files.read_binary(spark, str(tmp_path)).collect()} == {"txt": True, "csv": True, "bin": False}


def test_streams_equal_batches(spark, tmp_path):
    source = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    source.orderBy("ts").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = events.event_stream(spark, str(tmp_path / "in"), source.schema)
    q = events.windowed_counts(stream).writeStream.format("memory").queryName("windowed").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {tuple(r) for r in spark.table("windowed").select("window_start", "event_type", "n").collect()} == {tuple(r) for r in events.windowed_counts(source).select("window_start", "event_type", "n").collect()}
    q = events.recent_entries(stream, "user_id", "ts", "event_type").writeStream.format("memory").queryName("recent").outputMode("update").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    last = {r.key: r.entries.split("\n")[-1] for r in spark.table("recent").collect()}
    expected = {r.user_id: r.t for r in source.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_type")).alias("t")).collect()}
    assert last == expected
    events.ingested(stream, str(tmp_path / "out"), str(tmp_path / "check2")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == source.count()


def test_ontology_data_and_problems():
    data = {"entity_types": {"A": {"properties": {"x": {"type": "integer", "required": True, "constraints": [{"type": "range", "value": (1, 2)}]}}}, "B": {"inherits_from": ["A", "Z"]}}, "relation_types": {"r": {"sources": ["Q"], "inverse_of": "s"}}}
    one = ontology.Ontology.from_dict(data)
    assert one.problems() == ["B: unknown parent Z", "r: unknown inverse s", "r: unknown type Q"]
    assert ontology.Ontology.from_dict(one.to_dict()) == one
    assert ontology.Ontology({"A": ontology.EntityType(parents=("B",)), "B": ontology.EntityType(parents=("A",))}, {}).problems() == ["A: inherits from itself", "B: inherits from itself"]


def test_fuzzy_matching(spark):
    found = matching.closest(table(spark, [("1", "person"), ("2", "persn"), ("3", "car"), ("4", None)], "id string, name string"), ["person", "place"])
    assert {r.id: r.match for r in found.collect()} == {"1": "person", "2": "person", "3": None, "4": None}


def test_nested_records(spark):
    rows = spark.createDataFrame([(1, "a", [(10, "x"), (11, "y")]), (2, "b", [(10, "x")]), (3, "c", None)], "id int, name string, parts array<struct<k:int,v:string>>")
    nodes, edges = models.flattened(rows, "thing", "id", {"parts": ("part", "k")})
    assert {r.id for r in nodes.collect()} == {"thing:1", "thing:2", "thing:3", "part:10", "part:11"}
    assert {(r.src, r.dst) for r in edges.collect()} == {("thing:1", "part:10"), ("thing:1", "part:11"), ("thing:2", "part:10")}
    assert {r.id: r["items"] for r in models.nested(nodes, edges, "parts").collect()}["thing:1"] == ["part:10", "part:11"]
    assert models.flattened(rows.drop("parts"), "thing", "id")[1].count() == 0


def test_pipelines_record_and_skip(spark, tmp_path):
    items = table(spark, [(1,), (2,)], "id int")
    good = pipelines.Pipeline("double", (lambda df: df.withColumn("x", F.col("id") * 2), lambda df: df.where("x > 2")))
    out, log = str(tmp_path / "out"), str(tmp_path / "log")
    assert [r.x for r in pipelines.run(good, items, out, log, "main", 1).collect()] == [4]
    assert not pipelines.may_run(pipelines.runs(spark, log), "double", "main")
    with pytest.raises(Exception, match="nothing"):
        pipelines.run(pipelines.Pipeline("bad", (lambda df: df.select("nothing"),)), items, out, log, "main", 2)
    assert pipelines.may_run(pipelines.runs(spark, log), "bad", "main")
    done = table(spark, [(1, "p", "main", "COMPLETED"), (2, "p", "other", "COMPLETED")], "id int, pipeline string, dataset string, status string")
    assert [r.id for r in pipelines.pending(items, done, "id", "p", "main").collect()] == [2]


def test_dispatch(spark):
    texts = table(spark, [("1", "apple pie"), ("2", "pear")], "id string, text string")
    assert dispatch.context(dispatch.run("CHUNKS_LEXICAL", texts=texts, query="apple")).first().context.startswith("apple pie")
    with pytest.raises(ValueError):
        dispatch.run("NONSENSE")


def test_evaluation_and_feedback(spark):
    answers = table(spark, [("1", "yes", "yes"), ("2", "a b", "a c")], "id string, answer string, golden_answer string")
    assert {(r.id, r.EM, r.F1) for r in evaluation.evaluated(answers, ["EM", "F1"]).collect()} == {("1", 1.0, 1.0), ("2", 0.0, 0.5)}
    with pytest.raises(ValueError):
        evaluation.evaluated(answers, ["X"])
    assert [r.id for r in evaluation.sampled(answers, 1).collect()] == [r.id for r in evaluation.sampled(answers.repartition(3), 1).collect()]
    node, edges = feedback.interaction("q", "a", "c", table(spark, [("x", "y"), ("y", "z")], "src string, dst string"))
    assert node.count() == 1 and {r.dst for r in edges.collect()} == {"x", "y", "z"}
