"""What has to hold at larger sizes and on repeated, empty and missing rows."""

import difflib
import itertools
import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weftgraph import queries as Q
from weftgraph.operators import chunking, graph, lexical, matching, rdf, retrieval, search
from weftgraph.sources import files


def test_triangles_are_counted_by_blocks_without_shuffling_arrays(spark, monkeypatch):
    rng = np.random.default_rng(1)
    pairs = {(int(a), int(b)) for a, b in rng.integers(0, 40, (300, 2)) if a < b} | {(0, x) for x in range(1, 40)}
    monkeypatch.setattr(graph, "BLOCK_ENDS", 50)
    df = graph.clustering(spark.createDataFrame([(f"n{a}", f"n{b}", "r") for a, b in pairs], "src string, dst string, rel string"))
    assert "ends" not in df._jdf.queryExecution().toString()
    expected = dict.fromkeys(range(40), 0)
    for t in itertools.combinations(range(40), 3):
        if all(p in pairs for p in itertools.combinations(t, 2)):
            for x in t:
                expected[x] += 1
    assert {r.id: r.triangles for r in df.collect()} == {f"n{x}": n for x, n in expected.items()}


@pytest.mark.parametrize("mask", (0, 1000))
def test_corners_are_the_same_in_small_steps(monkeypatch, mask):
    monkeypatch.setattr(graph, "STEPS", 3)
    monkeypatch.setattr(graph, "MASK", mask)
    ends = [[1, 2, 3, 5], [2, 3, 4], [3, 5], [4, 5]]
    batch = pa.RecordBatch.from_arrays([pa.array(range(4), pa.int32()), pa.array(ends, pa.list_(pa.int32()))], names=["u", "ends"])
    total = np.zeros(6, int)
    for b in range(2):
        row_of = np.array([b_ // 2 if b_ < 4 else -1 for b_ in range(b, 6, 2)], np.int32)
        own = ends[b::2]
        block = type("B", (), {"value": (2, b, row_of, np.cumsum([0, *map(len, own)]), np.array(sum(own, []), np.int32))})
        for out in graph._corners(block, 6)([batch]):
            total[out.column(0).to_numpy()] += out.column(1).to_numpy()
    # 0 1 2, 0 1 3, 0 2 3, 0 2 5, 0 3 5, 1 2 3, 1 3 4, 2 3 5
    assert total.tolist() == [5, 4, 5, 6, 1, 3]


def test_nearest_vectors_equal_those_of_all_pairs(spark, monkeypatch):
    rng = np.random.default_rng(2)
    base = [[float(x) for x in rng.integers(-2, 3, 3)] for _ in range(60)]
    rows = [(i, v) for i, v in enumerate(base)] + [(60 + i, base[0]) for i in range(4)]
    rows += [(70, None), (71, [1.0, None, 2.0]), (72, [0.0, 0.0, 0.0]), (73, [1.0, 2.0]), (74, [2.0, 4.0]), (75, [])]
    v = spark.createDataFrame(rows, "id long, vector array<double>")

    def similarity(a, b):
        if not a or not b or len(a) != len(b) or None in a or None in b or not any(a) or not any(b):
            return None
        return sum(x * y for x, y in zip(a, b, strict=True)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))

    for k, most in ((4, 100), (70, 20)):
        expected = {}
        for q, a in rows:
            scored = sorted((-s if s is not None else math.inf, i) for i, b in rows for s in [similarity(a, b)])
            expected[q] = [i for _, i in scored[:k]]
        found = {}
        for r in sorted(search.batch_nearest(v, v, k, most).collect(), key=lambda r: r.rank):
            found.setdefault(r.query, []).append(r.id)
        assert found == expected


def test_nearest_vectors_are_not_joined_row_by_row(spark):
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 1.0])], "id string, vector array<float>")
    found = search.batch_nearest(v, v, 1)
    assert "NestedLoopJoin" not in found._jdf.queryExecution().toString()
    assert [(r.query, r.id) for r in found.orderBy("query").collect()] == [("a", "a"), ("b", "b")]


def test_scores_per_entity_are_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    scores = spark.createDataFrame([(1, "a", 0.5)], "query long, id string, distance double").mapInArrow(counted, "query long, id string, distance double")
    edges = spark.createDataFrame([("a", "b", "r"), ("c", "a", "r")], "src string, dst string, rel string")
    assert retrieval.per_entity(edges, scores).count() == 2
    assert made.value == 1


def test_each_page_is_fetched_once_also_where_urls_repeat(spark):
    pages = spark.createDataFrame([(1, "http://a/x"), (2, "http://a/x"), (3, "http://a/w"), (4, "http://b/x")], "page_id long, url string")
    found = files.crawl_times(pages, spark.createDataFrame([("http://b", 5.0)], "base_url string, delay double"))
    assert sorted((r.page_id, r["at"]) for r in found.collect()) == [(1, 1.0), (2, 2.0), (3, 0.0), (4, 0.0)]


def test_crawl_times_query_has_a_row_for_each_page(spark, tmp_path):
    spark.createDataFrame([(1, "http://a/x"), (2, "http://a/x")], "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    assert sorted((r.page_id, r["at"]) for r in Q.queries()["crawl_times"](spark, str(tmp_path)).collect()) == [(1, 0.0), (2, 1.0)]


def test_rows_are_numbered_once_each_over_many_ranges(spark):
    rows = spark.range(20_000).select(((F.col("id") * 7919) % 20_000).alias("k"), F.rand().alias("place"))
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "16")
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "24k")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.parallelismFirst", "false")
        found = files.csv_text(rows, ["k"], "k").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.parallelismFirst")
        for k, v in old.items():
            spark.conf.set(k, v)
    assert sorted((r.number, r.text) for r in found) == [(i + 1, f"Row {i + 1}: k: {i}") for i in range(20_000)]


@pytest.mark.parametrize("query", ("character_chunks", "code_chunks"))
def test_joined_chunks_give_each_row_of_documents(spark, tmp_path, query):
    rows = [(1, "one two " * 100), (1, "x\n\ndef y" * 90), (2, ""), (3, None), (4, " ")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(map(tuple, Q.queries()[query](spark, str(tmp_path)).collect()), key=repr) == sorted(rows, key=repr)


def test_chunks_are_made_in_short_batches(spark):
    docs = spark.createDataFrame([(i, "word. " * 300) for i in range(1200)], "doc_id long, text string").coalesce(1)
    chunks = chunking.chunked(docs, "paragraph", 10)
    assert "MapInPandas" not in chunks._jdf.queryExecution().toString()
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= chunking.BATCH_ROWS
    assert chunks.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "text"))), lambda x: x["text"]), "").alias("t")).where(F.col("t") == "word. " * 300).count() == 1200


def test_more_names_than_fit_in_one_list_are_matched(spark, monkeypatch):
    monkeypatch.setattr(matching, "MOST_CANDIDATES", 2)
    monkeypatch.setattr(matching, "MOST_NAMES", 2)
    known = [f"customer_{i}" for i in range(40)] + ["nation_1", "straße"]
    names = ["customer_7", "custmer_8", "customer_99", "natoin_1", "zzz", "strasse", "", None, "customer_"]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "id int, name string")
    found = {r.id: r.match for r in matching.closest(df, known).collect()}
    near = lambda n: n if n is None or n in known else next(iter(difflib.get_close_matches(n, known, 1, matching.CUTOFF)), None)
    assert found == {i: near(n) for i, n in enumerate(names)}
    table = spark.createDataFrame([("individuals", k, f"u#{k}") for k in known], "category string, key string, uri string")
    assert {r.id: r.uri for r in rdf.matched(df, table, "individuals").collect()} == {i: n and near(n) and f"u#{near(n)}" for i, n in enumerate(names)} | {6: None}


def test_a_query_is_cut_into_tokens_once(spark):
    chunks = spark.createDataFrame([(1, "red red blue"), (2, "green"), (3, "red blue blue")], "id int, text string")
    found = lexical.search(chunks, "red blue blue", scorer=lexical.multiset_jaccard)
    assert "red blue blue" not in found._jdf.queryExecution().analyzed().toString()
    assert [(r.id, r.score) for r in found.collect()] == [(3, 1.0), (1, 0.5), (2, 0.0)]
    assert [r.score for r in lexical.search(chunks, "", scorer=lexical.multiset_jaccard).collect()] == [0.0] * 3
