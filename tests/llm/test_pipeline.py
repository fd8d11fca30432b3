import corpus_pipeline as C
import pytest
from weftgraph.llm import queries

DIR = "/root/testdata/sf0.001"


def test_stages_keep_the_columns_and_do_their_work(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    names = [n for n, _ in C.STAGES]
    assert names == ["toxicity", "line_dedup", "near_dedup", "decontamination", "sentencepiece"]
    left = docs.count()
    for name, stage in C.STAGES:
        out = C.stored(stage(spark, docs, d), f"test-{name}")
        n = out.count()
        assert 0 < n <= left and out.columns == docs.columns + (["ids"] if name == "sentencepiece" else [])
        docs, left = out, n
    assert left == C.run(spark, d).count()


def test_every_query_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 11))


@pytest.mark.parametrize("name", ["op2_html_extract", "op8_decontaminate"])
def test_queries_run(spark, name):
    assert queries.queries()[name](spark, "/root/testdata/sf0.001").count() > 0


def odd_documents(spark):
    """Nulls in any column, empty and very long texts, ties and repeated rows, and extra columns with names that the operators use inside."""
    real = spark.read.parquet(f"{DIR}/documents.parquet").limit(60)
    rows = [(None, None, None, None, None), (None, "some words here", "en", "s", 15), (90001, None, "en", None, None), (90002, "", None, "s", 0), (90003, "x", "en", "s", 1), (90003, "x", "en", "s", 1), (90004, "long words " * 40000, "en", "s", None), (90005, " \n\t ", "en", "s", 4)]
    odd = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return real.select(*odd.columns).unionAll(odd).selectExpr("*", "1 AS id", "'k' AS key", "2 AS spans", "3 AS a", "4 AS component", "'t' AS __id", "5 AS h", "'x' AS item_id")


@pytest.mark.parametrize("name, stage", C.STAGES)
def test_stages_take_odd_rows_and_keep_columns(spark, name, stage):
    docs = odd_documents(spark)
    out = stage(spark, docs, DIR)
    assert out.columns[: len(docs.columns)] == docs.columns if name == "sentencepiece" else out.columns == docs.columns
    ids = [r.doc_id for r in out.select("doc_id").collect()]
    assert {90001, 90002, 90003} <= set(ids) and ids.count(None) >= 2  # clean odd rows stay
    if name in ("toxicity", "decontamination", "sentencepiece"):
        assert ids.count(90003) == 2
    empty = stage(spark, docs.where("doc_id < 0"), DIR)
    assert empty.columns == out.columns and empty.count() == 0
