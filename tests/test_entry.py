from pathlib import Path

import __spark_entry__


def test_nothing_else_imports_the_corpus_operators():
    root = Path(__spark_entry__.__file__).parent / "weftgraph"
    for path in root.rglob("*.py"):
        if root / "llm" not in path.parents:
            assert "llm" not in path.read_text(), path


def test_entry_and_registries(spark):
    assert __spark_entry__.entry(spark).count() == 5
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
