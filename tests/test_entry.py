import importlib
import sys

import __spark_entry__


def test_entry_gives_rows(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["book", "page", "group_start", "n_units", "chars"] and df.count() > 0


def test_every_sql_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_works_without_the_optional_part(monkeypatch):
    for name in [n for n in sys.modules if n.startswith("folioflow.llm") or n == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "folioflow.llm", None)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    monkeypatch.delitem(sys.modules, "__spark_entry__")
    bare = importlib.import_module("__spark_entry__")
    names = set(bare.queries())
    assert "merge_groups" in names and not any(n.startswith("op") and n[2].isdigit() or n == "pipeline" for n in names)
    assert set(bare.oracle_sql()) <= names
