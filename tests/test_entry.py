"""The driver contract: entry() runs on sf0.001; every oracle belongs to a
registered query."""

import sys

import __spark_entry__ as entry


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert "summary" in df.columns and "document_type" in df.columns


def test_oracle_keys_are_queries():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 80


def test_other_queries_without_what_the_training_data_part_needs(monkeypatch):
    for name in list(sys.modules):
        if name == "corpus_pipeline" or name.startswith("clauselake.llm"):
            monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "zstandard", None)
    q = entry.queries()
    assert len(q) >= 89 and set(entry.oracle_sql()) <= set(q)
    assert "pipeline" not in q and not any(n.startswith("op") for n in q)
