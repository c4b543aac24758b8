"""The driver's contract, with the training-data subpackage and without."""

import importlib
import sys

import __spark_entry__ as entry


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() and "WeightedPhotoPes" in df.columns
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_without_the_subpackage(monkeypatch):
    for name in ("tidemark.llm", "tidemark.llm.queries", "corpus_pipeline"):
        monkeypatch.setitem(sys.modules, name, None)
    alone = importlib.reload(entry)
    assert "daily_image_index" in alone.queries() and not any(n.startswith("op") or n == "pipeline" for n in alone.queries())
    monkeypatch.undo()
    importlib.reload(entry)
