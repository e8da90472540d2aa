import importlib
import sys

import __spark_entry__ as entry


def test_every_query_of_the_relational_part_has_sql():
    from tarn.plans import catalogue

    assert set(catalogue.SQL) == set(catalogue.QUERIES) and set(catalogue.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_it_works_without_the_corpus_part(monkeypatch):
    for name in [m for m in sys.modules if m == "corpus_pipeline" or m.startswith("tarn.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    found = importlib.reload(entry)
    assert "seq_scan" in found.queries() and not any(k.startswith("op") and k[2].isdigit() for k in found.queries())
    monkeypatch.undo()
    importlib.reload(entry)
