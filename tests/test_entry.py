"""The driver's contract, with and without the optional subpackage."""

import importlib
import sys

from tessaria.plans import catalog


def test_contract():
    import __spark_entry__ as e

    assert set(catalog.QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())


def test_without_the_subpackage(monkeypatch):
    import __spark_entry__ as e

    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)  # import raises ImportError
    again = importlib.reload(e)
    assert set(again.queries()) == set(catalog.QUERIES) and set(again.oracle_sql()) == set(catalog.ORACLE)
    monkeypatch.undo()
    importlib.reload(e)
