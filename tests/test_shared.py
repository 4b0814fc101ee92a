"""The shared folder and what is written there."""

import importlib
import sys

import pytest


def test_tables_are_read_back_and_dropped(spark):
    from panelweave.functions import shared

    shared.drop_settled(spark)
    df = shared.settle(spark.range(7), "t")
    assert df.count() == 7 and shared.drop_settled(spark) == 1 and shared.drop_settled(spark) == 0


def test_tables_made_once(spark):
    from panelweave.functions import shared

    made = []
    make = lambda: made.append(1) or spark.range(3)
    shared.drop_settled(spark)
    one, again, other = (shared.settle_once(spark, make, "t", k) for k in ("a", "a", "b"))
    assert one is again and other is not one and len(made) == 2
    assert shared.drop_settled(spark, once=False) == 0 and one.count() == 3
    assert shared.drop_settled(spark) == 2
    assert shared.settle_once(spark, make, "t", "a").count() == 3 and len(made) == 3
    shared.drop_settled(spark)


def test_a_cluster_without_a_shared_folder_is_an_error():
    from panelweave.functions import shared

    class Context:
        master = "spark://host:7077"
        getConf = staticmethod(lambda: {})
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Context
        conf = type("Conf", (), {"get": staticmethod(lambda k, d=None: d)})

    with pytest.raises(RuntimeError):
        shared.shared_dir(Session)


def test_entry_without_the_corpus_operators(monkeypatch):
    import importlib.util

    real = importlib.util.find_spec
    monkeypatch.setattr(importlib.util, "find_spec", lambda name, *a: None if name in ("panelweave.llm", "corpus_pipeline") else real(name, *a))
    monkeypatch.delitem(sys.modules, "__spark_entry__", raising=False)
    entry = importlib.import_module("__spark_entry__")
    names = set(entry.queries())
    assert "flagship_momentum_ic" in names and "pipeline" not in names and not any(n.startswith("op") for n in names)
    assert set(entry.oracle_sql()) <= names
    monkeypatch.delitem(sys.modules, "__spark_entry__", raising=False)
