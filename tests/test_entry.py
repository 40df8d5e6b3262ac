import __spark_entry__
from tidemark.plans import registry


def test_entry_has_rows(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_queries_and_sql_agree_in_names():
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(queries)
    assert all(name in queries for m in registry.MODULES for name in m.QUERIES)


def test_rest_stands_without_the_optional_subpackage(monkeypatch):
    import sys

    for name in [m for m in sys.modules if m.startswith("tidemark.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "tidemark.llm", None)
    monkeypatch.setitem(sys.modules, "tidemark.llm.queries", None)
    assert set(__spark_entry__.queries()) == {name for m in registry.MODULES for name in m.QUERIES}
