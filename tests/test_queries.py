import pytest

import __spark_entry__ as entry
from oracle import compare, connect
from quillon import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_against_sql(spark, con, name):
    assert compare(spark, con, name, queries.QUERIES[name], queries.SQL[name], SF) is None


def test_entry(spark):
    assert entry.entry(spark).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(queries.QUERIES) <= set(entry.queries())


def test_without_the_optional_part(spark, monkeypatch):
    """The rest imports and runs where the folders of the optional part and the pipeline are gone."""
    import builtins
    import sys

    for name in [m for m in sys.modules if m.startswith("quillon.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    real = builtins.__import__

    def gone(name, globals=None, locals=None, fromlist=(), level=0):
        if name == "corpus_pipeline" or name.startswith("quillon.llm"):
            raise ModuleNotFoundError(f"No module named {name!r}", name=name)
        return real(name, globals, locals, fromlist, level)

    monkeypatch.setattr(builtins, "__import__", gone)
    assert set(entry.queries()) == set(queries.QUERIES)
