import importlib
import sys

import duckdb
import pytest

from orbweave.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf_dir):
    out = duckdb.connect()
    for name in TABLES:
        out.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return out


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sf_dir, con, name):
    got = registry.QUERIES[name](spark, sf_dir)
    if name not in registry.ORACLES:
        assert got.count() > 0
        return
    want = con.sql(registry.ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(tuple, got.select(*(f"`{c}`" for c in want.columns)).collect()), key=str) == sorted(want.fetchall(), key=str)


def test_the_entry_works_without_the_text_operators(monkeypatch):
    monkeypatch.setitem(sys.modules, "orbweave.llm", None)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    import __spark_entry__

    entry = importlib.reload(__spark_entry__)
    assert set(entry.queries()) == set(registry.QUERIES) and set(entry.oracle_sql()) == set(registry.ORACLES)
    monkeypatch.undo()
    importlib.reload(__spark_entry__)
