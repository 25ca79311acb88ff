"""Every registered query against its DuckDB SQL."""

import math
import os

import duckdb
import pytest

from lakecurator import queries as library
from lakecurator.operators import scans

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are absent")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return connection


def rows(frame):
    def plain(v):
        if v is None or v is getattr(frame, "NA", None) or str(v) in ("<NA>", "NaT") or (isinstance(v, float) and math.isnan(v)):
            return "null"
        return str(int(v)) if isinstance(v, float) and v == int(v) else str(v)

    return sorted(tuple(map(plain, r)) for r in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(library.SQL))
def test_query_equals_sql(spark, duck, name):
    found, expected = library.QUERIES[name](spark, DATA).toPandas(), duck.sql(library.SQL[name]).df()
    assert sorted(found.columns) == sorted(expected.columns)
    assert rows(found) == rows(expected)


@pytest.mark.parametrize("name", ["import_plan", "organize_plan", "album_parts", "continued_parts"])
def test_query_equals_sql_where_keys_fill_ranges(spark, duck, monkeypatch, name):
    monkeypatch.setattr(scans, "KEY_ROWS", 0)
    test_query_equals_sql(spark, duck, name)


def test_entry_and_registry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 2
    assert set(library.QUERIES) <= set(entry.queries()) and set(library.SQL) <= set(entry.oracle_sql())


def test_entry_works_without_the_corpus_operators(monkeypatch):
    import importlib
    import sys

    import __spark_entry__ as entry

    for name in [m for m in sys.modules if m == "corpus_pipeline" or m.startswith("lakecurator.llm")]:
        monkeypatch.delitem(sys.modules, name)

    class Missing:
        def find_spec(self, name, path=None, target=None):
            if name == "corpus_pipeline" or name.startswith("lakecurator.llm"):
                raise ModuleNotFoundError(f"No module named {name!r}", name=name)

    monkeypatch.setattr(sys, "meta_path", [Missing(), *sys.meta_path])
    alone = importlib.reload(entry)
    assert set(alone.queries()) == set(library.QUERIES)
    monkeypatch.undo()
    importlib.reload(entry)
