"""Every registered query of the library against its SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from quillgraph.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_matches_sql(spark, sf, duck, name):
    df = registry.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    ours = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)
    if name not in registry.ORACLE_SQL:
        assert ours
        return
    found = duck.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    theirs = sorted((tuple(r[names.index(c)] for c in columns) for r in found.fetchall()), key=str)
    assert ours == theirs


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns and df.count() > 0


def test_no_query_without_function():
    assert set(entry.oracle_sql()) <= set(entry.queries())
