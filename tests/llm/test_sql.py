"""The queries that have SQL against it, on the smallest tables."""

import duckdb
import pytest

from quillgraph.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_matches_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = queries.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    found = con.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    ours = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)
    assert ours == sorted((tuple(r[names.index(c)] for c in columns) for r in found.fetchall()), key=str)
