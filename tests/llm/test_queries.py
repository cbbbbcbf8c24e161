"""The registered queries with SQL against DuckDB on the smallest tables; the others run."""

import duckdb
import pytest

from plexmat.llm import queries


@pytest.mark.parametrize("name", list(queries.queries()))
def test_query(spark, sf, name):
    df = queries.queries()[name](spark, sf)
    got = [tuple(r[c] for c in sorted(df.columns)) for r in df.collect()]
    assert got
    sql = queries.oracle_sql().get(name)
    if sql:
        con = duckdb.connect()
        for t in ("documents", "labels"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
        rel = con.sql(sql)
        assert sorted(rel.columns) == sorted(df.columns)
        order = sorted(range(len(rel.columns)), key=lambda i: rel.columns[i])
        assert sorted(got, key=repr) == sorted((tuple(r[i] for i in order) for r in rel.fetchall()), key=repr)
