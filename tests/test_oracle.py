"""All queries with SQL against DuckDB on the smallest tables; QUERY_FILTER chooses some by prefix."""

import os

import duckdb
import pytest

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SOME = os.environ.get("QUERY_FILTER", "").split()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return c


def names():
    from plexmat.plans import registry

    return [n for n in registry.oracle_sql() if not SOME or any(n.startswith(p) for p in SOME)]


def rows(df, columns):
    plain = lambda v: None if v is None or v != v else (v.item() if hasattr(v, "item") else v)
    return sorted((tuple(plain(v) for v in row) for row in df[columns].astype(object).itertuples(index=False, name=None)), key=repr)


@pytest.mark.parametrize("name", names())
def test_query_equals_oracle(spark, sf, con, name):
    from plexmat.plans import registry

    got, want = registry.queries()[name](spark, sf).toPandas(), con.sql(registry.oracle_sql()[name]).df()
    columns = sorted(got.columns)
    assert sorted(want.columns) == columns
    assert rows(got, columns) == rows(want, columns)


def test_every_query_is_registered_once():
    from plexmat.plans import registry

    seen = [n for p in registry.PLANS for n in p.QUERIES]
    assert len(seen) == len(set(seen))
    assert set(registry.oracle_sql()) <= set(seen)
