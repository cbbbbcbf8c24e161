"""Every registered query runs at the smallest scale; those with SQL are compared in test_oracle."""

import os

import pytest

CHOSEN = os.environ.get("QUERY_FILTER", "").split()


def names():
    from plexmat.plans import registry

    return [n for n in registry.queries() if n not in registry.oracle_sql() and (not CHOSEN or any(n.startswith(p) for p in CHOSEN))]


@pytest.mark.parametrize("name", names())
def test_query_runs(spark, sf, name):
    from plexmat.plans import registry

    df = registry.queries()[name](spark, sf)
    assert len(set(df.columns)) == len(df.columns) > 0
    assert df.count() > 0
