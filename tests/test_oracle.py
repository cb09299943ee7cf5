"""Every registered query with an SQL form equals its DuckDB oracle."""

import pytest

from cwescope.plans.catalog import REGISTRY
from cwescope.plans.check import compare, duck

KEYS = sorted(k for k, q in REGISTRY.items() if q.sql is not None)


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("key", KEYS)
def test_matches_oracle(spark, sf, con, key):
    q = REGISTRY[key]
    err = compare(q.spark_df(spark, sf), con, q.oracle())
    assert err is None, f"{key}: {err}"


@pytest.mark.parametrize("key", sorted(k for k, q in REGISTRY.items() if q.sql is None))
def test_rows_only_queries_run(spark, sf, key):
    df = REGISTRY[key].spark_df(spark, sf)
    assert df.count() >= 0
