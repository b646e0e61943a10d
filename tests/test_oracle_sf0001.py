"""Every registered query against its DuckDB oracle on the smallest data."""

import os

import duckdb
import pytest

from scripts.check_oracle import TABLES, normalise

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(SF), reason="test data not present")


def _keys():
    from chainlake.plans.catalog import oracle_sql
    return sorted(oracle_sql())


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        if os.path.exists(p):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return c


@pytest.mark.parametrize("key", _keys())
def test_query_matches_oracle(spark, con, key):
    from chainlake.plans.catalog import oracle_sql, queries

    got = queries()[key](spark, SF).toPandas()
    want = con.execute(oracle_sql()[key]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) == len(want)
    assert normalise(got) == normalise(want)


def test_every_query_has_oracle_or_is_documented():
    from chainlake.plans.catalog import oracle_sql, queries
    assert set(queries()) - set(oracle_sql()) == set()


def test_entry_smoke(spark):
    import __spark_entry__ as e
    df = e.entry(spark)
    assert df.count() > 0
