import os

import duckdb
import pytest

from hornspark import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def compared(df, columns):
    return sorted(tuple(None if v is None else str(v) for v in row) for row in df[columns].astype(object).itertuples(index=False))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, con, name):
    got, expected = queries.QUERIES[name](spark, SF).toPandas(), con.sql(queries.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(expected.columns)
    columns = sorted(got.columns)
    assert compared(got, columns) == compared(expected, columns)


def test_plans(spark):
    """Constants reach the scan, unused columns are not read, and semi-joins are semi-joins."""
    plan = queries.QUERIES["filter_const_number"](spark, SF)._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(n_regionkey), EqualTo(n_regionkey,1)]" in plan
    plan = queries.QUERIES["semi"](spark, SF)._jdf.queryExecution().toString()
    assert "LeftSemi" in plan and "ReadSchema: struct<o_custkey:bigint>" in plan
    plan = queries.QUERIES["multi_filter"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1  # one for all rules of a conclusion that filter a relation
