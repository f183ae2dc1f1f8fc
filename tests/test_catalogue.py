"""The query catalogue against its SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__
from freshet.plans.catalogue import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(v):
    return round(v, 9) + 0.0 if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_agrees_with_sql(spark, con, name):
    got, want = QUERIES[name](spark, SF), con.sql(ORACLES[name])
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    rows = lambda x: sorted((tuple(map(plain, r)) for r in x), key=repr)
    assert rows(got.select(*cols).collect()) == rows(want.project(", ".join(f'"{c}"' for c in cols)).fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert set(QUERIES) <= set(__spark_entry__.queries()) and set(ORACLES) <= set(__spark_entry__.oracle_sql())
    assert __spark_entry__.entry(spark).columns[:3] == ["basin", "lead_time", "n_pairs"]
