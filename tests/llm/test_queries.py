"""Every query is registered, runs over whole small tables, and agrees with its SQL."""

import duckdb
import pytest

import __spark_entry__
from freshet.llm import queries

SF = "/root/testdata/sf0.001"


def test_registered():
    names = __spark_entry__.queries()
    assert {n.split("_")[0] for n in queries.queries()} == {f"op{i}" for i in range(1, 13)}
    assert set(queries.queries()) <= set(names) and "pipeline" in names and set(queries.oracle_sql()) <= set(__spark_entry__.oracle_sql())


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_agrees_with_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.sql(queries.oracle_sql()[name])
    got = queries.queries()[name](spark, SF)
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    assert sorted((tuple(r) for r in got.select(*cols).collect()), key=repr) == sorted(want.project(", ".join(f'"{c}"' for c in cols)).fetchall(), key=repr)


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(queries.oracle_sql())))
def test_covers_the_table(spark, name):
    table, key = ("pages", "page_id") if name.startswith("op9") else ("documents", "doc_id")
    want = {r[0] for r in spark.read.parquet(f"{SF}/{table}.parquet").select(key).collect()}
    assert {r[0] for r in queries.queries()[name](spark, SF).select(key).collect()} == want
