"""Every registered query with SQL gives the same rows on Spark and on DuckDB."""

import os

import duckdb
import pytest

from compare import canonical
from paylens.plans.registry import QUERIES, SQL
from paylens.plans.views import TABLES

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    mine = canonical(df.columns, [tuple(r) for r in df.collect()])
    result = duck.execute(SQL[name])
    theirs = canonical([c[0] for c in result.description], result.fetchall())
    assert mine[0] == theirs[0]
    assert mine[1] == theirs[1]


def test_every_query_is_named_once():
    assert set(SQL) <= set(QUERIES)
    assert len(QUERIES) > 100
