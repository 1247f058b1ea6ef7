"""Every registered query with SQL equals it on the smallest tables."""

import duckdb
import pytest

from loomtext.plans.oracle import oracle_sql
from loomtext.plans.queries import QUERIES

TABLES = ("documents", "benchmark", "pages", "conversations", "labels", "embeddings")
SQL = oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    return con


def rows(df):
    return sorted(map(repr, df.reindex(sorted(df.columns), axis=1).itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf, duck, name):
    got = QUERIES[name](spark, sf).toArrow().to_pandas()
    want = duck.execute(SQL[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).limit(5).count() > 0


def test_entry_imports_without_the_training_data_part():
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries()) and set(SQL) <= set(e.oracle_sql())
