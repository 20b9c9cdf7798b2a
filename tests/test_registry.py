import duckdb
import pytest

import __spark_entry__ as entry
from tessella.plans import oracle, queries

SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows_of(frame):
    return sorted(map(str, frame[sorted(frame.columns)].astype(object).itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(oracle.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    got, want = queries.queries()[name](spark, SF).toPandas(), duck.execute(oracle.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want) > 0
    assert rows_of(got.astype(want.dtypes.to_dict(), errors="ignore")) == rows_of(want)


def test_registry():
    assert {*entry.oracle_sql()} <= {*entry.queries()}


def test_entry(spark):
    assert entry.entry(spark).count() == 10
