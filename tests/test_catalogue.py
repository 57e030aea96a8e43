"""Every catalogue query against its SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

from lodestone.plans.catalogue import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, con, name):
    ours, theirs = QUERIES[name](spark, SF), con.execute(SQL[name]).df()
    cols = sorted(ours.columns)
    assert cols == sorted(theirs.columns)
    key = lambda r: tuple(str(float(x)) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x) for x in r)
    a = sorted(key([r[c] for c in cols]) for r in ours.collect())
    b = sorted(key(r) for r in theirs[cols].itertuples(index=False))
    assert a == b


def test_queries_without_sql_run(spark):
    for name in set(QUERIES) - set(SQL):
        assert QUERIES[name](spark, SF).count() > 0
