"""Every registered core query runs on the smallest tables, and equals its SQL where it has one."""

import os

import duckdb
import pytest

from webloom.plans import core_queries, timestamp_queries

DIR = "/root/testdata/sf0.001"
QUERIES = {**core_queries.registry.queries, **timestamp_queries.registry.queries}
SQL = {**core_queries.registry.sql, **timestamp_queries.registry.sql}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in sorted(os.listdir(DIR)):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{DIR}/{f}'")
    return con


def rows_of(frame):
    def show(v):
        if v is None or (isinstance(v, float) and v != v):
            return None
        return f"{v:.6f}" if isinstance(v, int | float) and not isinstance(v, bool) else str(v)

    frame = frame[sorted(frame.columns)].astype(object)
    return sorted((tuple(show(v) for v in r) for r in frame.where(frame.notna(), None).values.tolist()), key=str)


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, DIR).toPandas()
    if name in SQL:
        want = duck.execute(SQL[name]).fetchdf()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows_of(got) == rows_of(want)
