"""Every pN_ query runs on the smallest tables and equals its SQL where it has one."""

import os

import duckdb
import pytest

from webloom.llm.queries import registry

DIR = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(registry.queries))
def test_query(spark, name):
    got = registry.queries[name](spark, DIR).toPandas()
    if name in registry.sql:
        con = duckdb.connect()
        for f in sorted(os.listdir(DIR)):
            con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{DIR}/{f}'")
        want = con.execute(registry.sql[name]).fetchdf()[sorted(got.columns)]
        show = lambda f: sorted(map(str, f[sorted(got.columns)].astype(object).where(f.notna(), None).values.tolist()))
        assert show(got) == show(want)
