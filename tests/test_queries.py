"""Every core query with SQL gives the SQL's rows on the small tables."""

import collections
import math
import os

import pytest

DATA = "/root/testdata/sf0.001"


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    return v.replace(tzinfo=None) if hasattr(v, "tzinfo") and hasattr(v, "hour") else v


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for f in os.listdir(DATA):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    return con


def names():
    from driftline.plans import registry

    return sorted(registry.queries())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", names())
def test_query(spark, duck, name):
    from driftline.plans import registry

    df = registry.queries()[name](spark, DATA)
    rows = df.collect()
    sql = registry.oracle_sql().get(name)
    if sql:
        want = duck.sql(sql)
        assert sorted(want.columns) == sorted(df.columns)
        cols = want.columns
        assert collections.Counter(tuple(norm(r[c]) for c in cols) for r in rows) == collections.Counter(tuple(map(norm, x)) for x in want.fetchall())
