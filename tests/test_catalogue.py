"""Every catalogue query against its SQL on DuckDB."""

import glob
import math
import os

import duckdb
import pytest

from strataflow import catalogue

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def oracle():
    c = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return c


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    return repr(int(v) if isinstance(v, float) and v == int(v) else v)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, oracle, name):
    df = catalogue.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    cur = oracle.execute(catalogue.SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    want = sorted(tuple(plain(dict(zip(names, r, strict=True))[c]) for c in cols) for r in cur.fetchall())
    assert got == want


def test_plans(spark):
    """A filter stays a CASE, a narrow read stays narrow, and a reduction is one aggregate."""
    text = catalogue.QUERIES["filter_outcomes"](spark, DATA)._jdf.queryExecution().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in text
    text = catalogue.QUERIES["reduce_ordered"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
