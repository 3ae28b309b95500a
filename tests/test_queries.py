"""Each registered query against its SQL, on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from filescope.plans import engine

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.sql("set TimeZone='UTC'")
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


@pytest.mark.parametrize("name", engine.QUERIES)
def test_query(spark, con, name):
    df = engine.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    ours = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)
    assert ours or name == "duplicate_lookup"  # the smallest tables have no such pair
    if name in engine.ORACLE:
        found = con.sql(engine.ORACLE[name])
        assert sorted(found.columns) == cols
        theirs = sorted((tuple(dict(zip(found.columns, r, strict=True))[c] for c in cols) for r in found.fetchall()), key=repr)
        assert ours == theirs


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
