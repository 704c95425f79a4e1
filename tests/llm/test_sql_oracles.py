"""Queries with oracles against DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pytest

from sturdytab.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, name):
    got = QUERIES[name](spark, SF).toPandas()
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from read_parquet('{path}')")
    want = con.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    rows = [sorted(map(tuple, x[sorted(want.columns)].astype(object).values.tolist()), key=str) for x in (got, want)]
    assert rows[0] == rows[1]
