"""Every query with an oracle against DuckDB on the smallest tables, and the shape of the plans.

No checked query may run Python, a Cartesian product or a nested-loop join.
"""

import math
import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not there")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def _rows(frame):
    frame = frame[sorted(frame.columns)]
    out = []
    for row in frame.itertuples(index=False, name=None):
        out.append(tuple(
            "NULL" if x is None or x != x else repr(x + 0.0) if isinstance(x, float) else str(x) for x in row))
    return sorted(out)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_against_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    if name not in ("one_hot_documents", "scored_rows"):
        plan = _plan(df)
        for bad in ("CartesianProduct", "BatchEvalPython", "ArrowEvalPython", "BroadcastNestedLoopJoin", "MapInPandas"):
            assert bad not in plan, plan
    got = df.toPandas()
    want = duck.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert _rows(got) == _rows(want)


def test_entry(spark):
    assert entry.entry(spark).count() == 1


def test_names_are_unique_and_oracles_have_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["corrupt_missing_10", "corrupt_label_noise_orders", "corrupt_outliers_median",
                                  "corrupt_imbalance_5to1", "corrupt_duplicates_distinct", "split_folds_orders"])
def test_fitted_corruptions_are_row_local(spark, name):
    """Once thresholds are known, the table is neither shuffled nor joined."""
    plan = _plan(entry.queries()[name](spark, SF))
    assert "Exchange" not in plan and "Join" not in plan


def test_only_needed_columns_are_read(spark):
    plan = _plan(entry.queries()["class_distribution_events"](spark, SF))
    schemas = [line for line in plan.splitlines() if "ReadSchema" in line]
    assert any("event_type" in s for s in schemas)
    assert not any(column in s for s in schemas for column in ("props", "user_id", "value", "ts:"))
