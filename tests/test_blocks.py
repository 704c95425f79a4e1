"""Rows alike meet across partitions; the tree models of a cell share their blocks."""

import dataclasses
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from sturdytab import LabelledTable
from sturdytab.learn import models as M, trees as T
from sturdytab.learn.models import LIGHT, fit_features, fit_model

TINY = dataclasses.replace(LIGHT, trees=5, rounds=6, tree_depth=None, round_depth=3, fourier=16, iterations=20, svm_iterations=5)


def coded(spark, n=800, values=30, partitions=8):
    """`n` rows, `values` x 2 different ones of which are in every partition."""
    v = F.col("id") % values
    return spark.range(n, numPartitions=partitions).select(
        F.pmod(F.floor(F.col("id") / values), F.lit(2)).cast("double").alias("y"), F.array(v * 1.0, v % 3 * 1.0).alias("raw"))


CUTS = [[float(i) for i in range(29)], [0.0, 1.0]]


def different(frame):
    return [(tuple(b), c, int(k)) for row in frame.collect() for b, c, k in zip(*(a.tolist() for a in T.opened(row.asDict())[:3]), strict=True)]


def test_rows_alike_of_many_partitions_are_one_block(spark):
    """800 rows in 8 partitions, 60 of them different: each partition has nearly all of them, so their blocks hold more than 100."""
    rows = coded(spark)
    many = T.block_frame(rows, "y", "raw", CUTS, 0, 8, 100)
    one = T.block_frame(rows.coalesce(1), "y", "raw", CUTS, 0, 1, 1000)
    assert [b.n for b in many.collect()] == [b.n for b in one.collect()] == [60]
    assert different(many) == different(one) and sum(d[2] for d in different(many)) == 800


def test_rows_that_differ_stay_in_several_blocks(spark):
    """More different rows than a block holds: each of them is in one block only, with the count of all."""
    blocks = T.block_frame(coded(spark), "y", "raw", CUTS, 0, 8, 20)
    assert blocks.count() > 1 and blocks.agg(F.max("n")).first()[0] <= 40
    assert sorted(different(blocks)) == sorted(different(T.block_frame(coded(spark).coalesce(1), "y", "raw", CUTS, 0, 1, 1000)))


def test_no_rows_make_no_block(spark):
    assert T.block_frame(coded(spark).where("y > 5"), "y", "raw", CUTS, 0, 8, 20).count() == 0


@pytest.mark.parametrize("kind", ["tree", "forest", "boosted"])
def test_many_partitions_of_rows_alike_take_no_job_a_level(spark, monkeypatch, kind):
    """The same model as from one partition, in a few jobs; boosting took one a level."""
    rows, shape = coded(spark), ("y", "raw", 2, [], 2, 800, 12, 3, 1, "p")
    monkeypatch.setattr(T, "BLOCK_ROWS", 1000)
    one = T.fit_trees(kind, rows.coalesce(1), *shape, cuts=CUTS)
    monkeypatch.setattr(T, "BLOCK_ROWS", 100)
    first = spark.sparkContext._jsc.sc().statusStore().jobsList(None).size()
    many = T.fit_trees(kind, rows, *shape, cuts=CUTS)
    assert spark.sparkContext._jsc.sc().statusStore().jobsList(None).size() - first < 20
    assert json.loads(many.getOrDefault("model")) == json.loads(one.getOrDefault("model"))


def test_the_tree_models_of_a_cell_share_their_blocks(spark, monkeypatch):
    made, real = [], M.row_blocks
    monkeypatch.setattr(M, "row_blocks", lambda *a: made.append(a[-2:]) or real(*a))
    df = spark.range(300).select("id", (F.col("id") % 17 * 1.0).alias("v"), (F.col("id") % 2).cast("int").alias("y"))
    features = fit_features(LabelledTable(df, "y", ("id",)), TINY)
    prepared = features.packed(df, 300)
    for name in ("Decision Tree", "Random Forest", "XGBoost"):
        fit_model(name, features, prepared, TINY)
    assert len(made) == 1
    monkeypatch.setattr(T, "BLOCK_ROWS", 100)  # blocks of another size are others
    fit_model("Decision Tree", features, prepared, TINY)
    assert made[0] != made[1] and np.all([m[1] for m in made] == [200_000, 100])
