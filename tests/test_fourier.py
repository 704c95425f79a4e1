"""Fourier features as plain formulas; a batch stays one matrix from Arrow to Arrow."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sturdytab.learn import rbf


def plain(numbers, codes, width, sizes, outputs, gamma, seed):
    draw = np.random.default_rng(seed)
    weights = draw.normal(0.0, math.sqrt(2 * gamma), (width + sum(sizes), outputs))
    total, at = draw.uniform(0.0, 2 * math.pi, outputs), width
    for j, x in enumerate(numbers):
        total = total + x * weights[j]
    for code, size in zip(codes, sizes, strict=True):
        total, at = total + (weights[at + int(code)] if code < size else 0), at + size
    return math.sqrt(2 / outputs) * np.cos(total)


@pytest.mark.parametrize("width,sizes", [(2, [3, 4]), (1, []), (0, [2])])
def test_features_are_those_of_the_formula(spark, width, sizes):
    """Two partitions, one of them empty; every third row has a category not seen in training, the index after the last."""
    numbers = [F.sin(F.col("id") * (j + 1)) for j in range(width)]
    codes = [F.when(F.col("id") % 3 == 0, s).otherwise(F.col("id") % s).cast("double") for s in sizes]
    df = spark.range(60, numPartitions=2).where("id < 30").select(
        F.array(*numbers).cast("array<double>").alias("n"), F.array(*codes).cast("array<double>").alias("c"))
    rows = df.select("n", "c", rbf.fourier_udf(width, sizes, 8, 0.7, 5)("n", "c").alias("x")).collect()
    assert len(rows) == 30
    for r in rows:
        assert np.allclose(r.x, plain(r.n, r.c, width, sizes, 8, 0.7, 5), rtol=0, atol=1e-12)


def test_no_object_is_made_for_a_row(spark):
    """Rows went through pandas, an array object each; no such step is left in the plan."""
    df = spark.range(3).select(F.array(F.col("id") * 1.0).alias("n"), F.array().cast("array<double>").alias("c"))
    udf = rbf.fourier_udf(1, [], 8, 0.7, 5)
    assert udf.evalType in (250, 251) and not hasattr(rbf, "pd")  # Arrow arrays, or an iterator of them
    assert [len(r.x) for r in df.select(udf("n", "c").alias("x")).collect()] == [8, 8, 8]
