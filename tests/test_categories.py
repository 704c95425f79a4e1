"""Category dictionaries: ranks, unseen and missing values, hot values, many categories, sparse vectors."""

import pytest
from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.sql import functions as F

from sturdytab.operators import sampling
from sturdytab.operators.categories import category_dictionary, category_indexes, dictionary_sizes
from sturdytab.operators.corrupt import class_ratio_check, inject_imbalance
from sturdytab.table import LabelledTable


def test_ranks_and_unseen(spark):
    train = spark.createDataFrame([(1, "b", True), (2, "a", None), (3, None, True), (4, "b", False), (5, "", True)],
                                  "k int, t string, f boolean")
    found = category_dictionary(train, ["t", "f"])
    assert sorted((r.ord, r.value, r.n, r.code) for r in found.collect()) == [
        (0, "", 1, 0), (0, "a", 1, 1), (0, "b", 2, 2), (1, "false", 1, 0), (1, "true", 3, 1)]
    assert dictionary_sizes(found, ["t", "f"]) == [3, 2]
    asked = train.union(spark.createDataFrame([(6, "new", False)], train.schema))
    coded = category_indexes(asked, found, ["t", "f"], 5)
    assert sorted((r.k, r.t_index, r.f_index) for r in coded.collect()) == [
        (1, 2.0, 1.0), (2, 1.0, None), (3, None, 1.0), (4, 2.0, 0.0), (5, 0.0, 1.0), (6, 3.0, 0.0)]
    full = coded.where("t_index is not null and f_index is not null")
    hot = OneHotEncoder(inputCols=["t_index", "f_index"], outputCols=["x", "y"]).fit(full).transform(full)
    rows = VectorAssembler(inputCols=["x", "y"], outputCol="v").transform(hot).collect()
    assert {r.k: r.v.toArray().tolist() for r in rows} == {
        1: [0, 0, 1, 0, 1], 4: [0, 0, 1, 1, 0], 5: [1, 0, 0, 0, 1], 6: [0, 0, 0, 1, 0]}
    with pytest.raises(ValueError, match="exist already"):
        category_indexes(coded, found, ["t"], 5)


def test_empty(spark):
    empty = spark.createDataFrame([], "t string")
    found = category_dictionary(empty, ["t"])
    assert not found.collect() and dictionary_sizes(found, ["t"]) == [0]
    assert not category_indexes(empty, found, ["t"], 0).collect()


def test_many_categories_and_a_hot_one(spark, monkeypatch):
    """As many values as rows but for a third of them, joined without a broadcast of the dictionary."""
    monkeypatch.setattr(sampling, "BROADCAST_ROWS", 100)
    n = 300_000
    df = spark.range(n).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(
        F.format_string("v%07d", F.col("id"))).alias("t"))
    found = category_dictionary(df, ["t"])
    assert dictionary_sizes(found, ["t"]) == [n - n // 3 + 1]
    coded = category_indexes(df, found, ["t"], n)
    want = F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") - F.floor(F.col("id") / 3))
    assert coded.count() == n and not coded.where(F.col("t_index") != want).count()


def test_class_ratio(spark):
    df = spark.createDataFrame([(i, "a" if i < 60 else "b" if i < 100 else None) for i in range(110)], "k int, y string")
    clean = LabelledTable(df, "y", ("k",))
    rows = {(r.state, r.classes, r.largest, r.smallest, r.ratio)
            for r in class_ratio_check(clean, inject_imbalance(clean, 5.0, 1)).collect()}
    assert ("clean", 2, 60, 40, 1.5) in rows and ("corrupted", 2, 60, 12, 5.0) in rows and len(rows) == 2
    assert not class_ratio_check(clean.with_df(df.limit(0)), clean.with_df(df.limit(0))).collect()
