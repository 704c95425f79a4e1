import pytest
from pyspark.sql import functions as F

from sturdytab import LabelledTable
from sturdytab.operators.metrics import confusion, scores
from sturdytab.operators.prep import fit_prep, modes
from sturdytab.operators.split import (
    group_split, holdout_split, stratified_folds, stratified_subset, subset_quotas, train_test,
)


@pytest.fixture(scope="module")
def table(spark):
    df = spark.range(1000).select(
        "id", (F.col("id") % 150).alias("g"), F.when(F.col("id") % 7 == 0, None).otherwise(F.col("id") % 2).alias("n"),
        F.when(F.col("id") % 5 == 0, "p").otherwise("n").alias("y"))
    return LabelledTable(df, "y", ("id",), "made")


def test_group_split_keeps_groups_whole(table):
    folds = group_split(table).persist()
    assert folds.count() == 1000
    straddling = folds.groupBy("g", "n").agg(F.count_distinct("fold").alias("f")).where("f > 1").count()
    assert straddling == 0
    sizes = [r[1] for r in folds.groupBy("fold").count().collect()]
    assert len(sizes) == 5 and all(150 <= s <= 250 for s in sizes)
    train, test = train_test(table, folds)
    assert train.df.count() + test.df.count() == 1000


def test_group_split_with_one_hot_group(spark):
    df = spark.range(4000).select("id", F.when(F.col("id") < 2000, 0).otherwise(F.col("id")).alias("g"),
                                  (F.col("id") % 3 == 0).cast("string").alias("y"))
    folds = group_split(LabelledTable(df, "y", ("id",)))
    assert folds.count() == 4000
    assert folds.where("g = 0").select("fold").distinct().count() == 1


def test_group_key_tells_null_places_apart(spark):
    df = spark.createDataFrame([(0, "a", None, "p"), (1, None, "a", "n")], "id int, f string, g string, y string")
    from sturdytab.functions.hashing import group_key_text

    keys = df.select(group_key_text(F.col("f"), F.col("g"))).distinct().count()
    assert keys == 2


def test_holdout_shares(table):
    counts = {(r["y"], r["part"]): r["count"] for r in holdout_split(table).groupBy("y", "part").count().collect()}
    assert counts == {("p", "test"): 40, ("p", "train"): 160, ("n", "test"): 160, ("n", "train"): 640}


def test_folds(table):
    counts = {(r["y"], r["fold"]): r["count"] for r in stratified_folds(table, 3).groupBy("y", "fold").count().collect()}
    assert sorted(counts.values()) == [66, 67, 67, 266, 267, 267]
    few = LabelledTable(table.df.where("y = 'n' or id = 0"), "y", ("id",))
    with pytest.raises(ValueError):
        stratified_folds(few)


def test_subset(table):
    assert {r[0]: r[1] for r in stratified_subset(table, 101).df.groupBy("y").count().collect()} == {"p": 20, "n": 81}
    assert subset_quotas({"a": 1, "b": 1, "c": 1}, 2) == {"a": 1, "b": 1, "c": 0}
    with pytest.raises(ValueError):
        subset_quotas({"a": 1}, 2)


def test_modes(spark):
    df = spark.createDataFrame([("b", None), ("a", None), (None, None), ("b", None), ("a", None)], "x string, e string")
    assert modes(df, ["x", "e"]) == {"x": "a", "e": None}


def test_prep(spark):
    df = spark.createDataFrame(
        [(1.0, 4, None, None, "p"), (None, 4, "it's", None, "n"), (3.0, None, "it's", None, "p"), (8.0, 4, "b", None, "n")],
        "v double, k int, s string, e double, y string")
    fitted = fit_prep(LabelledTable(df, "y"))
    rows = fitted.transform(df, ["y"]).collect()
    assert fitted.numeric == ["v", "k"] and fitted.medians["v"] == 3.0
    assert [r["s"] for r in rows] == ["it's", "it's", "it's", "b"]
    assert [r["k"] for r in rows] == [0.0] * 4
    assert [round(r["v"], 6) for r in rows] == [round((x - 3.75) / 2.5860201081971503, 6) for x in (1, 3, 3, 8)]
    with pytest.raises(ValueError):
        fit_prep(LabelledTable(df.select("e", "y"), "y"))


def test_scores(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "a"), ("b", "d")], "t string, p string")
    r = scores(confusion(df, "t", "p")).first()
    assert r["accuracy"] == 0.4
    assert r["balanced_accuracy"] == pytest.approx(1 / 3)
    assert (r["macro_precision"], r["macro_recall"], r["macro_f1"]) == (0.25, 0.25, 0.25)
