import math

import pytest
from pyspark.sql import functions as F

from sturdytab import LabelledTable
from sturdytab.functions import hashing
from sturdytab.operators import audit, meta
from sturdytab.table import drop_empty_columns, drop_index_columns, normalise_missing, require_classes


def test_report(f1):
    r = audit.report_audit(f1).first()
    assert (r["rows"], r["columns"], r["features"]) == (8, 3, 2)
    assert (r["numerical_features"], r["categorical_features"]) == (1, 1)
    assert (r["missing_cells"], r["missing_rate_percent"]) == (4, 16.6667)
    assert (r["duplicate_rows"], r["duplicate_rate_percent"]) == (1, 12.5)
    assert r["outlier_row_rate_percent"] == 12.5
    assert r["potential_label_conflict_rate_percent"] == 50.0
    assert (r["number_of_classes"], r["imbalance_ratio"]) == (2, 5.0)


def test_fractions_and_impurities(f1):
    frame = audit.fraction_audit(f1)
    r = frame.first()
    assert r["missing_rate"] == 0.1875 and r["n_classes"] == 3
    assert math.isclose(r["class_entropy"], 1.298795, abs_tol=1e-6)
    found = [(x["corruption"], x["severity"]) for x in audit.detect_impurities(frame).orderBy("ord").collect()]
    assert found == [("missing", 0.1875), ("duplicates", 0.125), ("outliers", 0.125), ("label_noise", 0.2),
                     ("imbalance", 5.0)]


@pytest.mark.parametrize("ratio,expected", [(1.5, []), (1.6, [2.0]), (2.5, [2.0]), (3.5, [4.0]), (10.0, [10.0]),
                                            (10.1, [])])
def test_imbalance_severity(spark, ratio, expected):
    row = spark.range(1).select(
        F.lit("d").alias("dataset"), F.lit(0).alias("n_numeric"), F.lit(ratio).alias("imbalance_ratio"),
        *[F.lit(0.0).alias(c) for c in ("missing_rate", "duplicate_rate", "outlier_rate",
                                        "potential_label_conflict_rate")])
    assert [r["severity"] for r in audit.detect_impurities(row).collect()] == expected


def test_meta_features(f1):
    r = meta.meta_features(f1).first()
    assert (r["n_rows"], r["n_classes"], r["imbalance_ratio"]) == (8, 2, 2.5)
    assert math.isclose(r["class_entropy"], 0.863121, abs_tol=1e-6)
    assert (r["avg_numeric_cardinality"], r["avg_categorical_cardinality"]) == (4.0, 3.0)
    a = meta.meta_features(f1, approximate=True).first()
    assert (a["avg_numeric_cardinality"], a["avg_categorical_cardinality"]) == (4.0, 3.0)


@pytest.mark.parametrize("cells", [32, 2])
def test_rows_group_by_content(spark, monkeypatch, cells):
    """By cells and, for very wide tables, by digest: the same groups."""
    monkeypatch.setattr(hashing, "MAX_CELLS", cells)
    rows = [("a||b", "c", None, 0.0, 1), ("a", "b||c", None, 0.0, 1), ("a", "b||c", None, -0.0, 2), (None, "x", "", 1.0, 1),
            (None, "x", None, 1.0, 1), (None, "x", None, 1.0, 1)]
    df = spark.createDataFrame(rows, "a string, b string, c string, d double, y int")
    r = audit.group_facts(df, ["a", "b", "c", "d"], "y").first()
    assert (r["duplicate_rows"], r["conflict_rows"]) == (1, 2)


def test_empty_table_gives_zero_rates(spark):
    table = LabelledTable(spark.createDataFrame([], "a double, y string"), "y")
    r = audit.report_audit(table).first()
    assert r["rows"] == 0 and r["missing_rate_percent"] == 0.0 and r["outlier_row_rate_percent"] == 0.0


def test_constant_and_short_columns_have_no_outliers(spark):
    df = spark.createDataFrame([(5.0, 1.0, "a"), (5.0, 2.0, "b"), (5.0, 90.0, "a")], "c double, s double, y string")
    table = LabelledTable(df, "y")
    assert audit.fraction_audit(table).first()["outlier_rows"] == 0


def test_report_with_class_maps(f1):
    r = audit.report_with_classes(f1).first()
    assert r["class_counts"] == {"p": 5, "n": 2, "nan": 1}
    assert r["class_percentages"] == {"p": 62.5, "n": 25.0, "nan": 12.5}


def test_missing_states(spark):
    df = spark.createDataFrame([(float("nan"), "N/A"), (1.0, "x"), (None, None)], "v double, s string")
    assert normalise_missing(df, ("N/A",)).collect() == [(None, None), (1.0, "x"), (None, None)]


def test_column_cleaning(spark):
    df = spark.createDataFrame([(1, None, None)], "`unnamed: 0` int, e string, y string")
    assert drop_empty_columns(drop_index_columns(df), "y").columns == ["y"]


def test_guards(spark, f1):
    with pytest.raises(ValueError):
        LabelledTable(f1.df, "nope")
    with pytest.raises(ValueError):
        require_classes({"a": 5, None: 3})
    with pytest.raises(ValueError):
        require_classes({"a": 5, "b": 1}, 2, 2)


def test_conflict_flags_with_a_hot_feature_row(spark):
    """One feature row owns most of the table and goes through the broadcast side."""
    df = spark.range(5000).select(
        F.when(F.col("id") < 3000, F.lit(-1)).otherwise(F.col("id") % 1500).alias("f"),
        (F.col("id") % 2).alias("y"))
    table = LabelledTable(df, "y")
    got = audit.conflict_flags(table).groupBy("f").agg(F.count("*").alias("n"), F.max("labels").alias("l"))
    want = df.groupBy("f").agg(F.count("*").alias("n"), F.count_distinct("y").alias("l"))
    assert sorted(got.collect()) == sorted(want.collect())


def test_long_texts_group_by_digest(spark):
    """Texts that differ only at the end stay apart, and a text that looks like a digest is not taken for one."""
    import hashlib

    long_a, long_b = "x" * 500 + "a", "x" * 500 + "b"
    fake = "#" + hashlib.sha256(long_a.encode()).hexdigest()
    df = spark.createDataFrame([(t, "l") for t in (long_a, long_a, long_b, fake, None, None)], "t string, y string")
    assert audit.surplus_rows(df, ["t"]).first()["duplicate_rows"] == 2
