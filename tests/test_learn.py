import dataclasses
import tempfile

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from sturdytab import LabelledTable
from sturdytab.learn.models import LIGHT, MODELS, FittedModel, fit_features, fit_model
from sturdytab.plans import adaptive, experiments as E
from sturdytab.operators.split import group_split, train_test

TINY = dataclasses.replace(LIGHT, trees=8, rounds=3, tree_depth=6, fourier=64)


@pytest.fixture(scope="module")
def table(spark):
    """The label follows the features, so every model must find it."""
    df = spark.range(240).select(
        "id", (F.col("id") % 17 * 1.0).alias("v"), F.concat(F.lit("c"), F.col("id") % 3).alias("s"),
        F.when((F.col("id") % 17 > 8), "high").otherwise("low").alias("y"))
    return LabelledTable(df, "y", ("id",), "made")


def test_every_model_learns(spark, table):
    rows, fitted = E.fit_and_score(table, table.df, TINY)
    assert [r["model"] for r in rows] == list(MODELS)
    assert all(r["accuracy"] > 0.9 for r in rows), rows


def test_packed_rows_are_read_from_files(spark, table):
    """The rows of a fit carry no lineage of the training table; Fourier features are made only by who asks for them."""
    features = fit_features(table, TINY)
    packed = features.packed(table.df, 240)
    columns = ["label_code", vector_to_array("model_features"), vector_to_array("fourier_features"), "column_values"]
    assert packed.inputFiles() and packed.rdd.getNumPartitions() == 1
    assert sorted(packed.select(*columns).collect()) == sorted(features.prepared(table.df).select(*columns).collect())
    plan = packed.select("label_code", "model_features")._jdf.queryExecution().executedPlan().toString()
    assert "FileScan" in plan and "Python" not in plan and "Range" not in plan


def test_three_classes_and_failure_isolation(spark):
    df = spark.range(120).select("id", (F.col("id") % 3 * 1.0).alias("v"), (F.col("id") % 3).cast("int").alias("y"))
    failures = []
    rows, _ = E.fit_and_score(LabelledTable(df, "y", ("id",)), df, TINY, [*MODELS, "No Such Model"], failures=failures)
    assert len(rows) == 5 and [f[0] for f in failures] == ["No Such Model"]
    assert all(r["accuracy"] > 0.9 for r in rows), rows


def test_failed_model_keeps_its_row(spark, table):
    rows = {r["model"]: r for r in E.run_clean(table, table, TINY, ["Decision Tree", "No Such Model"]).collect()}
    assert rows["Decision Tree"]["error"] is None and rows["Decision Tree"]["accuracy"] > 0.9
    assert rows["No Such Model"]["accuracy"] is None and "unknown model" in rows["No Such Model"]["error"]


@pytest.mark.parametrize("kind", ["decimal(5,2)", "date", "int", "boolean"])
def test_labels_keep_their_type(spark, kind):
    label = {"date": "date_add(date'2020-01-01', cast(id % 2 as int))"}.get(kind, f"cast(id % 2 as {kind})")
    df = spark.range(40).selectExpr("id", "cast(id % 2 as double) as v", f"{label} as y")
    features = fit_features(LabelledTable(df, "y", ("id",)), TINY)
    path = tempfile.mkdtemp(prefix="sturdytab-test-") + "/m"
    fit_model("Decision Tree", features, features.prepared(df), TINY).save(path)
    scored = adaptive.score_rows(FittedModel.load(path), df)
    assert scored.schema["prediction"].dataType == df.schema["y"].dataType
    assert scored.where("not prediction <=> y").count() == 0


def test_wide_text_features_are_refused_by_exact_count(spark):
    df = spark.range(30).selectExpr("concat('c', id) as s", "id % 2 as y")
    table = LabelledTable(df, "y")
    assert fit_features(table, dataclasses.replace(TINY, categories=30)).rows == 30
    with pytest.raises(ValueError, match="more than 29 values"):
        fit_features(table, dataclasses.replace(TINY, categories=29))


def test_unseen_categories_are_all_zero(spark):
    train = spark.createDataFrame([("a", "p"), ("b", "n"), ("c", "p")], "s string, y string")
    features = fit_features(LabelledTable(train, "y"), TINY)
    test = spark.createDataFrame([("z",), ("b",)], "s string")
    rows = features.stages.transform(test).select(vector_to_array("model_features").alias("v")).collect()
    assert [r["v"] for r in rows] == [[0.0, 0.0, 0.0], [0.0, 1.0, 0.0]]


def test_unseen_test_label_is_an_error(spark, table):
    test = table.df.withColumn("y", F.lit("other"))
    with pytest.raises(ValueError):
        E.fit_and_score(table, test, TINY, ["Decision Tree"])


@pytest.mark.parametrize("name", ["Decision Tree", "SVM"])
def test_saved_model_scores_alike(spark, table, name):
    features = fit_features(table, TINY)
    model = fit_model(name, features, features.prepared(table.df), TINY)
    path = tempfile.mkdtemp(prefix="sturdytab-test-") + "/m"
    model.save(path)
    new = table.df.drop("y")
    one = adaptive.score_rows(model, new)
    assert one.columns == [*new.columns, "prediction"]
    assert sorted(adaptive.score_rows(FittedModel.load(path), new).collect()) == sorted(one.collect())


def test_single_grid(spark, table):
    train, test = train_test(table, group_split(table))
    clean = E.run_clean(train, test, TINY, ["Decision Tree"])
    results = E.run_single(train, test, [("missing", 0.1), ("imbalance", 2.0)], (42, 123), TINY, ["Decision Tree"])
    out = E.results_with_drops(results, clean)
    assert {(r["seed"], r["condition"]) for r in out.collect()} == {
        (s, c) for s in (42, 123) for c in ("missing_10", "imbalance_2to1")}
    assert out.where("macro_f1_drop is null").count() == 0


def test_adaptive_run_writes_its_outputs(spark, table):
    dirty = table.with_df(table.df.withColumn("v", F.when(F.col("id") % 9 == 0, None).otherwise(F.col("v"))))
    result = adaptive.run_adaptive(dirty, settings=TINY, models=("Logistic Regression", "Decision Tree"), folds=2)
    assert [c for c, _ in result.impurities][0] == "missing"
    path = tempfile.mkdtemp(prefix="sturdytab-test-") + "/run"
    result.write(path)
    report = spark.read.json(f"{path}/report").first()
    assert report["selected_model"] == result.selected_model
    assert sum(report["quality_audit"]["class_distribution"].asDict().values()) == 240
    assert report["final_test_metrics"]["accuracy"] == pytest.approx(result.metrics["accuracy"])
    wide = spark.read.option("header", True).csv(f"{path}/profile")
    assert {"missing_probe_f1", "missing_relative_drop", "clean_cv_macro_f1"} <= set(wide.columns)


def test_reduced_source_grid(spark, table):
    """Subset, clean, single and combined runs of the reduced grid, one model and seed."""
    out = E.run_reduced_source(table, table, 100, (42,), TINY, ["Decision Tree"])
    assert out.count() == 1 + len(E.REDUCED_SINGLE) + len(E.REDUCED_COMBINED)
    assert out.where("condition = 'clean'").first()["train_rows"] == 100


def test_training_queries_run_the_whole_grids(monkeypatch):
    import inspect

    from sturdytab.learn.models import Settings
    from sturdytab.operators.corrupt import CONDITIONS, CORRUPTIONS
    from sturdytab.plans import adaptive, experiments as E
    from sturdytab.plans.grid import SINGLE_CONDITIONS
    from sturdytab.queries import learning

    asked = []

    class Frame:
        def __getattr__(self, name):
            return lambda *args, **kw: self

    def record(module, name):
        signature = inspect.signature(getattr(module, name))

        def call(*args, **kw):
            bound = signature.bind(*args, **kw)
            bound.apply_defaults()
            asked.append((name, bound.arguments))
            return Frame()
        monkeypatch.setattr(module, name, call)

    for name in ("run_clean", "run_single", "run_combined", "run_reduced_source", "probe_scores"):
        record(E, name)
    record(adaptive, "run_adaptive")
    for name in ("selection_profile", "wide_profile"):
        monkeypatch.setattr(adaptive, name, lambda *args: Frame())
    monkeypatch.setattr(E, "results_with_drops", lambda results, clean: results)
    monkeypatch.setattr(learning, "_split", lambda spark, sf: ("train", "test"))
    monkeypatch.setattr(learning, "graded_documents", lambda spark, sf: "table")
    monkeypatch.setattr(learning, "F", Frame())
    import __spark_entry__ as entry

    names = [n for n in entry.queries() if n.startswith("train_") or n == "adaptive_run"]
    assert {f"train_combined_{n}" for n in CONDITIONS} | {f"train_{n}" for n in CORRUPTIONS} | {"train_reduced_source"} <= {*names}
    grids = {}
    for name in names:
        asked.clear()
        entry.queries()[name](None, "")
        assert asked and all(a["settings"] == Settings() for _, a in asked)
        assert all(tuple(a["seeds"]) == tuple(E.SEEDS) for _, a in asked if "seeds" in a)
        grids[name] = dict(asked)
    singles = [c for k in CORRUPTIONS for c in grids[f"train_{k}"]["run_single"]["conditions"]]
    assert sorted(singles) == sorted(SINGLE_CONDITIONS)
    assert [grids[f"train_combined_{n}"]["run_combined"]["conditions"] for n in CONDITIONS] == [(n,) for n in CONDITIONS]
    assert {c for c, _ in grids["train_probe_selection"]["probe_scores"]["impurities"]} == set(CORRUPTIONS)
