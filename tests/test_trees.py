"""Trees, forests and boosting on blocks; grids with a journal."""

import dataclasses
import json
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from sturdytab import LabelledTable
from sturdytab.learn import trees as T
from sturdytab.learn.models import LIGHT, fit_features, fit_model
from sturdytab.plans import experiments as E

TINY = dataclasses.replace(LIGHT, trees=5, rounds=12, tree_depth=None, fourier=16, iterations=20, svm_iterations=5)


def spec_of(kind, widths, numeric, classes, **more):
    return {"kind": kind, "numeric": numeric, "offsets": [0, *np.cumsum(widths).tolist()], "classes": classes, "trees": 1,
            "rounds": 1, "depth": None, "seed": 1, "leaf_rows": 1, **more}


def plain_best(x, y, spec):
    """The split of the root by trying all of them."""
    best = None
    for j in range(x.shape[1]):
        for cut in range(spec["offsets"][j + 1] - spec["offsets"][j]):
            left = x[:, j] <= cut if j < spec["numeric"] else x[:, j] == cut
            if 0 < left.sum() < len(y):
                gain = sum((np.bincount(y[m]) ** 2).sum() / m.sum() for m in (left, ~left)) - (np.bincount(y) ** 2).sum() / len(y)
                if best is None or gain > best[0] + 1e-9:
                    best = (gain, j, cut)
    return best


def test_best_split_is_that_of_brute_force():
    draw = np.random.default_rng(3)
    for _ in range(60):
        x = np.stack([draw.integers(0, 6, 25), draw.integers(0, 3, 25), draw.integers(0, 4, 25)], 1).astype(np.int32)
        y = draw.integers(0, 3, 25)
        spec = spec_of("tree", [7, 4, 5], 2, 3)
        values = T.row_values(y.astype(float), np.zeros((25, 0)), spec, 0, 0)
        open_root = [{"column": [-1], "cut": [-1], "left": [-1], "value": [0], "open": [0]}]
        (_, keys, sums), = T.sums(x, values, open_root, spec)
        (_, node, column, cut, total, left), = T.best_splits(0, keys, sums, spec, 0)
        assert (node, column, cut) == (0, *plain_best(x, y, spec)[1:])
        assert total == np.bincount(y, minlength=3).tolist() and 0 < sum(left) < 25


def test_a_chain_of_forty_levels_is_fitted_exactly(spark):
    """A split can take only one row from the rest, and all labels differ."""
    n = 42
    rows = [(*[1.0 if i == j else 0.0 for j in range(n)], i) for i in range(n)]
    df = spark.createDataFrame(rows, ", ".join(f"c{j} double" for j in range(n)) + ", y int")
    features = fit_features(LabelledTable(df, "y"), TINY)
    model = fit_model("Decision Tree", features, features.packed(df, n), TINY)
    assert model.predict(df).where("prediction <> y").count() == 0
    tree, = json.loads(model.stages.stages[-1].getOrDefault("model"))["rounds"][0]
    depth = [0] * len(tree["left"])
    for i, left in enumerate(tree["left"]):
        if left >= 0:
            depth[left] = depth[left + 1] = depth[i] + 1
    assert max(depth) >= 40


def made(spark, classes, n=400):
    y = F.pmod(F.col("id") % 17 + F.when(F.col("id") % 5 == 0, 3).otherwise(0), F.lit(classes))
    return spark.range(n).select("id", (F.col("id") % 17 * 1.0).alias("v"), F.concat(F.lit("c"), F.col("id") % 5).alias("s"),
                                 (F.hash("id") % 50 * 0.1).alias("noise"), y.cast("int").alias("y"))


@pytest.mark.parametrize("classes", [2, 3])
@pytest.mark.parametrize("name", ["Decision Tree", "Random Forest", "XGBoost"])
def test_many_blocks_learn_as_one_does(spark, monkeypatch, name, classes):
    df = made(spark, classes)
    settings = dataclasses.replace(TINY, rounds=12 if classes == 2 else 5, round_depth=4)
    table = LabelledTable(df, "y", ("id",))
    features = fit_features(table, settings)
    prepared = features.packed(df, 400).persist()
    one = fit_model(name, features, prepared, settings)
    monkeypatch.setattr(T, "BLOCK_ROWS", 20 if name == "Decision Tree" else 150)
    monkeypatch.setattr(T, "WRITTEN", 2)
    many = fit_model(name, features, prepared, settings)
    right = [m.predict(df).where("prediction = y").count() / 400 for m in (one, many)]
    assert min(right) > (0.7 if name == "XGBoost" else 0.9), right  # a few rounds of a small step
    if name == "Decision Tree":  # nothing is drawn, so the trees are the same
        assert one.stages.stages[-1].getOrDefault("model") == many.stages.stages[-1].getOrDefault("model")


def test_a_narrow_table_of_many_rows_is_one_block(spark):
    """Boosting 120,000 different rows takes no Spark job a level, as it did beyond 50,000; wide tables have smaller blocks."""
    assert [T.block_rows(c) for c in (0, 4, 10, 20, 500)] == [200_000, 200_000, 100_000, 50_000, 50_000]
    rows = spark.range(120_000, numPartitions=3).select(
        (F.col("id") % 2 * 1.0).alias("y"), F.array((F.col("id") % 400 * 1.0), (F.col("id") / 400).cast("int") * 1.0).alias("raw"))
    cuts = [[float(i) for i in range(399)], [float(i) for i in range(299)]]
    before = spark.sparkContext._jsc.sc().statusStore().jobsList(None).size()
    model = T.fit_trees("boosted", rows, "y", "raw", 2, [], 2, 120_000, 4, 6, 1, "p", cuts=cuts)
    assert spark.sparkContext._jsc.sc().statusStore().jobsList(None).size() - before < 12
    assert len(json.loads(model.getOrDefault("model"))["rounds"]) == 4
    blocks = T.block_frame(rows, "y", "raw", cuts, 1, 3, T.block_rows(2)).collect()
    assert [b.n for b in blocks] == [120_000]


def test_a_grid_lets_go_of_finished_cells(spark, monkeypatch):
    """What a cell left on the driver is collected at its end; a cell needs a core for each of its fits."""
    calls = []
    monkeypatch.setattr(E, "_let_go", calls.append)
    table = LabelledTable(made(spark, 2, 60), "y", ("id",), "t")
    assert E.run_single(table, table, [("missing", 0.1)], (1, 2), TINY, ["Decision Tree"]).count() == 2 and len(calls) == 2
    cores = spark.sparkContext.defaultParallelism
    at_once = [E._cells_at_once(spark, dataclasses.replace(TINY, cells=8, parallelism=p)) for p in (cores, cores + 1, max(1, cores - 1))]
    assert at_once == [1, 1, 2 if cores == 2 else 1]


def test_boosting_lowers_the_loss_every_round():
    draw = np.random.default_rng(5)
    x = np.stack([draw.integers(0, 30, 300), draw.integers(0, 4, 300)], 1).astype(np.int32)
    y = ((x[:, 0] > 12) ^ (x[:, 1] == 2)).astype(float)
    spec, margins, losses = spec_of("boosted", [31, 5], 1, 2, depth=3), np.zeros((300, 1)), []
    for number in range(25):
        values = T.row_values(y, margins, spec, number, 0)
        trees = T.grown(lambda t: [s for k, keys, v in T.sums(x, values, t, spec) for s in T.best_splits(k, keys, v, spec, number)], 1, spec)
        T.advanced(x, margins, [trees], spec)
        losses.append(float(np.log1p(np.exp(np.where(y == 1, -1, 1) * margins[:, 0])).mean()))
    assert losses == sorted(losses, reverse=True) and losses[-1] < 0.35


def test_journal_spares_finished_cells_and_runs_the_rest(spark, monkeypatch):
    table = LabelledTable(made(spark, 2, 120), "y", ("id",), "journalled")
    journal, fitted, real = tempfile.mkdtemp(prefix="sturdytab-test-") + "/journal", [], E.fit_and_score

    def counted(train, *args, **kw):
        fitted.append(train.name)
        if len(fitted) == 2:
            raise RuntimeError("an executor is gone")
        return real(train, *args, **kw)

    monkeypatch.setattr(E, "fit_and_score", counted)
    grid = [("missing", 0.1), ("duplicates", 0.1), ("label_noise", 0.1)]
    settings = dataclasses.replace(TINY, cells=1)
    first = E.run_single(table, table, grid, (42,), settings, ["Decision Tree"], journal=journal).collect()
    assert len(fitted) == 3 and [r.condition for r in first if r.error] == ["duplicates_10"]
    assert "an executor is gone" in next(r.error for r in first if r.error)
    second = E.run_single(table, table, grid, (42,), settings, ["Decision Tree"], journal=journal).collect()
    assert len(fitted) == 4 and not any(r.error for r in second)
    assert {r.condition: r.macro_f1 for r in first if not r.error}.items() <= {r.condition: r.macro_f1 for r in second}.items()
    third = E.run_single(table, table, grid, (42,), settings, ["Decision Tree"], journal=journal).collect()
    assert len(fitted) == 4 and sorted(third, key=str) == sorted(second, key=str)


def test_a_fault_before_the_fits_is_an_error_row(spark):
    table = LabelledTable(made(spark, 2, 60), "y", ("id",), "t")
    rows = E._grid(table, table, [(1, "broken", None, None, lambda: 1 / 0), (1, "clean", None, None, lambda: table)], TINY,
                   ["Decision Tree"], None).collect()
    assert {r.condition: (r.error or "").split(":")[0] for r in rows} == {"broken": "ZeroDivisionError", "clean": ""}


def test_a_small_table_is_its_own_reduced_source(spark):
    table = LabelledTable(made(spark, 2, 60), "y", ("id",), "t")
    out = E.run_reduced_source(table, table, 10_000, (42,), TINY, ["Decision Tree"])
    assert out.count() == 8 and out.where("condition = 'clean'").first()["train_rows"] == 60


@pytest.mark.parametrize("rows", [50_000, 100])
def test_a_forest_reaches_the_driver_only_as_a_folder(spark, monkeypatch, rows):
    """Votes of trees read from files are those of the same trees as JSON, before and after saving, on one block and on several."""
    df = made(spark, 2)
    features = fit_features(LabelledTable(df, "y", ("id",)), TINY)
    prepared = features.packed(df, 400).persist()
    monkeypatch.setattr(T, "BLOCK_ROWS", rows)
    small = fit_model("Random Forest", features, prepared, TINY)
    monkeypatch.setattr(T, "INLINE", 20)
    large = fit_model("Random Forest", features, prepared, TINY)
    kept = [m.stages.stages[-1] for m in (small, large)]
    whole, top = (json.loads(m.getOrDefault("model"))["rounds"][0] for m in kept)
    assert [bool(m.getOrDefault("folder")) for m in kept] == [False, True]
    assert len(whole) == 5 and sum(len(t["left"]) for t in top) < sum(len(t["left"]) for t in whole)
    path = tempfile.mkdtemp(prefix="sturdytab-test-") + "/model"
    large.save(path)
    back = type(large).load(path)
    assert back.stages.stages[-1].getOrDefault("folder").startswith(path)
    answers = [sorted(m.predict(df).select("id", "prediction").collect()) for m in (small, large, back)]
    assert answers[0] == answers[1] == answers[2] and len(answers[0]) == 400


def test_rows_alike_count_as_many():
    draw = np.random.default_rng(7)
    x = np.stack([draw.integers(0, 6, 900), draw.integers(0, 4, 900)], 1).astype(np.int32)
    y = draw.integers(0, 3, 900).astype(float)
    spec = spec_of("tree", [7, 5], 1, 3)
    few, codes, counts = T.collapsed(x, y, np.ones(900, np.int64))
    assert len(few) <= 72 and counts.sum() == 900
    one, many = (T.whole_tree(a, T.row_values(b, np.zeros((len(b), 0)), spec, 0, 0, c)(0), spec, 0, 0)
                 for a, b, c in ((few, codes, counts), (x, y, None)))
    assert T.as_lists(one) == T.as_lists(many)
    forest = spec | {"kind": "forest"}
    drawn = [T.row_values(codes, np.zeros((len(codes), 0)), forest, 0, 0, counts)(k).sum() for k in range(200)]
    assert abs(np.mean(drawn) - 900) < 10 and 20 < np.std(drawn) < 40
