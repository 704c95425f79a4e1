"""Train-and-score grids: clean, single corruptions, combined corruptions, several seeds, fold probes.

A corrupted training table is prepared once, written, and shared by all models; the models of one condition are
fitted side by side from a few driver threads. Only score rows come back to the driver.

A grid may keep a journal, a folder of its own: each cell's rows are written there when the cell is done, and a later run of the same
grid takes finished cells from it and runs the others. A cell with an error is not finished.
"""

from __future__ import annotations

import gc
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from sturdytab.learn.models import CODE, MODELS, PREDICTION, FittedModel, Settings, fit_features, fit_model
from sturdytab.operators.corrupt import CONDITIONS, EXPERIMENT, PROBE, corrupt, corrupt_combined, keyed
from sturdytab.operators.metrics import SCORES, confusion, scores
from sturdytab.operators.profile import with_clean_scores, with_drops
from sturdytab.operators.split import stratified_folds, stratified_subset
from sturdytab.plans.grid import SINGLE_CONDITIONS
from sturdytab.session import shared_folder
from sturdytab.table import LabelledTable, class_counts, known_target

# Seeds and the reduced grid of the published experiments.
SEEDS = (42, 123, 2026)
REDUCED_SINGLE = [("missing", 0.10), ("label_noise", 0.10), ("duplicates", 0.10), ("outliers", 0.10)]
REDUCED_COMBINED = ("missing_noise", "missing_noise_duplicates", "missing_noise_outliers")
SUBSET_ROWS = 10_000

RESULT_SCHEMA = (
    "dataset string, seed long, condition string, corruption string, severity double, model string, "
    + ", ".join(f"{s} double" for s in SCORES) + ", training_time_seconds double, train_rows long, error string")


def _side_by_side(spark: SparkSession, parallelism: int, task, items: list) -> list:
    """Run independent Spark jobs from a few driver threads."""
    with ThreadPool(min(parallelism, len(items))) as pool:
        return pool.map(inheritable_thread_target(spark)(task), items)


def _cells_at_once(spark: SparkSession, settings: Settings) -> int:
    """As many cells as have a core for each of their fits, `cells` at most: each one more costs the driver threads, plans and memory."""
    return max(1, min(settings.cells, spark.sparkContext.defaultParallelism // settings.parallelism))


def _let_go(spark: SparkSession) -> None:
    """Collect what a finished cell left on the driver. Spark drops its shuffle files and broadcasts only then, and the driver's
    heap, which else grows to its limit with the jobs of a grid, goes back to what is in use."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def fit_and_score(train: LabelledTable, test: DataFrame, settings: Settings, models=MODELS, classes=None,
                  failures: list | None = None) -> tuple[list[dict], dict[str, FittedModel]]:
    """Scores of each model on the test rows. A model that fails does not stop the others."""
    spark = train.df.sparkSession
    shared_folder(spark)  # boosting cuts its lineage there
    features = fit_features(train, settings, classes)
    counts = class_counts(test, train.target)
    unknown = set(c for c in counts if c is not None) - set(features.classes)
    if unknown:
        raise ValueError(f"labels not seen in training: {sorted(unknown)}")
    prepared = features.packed(train.df, features.rows)
    held = features.packed(test, sum(counts.values()))

    def one(name):
        try:
            fitted = fit_model(name, features, prepared, settings)
            scored = fitted.stages.stages[-1].transform(held)
            row = scores(confusion(scored, CODE, PREDICTION)).first()
            return name, {"model": name, **{s: row[s] for s in SCORES}, "training_time_seconds": fitted.seconds,
                          "train_rows": features.rows}, fitted, None
        except Exception as error:  # the other models of the grid still count
            return name, None, None, f"{type(error).__name__}: {error}".splitlines()[0]

    try:
        done = _side_by_side(spark, settings.parallelism, one, list(models))
    finally:
        _let_go(spark)
    if failures is not None:
        failures += [(name, error) for name, _, _, error in done if error]
    return [row for _, row, _, _ in done if row], {name: fitted for name, _, fitted, _ in done if fitted}


def _frame(spark: SparkSession, rows: list[dict]) -> DataFrame:
    columns = [c.split()[0] for c in RESULT_SCHEMA.split(", ")]
    return spark.createDataFrame([tuple(row.get(c) for c in columns) for row in rows], RESULT_SCHEMA)


def _finished(spark: SparkSession, journal: str | None, dataset: str, models) -> dict[tuple, list[dict]]:
    """Journal rows of each (seed, condition) whose models all have scores; at most one row per fit of the grid."""
    if journal is None:
        return {}
    try:
        rows = spark.read.schema(RESULT_SCHEMA).parquet(f"{journal}/*").where(F.col("dataset") == dataset).collect()
    except AnalysisException as absent:
        if absent.getCondition() != "PATH_NOT_FOUND":
            raise
        return {}
    cells: dict[tuple, list[dict]] = {}
    for row in rows:
        cells.setdefault((row["seed"], row["condition"]), []).append(row.asDict())
    return {key: [r for r in got if r["model"] in models] for key, got in cells.items()
            if set(models) <= {r["model"] for r in got if r["error"] is None}}


def _grid(train, test, conditions, settings, models, failures, journal=None):
    """conditions: (seed, condition, corruption, severity, callable giving the training table).

    A model that failed keeps its row: no scores, and the reason in `error`. So do all models of a cell whose table failed.
    """
    spark = train.df.sparkSession
    classes = sorted(c for c in class_counts(train.df, train.target) if c is not None)
    finished = _finished(spark, journal, train.name, models)

    def cell(item):
        seed, condition, corruption, severity, make = item
        errors: list = []
        try:
            got, _ = fit_and_score(make(), test.df, settings, models, classes, errors)
        except Exception as error:  # the other cells of the grid still count
            got, errors = [], [(name, f"{type(error).__name__}: {error}".splitlines()[0]) for name in models]
        got += [{"model": name, "error": error} for name, error in errors]
        rows = [{"dataset": train.name, "seed": seed, "condition": condition, "corruption": corruption,
                 "severity": severity, **row} for row in got]
        if journal is not None:
            _frame(spark, rows).coalesce(1).write.mode("overwrite").parquet(f"{journal}/{train.name}-{seed}-{condition}")
        return rows, [(condition, name, error) for name, error in errors]

    open_cells = [c for c in conditions if (c[0], c[1]) not in finished]
    done = _side_by_side(spark, _cells_at_once(spark, settings), cell, open_cells) if open_cells else []
    if failures is not None:
        failures += [f for _, errors in done for f in errors]
    known = [row for c in conditions for row in finished.get((c[0], c[1]), [])]
    return _frame(spark, known + [row for rows, _ in done for row in rows])


def run_clean(train: LabelledTable, test: LabelledTable, settings: Settings = Settings(), models=MODELS,
              failures: list | None = None, journal: str | None = None) -> DataFrame:
    return _grid(train, test, [(None, "clean", None, None, lambda: train)], settings, models, failures, journal)


def condition_label(corruption: str, severity: float) -> str:
    return f"imbalance_{int(severity)}to1" if corruption == "imbalance" else f"{corruption}_{int(round(severity * 100, 9))}"


def run_single(train: LabelledTable, test: LabelledTable, conditions=SINGLE_CONDITIONS, seeds=SEEDS,
               settings: Settings = Settings(), models=MODELS, failures: list | None = None,
               journal: str | None = None) -> DataFrame:
    """Every (corruption, severity) under every seed; the split stays fixed."""
    base = keyed(train)
    return _grid(base, test, [
        (seed, condition_label(c, s), c, float(s),
         lambda c=c, s=s, seed=seed: corrupt(base, c, s, seed, EXPERIMENT))
        for seed in seeds for c, s in conditions
    ], settings, models, failures, journal)


def run_combined(train: LabelledTable, test: LabelledTable, conditions=tuple(CONDITIONS), seeds=SEEDS,
                 settings: Settings = Settings(), models=MODELS, failures: list | None = None,
                 journal: str | None = None) -> DataFrame:
    base = keyed(train)
    return _grid(base, test, [
        (seed, name, None, None, lambda name=name, seed=seed: corrupt_combined(base, name, seed, EXPERIMENT))
        for seed in seeds for name in conditions
    ], settings, models, failures, journal)


def results_with_drops(results: DataFrame, clean: DataFrame) -> DataFrame:
    return with_drops(with_clean_scores(results, clean))


def run_reduced_source(train: LabelledTable, test: LabelledTable, size: int = SUBSET_ROWS, seeds=SEEDS,
                       settings: Settings = Settings(), models=MODELS, journal: str | None = None) -> DataFrame:
    """A stratified subset of the training rows, clean, under four single corruptions and three combinations.

    A training part of no more than `size` labelled rows is taken whole; `train_rows` tells how many there were.
    """
    labelled = known_target(train.df, train.target)
    rows = labelled.count()
    subset = stratified_subset(train, size) if rows > size else train.with_df(labelled, rows)
    shared = {"settings": settings, "models": models, "journal": journal}
    return (
        run_clean(subset, test, **shared)
        .unionByName(run_single(subset, test, REDUCED_SINGLE, seeds, **shared))
        .unionByName(run_combined(subset, test, REDUCED_COMBINED, seeds, **shared))
    )


# ---- fold probes --------------------------------------------------------------------------------

PROBE_SCHEMA = "model string, model_ord int, corruption string, fold int, macro_f1 double"


def probe_scores(table: LabelledTable, impurities: list[tuple[str, float]], seed: int = 42, folds: int = 3,
                 settings: Settings = Settings(), models=MODELS) -> DataFrame:
    """(model, corruption or NULL, fold, macro_f1): training folds are corrupted, validation folds are not.

    The clean scores use the folds of `seed`, all impurities share those of seed + 100. Each corrupted fold is
    made once for all models.
    """
    base = keyed(table)
    spark = base.df.sparkSession
    cells = []
    for kinds, split_seed in (([(None, None)], seed), (impurities, seed + 100)):
        if not kinds:
            continue
        split = stratified_folds(base, folds, split_seed)  # a narrow plan, cheap to run again
        numbers = sorted(r[0] for r in split.select("fold").distinct().collect())  # at most `folds` rows
        classes = sorted(c for c in class_counts(split, base.target) if c is not None)
        for fold in numbers:
            train = base.with_df(split.where(F.col("fold") != fold).drop("fold"))
            validation = split.where(F.col("fold") == fold).drop("fold")
            cells += [(train, validation, classes, fold, split_seed + fold + 1, *kind) for kind in kinds]

    def probe(cell):
        train, validation, classes, fold, corruption_seed, corruption, severity = cell
        if corruption is not None:
            train = corrupt(train, corruption, severity, corruption_seed, PROBE, offset=False)
        errors: list = []
        got, _ = fit_and_score(train, validation, settings, models, classes, errors)
        if errors:
            raise RuntimeError(f"probe failed: {errors}")
        return [(r["model"], models.index(r["model"]), corruption, fold, r["macro_f1"]) for r in got]

    done = _side_by_side(spark, _cells_at_once(spark, settings), probe, cells)
    return spark.createDataFrame([row for rows in done for row in rows], PROBE_SCHEMA)
