"""Choosing a model for a corrupted condition from its scores under single corruptions.

Inputs are score tables: clean (dataset, model, clean_f1), single (dataset, seed, model, corruption, severity,
macro_f1), combined (dataset, condition, seed, model, macro_f1). Conditions come as {name: [(corruption,
severity)]}, models as an ordered list; the earlier model wins a tie.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from sturdytab.functions.scalars import clamp
from sturdytab.operators.profile import relative_drop

# Formula names in tie order, and the blend weights 0, 0.05, ..., 1.
FORMULAS = (
    "multiplicative", "geometric_mean", "arithmetic_mean", "harmonic_mean", "minimum", "additive_drop", "mean_f1",
)
WEIGHT_STEPS = 20
TINY = 1e-12
DIGITS = 9  # scores are rounded before any comparison, so that ties do not hang on summation order


def literal_rows(columns: list[str], rows: list[tuple]) -> Column:
    """An array of structs to explode: a small configuration table inside the plan."""
    return F.array(*[F.struct(*[F.lit(v).alias(c) for c, v in zip(columns, row)]) for row in rows])


def condition_components(df: DataFrame, conditions: dict) -> DataFrame:
    """One row per component of the row's `condition`: adds corruption and severity."""
    rows = [(name, c, float(s)) for name, parts in conditions.items() for c, s in parts]
    names = ["of_condition", "corruption", "severity"]
    return (
        df.withColumn("component", F.explode(literal_rows(names, rows)))
        .where(F.col("component.of_condition") == F.col("condition"))
        .select(*df.columns, "component.corruption", "component.severity")
    )


def with_models(df: DataFrame, models: list[str]) -> DataFrame:
    """One row per model: adds model and its place in the list."""
    rows = [(m, i) for i, m in enumerate(models)]
    return df.select("*", F.inline(literal_rows(["model", "model_ord"], rows)))


def last_of(df: DataFrame, keys: list[str], value: str, order: Column | None = None) -> DataFrame:
    """One value per key, so that a lookup never multiplies rows: the last by `order`, else the largest."""
    pick = F.max(value) if order is None else F.max_by(value, order)
    return df.groupBy(*keys).agg(pick.alias(value))


def missing_baselines(combined: DataFrame, clean: DataFrame, models: list[str]) -> DataFrame:
    """(dataset, model) pairs that need a clean score and have none; must be empty before selecting."""
    needed = with_models(combined.select("dataset").distinct(), models).select("dataset", "model")
    return needed.join(clean.select("dataset", "model"), ["dataset", "model"], "left_anti")


# ---- formulas -----------------------------------------------------------------------------------

def formula_columns(clean: Column, f: Column) -> dict[str, Column]:
    """The seven aggregates over component scores `f` of one group with the clean score `clean`."""
    f = F.greatest(f, F.lit(0.0))
    safe = F.greatest(f, F.lit(TINY))
    kept = F.when(clean > 0, clamp(f / clean, 0.0, 1.0)).otherwise(0.0)
    mean = F.avg(f)
    one = F.max(clean)  # constant in the group
    return {
        "multiplicative": F.when(one > 0, one * F.product(kept)).otherwise(0.0),
        "geometric_mean": F.exp(F.avg(F.log(safe))),
        "arithmetic_mean": mean,
        "harmonic_mean": F.count(f) / F.sum(1 / safe),
        "minimum": F.min(f),
        "additive_drop": F.greatest(F.lit(0.0), one - F.sum(F.greatest(clean - f, F.lit(0.0)))),
        "mean_f1": mean,
    }


def component_scores(clean: DataFrame, single: DataFrame, combined: DataFrame, models, conditions) -> DataFrame:
    """(dataset, condition, seed, model, model_ord, clean_f1, corruption, severity, single_f1 or NULL)."""
    cases = with_models(combined.select("dataset", "condition", "seed").distinct(), models)
    clean = last_of(clean, ["dataset", "model"], "clean_f1")
    single = last_of(single, ["dataset", "seed", "model", "corruption", "severity"], "macro_f1")
    known = F.array(*[F.lit(c) for c in conditions]).cast("array<string>")
    unknown = F.concat(F.lit("unknown condition: "), F.coalesce("condition", F.lit("null")))
    cases = cases.where(F.when(F.array_contains(known, F.col("condition")), True).otherwise(F.raise_error(unknown).cast("boolean")))
    absent = F.concat(F.lit("no clean score: "), F.col("dataset"), F.lit(", "), F.col("model"))
    parts = condition_components(cases, conditions).join(clean, ["dataset", "model"], "left").withColumn(
        "clean_f1", F.coalesce("clean_f1", F.raise_error(absent).cast("double")))
    return parts.join(single, ["dataset", "seed", "model", "corruption", "severity"], "left").select(
        "dataset", "condition", "seed", "model", "model_ord", "clean_f1", "corruption", "severity",
        F.col("macro_f1").alias("single_f1"),
    )


def formula_scores(clean, single, combined, models, conditions) -> DataFrame:
    """Long table (dataset, condition, seed, model, model_ord, clean_f1, formula_ord, formula, aggregate).

    A component without a single-corruption score counts with the clean score.
    """
    parts = component_scores(clean, single, combined, models, conditions)
    f = F.coalesce("single_f1", "clean_f1")
    columns = formula_columns(F.col("clean_f1"), f)
    wide = parts.groupBy("dataset", "condition", "seed", "model", "model_ord", "clean_f1").agg(
        *[c.alias(f"f{i}") for i, c in enumerate(columns.values(), start=1)])
    cells = [F.struct(F.lit(i).alias("formula_ord"), F.lit(name).alias("formula"), F.col(f"f{i}").alias("aggregate"))
             for i, name in enumerate(columns, start=1)]
    return wide.select("dataset", "condition", "seed", "model", "model_ord", "clean_f1", F.inline(F.array(*cells)))


def blended(formulas: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Mean over seeds of w * aggregate + (1 - w) * clean for every weight step.

    Both parts are averaged over the seeds first; the blend is linear, so weights never multiply the rows of
    the shuffle.
    """
    means = formulas.groupBy("dataset", "condition", "model", "model_ord", "formula_ord", "formula").agg(
        F.avg("aggregate").alias("aggregate"), F.avg("clean_f1").alias("clean_f1"))
    step = F.explode(F.sequence(F.lit(0), F.lit(WEIGHT_STEPS)))
    weight = F.col("weight_step") / WEIGHT_STEPS
    return means.withColumn("weight_step", step).select(
        "dataset", "condition", "model", "model_ord", "formula_ord", "formula", "weight_step",
        F.round(weight * F.col("aggregate") + (1 - weight) * F.col("clean_f1"), digits).alias("estimate"),
    )


def mean_actuals(combined: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Mean over seeds of the actual score."""
    return combined.groupBy("dataset", "condition", "model").agg(
        F.round(F.avg("macro_f1"), digits).alias("actual"))


def selections(estimates: DataFrame, actuals: DataFrame, case: list[str]) -> DataFrame:
    """Per case the model with the best estimate, the best model in fact, and the regret.

    Both winners come from one aggregation per case; the struct order holds score first, then list place.
    """
    joined = estimates.join(actuals, [c for c in ("dataset", "condition", "seed", "model")
                                      if c in estimates.columns and c in actuals.columns])
    return joined.groupBy(*case).agg(
        F.min(F.struct((-F.col("estimate")).alias("s"), "model_ord", "model", "estimate", "actual")).alias("sel"),
        F.min(F.struct((-F.col("actual")).alias("s"), "model_ord", "model", "actual")).alias("ora"),
    ).select(
        *case,
        F.col("sel.model").alias("selected_model"),
        F.col("ora.model").alias("oracle_model"),
        F.col("sel.estimate").alias("selected_predicted_f1"),
        F.col("sel.actual").alias("selected_actual_f1"),
        F.col("ora.actual").alias("oracle_f1"),
        (F.col("ora.actual") - F.col("sel.actual")).alias("regret"),
        (F.col("sel.model") == F.col("ora.model")).alias("correct"),
    )


# ---- per-seed selector --------------------------------------------------------------------------

def per_seed_selection(clean, single, combined, models, conditions, digits: int = DIGITS) -> DataFrame:
    """Per (seed, dataset, condition): estimate = clean * product of kept shares; an absent component is skipped."""
    parts = component_scores(clean, single, combined, models, conditions)
    lost = clamp(relative_drop(F.col("clean_f1"), F.col("single_f1")), 0.0, 1.0)
    kept = F.when(F.col("single_f1").isNull(), 1.0).otherwise(1 - lost)
    estimates = parts.groupBy("dataset", "condition", "seed", "model", "model_ord").agg(
        F.round(F.max("clean_f1") * F.product(kept), digits).alias("estimate"))
    actuals = combined.select("dataset", "condition", "seed", "model", F.round("macro_f1", digits).alias("actual"))
    return selections(estimates, actuals, ["seed", "dataset", "condition"])


def seed_summary(selected: DataFrame) -> DataFrame:
    """Cases, hits, accuracy and mean regret per seed and over all."""
    return selected.rollup("seed").agg(
        F.count("*").alias("conditions_tested"),
        F.sum(F.col("correct").cast("bigint")).alias("correct_selections"),
        F.avg(F.col("correct").cast("double")).alias("selection_accuracy"),
        F.avg("regret").alias("mean_regret"),
        F.grouping("seed").alias("overall"),
    ).select(
        F.when(F.col("overall") == 1, "OVERALL").otherwise(F.col("seed").cast("string")).alias("seed"),
        "conditions_tested", "correct_selections", "selection_accuracy", "mean_regret",
    )


# ---- strategy choice ----------------------------------------------------------------------------

def evaluated_strategies(clean, single, combined, models, conditions) -> DataFrame:
    """Every (dataset, condition, formula, weight) with its selection, oracle and regret."""
    estimates = blended(formula_scores(clean, single, combined, models, conditions))
    return selections(estimates, mean_actuals(combined),
                      ["dataset", "condition", "formula_ord", "formula", "weight_step"])


def strategy_scores(evaluated: DataFrame, held_out: list[str] | None = None) -> DataFrame:
    """Accuracy and mean regret of each strategy over all datasets but the held-out one.

    Sums over all datasets minus the own sums give every held-out view at once, without pairing datasets.
    """
    strategy = ["formula_ord", "formula", "weight_step"]
    own = evaluated.groupBy("dataset", *strategy).agg(
        F.count("*").alias("n"), F.sum(F.col("correct").cast("bigint")).alias("hits"), F.sum("regret").alias("lost"))
    everywhere = own.groupBy(*strategy).agg(
        F.sum("n").alias("all_n"), F.sum("hits").alias("all_hits"), F.sum("lost").alias("all_lost"))
    views = own.join(everywhere, strategy)
    if held_out is not None:
        views = views.where(F.col("dataset").isin(*held_out))
    n = F.col("all_n") - F.col("n")
    return views.where(n > 0).select(
        F.col("dataset").alias("held_out"), *strategy,
        n.alias("source_cases"),
        (F.col("all_hits") - F.col("hits")).alias("source_correct"),
        F.round((F.col("all_hits") - F.col("hits")) / n, 9).alias("source_accuracy"),
        F.round((F.col("all_lost") - F.col("lost")) / n, DIGITS).alias("source_mean_regret"),
    )


def best_strategies(scores: DataFrame) -> DataFrame:
    """One strategy per held-out dataset: accuracy, then regret, then weight, then formula order."""
    order = Window.partitionBy("held_out").orderBy(
        F.desc("source_accuracy"), "source_mean_regret", "weight_step", "formula_ord")
    return scores.withColumn("place", F.row_number().over(order)).where("place = 1").drop("place")


def leave_one_out(evaluated: DataFrame, best: DataFrame) -> DataFrame:
    """Selections on each held-out dataset under the strategy chosen from the others."""
    chosen = best.select(F.col("held_out").alias("dataset"), "formula_ord", "weight_step")
    return evaluated.join(chosen, ["dataset", "formula_ord", "weight_step"]).select(
        "dataset", "condition", "formula", (F.col("weight_step") / WEIGHT_STEPS).alias("weight"),
        "selected_model", "oracle_model", "selected_predicted_f1", "selected_actual_f1", "oracle_f1",
        "regret", "correct",
    )


def overall_summary(selected: DataFrame) -> DataFrame:
    return selected.agg(
        F.count_distinct("dataset").alias("datasets"),
        F.count("*").alias("cases"),
        F.sum(F.col("correct").cast("bigint")).alias("correct"),
        F.avg(F.col("correct").cast("double")).alias("selection_accuracy"),
        F.avg("regret").alias("mean_regret"),
    )
