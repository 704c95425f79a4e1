"""Robustness profiles over score tables.

Score tables: clean (dataset, model, accuracy, balanced_accuracy, macro_f1); corrupted (dataset, model,
corruption, severity, condition, accuracy, balanced_accuracy, macro_f1, and seed where several were run).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from sturdytab.functions.scalars import clamp

SCORE_NAMES = ("accuracy", "balanced_accuracy", "macro_f1")


def with_clean_scores(results: DataFrame, clean: DataFrame) -> DataFrame:
    """Left join of the clean scores of (dataset, model) as clean_*; of a repeated key the best row counts."""
    base = clean.groupBy("dataset", "model").agg(*[F.max_by(c, F.struct(*SCORE_NAMES)).alias(f"clean_{c}")
                                                   for c in SCORE_NAMES])
    return results.join(base, ["dataset", "model"], "left")


def with_drops(results: DataFrame) -> DataFrame:
    """Signed drops clean - corrupted of the three scores."""
    return results.select(
        "*", *[(F.col(f"clean_{c}") - F.col(c)).alias(f"{c}_drop") for c in SCORE_NAMES])


def with_robustness(results: DataFrame) -> DataFrame:
    """Per record 1 - drop, not limited."""
    return results.withColumn("robustness_score", 1 - F.col("macro_f1_drop"))


def relative_drop(clean: Column, corrupted: Column) -> Column:
    """Share of the clean score lost, 0 for a gain or a clean score that is not positive."""
    return F.when(clean > 0, F.greatest(F.lit(0.0), clean - corrupted) / clean).otherwise(0.0)


def robustness_profile(results: DataFrame, by: list[str]) -> DataFrame:
    """Mean and worst macro F1 and drop per group, with the score 1 - mean drop, at most 1."""
    known = results
    for c in by:
        known = known.where(F.col(c).isNotNull())
    return known.groupBy(*by).agg(
        F.avg("macro_f1").alias("mean_macro_f1"),
        F.avg("macro_f1_drop").alias("mean_macro_f1_drop"),
        F.min("macro_f1").alias("worst_macro_f1"),
        F.max("macro_f1_drop").alias("worst_macro_f1_drop"),
        F.avg("accuracy_drop").alias("mean_accuracy_drop"),
    ).withColumn("robustness_score", 1 - clamp(F.col("mean_macro_f1_drop"), 0.0, float("inf")))


def model_profile(results: DataFrame) -> DataFrame:
    return robustness_profile(results, ["dataset", "model", "corruption"])


def dataset_profile(results: DataFrame) -> DataFrame:
    return robustness_profile(results, ["dataset", "model"])


def condition_winners(results: DataFrame, order: Column) -> DataFrame:
    """Best model per (dataset, condition) by macro F1; `order` decides ties, smallest first."""
    best = Window.partitionBy("dataset", "condition").orderBy(F.desc("macro_f1"), order)
    return (
        results.withColumn("place", F.row_number().over(best)).where("place = 1")
        .select("dataset", "condition", "model", "macro_f1", "balanced_accuracy")
    )
