"""Classification scores from confusion counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sturdytab.functions.scalars import safe_ratio

SCORES = ("accuracy", "balanced_accuracy", "macro_precision", "macro_recall", "macro_f1")


def confusion(df: DataFrame, truth: str, prediction: str, by: list[str] | None = None) -> DataFrame:
    """(by..., truth, prediction, n)."""
    by = by or []
    return df.groupBy(*by, F.col(truth).alias("truth"), F.col(prediction).alias("prediction")).agg(
        F.count("*").alias("n"))


def label_scores(counts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Per label over the union of true and predicted labels: support, predicted, hits, precision, recall, F1."""
    by = by or []
    zero = F.lit(0).cast("bigint")
    hit = F.when(F.col("truth").eqNullSafe(F.col("prediction")), F.col("n")).otherwise(zero)
    sides = F.array(
        F.struct(F.col("truth").alias("label"), F.col("n").alias("support"), zero.alias("predicted"),
                 hit.alias("hits")),
        F.struct(F.col("prediction").alias("label"), zero.alias("support"), F.col("n").alias("predicted"),
                 zero.alias("hits")),
    )
    marginals = counts.select(*by, F.inline(sides)).groupBy(*by, "label").agg(
        F.sum("support").alias("support"), F.sum("predicted").alias("predicted"), F.sum("hits").alias("hits"))
    return marginals.select(
        "*",
        safe_ratio(F.col("hits"), F.col("predicted")).alias("precision"),
        safe_ratio(F.col("hits"), F.col("support")).alias("recall"),
        safe_ratio(2 * F.col("hits"), F.col("support") + F.col("predicted")).alias("f1"),
    )


def scores(counts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Accuracy, balanced accuracy (labels present in the truth) and macro precision, recall, F1 (all labels)."""
    by = by or []
    return label_scores(counts, by).groupBy(*by).agg(
        (F.sum("hits") / F.sum("support")).alias("accuracy"),
        F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("balanced_accuracy"),
        F.avg("precision").alias("macro_precision"),
        F.avg("recall").alias("macro_recall"),
        F.avg("f1").alias("macro_f1"),
    )
