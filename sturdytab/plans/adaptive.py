"""From a labelled table to a model that suits its impurities: audit, detect, probe, choose, train, test, score."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from sturdytab.functions.scalars import clamp
from sturdytab.learn.models import MODELS, FittedModel, Settings
from sturdytab.operators.audit import class_maps, detect_impurities, fraction_audit
from sturdytab.operators.corrupt import keyed
from sturdytab.operators.profile import relative_drop
from sturdytab.operators.split import holdout_split
from sturdytab.plans.experiments import fit_and_score, probe_scores
from sturdytab.sources.tables import write_table
from sturdytab.table import (
    LabelledTable, class_counts, drop_empty_columns, drop_index_columns, known_target, normalise_missing,
    require_classes,
)


def selection_profile(probes: DataFrame) -> DataFrame:
    """Long probes -> (model, model_ord, corruption, probe_f1, clean_f1, relative_drop), means over the folds."""
    means = probes.groupBy("model", "model_ord", "corruption").agg(F.avg("macro_f1").alias("probe_f1"))
    clean = means.where(F.col("corruption").isNull()).select("model", F.col("probe_f1").alias("clean_f1"))
    return means.join(clean, "model").withColumn(
        "relative_drop", clamp(relative_drop(F.col("clean_f1"), F.col("probe_f1")), 0.0, 1.0))


def estimates(profile: DataFrame) -> DataFrame:
    """(model, model_ord, clean_cv_macro_f1, estimated_combined_macro_f1): clean times the kept shares."""
    kept = F.when(F.col("corruption").isNull(), 1.0).otherwise(1 - F.col("relative_drop"))
    return profile.groupBy("model", "model_ord").agg(
        F.max("clean_f1").alias("clean_cv_macro_f1"),
        (F.max("clean_f1") * F.product(kept)).alias("estimated_combined_macro_f1"))


def wide_profile(profile: DataFrame, corruptions: list[str]) -> DataFrame:
    """One row per model with <corruption>_probe_f1 and <corruption>_relative_drop columns."""
    best = estimates(profile)
    if not corruptions:
        return best.drop("model_ord")
    pivoted = profile.where(F.col("corruption").isNotNull()).groupBy("model").pivot("corruption", corruptions).agg(
        F.first("probe_f1").alias("probe_f1"), F.first("relative_drop").alias("relative_drop"))
    return best.drop("model_ord").join(pivoted, "model")


def chosen_model(profile: DataFrame) -> str:
    """The best estimate; the earlier model wins a tie."""
    return estimates(profile).orderBy(F.desc("estimated_combined_macro_f1"), "model_ord").first()["model"]


@dataclass
class AdaptiveResult:
    selected_model: str
    audit: DataFrame
    classes: dict  # rows per class
    impurities: list[tuple[str, float]]
    profile: DataFrame  # long
    metrics: dict[str, float]
    model: FittedModel
    calibration_seconds: float

    def report(self) -> DataFrame:
        """One nested row: audit with class distribution, impurities, chosen model, estimate, test metrics, times."""
        best = estimates(self.profile).where(F.col("model") == self.selected_model)
        found = [F.struct(F.lit(c).alias("corruption"), F.lit(s).alias("severity")) for c, s in self.impurities]
        nothing = F.array().cast("array<struct<corruption:string,severity:double>>")
        counts = class_maps(self.audit.sparkSession, self.classes).select("class_counts")
        return self.audit.select(
            F.col("dataset"),
            F.lit(self.model.target).alias("target"),
            F.lit(self.selected_model).alias("selected_model"),
            best.select("estimated_combined_macro_f1").scalar().alias("estimated_combined_macro_f1"),
            F.struct(*[F.lit(v).alias(k) for k, v in self.metrics.items()]).alias("final_test_metrics"),
            F.lit(self.calibration_seconds).alias("calibration_time_seconds"),
            F.lit(self.model.seconds).alias("training_time_seconds"),
            F.struct(*[F.col(c) for c in self.audit.columns], counts.scalar().alias("class_distribution"))
            .alias("quality_audit"),
            (F.array(*found) if found else nothing).alias("detected_impurities"),
        )

    def write(self, path: str) -> None:
        """Model, selection profile, audit and report below one path."""
        self.model.save(f"{path}/model")
        write_table(wide_profile(self.profile, [c for c, _ in self.impurities]), f"{path}/profile", fmt="csv")
        write_table(self.audit, f"{path}/audit", fmt="json")
        write_table(self.report(), f"{path}/report", fmt="json")


def cleaned(table: LabelledTable) -> LabelledTable:
    """Index columns, empty columns and rows without a target removed; NaN becomes NULL."""
    df = drop_index_columns(normalise_missing(table.df))
    df = known_target(drop_empty_columns(df, table.target), table.target)
    return table.with_df(df)


def run_adaptive(table: LabelledTable, test_share: float = 0.2, seed: int = 42, settings: Settings = Settings(),
                 models=MODELS, folds: int = 3) -> AdaptiveResult:
    """Audit the table, probe every model under the impurities found, train the choice and test it."""
    clean = cleaned(table)
    counts = class_counts(clean.df, clean.target)
    require_classes(counts, 2, 2)
    audit = fraction_audit(clean)
    found = detect_impurities(audit).orderBy("ord").collect()  # at most five rows
    impurities = [(r["corruption"], r["severity"]) for r in found]
    base = keyed(clean)
    parts = holdout_split(base, test_share, seed)
    train = base.with_df(parts.where("part = 'train'").drop("part"))
    test = parts.where("part = 'test'").drop("part")
    start = time.monotonic()
    profile = selection_profile(probe_scores(train, impurities, seed, folds, settings, models))
    selected = chosen_model(profile)
    calibration = time.monotonic() - start
    errors: list = []
    rows, fitted = fit_and_score(train, test, settings, [selected], failures=errors)
    if errors:
        raise RuntimeError(f"training of the chosen model failed: {errors}")
    metrics = {k: v for k, v in rows[0].items() if k not in ("model", "training_time_seconds", "train_rows")}
    return AdaptiveResult(selected, audit, counts, impurities, profile, metrics, fitted[selected], calibration)


def score_rows(model: FittedModel, df: DataFrame) -> DataFrame:
    """New rows with a decoded `prediction`; a target column among them is ignored."""
    return model.predict(normalise_missing(df))
