"""Experiment grids: which corruption is run on which dataset, at which severity, under which name."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sturdytab.functions.scalars import condition_name
from sturdytab.operators.corrupt import CONDITIONS, RATES, RATIOS
from sturdytab.operators.selector import literal_rows

SINGLE_CONDITIONS = [
    (corruption, severity)
    for corruption, levels in (
        ("missing", RATES), ("duplicates", RATES), ("label_noise", RATES), ("outliers", RATES), ("imbalance", RATIOS),
    )
    for severity in levels
]


# Corruptions the published experiments leave out of a dataset. The single-seed sweep still thins
# the classes of bank_marketing; the multi-seed and combined runs do not.
LEFT_OUT_SINGLE_SEED = {"car_evaluation": ("outliers", "imbalance")}
LEFT_OUT_MULTI_SEED = {"car_evaluation": ("outliers", "imbalance"), "bank_marketing": ("imbalance",)}


def conditions_for(dataset: str, left_out: dict[str, tuple[str, ...]]) -> list[tuple[str, float]]:
    """Single conditions that apply to one dataset."""
    return [(c, s) for c, s in SINGLE_CONDITIONS if c not in left_out.get(dataset, ())]


def combinations_for(dataset: str, left_out: dict[str, tuple[str, ...]] = LEFT_OUT_MULTI_SEED) -> list[str]:
    """Combined conditions all of whose components apply to one dataset."""
    skipped = left_out.get(dataset, ())
    return [name for name, parts in CONDITIONS.items() if not any(c in skipped for c, _ in parts)]


def applicable_conditions(datasets: DataFrame, excluded: dict[str, tuple[str, ...]]) -> DataFrame:
    """(dataset, corruption, severity, condition) for a frame (dataset) and {dataset: corruptions left out}."""
    grid = datasets.select("dataset", F.inline(literal_rows(["corruption", "severity"], SINGLE_CONDITIONS)))
    for name, corruptions in excluded.items():
        grid = grid.where(~((F.col("dataset") == name) & F.col("corruption").isin(*corruptions)))
    return grid.select("*", condition_name(F.col("corruption"), F.col("severity")).alias("condition"))
