"""Feature preparation fitted on a training table: median and mode imputation, scaling, label encoding."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from sturdytab.operators.quantiles import profile_columns
from sturdytab.table import LabelledTable, class_counts


def modes(df: DataFrame, columns: list[str]) -> dict[str, str | None]:
    """Most frequent value of each text column, the lowest on a tie; NULL is ignored.

    Values are counted with map-side combine and compared per column, so no task holds all values of a column.
    """
    if not columns:
        return {}
    cells = [F.struct(F.lit(i).alias("ord"), F.col(f"`{c}`").cast("string").alias("value"))
             for i, c in enumerate(columns)]
    counted = (
        df.select(F.inline(F.array(*cells))).where(F.col("value").isNotNull())
        .groupBy("ord", "value").agg(F.count("*").alias("n"))
    )
    best = counted.groupBy("ord").agg(F.min(F.struct((-F.col("n")).alias("less"), F.col("value"))).alias("top"))
    got = {r["ord"]: r["top"]["value"] for r in best.collect()}  # one row per column
    return {c: got.get(i) for i, c in enumerate(columns)}


@dataclass
class FittedPrep:
    """Constants learnt from the training table. Columns without any value in training are dropped."""

    numeric: list[str]
    categorical: list[str]
    medians: dict[str, float] = field(default_factory=dict)
    means: dict[str, float] = field(default_factory=dict)
    deviations: dict[str, float] = field(default_factory=dict)
    modes: dict[str, str] = field(default_factory=dict)

    def select_list(self) -> list[str]:
        """SQL of the prepared columns: scaled numerics as double, imputed categoricals as text."""
        out = []
        for c in self.numeric:
            spread = self.deviations[c] or 1.0
            filled = f"coalesce(cast(`{c}` as double), {self.medians[c]!r}D)"
            out.append(f"({filled} - {self.means[c]!r}D) / {spread!r}D AS `{c}`")
        for c in self.categorical:
            text = self.modes[c].replace("\\", "\\\\").replace("'", "\\'")
            out.append(f"coalesce(cast(`{c}` as string), '{text}') AS `{c}`")
        return out

    def transform(self, df: DataFrame, keep: list[str]) -> DataFrame:
        return df.selectExpr(*[f"`{c}`" for c in keep], *self.select_list())


def fit_prep(table: LabelledTable) -> FittedPrep:
    """Exact medians, modes, means and population deviations of the imputed training features."""
    profiles = profile_columns(table.df, table.numeric, (0.5,), table.rows())
    numeric = [c for c, p in profiles.items() if p.n]
    top = modes(table.df, table.categorical)
    categorical = [c for c, value in top.items() if value is not None]
    if not numeric and not categorical:
        raise ValueError("no usable feature columns found")
    fitted = FittedPrep(numeric, categorical, {c: profiles[c].quantiles[0.5] for c in numeric},
                        modes={c: top[c] for c in categorical})
    if numeric:
        filled = {c: F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(fitted.medians[c])) for c in numeric}
        row = table.df.agg(*[
            a for i, c in enumerate(numeric)
            for a in (F.avg(filled[c]).alias(f"m{i}"), F.stddev_pop(filled[c]).alias(f"s{i}"))
        ]).first()
        for i, c in enumerate(numeric):
            fitted.means[c] = row[f"m{i}"]
            # a constant column must scale to 0, not to rounding noise
            flat = profiles[c].low == profiles[c].high == fitted.medians[c]
            fitted.deviations[c] = 0.0 if flat else row[f"s{i}"]
            if flat:
                fitted.means[c] = fitted.medians[c]
    return fitted


def class_list(df: DataFrame, target: str) -> list:
    """Known classes in ascending order; the position is the code of the class."""
    return sorted(c for c in class_counts(df, target) if c is not None)
