"""Column helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def clamp(c: Column, low: float, high: float) -> Column:
    """Limit to [low, high]; NULL stays NULL (greatest/least alone would replace it)."""
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(low)), F.lit(high)))


def safe_ratio(part: Column, whole: Column) -> Column:
    """part / whole as double, 0.0 where it is undefined."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def as_number(c: Column) -> Column:
    """Text as double; NULL where it is no number."""
    return c.try_cast("double")


def floor_count(rows, rate: float) -> int:
    """Rows to touch when the product is truncated."""
    return int(rows * rate)


def half_even_count(rows, rate: float) -> int:
    """Rows to touch when the product is rounded half to even."""
    return int(round(rows * rate))


def condition_name(corruption: Column, severity: Column) -> Column:
    """`missing_10` for a rate, `imbalance_5to1` for a ratio."""
    return F.when(
        corruption == "imbalance",
        F.concat(F.lit("imbalance_"), severity.cast("bigint").cast("string"), F.lit("to1")),
    ).otherwise(F.concat_ws("_", corruption, F.floor(F.bround(severity * 100, 9)).cast("string")))


def side_by_side(spark: SparkSession, *frames: DataFrame) -> DataFrame:
    """Put frames of exactly one row next to each other, as scalar subqueries."""
    if len(frames) == 1:
        return frames[0]
    parts = [
        f.agg(F.first(F.struct(*[F.col(f"`{c}`") for c in f.columns])).alias("v")).scalar().alias(f"part{i}")
        for i, f in enumerate(frames)
    ]
    return spark.range(1).select(*parts).select(*[f"part{i}.*" for i in range(len(frames))])
