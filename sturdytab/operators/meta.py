"""Meta-features of a labelled table: shape, type mix, class balance, cardinalities."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sturdytab.functions.hashing import cell_text
from sturdytab.functions.scalars import side_by_side
from sturdytab.operators.audit import class_facts
from sturdytab.table import LabelledTable, drop_index_columns, normalise_missing


def distinct_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(ord, n_distinct) per column with any value. Unpivoted, so each cell is shuffled at most once, narrow."""
    cells = [
        F.struct(F.lit(i).alias("ord"), cell_text(df.schema[c]).alias("value")) for i, c in enumerate(columns)
    ]
    return (
        df.select(F.inline(F.array(*cells)))
        .where(F.col("value").isNotNull())
        .groupBy("ord", "value").agg(F.lit(1).alias("one"))
        .groupBy("ord").agg(F.count("*").alias("n_distinct"))
    )


def column_cardinality(df: DataFrame, columns: list[str], approximate: bool = False) -> DataFrame:
    """(column, n_distinct) for every column, 0 for one without values."""
    names = F.array(*[F.lit(c) for c in columns])
    if approximate:
        wide = df.agg(*[F.approx_count_distinct(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)])
        cells = [F.struct(F.lit(c).alias("column"), F.col(f"c{i}").alias("n_distinct"))
                 for i, c in enumerate(columns)]
        return wide.select(F.inline(F.array(*cells)))
    every = df.sparkSession.range(1).select(F.posexplode(names).alias("ord", "column"))
    counts = distinct_counts(df, columns)
    return every.join(counts, "ord", "left").select("column", F.coalesce("n_distinct", F.lit(0)).alias("n_distinct"))


def mean_cardinalities(df: DataFrame, numeric: list[str], categorical: list[str], approximate: bool = False):
    """One row: mean distinct count of numeric and of categorical features, 0.0 where there are none."""
    columns = [*numeric, *categorical]
    if not columns:
        return df.sparkSession.range(1).select(
            F.lit(0.0).alias("avg_numeric_cardinality"), F.lit(0.0).alias("avg_categorical_cardinality"))
    if approximate:
        counts = column_cardinality(df, columns, approximate=True).withColumn(
            "is_numeric", F.col("column").isin(*numeric) if numeric else F.lit(False))
    else:
        counts = distinct_counts(df, columns).withColumn("is_numeric", F.col("ord") < len(numeric))

    def mean(test, size):
        if not size:
            return F.lit(0.0)
        return F.coalesce(F.sum(F.when(test, F.col("n_distinct"))), F.lit(0)) / F.lit(float(size))

    return counts.agg(
        mean(F.col("is_numeric"), len(numeric)).alias("avg_numeric_cardinality"),
        mean(~F.col("is_numeric"), len(categorical)).alias("avg_categorical_cardinality"),
    )


def meta_features(table: LabelledTable, approximate: bool = False) -> DataFrame:
    """Shape, type mix, class balance and cardinalities, one row. NULL labels are ignored."""
    df = normalise_missing(drop_index_columns(table.df))
    table = table.with_df(df)
    features, numeric, categorical = table.features, table.numeric, table.categorical
    facts = side_by_side(
        df.sparkSession,
        df.agg(F.count("*").alias("n_rows")),
        class_facts(df, table.target, null_is_class=False),
        mean_cardinalities(df, numeric, categorical, approximate),
    )

    def share(part):
        return F.lit(len(part) / len(features) if features else 0.0)

    return facts.select(
        F.lit(table.name).alias("dataset"),
        "n_rows",
        F.lit(len(features)).cast("bigint").alias("n_features"),
        F.lit(len(numeric)).cast("bigint").alias("n_numeric"),
        F.lit(len(categorical)).cast("bigint").alias("n_categorical"),
        share(numeric).alias("numeric_ratio"),
        share(categorical).alias("categorical_ratio"),
        F.col("classes").alias("n_classes"),
        F.col("ratio").alias("imbalance_ratio"),
        F.col("entropy").alias("class_entropy"),
        "avg_numeric_cardinality",
        "avg_categorical_cardinality",
    )


def with_quality_rates(meta: DataFrame, reports: DataFrame) -> DataFrame:
    """Add the audit's percents as fractions by dataset name, 0.0 for a dataset without an audit."""
    rates = reports.groupBy("dataset").agg(
        F.first("missing_rate_percent").alias("m"),
        F.first("duplicate_rate_percent").alias("d"),
        F.first("outlier_row_rate_percent").alias("o"),
    )

    def fraction(c):
        return F.coalesce(F.col(c) / 100, F.lit(0.0))

    return meta.join(rates, "dataset", "left").select(
        *meta.columns,
        fraction("m").alias("missing_rate"),
        fraction("d").alias("duplicate_rate"),
        fraction("o").alias("outlier_rate"),
    )
