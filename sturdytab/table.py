"""The labelled table: one target column, the rest features, optional key columns."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, functions as F, types as T

NUMERIC_TYPES = (
    T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType,
)
INTEGER_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FLOAT_TYPES = (T.FloatType, T.DoubleType)
CATEGORICAL_TYPES = (T.StringType, T.BooleanType)

# The texts a pandas CSV reader takes for a missing value.
MISSING_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# A label column with more classes than this is an identifier, not a class label.
MAX_CLASSES = 100_000


@dataclass(frozen=True)
class LabelledTable:
    """`keys` name rows uniquely and are no features; `known_rows` spares a count when the size is known."""

    df: DataFrame
    target: str
    keys: tuple[str, ...] = ()
    name: str = "table"
    known_rows: int | None = None

    def __post_init__(self):
        missing = [c for c in (self.target, *self.keys) if c not in self.df.columns]
        if missing:
            raise ValueError(f"column(s) {missing} not found in {self.name}")

    @property
    def features(self) -> list[str]:
        return [c for c in self.df.columns if c != self.target and c not in self.keys]

    def type_of(self, column: str) -> T.DataType:
        return self.df.schema[column].dataType

    @property
    def numeric(self) -> list[str]:
        return [c for c in self.features if isinstance(self.type_of(c), NUMERIC_TYPES)]

    @property
    def categorical(self) -> list[str]:
        """Text and boolean features; the audit report counts every non-numeric feature instead."""
        return [c for c in self.features if isinstance(self.type_of(c), CATEGORICAL_TYPES)]

    def rows(self) -> int:
        return self.df.count() if self.known_rows is None else self.known_rows

    def with_df(self, df: DataFrame, known_rows: int | None = None, keys: tuple[str, ...] | None = None):
        return replace(self, df=df, known_rows=known_rows, keys=self.keys if keys is None else keys)

    def split(self) -> tuple[DataFrame, DataFrame]:
        """Features and target as two frames."""
        return self.df.drop(self.target), self.df.select(self.target)


def normalise_missing(df: DataFrame, tokens: tuple[str, ...] = ()) -> DataFrame:
    """NaN, and any text in `tokens`, becomes NULL so that one state means missing."""
    out = []
    for field in df.schema:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, FLOAT_TYPES):
            c = F.when(F.isnan(c), None).otherwise(c)
        elif tokens and isinstance(field.dataType, T.StringType):
            c = F.when(c.isin(*tokens), None).otherwise(c)
        out.append(c.alias(field.name))
    return df.select(*out)


def drop_index_columns(df: DataFrame) -> DataFrame:
    """Drop columns left behind by a saved row index."""
    return df.drop(*[c for c in df.columns if c.lower().startswith("unnamed:")])


def drop_empty_columns(df: DataFrame, target: str) -> DataFrame:
    """Drop feature columns without a single value, found in one aggregate."""
    columns = [c for c in df.columns if c != target]
    if not columns:
        return df
    filled = df.agg(*[F.count(f"`{c}`").alias(c) for c in columns]).first()
    return df.drop(*[c for c in columns if filled[c] == 0])


def known_target(df: DataFrame, target: str) -> DataFrame:
    return df.where(F.col(f"`{target}`").isNotNull())


def class_counts(df: DataFrame, target: str) -> dict:
    """Rows per class (NULL is a class) on the driver; an identifier-like target is refused."""
    rows = df.groupBy(F.col(f"`{target}`").alias("label")).agg(F.count("*").alias("n")).take(MAX_CLASSES + 1)
    if len(rows) > MAX_CLASSES:
        raise ValueError(f"{target} has more than {MAX_CLASSES} classes")
    return {r["label"]: r["n"] for r in rows}


def require_classes(counts: dict, least_classes: int = 2, least_rows: int = 0) -> None:
    """Guard used before corruption, splitting and training."""
    labels = [c for c in counts if c is not None]
    if len(labels) < least_classes:
        raise ValueError(f"the target must contain at least {least_classes} classes")
    if least_rows and min(counts[c] for c in labels) < least_rows:
        raise ValueError(f"every class needs at least {least_rows} rows")
