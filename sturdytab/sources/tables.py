"""Reading and writing labelled tables and reports."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from sturdytab.table import MISSING_TOKENS, LabelledTable, drop_index_columns, normalise_missing


DATE, TIME = r"^\d{4}-\d{2}-\d{2}", r"^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}"
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$|^[+-]?(NaN|Infinity)$"
#: Types a column of texts may have, the narrowest first, and the pattern their texts must match.
INFERRED = [("int", r"^[+-]?\d+$"), ("bigint", r"^[+-]?\d+$"), ("double", NUMBER), ("date", DATE + "$"),
            ("timestamp", TIME), ("boolean", r"^(?i)(true|false)$")]


def typed_texts(text: DataFrame) -> DataFrame:
    """Each text column in the first type that fits all its texts; one aggregate counts the misfits. A column without any
    text stays text."""
    counts = []
    for i, name in enumerate(text.columns):
        c = F.col(f"`{name}`")
        counts.append(F.count(c).alias(f"n{i}"))
        for j, (kind, pattern) in enumerate(INFERRED):
            counts.append(F.count(F.when(F.trim(c).rlike(pattern), F.trim(c).try_cast(kind))).alias(f"n{i}_{j}"))
    found = text.agg(*counts).first()
    out = []
    for i, name in enumerate(text.columns):
        c = F.col(f"`{name}`")
        fits = [kind for j, (kind, _) in enumerate(INFERRED) if 0 < found[f"n{i}"] == found[f"n{i}_{j}"]]
        out.append((F.trim(c).cast(fits[0]) if fits else c).alias(name))
    return text.select(*out)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None, header: bool = True,
             multi_line: bool = False) -> DataFrame:
    """A CSV table with missing texts as NULL. Without a schema the types are inferred, which costs a scan.

    Columns are read as text first: a missing text in a numeric column is NULL, any other misfit an error. With a header
    the schema's columns are taken by name, wherever they stand; an absent one is an error, further ones are left out,
    and files with other headers are an error too. Files are split between tasks, so a quoted text must not hold line
    breaks; `multi_line` allows them and reads each file in one task.
    """
    reader = spark.read.option("header", header).option("quote", '"').option("escape", '"').option("mode", "FAILFAST")
    reader = reader.option("multiLine", multi_line)
    names = reader.csv(path).columns if header else [f.name for f in schema]
    absent = [f.name for f in schema or [] if f.name not in names]
    if absent:
        raise ValueError(f"columns not in the header: {', '.join(absent)}")
    raw = T.StructType([T.StructField(n, T.StringType()) for n in names])
    text = normalise_missing(reader.option("enforceSchema", not header).schema(raw).csv(path), MISSING_TOKENS)
    if schema is None:
        return normalise_missing(typed_texts(text))
    typed = text.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema])
    return normalise_missing(typed)


def read_headerless_csv(spark: SparkSession, path: str, schema: T.StructType, multi_line: bool = False) -> DataFrame:
    """A CSV without a header row; the names come from the schema."""
    return read_csv(spark, path, schema, header=False, multi_line=multi_line)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return normalise_missing(spark.read.parquet(path))


@dataclass(frozen=True)
class Source:
    """Catalog entry: how to read a dataset and what it predicts."""

    path: str
    target: str
    keys: tuple[str, ...] = ()
    columns: tuple[str, ...] = ()  # empty: every column
    fmt: str = "parquet"
    schema: T.StructType | None = None
    supports_outliers: bool = True
    supports_imbalance: bool = True
    multi_line: bool = False  # CSV texts that hold line breaks; each file is then read by one task


READERS: dict[str, Callable[[SparkSession, Source], DataFrame]] = {
    "parquet": lambda spark, s: read_parquet(spark, s.path),
    "csv": lambda spark, s: read_csv(spark, s.path, s.schema, multi_line=s.multi_line),
    "headerless_csv": lambda spark, s: read_headerless_csv(spark, s.path, s.schema, s.multi_line),
}


def load(spark: SparkSession, catalog: dict[str, Source], name: str) -> LabelledTable:
    """A table of the catalog. Only the listed columns are read."""
    if name not in catalog:
        raise KeyError(f"unknown dataset: {name}")
    source = catalog[name]
    df = drop_index_columns(READERS[source.fmt](spark, source))
    if source.columns:
        wanted = list(dict.fromkeys([*source.keys, *source.columns, source.target]))
        df = df.select(*wanted)
    return LabelledTable(df, source.target, source.keys, name)


def write_table(df: DataFrame, path: str, by: tuple[str, ...] = (), fmt: str = "parquet") -> None:
    """Write a processed, corrupted, split or result table, partitioned by configuration columns."""
    writer = df.write.mode("errorifexists")
    if fmt == "csv":
        writer = writer.option("header", True).option("quote", '"').option("escape", '"')
    if by:
        writer = writer.partitionBy(*by)
    writer.format(fmt).save(path)


def write_report(report: DataFrame, path: str) -> None:
    """The nested report as JSON and its flat part as CSV."""
    report.write.mode("errorifexists").json(f"{path}/json")
    flat = [f.name for f in report.schema if not isinstance(f.dataType, (T.MapType, T.ArrayType, T.StructType))]
    report.select(*flat).write.mode("errorifexists").option("header", True).csv(f"{path}/csv")


def dtype_histogram(df: DataFrame, target: str) -> dict[str, int]:
    """Feature columns per type."""
    out: dict[str, int] = {}
    for field in df.schema:
        if field.name != target:
            kind = field.dataType.simpleString()
            out[kind] = out.get(kind, 0) + 1
    return out


def summary(table: LabelledTable) -> DataFrame:
    """Long summary (item, name, value): size, class counts and percents, feature types."""
    df = table.df
    shape = df.agg(F.count("*").alias("rows"))
    sized = [F.struct(F.lit("rows").alias("item"), F.lit("").alias("name"), F.col("rows").cast("double").alias("value")),
             F.struct(F.lit("columns").alias("item"), F.lit("").alias("name"), F.lit(float(len(df.columns))).alias("value"))]
    for kind, n in sorted(dtype_histogram(df, table.target).items()):
        sized.append(F.struct(F.lit("type").alias("item"), F.lit(kind).alias("name"), F.lit(float(n)).alias("value")))
    target = F.col(f"`{table.target}`")
    counts = df.where(target.isNotNull()).groupBy(target.alias("label")).agg(F.count("*").alias("n"))
    total = df.agg(F.count(target).alias("n"))
    label = F.col("label").cast("string")
    classes = counts.select(F.inline(F.array(
        F.struct(F.lit("class").alias("item"), label.alias("name"), F.col("n").cast("double").alias("value")),
        F.struct(F.lit("class_percent").alias("item"), label.alias("name"),
                 F.bround(F.col("n") / total.scalar() * 100, 2).alias("value")),
    )))
    return shape.select(F.inline(F.array(*sized))).unionByName(classes)
