"""Quality audit of a labelled table: missing cells, duplicates, IQR outliers, label conflicts, class balance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sturdytab.functions.hashing import row_digest, row_identity
from sturdytab.functions.scalars import clamp, safe_ratio, side_by_side
from sturdytab.operators.quantiles import ColumnProfile, profile_columns
from sturdytab.operators.sampling import attach_by_key, is_hot
from sturdytab.session import settle
from sturdytab.table import LabelledTable, class_counts, normalise_missing

FENCE = 1.5
IMPURITY_LOW, IMPURITY_HIGH = 0.01, 0.20
NATURAL_RATIO, STRONG_RATIO = 1.5, 10


# ---- pieces -------------------------------------------------------------------------------------

def null_cells(columns: list[str]) -> Column:
    """NULL cells of the given columns, as an aggregate."""
    if not columns:
        return F.lit(0).cast("bigint")
    per_row = sum((F.col(f"`{c}`").isNull().cast("int") for c in columns), F.lit(0))
    return F.coalesce(F.sum(per_row), F.lit(0)).cast("bigint")


def fences(profile: ColumnProfile, least_values: int = 1) -> tuple[float, float] | None:
    """[q1 - 1.5 iqr, q3 + 1.5 iqr], or None for a column that cannot have outliers."""
    if profile.n < least_values or not profile.iqr:
        return None
    return profile.quantiles[0.25] - FENCE * profile.iqr, profile.quantiles[0.75] + FENCE * profile.iqr


def outside(column: str, bounds: tuple[float, float]) -> Column:
    c = F.col(f"`{column}`").cast("double")
    return F.coalesce((c < F.lit(bounds[0])) | (c > F.lit(bounds[1])), F.lit(False))


def outlier_row(profiles: dict[str, ColumnProfile], least_values: int = 1) -> Column:
    """True once any column is outside its fences."""
    test = F.lit(False)
    for column, profile in profiles.items():
        bounds = fences(profile, least_values)
        if bounds:
            test = test | outside(column, bounds)
    return test


def feature_groups(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """One row per distinct feature row: rows, surplus copies of whole rows, distinct known labels.

    Copies collapse map-side, first with and then without the label, so a frequent row stays small.
    """
    identity = row_identity(df, features)
    names = [f"cell{i}" for i in range(len(identity))]
    per_label = (
        df.select(*identity, F.col(f"`{target}`").alias("label"))
        .groupBy(*names, "label").agg(F.count("*").alias("n"))
    )
    return per_label.groupBy(*names).agg(
        F.sum("n").alias("rows"),
        F.sum(F.col("n") - 1).alias("surplus"),
        F.count("label").alias("labels"),
    )


def group_facts(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """One row: surplus duplicate rows, and rows whose feature row carries more than one label."""
    conflict = F.when(F.col("labels") > 1, F.col("rows")).otherwise(0) if features else F.lit(0)
    return feature_groups(df, features, target).agg(
        F.coalesce(F.sum("surplus"), F.lit(0)).alias("duplicate_rows"),
        F.coalesce(F.sum(conflict), F.lit(0)).alias("conflict_rows"),
    )


def surplus_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: rows beyond the first of each group of identical rows."""
    identity = row_identity(df, columns)
    names = [f"cell{i}" for i in range(len(identity))]
    return (
        df.select(*identity).groupBy(*names).agg(F.count("*").alias("n"))
        .agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
             F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_rows"))
    )


def class_facts(df: DataFrame, target: str, null_is_class: bool) -> DataFrame:
    """One row: number of classes, max/min ratio, Shannon entropy in bits."""
    counts = df.groupBy(F.col(f"`{target}`").alias("label")).agg(F.count("*").alias("n"))
    if not null_is_class:
        counts = counts.where(F.col("label").isNotNull())
    total = F.sum("n")
    entropy = F.log2(total) - F.sum(F.col("n") * F.log2("n")) / total
    return counts.agg(
        F.count("*").alias("classes"),
        F.count("label").alias("known_classes"),
        F.when(F.count("*") > 1, F.max("n") / F.min("n")).otherwise(1.0).alias("ratio"),
        F.coalesce(entropy, F.lit(0.0)).alias("entropy"),
    )


def class_distribution(df: DataFrame, target: str) -> DataFrame:
    """(label, n, percent), NULL as a class."""
    counts = df.groupBy(F.col(f"`{target}`").alias("label")).agg(F.count("*").alias("n"))
    total = df.agg(F.count("*").alias("total"))
    return counts.select(
        "label", "n", F.bround(F.col("n") / total.scalar() * 100, 2).alias("percent")
    )


def imbalance_advice(df: DataFrame, target: str) -> DataFrame:
    """One row: known classes, ratio of the largest to the smallest, and what to do about it."""
    counts = df.where(F.col(f"`{target}`").isNotNull()).groupBy(f"`{target}`").agg(F.count("*").alias("n"))
    facts = counts.agg(
        F.sum("n").alias("labelled_rows"), F.count("*").alias("classes"),
        F.max("n").alias("largest"), F.min("n").alias("smallest"),
    ).withColumn("ratio", F.col("largest") / F.col("smallest"))
    advice = (
        F.when(F.col("ratio") >= 5, "strong natural imbalance: keep as it is")
        .when(F.col("ratio") > 1, "some natural imbalance: keep as baseline")
        .otherwise("balanced: suitable for controlled imbalance")
    )
    return facts.withColumn("advice", advice).withColumn(
        "suggested_ratios", F.lit("2,5,10")
    )


# ---- whole audits -------------------------------------------------------------------------------

def report_audit(table: LabelledTable) -> DataFrame:
    """The flat audit report in percent, one row. NULL labels form a class but do not count as one."""
    df = normalise_missing(table.df)
    features, numeric = table.features, table.numeric
    columns = [*features, table.target]
    profiles = profile_columns(df, numeric, (0.25, 0.75), table.rows())
    scan = df.agg(
        F.count("*").alias("n"),
        null_cells(columns).alias("missing_cells"),
        F.count_if(outlier_row(profiles)).alias("outlier_rows"),
    )
    facts = side_by_side(
        df.sparkSession, scan, group_facts(df, features, table.target),
        class_facts(df, table.target, null_is_class=True),
    )

    def percent(part, whole):
        return F.bround(safe_ratio(part, whole) * 100, 4)

    n = F.col("n")
    return facts.select(
        F.lit(table.name).alias("dataset"),
        n.alias("rows"),
        F.lit(len(columns)).cast("bigint").alias("columns"),
        F.lit(len(features)).cast("bigint").alias("features"),
        F.lit(table.target).alias("target"),
        F.lit(len(numeric)).cast("bigint").alias("numerical_features"),
        F.lit(len(features) - len(numeric)).cast("bigint").alias("categorical_features"),
        "missing_cells",
        percent(F.col("missing_cells"), n * len(columns)).alias("missing_rate_percent"),
        "duplicate_rows",
        percent(F.col("duplicate_rows"), n).alias("duplicate_rate_percent"),
        percent(F.col("outlier_rows"), n).alias("outlier_row_rate_percent"),
        percent(F.col("conflict_rows"), n).alias("potential_label_conflict_rate_percent"),
        F.col("known_classes").alias("number_of_classes"),
        F.bround("ratio", 4).alias("imbalance_ratio"),
    )


def class_maps(spark: SparkSession, counts: dict) -> DataFrame:
    """One row: the class counts and percents as maps by label text, from the counts of `class_counts`."""
    total = sum(counts.values())
    rows = [("nan" if label is None else str(label), n, round(100 * n / total, 2)) for label, n in counts.items()]
    frame = spark.createDataFrame(rows, "label string, n bigint, percent double")

    def as_map(value):
        return F.map_from_entries(F.sort_array(F.collect_list(F.struct("label", value))))

    return frame.agg(as_map("n").alias("class_counts"), as_map("percent").alias("class_percentages"))


def with_classes(report: DataFrame, table: LabelledTable) -> DataFrame:
    """An audit of one row with the class distribution as maps, for a JSON sink. Identifier-like targets are refused."""
    spark = report.sparkSession
    return side_by_side(spark, report, class_maps(spark, class_counts(normalise_missing(table.df), table.target)))


def report_with_classes(table: LabelledTable) -> DataFrame:
    """The audit report in percent with the class distribution."""
    return with_classes(report_audit(table), table)


def fraction_audit(table: LabelledTable) -> DataFrame:
    """The audit in fractions that impurity detection reads, one row. NULL labels count as a class."""
    df = normalise_missing(table.df)
    features, numeric, categorical = table.features, table.numeric, table.categorical
    profiles = profile_columns(df, numeric, (0.25, 0.75), table.rows())
    scan = df.agg(
        F.count("*").alias("n_rows"),
        null_cells(features).alias("missing_cells"),
        F.count_if(outlier_row(profiles, least_values=4)).alias("outlier_rows"),
    )
    facts = side_by_side(
        df.sparkSession, scan, group_facts(df, features, table.target),
        class_facts(df, table.target, null_is_class=True),
    )
    n = F.col("n_rows")

    def share(part):
        return len(part) / len(features) if features else 0.0

    return facts.select(
        F.lit(table.name).alias("dataset"),
        "n_rows",
        F.lit(len(features)).cast("bigint").alias("n_features"),
        F.lit(len(numeric)).cast("bigint").alias("n_numeric"),
        F.lit(len(categorical)).cast("bigint").alias("n_categorical"),
        F.lit(float(share(numeric))).alias("numeric_ratio"),
        F.lit(float(share(categorical))).alias("categorical_ratio"),
        F.col("classes").alias("n_classes"),
        F.col("ratio").alias("imbalance_ratio"),
        F.col("entropy").alias("class_entropy"),
        "missing_cells",
        safe_ratio(F.col("missing_cells"), n * len(features)).alias("missing_rate"),
        "duplicate_rows",
        safe_ratio(F.col("duplicate_rows"), n).alias("duplicate_rate"),
        "outlier_rows",
        safe_ratio(F.col("outlier_rows"), n).alias("outlier_rate"),
        safe_ratio(F.col("conflict_rows"), n).alias("potential_label_conflict_rate"),
    )


def detect_impurities(audit: DataFrame) -> DataFrame:
    """Fraction audits -> (dataset, ord, corruption, severity), one row per impurity found."""

    def rate(name):
        return F.when(F.col(name) > 0, clamp(F.col(name), IMPURITY_LOW, IMPURITY_HIGH))

    ratio = F.col("imbalance_ratio")
    found = [
        ("missing", rate("missing_rate")),
        ("duplicates", rate("duplicate_rate")),
        ("outliers", F.when(F.col("n_numeric") > 0, rate("outlier_rate"))),
        ("label_noise", rate("potential_label_conflict_rate")),
        ("imbalance", F.when((ratio > NATURAL_RATIO) & (ratio <= STRONG_RATIO) & (F.bround(ratio, 0) >= 2),
                             clamp(F.bround(ratio, 0), 2.0, 10.0))),
    ]
    cells = [
        F.struct(F.lit(i).alias("ord"), F.lit(name).alias("corruption"), severity.alias("severity"))
        for i, (name, severity) in enumerate(found, start=1)
    ]
    return (
        audit.select("dataset", F.inline(F.array(*cells)))
        .where(F.col("severity").isNotNull())
    )


def audit_many(tables: list) -> tuple[DataFrame | None, dict[str, str]]:
    """Audit several tables. A table that cannot be audited does not stop the others.

    `tables` holds LabelledTables or (name, callable giving one). Returns the reports and the failures by name.
    """
    reports, failures = None, {}
    for entry in tables:
        name, make = (entry.name, lambda t=entry: t) if isinstance(entry, LabelledTable) else entry
        try:
            report = report_audit(make())
            reports = report if reports is None else reports.unionByName(report)
        except Exception as error:  # one bad table must not hide the other reports
            failures[name] = f"{type(error).__name__}: {error}".splitlines()[0]
    return reports, failures


def conflict_flags(table: LabelledTable) -> DataFrame:
    """The rows with `labels`, the number of distinct known labels of their feature row.

    Only feature rows whose count does not follow from the row's own label are looked up.
    """
    df, total = table.df, table.rows()
    label = F.col(f"`{table.target}`")
    rows = df.withColumn("feature_row", row_digest(df, table.features))
    groups = (
        rows.groupBy("feature_row", label.alias("label")).agg(F.count("*").alias("n"))
        .groupBy("feature_row").agg(
            F.sum("n").alias("group_rows"), F.count("label").alias("labels"), F.count("*").alias("kinds"))
    )
    special = settle(groups.where((F.col("kinds") > 1) | is_hot("group_rows", total)).drop("kinds"), "conflicts")
    found = attach_by_key(rows, special, "feature_row", "group_rows", total)
    labels = F.coalesce("labels", label.isNotNull().cast("bigint")).alias("labels")
    return found.select(*[F.col(f"`{c}`") for c in df.columns], labels)
