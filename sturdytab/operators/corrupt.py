"""Seeded corruptions with exact counts: missing cells, duplicates, label noise, outliers, imbalance.

Statistics (row counts, thresholds, medians) are fitted first; the corruption itself is then a projection or
filter over the table. Each operator takes one severity or several: several give one output with a
`severity` column from a single pass, and smaller severities touch a subset of what larger ones touch.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from decimal import Decimal

from pyspark.sql import Column, DataFrame, functions as F, types as T

from sturdytab.functions.hashing import hash_choice, seeded_hash
from sturdytab.functions.scalars import floor_count, half_even_count
from sturdytab.operators.quantiles import ColumnProfile, profile_columns
from sturdytab.operators.sampling import (
    arrivals, by_class, kth_arrival, kth_hash, kth_hashes, with_row_key,
)
from sturdytab.session import settle
from sturdytab.table import INTEGER_TYPES, LabelledTable, class_counts

ROW_KEY = "row_key"
INLINE_LABELS = 1_000


@dataclass(frozen=True)
class Preset:
    """Where the variants of a corruption differ."""

    count: Callable[[int, float], int]
    replacement: bool  # duplicates drawn with replacement
    magnitude: str  # outlier size: "median6" or "quartile3"
    min_keep: int  # rows of a class that imbalance always keeps
    strict: bool  # unusable input is an error; otherwise the table stays as it is


LIBRARY = Preset(floor_count, True, "median6", 1, True)
EXPERIMENT = Preset(half_even_count, False, "quartile3", 0, False)
PROBE = Preset(half_even_count, False, "quartile3", 1, False)

# Seed offsets, severities and named conditions of the published experiments.
SEED_OFFSETS = {"missing": 11, "label_noise": 22, "outliers": 33, "duplicates": 44, "imbalance": 55}
FIXED_SEEDS = {"missing": 42, "label_noise": 142, "outliers": 242, "duplicates": 342, "imbalance": 442}
RATES = (0.05, 0.10, 0.20)
RATIOS = (2.0, 5.0, 10.0)
CONDITIONS = {
    "missing_noise": [("missing", 0.10), ("label_noise", 0.10)],
    "missing_noise_duplicates": [("missing", 0.10), ("label_noise", 0.10), ("duplicates", 0.10)],
    "missing_imbalance": [("missing", 0.10), ("imbalance", 5.0)],
    "noise_imbalance": [("label_noise", 0.10), ("imbalance", 5.0)],
    "missing_noise_imbalance": [("missing", 0.10), ("label_noise", 0.10), ("imbalance", 5.0)],
    "missing_noise_outliers": [("missing", 0.10), ("label_noise", 0.10), ("outliers", 0.10)],
}


# ---- shared -------------------------------------------------------------------------------------

def keyed(table: LabelledTable) -> LabelledTable:
    """A table whose rows have a unique key. Without key columns one is made from content and copy number."""
    if table.keys:
        return table
    return replace(table, df=settle(with_row_key(table.df, ROW_KEY)), keys=(ROW_KEY,))


def unkeyed(table: LabelledTable) -> LabelledTable:
    """Drop the made key again."""
    if ROW_KEY not in table.keys:
        return table
    return replace(table, df=table.df.drop(ROW_KEY), keys=tuple(k for k in table.keys if k != ROW_KEY))


def _levels(severity) -> tuple[list, bool]:
    many = isinstance(severity, (list, tuple))
    return [float(s) for s in (severity if many else [severity])], many


def _check_rates(levels, preset):
    if preset.strict and any(not 0 <= r <= 1 for r in levels):
        raise ValueError("rate must be between 0 and 1")


def _touched(preset: Preset, total: int, rate: float) -> int:
    return max(0, min(total, preset.count(total, rate)))


def _row_hash(table: LabelledTable, seed: int, tag: str) -> Column:
    return seeded_hash(seed, tag, *[F.col(f"`{k}`") for k in table.keys])


def _fan_out(df: DataFrame, levels, many, values) -> tuple[DataFrame, Column]:
    """One copy of each row per severity when there are many, and the value that belongs to the severity."""
    if not many:
        return df, F.lit(values[0])
    df = df.withColumn("severity", F.explode(F.array(*[F.lit(s) for s in levels])))
    value = F.lit(None)
    for s, v in zip(levels, values):
        value = F.when(F.col("severity") == s, F.lit(v)).otherwise(value)
    return df, value


def _unchanged(table: LabelledTable, levels, many) -> LabelledTable:
    """The table as it is, once per severity when there are many."""
    return _out(table, _fan_out(table.df, levels, True, levels)[0], True, None) if many else table


def _out(table: LabelledTable, df: DataFrame, many: bool, rows: int | None, extra_keys=()) -> LabelledTable:
    keys = table.keys + tuple(extra_keys) + (("severity",) if many else ())
    return table.with_df(df, None if many else rows, keys)


# ---- the five corruptions -----------------------------------------------------------------------

def inject_missing(table: LabelledTable, rate, seed: int = 42, preset: Preset = LIBRARY) -> LabelledTable:
    """Set an exact number of feature cells to NULL. The target is never touched."""
    levels, many = _levels(rate)
    _check_rates(levels, preset)
    made = keyed(table)
    features = made.features
    if not features:
        if preset.strict:
            raise ValueError("no feature columns available")
        return _unchanged(table, levels, many)
    n = made.rows()
    ks = [_touched(preset, n * len(features), r) for r in levels]
    keys = [F.col(f"`{k}`") for k in made.keys]
    cells = {c: seeded_hash(seed, "cell", F.lit(j), *keys) for j, c in enumerate(features)}
    hashes = made.df.select(F.explode(F.array(*cells.values())).alias("h"))
    found = kth_hash(hashes, n * len(features), ks)
    marked = made.df.select("*", *[h.alias(f"h_{j}") for j, h in enumerate(cells.values())]) if many else made.df
    marked, limit = _fan_out(marked, levels, many, [found[k] for k in ks])
    at = {c: F.col(f"h_{j}") if many else h for j, (c, h) in enumerate(cells.items())}
    out = marked.select(*[
        F.when(at[c] <= limit, None).otherwise(F.col(f"`{c}`")).alias(c) if c in at else F.col(f"`{c}`")
        for c in made.df.columns
    ], *(["severity"] if many else []))
    result = _out(made, out, many, n)
    return result if table.keys else unkeyed(result)


def inject_duplicates(table: LabelledTable, rate, seed: int = 42, preset: Preset = LIBRARY) -> LabelledTable:
    """Append copies of drawn rows. `copy_no` is 0 for the original and joins the key.

    With replacement a row counts its own arrivals before the k-th of all rows, without it the k smallest hashes win.
    """
    levels, many = _levels(rate)
    _check_rates(levels, preset)
    made = keyed(table)
    n = made.rows()
    copy_no = "copy_no"
    while copy_no in made.df.columns:
        copy_no += "_"
    if preset.replacement:
        added = [max(0, preset.count(n, r)) for r in levels]
        ends = [kth_arrival(made.df, list(made.keys), n, k, seed) if k else 0.0 for k in added]
        times = arrivals(seed, [F.col(f"`{k}`") for k in made.keys], max(ends))
        marked, end = _fan_out(made.df.withColumn("times_", times), levels, many, ends)
        hits = F.size(F.filter("times_", lambda t: t <= end))
        out = marked.withColumn(copy_no, F.explode(F.sequence(F.lit(0), hits))).drop("times_")
    else:
        added = [_touched(preset, n, r) for r in levels]
        h = _row_hash(made, seed, "copy")
        found = kth_hash(made.df.select(h.alias("h")), n, added)
        marked, limit = _fan_out(made.df.withColumn("h_", h), levels, many, [found[k] for k in added])
        copies = F.when(F.col("h_") <= limit, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
        out = marked.withColumn(copy_no, F.explode(copies)).drop("h_")
    result = _out(made, out, many, n + added[0], (copy_no,))
    return result if table.keys else unkeyed(result)


def inject_label_noise(table: LabelledTable, rate, seed: int = 42, preset: Preset = LIBRARY) -> LabelledTable:
    """Give an exact number of rows another label, uniform over the other classes. Features are never touched."""
    levels, many = _levels(rate)
    _check_rates(levels, preset)
    made = keyed(table)
    counts = class_counts(made.df, made.target)
    labels = sorted(c for c in counts if c is not None)
    if len(labels) < 2:
        if preset.strict:
            raise ValueError("label noise requires at least two target classes")
        return _unchanged(table, levels, many)
    n = sum(counts.values())
    ks = [_touched(preset, n, r) for r in levels]
    h = _row_hash(made, seed, "row")
    found = kth_hash(made.df.select(h.alias("h")), n, ks)
    marked = made.df.withColumn("h_", h)
    target = F.col(f"`{made.target}`")
    kind = made.type_of(made.target)
    pick = _row_hash(made, seed, "pick")
    if len(labels) <= INLINE_LABELS:
        others = F.filter(F.array(*[F.lit(c).cast(kind) for c in labels]), lambda x: ~x.eqNullSafe(target))
        other = F.element_at(others, (hash_choice(pick, F.size(others)) + 1).cast("int"))
    else:
        # skip the own position in the sorted classes, then look the drawn position up
        marked = by_class(marked, made.target, {c: (i,) for i, c in enumerate(labels)}, ["own_"], ["bigint"])
        choice = hash_choice(pick, F.when(F.col("own_").isNull(), len(labels)).otherwise(len(labels) - 1))
        marked = marked.withColumn("drawn_", choice + (choice >= F.col("own_")).cast("bigint"))
        marked = marked.withColumn("drawn_", F.coalesce("drawn_", choice))
        marked = by_class(marked, "drawn_", {i: (c,) for i, c in enumerate(labels)}, ["label_"],
                          [kind.simpleString()])
        other = F.col("label_")
    marked, limit = _fan_out(marked, levels, many, [found[k] for k in ks])
    out = marked.withColumn(made.target, F.when(F.col("h_") <= limit, other).otherwise(target))
    out = out.drop("h_", "own_", "drawn_", "label_")
    result = _out(made, out, many, n)
    return result if table.keys else unkeyed(result)


def outlier_values(p: ColumnProfile, magnitude: str) -> tuple[float, float] | None:
    """(low, high) replacement of a column, or None where the row is left alone."""
    q1, q3 = p.quantiles[0.25], p.quantiles[0.75]
    if magnitude == "quartile3":
        return None if not p.iqr else (q1 - 3 * p.iqr, q3 + 3 * p.iqr)
    median = p.quantiles[0.5]
    size = p.iqr or p.std or max(abs(median) * 0.1, 1.0)
    return median - 6 * size, median + 6 * size


def _cell_kind(kind: T.DataType, values) -> T.DataType:
    """The column type, widened where a replacement does not fit."""
    if isinstance(kind, INTEGER_TYPES):
        bits = {"ByteType": 7, "ShortType": 15, "IntegerType": 31, "LongType": 63}[type(kind).__name__]
        return T.LongType() if any(abs(v) >= 2**bits for v in values) else kind
    return T.DecimalType(38, kind.scale) if isinstance(kind, T.DecimalType) else kind


def inject_outliers(table: LabelledTable, rate, seed: int = 42, preset: Preset = LIBRARY) -> LabelledTable:
    """Replace one numeric cell in an exact number of rows by a far value, computed from the table as given."""
    levels, many = _levels(rate)
    _check_rates(levels, preset)
    made = keyed(table)
    n = made.rows()
    profiles = {c: p for c, p in profile_columns(made.df, made.numeric, rows=n).items() if p.varied}
    if not profiles:
        if preset.strict:
            raise ValueError("no suitable numeric feature columns found")
        return _unchanged(table, levels, many)
    ks = [_touched(preset, n, r) for r in levels]
    h = _row_hash(made, seed, "row")
    found = kth_hash(made.df.select(h.alias("h")), n, ks)
    pick = hash_choice(_row_hash(made, seed, "pick"), len(profiles))
    sign = hash_choice(_row_hash(made, seed, "sign"), 2)
    marked = made.df.select("*", h.alias("h_"), pick.alias("pick_"), sign.alias("sign_"))
    marked, limit = _fan_out(marked, levels, many, [found[k] for k in ks])
    new = {}
    for i, (column, profile) in enumerate(profiles.items()):
        values = outlier_values(profile, preset.magnitude)
        if values is None:
            continue
        kind = made.type_of(column)
        if isinstance(kind, INTEGER_TYPES):
            values = tuple(int(round(v)) for v in values)
        elif isinstance(kind, T.DecimalType):
            values = tuple(Decimal(str(v)).quantize(Decimal(1).scaleb(-kind.scale)) for v in values)
        kind = _cell_kind(kind, values)
        low, high = (F.lit(v).cast(kind) for v in values)
        hit = (F.col("h_") <= limit) & (F.col("pick_") == i)
        new[column] = F.when(hit, F.when(F.col("sign_") == 1, high).otherwise(low)).otherwise(
            F.col(f"`{column}`").cast(kind))
    out = marked.select(
        *[new[c].alias(c) if c in new else F.col(f"`{c}`") for c in made.df.columns],
        *(["severity"] if many else []),
    )
    result = _out(made, out, many, n)
    return result if table.keys else unkeyed(result)


def majority_class(counts: dict):
    """The most frequent known class, the lowest on a tie."""
    return min((c for c in counts if c is not None), key=lambda c: (-counts[c], c))


def imbalance_quotas(counts: dict, ratio: float, min_keep: int) -> dict:
    """Rows each known class keeps."""
    labels = {c: n for c, n in counts.items() if c is not None}
    majority = majority_class(labels)
    target = max(min_keep, int(labels[majority] / ratio))
    return {c: n if c == majority else min(n, target) for c, n in labels.items()}


def inject_imbalance(table: LabelledTable, ratio, seed: int = 42, preset: Preset = LIBRARY) -> LabelledTable:
    """Keep the largest class and thin the others to its size / ratio. Rows without a label are dropped."""
    levels, many = _levels(ratio)
    if preset.strict and any(r <= 1 for r in levels):
        raise ValueError("ratio must be greater than 1")
    made = keyed(table)
    counts = {c: n for c, n in class_counts(made.df, made.target).items() if c is not None}
    idle = [r for r in levels if r <= 1 and preset.min_keep]  # these ratios leave every row where it is
    if len(counts) < 2 or len(idle) == len(levels):
        if preset.strict:
            raise ValueError("at least two classes are required")
        return _unchanged(table, levels, many)
    quotas = [counts if r in idle else imbalance_quotas(counts, r, preset.min_keep) for r in levels]
    h = _row_hash(made, seed, "keep")
    label = F.col(f"`{made.target}`")
    hashes = made.df.where(label.isNotNull()).select(label.alias("label"), h.alias("h"))
    found = kth_hashes(hashes, counts, {c: [q[c] for q in quotas] for c in counts})
    limits = {c: [found[c][q[c]] for q in quotas] for c in counts}
    names = [f"limit{i}_" for i in range(len(levels))]
    marked = by_class(made.df.withColumn("h_", h), made.target, limits, names, ["string"] * len(names))
    if many:
        marked = marked.withColumn("severity", F.explode(F.array(*[F.lit(s) for s in levels])))
        limit = F.lit(None)
        for s, name in zip(levels, names):
            limit = F.when(F.col("severity") == s, F.col(name)).otherwise(limit)
    else:
        limit = F.col(names[0])
    keep = F.col("h_") <= limit
    if idle:
        keep = F.coalesce(keep, F.lit(False)) | F.col("severity").isin(*idle)
    out = marked.where(keep).drop("h_", *names)
    result = _out(made, out, many, sum(quotas[0].values()))
    return result if table.keys else unkeyed(result)


# ---- dispatch and combination -------------------------------------------------------------------

CORRUPTIONS = {
    "missing": inject_missing,
    "duplicates": inject_duplicates,
    "label_noise": inject_label_noise,
    "outliers": inject_outliers,
    "imbalance": inject_imbalance,
}


def corrupt(table: LabelledTable, corruption: str, severity, seed: int, preset: Preset = EXPERIMENT,
            offset: bool = True) -> LabelledTable:
    """Apply one corruption by name; each kind draws from its own seed."""
    if corruption not in CORRUPTIONS:
        raise ValueError(f"unknown corruption: {corruption}")
    seed = seed + SEED_OFFSETS[corruption] if offset else seed
    return CORRUPTIONS[corruption](table, severity, seed, preset)


def corrupt_combined(table: LabelledTable, components, seed: int, preset: Preset = EXPERIMENT,
                     seeds: dict[str, int] | None = None) -> LabelledTable:
    """Several corruptions in fixed order: imbalance, then cells and labels, duplicates last.

    `components` is a condition name or a list of (corruption, severity). `seeds` fixes a seed per kind.
    """
    components = CONDITIONS[components] if isinstance(components, str) else components
    stage = {"imbalance": 0, "duplicates": 2}
    result = keyed(table)
    for corruption, severity in sorted(components, key=lambda c: stage.get(c[0], 1)):
        if seeds:
            result = corrupt(result, corruption, severity, seeds[corruption], preset, offset=False)
        else:
            result = corrupt(result, corruption, severity, seed, preset)
    return result if table.keys else unkeyed(result)


# ---- self-check ---------------------------------------------------------------------------------

def corruption_check(clean: LabelledTable, corrupted: LabelledTable) -> DataFrame:
    """What a corruption changed, by comparing rows with the same key. Added rows have copy_no > 0.

    One row, or one per severity with a `severity` column where the corrupted table has several. A table without key
    columns must be given its key by `keyed` first, and that table be corrupted.
    """
    keys = list(clean.keys)
    if not keys:
        raise ValueError("rows without key columns cannot be compared: corrupt the table that keyed() returns")
    by = ["severity"] if "severity" in corrupted.keys else []
    features = [c for c in clean.features if c in corrupted.df.columns]
    extra = [k for k in corrupted.keys if k not in keys and k.startswith("copy_no")]
    before = clean.df.select(*keys, *[F.col(f"`{c}`").alias(f"b{i}") for i, c in enumerate(features)],
                             F.col(f"`{clean.target}`").alias("bt"), F.lit(True).alias("in_clean"))
    if by:
        levels = [r[0] for r in corrupted.df.select("severity").distinct().collect()]  # the severities asked for
        before = before.withColumn("severity", F.explode(F.lit(levels)))
    after = corrupted.df.select(*by, *keys, *[F.col(f"`{c}`").alias(f"a{i}") for i, c in enumerate(features)],
                                F.col(f"`{clean.target}`").alias("at"),
                                (sum((F.col(k) for k in extra), F.lit(0)) > 0).alias("added"),
                                F.lit(True).alias("in_corrupted"))
    pairs = before.join(after, [*by, *keys], "full")
    both = F.col("in_clean").isNotNull() & F.col("in_corrupted").isNotNull() & ~F.coalesce("added", F.lit(False))
    nulled = sum((F.when(F.col(f"b{i}").isNotNull() & F.col(f"a{i}").isNull(), 1).otherwise(0)
                  for i in range(len(features))), F.lit(0))
    changed = sum((F.when(~F.col(f"b{i}").eqNullSafe(F.col(f"a{i}")), 1).otherwise(0)
                   for i in range(len(features))), F.lit(0))

    def total(value, test=both):
        return F.coalesce(F.sum(F.when(test, value)), F.lit(0)).cast("bigint")

    return pairs.groupBy(*by).agg(
        total(F.lit(1), F.col("in_clean").isNotNull() & ~F.coalesce("added", F.lit(False))).alias("clean_rows"),
        total(F.lit(1), F.col("in_corrupted").isNotNull()).alias("corrupted_rows"),
        total(F.lit(1), F.col("in_corrupted").isNull()).alias("removed_rows"),
        total(F.lit(1), F.col("added")).alias("added_rows"),
        total(nulled).alias("cells_nulled"),
        total(changed).alias("cells_changed"),
        total(F.when(changed > 0, 1).otherwise(0)).alias("rows_changed"),
        total(F.when(~F.col("bt").eqNullSafe(F.col("at")), 1).otherwise(0)).alias("labels_changed"),
    )


def class_ratio_check(clean: LabelledTable, corrupted: LabelledTable) -> DataFrame:
    """The class ratio that a corruption achieved: known classes, rows of the largest and smallest, and their ratio.

    One row for the clean table and one for the corrupted, or one per severity where it has several. A class that lost all
    its rows is no longer a class; a table without known labels has no row.
    """
    by = ["severity"] if "severity" in corrupted.keys else []
    out = None
    for state, table, groups in (("clean", clean, []), ("corrupted", corrupted, by)):
        label = F.col(f"`{table.target}`").alias("label")
        sizes = table.df.where(label.isNotNull()).groupBy(*groups, label).agg(F.count("*").alias("n"))
        kept = [F.col(g) for g in groups] or [F.lit(None).cast(corrupted.type_of(g)).alias(g) for g in by]
        row = sizes.groupBy(*groups).agg(
            F.count("*").alias("classes"), F.max("n").alias("largest"), F.min("n").alias("smallest")).where(
            "classes > 0").select(F.lit(state).alias("state"), *kept, "classes", "largest", "smallest",
                                  (F.col("largest") / F.col("smallest")).alias("ratio"))
        out = row if out is None else out.unionByName(row)
    return out
