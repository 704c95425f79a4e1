"""Stratified splits by hash threshold: hold-out, fixed-size subset, folds, and a split that keeps groups whole."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from sturdytab.functions.hashing import group_key_text, seeded_hash
from sturdytab.operators.corrupt import keyed
from sturdytab.operators.sampling import attach_by_key, by_class, is_hot, kth_hashes, weight_cuts
from sturdytab.session import settle
from sturdytab.table import MAX_CLASSES, LabelledTable, class_counts, known_target, require_classes


def group_split(table: LabelledTable, folds: int = 5, seed: int = 42) -> DataFrame:
    """Add `fold`: rows with equal features share a fold, and folds hold similar shares of each label.

    A group belongs to its most frequent label (lowest on a tie) and has a seeded hash of its features; the hash
    order of each label is cut into folds of equal rows. Fold 0 serves as the test part. A row finds its fold from
    its own hash and the cuts; only groups of mixed labels need a lookup for the label they belong to.
    """
    counts = {c: n for c, n in class_counts(table.df, table.target).items() if c is not None}
    classes, total = sorted(counts), sum(counts.values())
    coded = by_class(known_target(table.df, table.target), table.target,
                     {c: (i,) for i, c in enumerate(classes)}, ["own_label"], ["bigint"])
    group = seeded_hash(seed, "group", group_key_text(*[F.col(f"`{c}`") for c in table.features]))
    rows = coded.withColumn("h", group)
    per_label = rows.groupBy("h", "own_label").agg(F.count("*").alias("n"))
    # the most rows first, then the lowest label, as one number that hash aggregation can keep
    rank = F.max(F.col("n") * MAX_CLASSES + (MAX_CLASSES - 1 - F.col("own_label")))
    groups = settle(per_label.groupBy("h").agg(
        F.sum("n").alias("weight"), F.count("*").alias("labels"),
        (MAX_CLASSES - 1 - rank % MAX_CLASSES).alias("label")), "groups")
    cuts = weight_cuts(groups, folds, total)
    special = groups.where((F.col("labels") > 1) | is_hot("weight", total)).select("h", "weight", "label")
    placed = attach_by_key(rows, special, "h", "weight", total).withColumn(
        "label_", F.coalesce("label", "own_label"))
    names = [f"cut{i}_" for i in range(folds - 1)]
    placed = by_class(placed, "label_", cuts, names, ["string"] * (folds - 1))
    fold = sum(((F.col("h") >= F.col(name)).cast("int") for name in names), F.lit(0))
    return placed.select(*[F.col(f"`{c}`") for c in table.df.columns], fold.alias("fold"))


def train_test(table: LabelledTable, fold_frame: DataFrame) -> tuple[LabelledTable, LabelledTable]:
    """Fold 0 as test, the rest as training table."""
    train = fold_frame.where(F.col("fold") > 0).drop("fold")
    test = fold_frame.where(F.col("fold") == 0).drop("fold")
    return table.with_df(train), table.with_df(test)


def _limits(table: LabelledTable, h, counts: dict, quotas: dict) -> dict:
    label = F.col(f"`{table.target}`")
    hashes = table.df.where(label.isNotNull()).select(label.alias("label"), h.alias("h"))
    found = kth_hashes(hashes, counts, quotas)
    return {c: [found[c][k] for k in ks] for c, ks in quotas.items()}


def _hash(table: LabelledTable, seed: int, tag: str):
    return seeded_hash(seed, tag, *[F.col(f"`{k}`") for k in table.keys])


def holdout_split(table: LabelledTable, test_share: float = 0.2, seed: int = 42) -> DataFrame:
    """Add `part`: 'test' for a half-even rounded share of each class, else 'train'. NULL labels are dropped."""
    table = keyed(table)
    counts = {c: n for c, n in class_counts(table.df, table.target).items() if c is not None}
    require_classes(counts, 1, 2)
    h = _hash(table, seed, "holdout")
    limits = _limits(table, h, counts, {c: [round(test_share * n)] for c, n in counts.items()})
    marked = by_class(known_target(table.df, table.target), table.target, limits, ["limit_"], ["string"])
    return marked.withColumn("part", F.when(h <= F.col("limit_"), "test").otherwise("train")).drop("limit_")


def subset_quotas(counts: dict, size: int) -> dict:
    """Rows per class adding up to size: whole shares, then one more for the largest remainders."""
    total = sum(counts.values())
    if total < size:
        raise ValueError(f"only {total} rows; {size} are required")
    quotas = {c: n * size // total for c, n in counts.items()}
    rest = sorted(counts, key=lambda c: (-(counts[c] * size % total), c))
    for c in rest[: size - sum(quotas.values())]:
        quotas[c] += 1
    return quotas


def stratified_subset(table: LabelledTable, size: int, seed: int = 42) -> LabelledTable:
    """Exactly `size` rows with the class shares of the table."""
    table = keyed(table)
    counts = {c: n for c, n in class_counts(table.df, table.target).items() if c is not None}
    quotas = subset_quotas(counts, size)
    h = _hash(table, seed, "subset")
    limits = _limits(table, h, counts, {c: [k] for c, k in quotas.items()})
    marked = by_class(table.df, table.target, limits, ["limit_"], ["string"])
    return table.with_df(marked.where(h <= F.col("limit_")).drop("limit_"), size)


def fold_count(counts: dict, folds: int) -> int:
    k = min(folds, min(n for c, n in counts.items() if c is not None))
    if k < 2:
        raise ValueError("not enough rows per class for stratified folds")
    return k


def stratified_folds(table: LabelledTable, folds: int = 3, seed: int = 42) -> DataFrame:
    """Add `fold` 0..k-1, k = min(folds, smallest class): equal cuts of each class in hash order."""
    table = keyed(table)
    counts = {c: n for c, n in class_counts(table.df, table.target).items() if c is not None}
    k = fold_count(counts, folds)
    h = _hash(table, seed, "fold")
    cuts = {c: [math.ceil((i + 1) * n / k) for i in range(k - 1)] for c, n in counts.items()}
    limits = _limits(table, h, counts, cuts)
    names = [f"limit{i}_" for i in range(k - 1)]
    marked = by_class(known_target(table.df, table.target), table.target, limits, names, ["string"] * (k - 1))
    fold = sum(((h > F.col(name)).cast("int") for name in names), F.lit(0))
    return marked.withColumn("fold", fold).drop(*names)
