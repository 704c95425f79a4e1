"""Seeded hashes. They depend on the key text only, never on partitioning, so any retry draws the same rows.

Hashes are compared as 32-digit lower-case hex strings: text order is number order, and 128 bits leave no ties.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

HASH_SPACE = 1 << 128
HASH_DIGITS = 32
NO_ROW = ""  # every hash is greater
EVERY_ROW = "g"  # every hash is smaller
DIGEST_CHARS = 64  # a tagged SHA-256 text has 65
MAX_CELLS = 32


def null_tagged(c: Column) -> Column:
    """The cell as text with a tag for NULL, since concat_ws would drop it."""
    return F.coalesce(c.cast("string"), F.lit("nan"))


def sized(c: Column) -> Column:
    """The cell as text behind its length, NULL as `-`, so that no two lists of cells give the same text."""
    text = c.cast("string")
    return F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def seeded_hash(seed: int, tag: str, *parts: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(tag), *[sized(p) for p in parts]))


def hash_choice(h: Column, n: Column | int) -> Column:
    """A whole number in [0, n) taken from the first 60 bits of a hash."""
    n = n if isinstance(n, Column) else F.lit(n)
    return F.pmod(F.conv(F.substring(h, 1, 15), 16, 10).cast("bigint"), n.cast("bigint"))


def hex_point(share: float) -> str:
    """The hash below which the given share of all hashes lies."""
    point = int(min(max(share, 0.0), 1.0) * HASH_SPACE)
    return EVERY_ROW if point >= HASH_SPACE else format(point, f"0{HASH_DIGITS}x")


def group_key_text(*columns: Column) -> Column:
    """The text key of a feature row: cells joined by `||`, NULL as `nan`."""
    return F.concat_ws("||", *[null_tagged(c) for c in columns])


def cell_text(field: T.StructField) -> Column:
    c = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (T.FloatType, T.DoubleType)):
        c = F.when(c == 0, F.lit(0).cast(field.dataType)).otherwise(c)  # -0.0 equals 0.0
    if isinstance(field.dataType, (T.ArrayType, T.StructType, T.MapType)):
        return F.to_json(c, {"ignoreNullFields": "false"})
    return c.cast("string")


FIXED_WIDTH = (
    T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.BooleanType, T.DateType,
    T.TimestampType, T.TimestampNTZType,
)


def row_digest(df: DataFrame, columns: list[str]) -> Column:
    """SHA-256 of the row. Each text cell carries its length, so no two different rows share a text.

    Cells of fixed width enter as two differently salted 64-bit hashes and their NULL pattern, which spares turning
    every number into text.
    """
    cells, fixed, nulls = [], [], []
    for name in columns:
        field = df.schema[name]
        if isinstance(field.dataType, FIXED_WIDTH):
            c = F.col(f"`{name}`")
            if isinstance(field.dataType, (T.FloatType, T.DoubleType)):
                c = F.when(c == 0, F.lit(0).cast(field.dataType)).otherwise(c)
            fixed.append(c)
            nulls.append(F.when(c.isNull(), "1").otherwise("0"))
            continue
        text = cell_text(field)
        cells.append(F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    if fixed:
        cells += [F.concat(*nulls), *[F.hex(F.xxhash64(F.lit(salt), *fixed)) for salt in (1, 2)]]
    return F.unhex(F.sha2(F.concat(*cells), 256))


def row_identity(df: DataFrame, columns: list[str]) -> list[Column]:
    """Grouping columns cell0, cell1, ... that stand for the whole row.

    Cells group as they are, except that text beyond DIGEST_CHARS is replaced by its digest, which is longer than any
    text kept; very wide tables use one digest of the row. Either way the shuffle moves few bytes per cell.
    """
    if len(columns) > MAX_CELLS:
        return [row_digest(df, columns).alias("cell0")]
    out = []
    for i, name in enumerate(columns):
        field = df.schema[name]
        c = F.col(f"`{name}`")
        if isinstance(field.dataType, (T.StringType, T.BinaryType, T.ArrayType, T.StructType, T.MapType)):
            c = cell_text(field) if not isinstance(field.dataType, T.BinaryType) else F.hex(c)
            c = F.when(F.length(c) > DIGEST_CHARS, F.concat(F.lit("#"), F.sha2(c, 256))).otherwise(c)
        out.append(c.alias(f"cell{i}"))
    return out
