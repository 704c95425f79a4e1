"""Helpers shared by the operators: table access, column checks and record batches of bounded size."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_BYTES = 1_000_000  # text handled at once inside a task; a single longer text is handled alone
FILTER_WORDS = 1 << 20  # 64-bit words of a key filter, so at most as many rows are broadcast
ARROW_ROWS, ARROW_BYTES = 1_000, 4_000_000  # what Spark hands to a Python worker at once


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def need(df: DataFrame, *columns: str) -> None:
    """Fail early, and by name, on a missing column."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def bounded_batches(spark: SparkSession) -> None:
    """Keep a Python worker's memory small: record batches of texts hold few rows and few bytes in this session."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)


def no_clash(carried: list[str], made: list[str]) -> None:
    both = sorted(set(carried) & set(made))
    if both:
        raise ValueError(f"carried columns have the names of results: {', '.join(both)}")


def maybe_among(rows: DataFrame, keys: DataFrame, *columns: str) -> DataFrame:
    """The rows with `maybe`, false only where no row of `keys` has the same columns (nulls are equal). A Bloom filter of one hash,
    whose size is fixed: with more keys it lets more rows through, and a join behind it decides."""
    slot = F.pmod(F.xxhash64(*columns), F.lit(64 * FILTER_WORDS))
    words = keys.select(slot.alias("slot")).groupBy(F.expr("slot div 64").alias("word")).agg(
        F.expr("bit_or(shiftleft(1L, cast(slot % 64 as int)))").alias("bits"))
    met = rows.withColumn("slot", slot).withColumn("word", F.expr("slot div 64")).join(F.broadcast(words), "word", "left")
    return met.withColumn("maybe", F.expr("coalesce(shiftright(bits, cast(slot % 64 as int)) & 1L, 0L) = 1L")).select(
        *rows.columns, "maybe")


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in pieces of at most `limit` bytes of text each (one row at least)."""
    for batch in batches:
        sizes = [0 if n is None else n for n in pa.compute.binary_length(batch.column(column)).to_pylist()]
        start, held = 0, 0
        for i, n in enumerate(sizes):
            if i > start and held + n > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if start < batch.num_rows:
            yield batch.slice(start)


def raw_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null counts as empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def give_back() -> None:
    """Hand freed memory back to the machine: a Python worker lives on after its task."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def trimmed(run: Callable) -> Callable:
    """The same task function, which gives memory back at its end."""

    def then_trim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return then_trim
