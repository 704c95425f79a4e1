"""Category dictionaries as tables, for text columns with any number of values.

A dictionary has one row a column and value: its rows and its code, the place of the value in ascending order. It is
written to the shared folder, so neither the driver nor a task holds the values of a column, and rows meet it in a join.
NULL is no category. A value that the dictionary does not hold gets the code behind the last, which one-hot coding drops.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from sturdytab.operators import sampling
from sturdytab.operators.sampling import attach_by_key
from sturdytab.session import settle

IN_PARTITION = 33  # low bits of monotonically_increasing_id: the place inside a partition


def category_dictionary(df: DataFrame, columns: list[str]) -> DataFrame:
    """(ord, value, n, code): for the column at place `ord` each value, its rows, and its rank from 0.

    Values are counted with map-side combine and dealt by range; a rank is the place in a sorted partition plus the values
    in the partitions before it.
    """
    cells = [F.struct(F.lit(i).alias("ord"), F.col(f"`{c}`").cast("string").alias("value")) for i, c in enumerate(columns)]
    counted = df.select(F.inline(F.array(*cells))).where(F.col("value").isNotNull()).groupBy("ord", "value").agg(
        F.count("*").alias("n"))
    ordered = settle(counted.repartitionByRange("ord", "value").sortWithinPartitions("ord", "value").withColumn(
        "id", F.monotonically_increasing_id()), "categories")
    part = F.shiftright("id", IN_PARTITION).alias("part")
    # a row for each partition and column; both windows are over these rows only
    parts = ordered.groupBy("ord", part).agg(F.count("*").alias("rows"), F.min("id").alias("low"))
    before = Window.partitionBy("ord").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select("ord", "part", "low", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start"))
    ranked = ordered.withColumn("part", part).join(F.broadcast(starts), ["ord", "part"])
    return settle(ranked.select("ord", "value", "n", (F.col("start") + F.col("id") - F.col("low")).alias("code")),
                  "dictionary")


def dictionary_sizes(dictionary: DataFrame, columns: list[str]) -> list[int]:
    """Values per column, one number a column."""
    found = {r["ord"]: r["values"] for r in dictionary.groupBy("ord").agg(F.count("*").alias("values")).collect()}
    return [found.get(i, 0) for i in range(len(columns))]


def category_indexes(df: DataFrame, dictionary: DataFrame, columns: list[str], total: int,
                     suffix: str = "_index") -> DataFrame:
    """Add an index column for each column; `total` is the number of rows that the dictionary was made of.

    The columns carry the number of values as Spark ML metadata, so `OneHotEncoder` makes sparse vectors of them without
    a pass over the rows. NULL has a NULL index.
    """
    clash = [c + suffix for c in columns if c + suffix in df.columns]
    if clash:
        raise ValueError(f"column(s) {clash} exist already")
    sizes = dictionary_sizes(dictionary, columns)
    for i, c in enumerate(columns):
        name, text = c + suffix, F.col(f"`{c}`").cast("string")
        lookup = dictionary.where(F.col("ord") == i).select(F.concat(F.lit("v"), "value").alias("value_"),
                                                            F.col("n").alias("n_"), F.col("code").alias("code_"))
        # rows without a value are spread by their hash and meet no value
        spread = F.concat(F.lit("n"), F.xxhash64(*[F.col(f"`{x}`") for x in df.columns]).cast("string"))
        met = attach_by_key(df.withColumn("value_", F.coalesce(F.concat(F.lit("v"), text), spread)), lookup, "value_", "n_", total)
        code = F.when(text.isNotNull(), F.coalesce("code_", F.lit(sizes[i])).cast("double"))
        df = met.select(*[F.col(f"`{x}`") for x in df.columns], code.alias(name))
        if sizes[i] > sampling.BROADCAST_ROWS:
            df = settle(df, "indexed")  # such a join reads its rows twice; several must not multiply
        df = df.withMetadata(name, {"ml_attr": {"type": "nominal", "name": name, "num_vals": sizes[i] + 1}})
    return df
