"""Connected components of an edge table, by hooking and pointer jumping over written tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sturdytab.session import settle


def local_roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Star forest of the edges a-b: every node but the smallest of its component, and that smallest node."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = at[:len(a)], at[len(a):]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        after = root.copy()
        np.minimum.at(after, root[x], low)
        np.minimum.at(after, root[y], low)
        while not np.array_equal(after, after[after]):
            after = after[after]
        if np.array_equal(after, root):
            break
        root = after
    moved = root != np.arange(len(nodes))
    return nodes[moved], nodes[root[moved]]


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (hi, lo), hi > lo, that is not the smallest of its component.

    A round hooks each node to its smallest neighbour, hands its other neighbours to that one and halves the paths.
    Rounds grow with the logarithm of the longest path. Each round is written to the shared folder; only one truth
    value a round comes to the driver.
    """
    edges = settle(edges.distinct(), "edges")
    while True:
        parents = settle(edges.groupBy("hi").agg(F.min("lo").alias("lo")), "parents")
        up = parents.select(F.col("hi").alias("lo"), F.col("lo").alias("above"))
        jumped = parents.join(up, "lo", "left").select(
            "hi", F.coalesce("above", "lo").alias("lo"), F.col("above").isNotNull().alias("moved"))
        smallest = F.min("lo").over(Window.partitionBy("hi"))
        rest = edges.withColumn("parent", smallest).where("lo <> parent").select(
            F.greatest("lo", "parent").alias("hi"), F.least("lo", "parent").alias("lo"), F.lit(True).alias("moved"))
        edges = settle(jumped.union(rest).groupBy("hi", "lo").agg(F.max("moved").alias("moved")), "edges")
        if not edges.where("moved").limit(1).count():
            return edges.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
        edges = edges.drop("moved")
