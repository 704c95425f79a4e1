"""Merkle manifest of a table: digests, stored every few levels, and membership proofs recomputed from what is stored.

Trees. Rows are leaves; leaves with the same tree key form one tree, in the order of the given columns. While a level has
several nodes, every two consecutive ones become the hash of their two digests (hex text), a last single one the hash of
its own. What remains is the tree's root; the roots, in the order of the tree keys (null first, then bytewise), are the
leaves of one more tree, whose root is that of the table.

Checkpoint and recompute. Leaves are numbered by a range partitioning: each partition numbers its own rows per tree, and the
counts before a partition are added. Only every `STEP`-th level is stored. A run of 2^STEP consecutive stored nodes is an
aligned subtree: one task at a time hashes it and keeps the top. Proofs go down from the root: each subtree is hashed once more
from its stored nodes, gives every one of them its siblings inside, followed by the path of its top, and is dropped. So no task
holds more than 2^STEP nodes, whatever the size of a tree, and no level but the stored ones is ever written.

A path is one text: a word per level from the leaf up, `L` and a digest (sibling on the left), `R` and a digest (on the
right), or `-` (no sibling). A lone leaf of a lone tree has the empty path.

Leaf digests hash the values one after another, each `-` if null, else the byte count of its text, `:` and the text; so no two
different rows have one preimage. Nulls in order columns come first. Rows of equal order are ordered by leaf; repeated
rows are leaves of their own. An empty table has no leaves and no root. Carried columns must not have the results' names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sturdytab.llm.common import need, no_clash, partitions
from sturdytab.session import settle

STEP = 8
MADE = ["tree", "pos", "leaf", "subroot", "root", "path"]


def leaf_digest(*columns: Column) -> Column:
    """SHA-256 (lowercase hex) of the values, each with its length in bytes in front, null as `-`."""
    def one(c):
        text = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))
    return F.sha2(F.concat(*[one(c) for c in columns]).cast("binary"), 256)


def hashed(digests: str) -> str:
    return hashlib.sha256(digests.encode()).hexdigest()


def level_above(nodes: list[str]) -> list[str]:
    return [hashed("".join(nodes[i:i + 2])) for i in range(0, len(nodes), 2)]


def subtree(nodes: list[str], levels: int | None) -> Iterator[list[str]]:
    """The levels of an aligned subtree below its top, from the stored nodes up; all up to one node if `levels` is None."""
    done = 0
    while len(nodes) > 1 if levels is None else done < levels:
        yield nodes
        nodes, done = level_above(nodes), done + 1
    yield nodes


def paths_within(nodes: list[str], levels: int | None) -> list[list[str]]:
    """For each stored node the words of its path up to the subtree's top."""
    paths: list[list[str]] = [[] for _ in nodes]
    *below, _ = subtree(nodes, levels)
    for height, row in enumerate(below):
        for i, path in enumerate(paths):
            at = i >> height
            path.append("L" + row[at - 1] if at % 2 else "R" + row[at + 1] if at + 1 < len(row) else "-")
    return paths


@dataclass
class Manifest:
    """Stored levels of a table's trees. `leaves` has tree, pos, leaf and the carried columns."""

    leaves: DataFrame
    levels: list[DataFrame]  # of the trees: (tree, pos, digest) every STEP levels above the leaves, the roots last
    top: list[DataFrame]  # the same of the tree over the roots, its leaves (the roots, numbered) first

    @property
    def subroots(self) -> DataFrame:
        """(tree, subroot)"""
        return self.levels[-1].select("tree", F.col("digest").alias("subroot"))

    @property
    def root(self) -> DataFrame:
        """(root): one row, none for an empty table."""
        return self.top[-1].select(F.col("digest").alias("root"))


def numbered(rows: DataFrame, tree: str, order: list[str], name: str) -> DataFrame:
    """The rows with `pos`, their place from 0 among those of the same tree; written in that order.

    A range partitioning puts a tree into consecutive partitions, however large it is, and a partition's rows are numbered as
    they pass. The counts of a (partition, tree) are one row each; a tree's earlier partitions are summed in a window.
    """
    spark = rows.sparkSession
    # ascending puts nulls first
    ordered = rows.repartitionByRange(partitions(spark), tree, *order).sortWithinPartitions(tree, *order)
    fields = rows.schema

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, current, done = TaskContext.get().partitionId(), object(), 0
        for batch in batches:
            places = []
            for key in batch.column(tree).to_pylist():
                if key != current:
                    current, done = key, 0
                places.append(done)
                done += 1
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([part] * batch.num_rows, pa.int32()), pa.array(places, pa.int64())],
                names=[*batch.schema.names, "part_", "place_"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    placed = settle(ordered.mapInArrow(count, f"{schema}, part_ int, place_ bigint"), name)
    counts = placed.groupBy("part_", F.col(tree).alias("tree_")).agg(F.count("*").alias("n"))
    before = counts.selectExpr(
        "part_", "tree_",
        "sum(n) over (partition by tree_ order by part_ rows between unbounded preceding and current row) - n as before_")
    # one row per partition and tree; Spark broadcasts it where it is small
    joined = placed.join(before.withColumnRenamed("part_", "of_part_"),
                         (F.col("part_") == F.col("of_part_")) & F.col(tree).eqNullSafe(F.col("tree_")))
    return joined.select(*[F.col(f"`{f.name}`") for f in fields], (F.col("before_") + F.col("place_")).alias("pos"))


def grouped(nodes: DataFrame, step: int, *more: Column) -> DataFrame:
    """One row per aligned subtree: (tree, above, nodes), at most 2^step nodes in the order of their place."""
    held = F.sort_array(F.collect_list(F.struct("pos", "digest", *more)))
    return nodes.groupBy("tree", F.shiftright("pos", step).alias("above")).agg(held.alias("nodes"))


def raised(nodes: DataFrame, step: int) -> DataFrame:
    """The tops of the aligned subtrees over (tree, pos, digest): (tree, pos, digest, more), more: the tree has others."""
    runs = grouped(nodes, step)
    last = nodes.groupBy(F.col("tree").alias("tree_")).agg(F.max("pos").alias("last_"))
    runs = runs.join(last, F.col("tree").eqNullSafe(F.col("tree_"))).select(
        "tree", "above", (F.col("last_") >= (1 << step)).alias("more"), F.col("nodes.digest").alias("digests"))

    def up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tops = [list(subtree(digests, step if more else None))[-1][0]
                    for digests, more in zip(batch.column("digests").to_pylist(), batch.column("more").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("tree"), batch.column("above"), pa.array(tops, pa.string()), batch.column("more")],
                names=["tree", "pos", "digest", "more"])

    return runs.mapInArrow(up, "tree string, pos bigint, digest string, more boolean")


def stored_levels(nodes: DataFrame, step: int, name: str) -> list[DataFrame]:
    """Every step-th level over (tree, pos, digest), until each tree has one node. Finished trees keep their root."""
    levels = []
    while True:
        tops = settle(raised(nodes, step), name)
        nodes = tops.select("tree", "pos", "digest")
        levels.append(nodes)
        if not tops.where("more").limit(1).count():
            return levels


def build_manifest(leaves: DataFrame, order: list[str], tree: str = "tree", leaf: str = "leaf", carry: tuple[str, ...] = (),
                   step: int = STEP) -> Manifest:
    """Trees over `leaves`: `tree` a key of any type or null, `leaf` digests as hex text, `order` the order of the leaves."""
    need(leaves, tree, leaf, *order, *carry)
    no_clash(list(carry), MADE)
    if step < 1:
        raise ValueError("step must be at least 1")
    # null first, then bytewise
    key = F.coalesce(F.concat(F.lit("+"), F.col(f"`{tree}`").cast("string")), F.lit(""))
    rows = leaves.select(
        key.alias("tree_key"), *[F.col(f"`{c}`").alias(f"order_{i}") for i, c in enumerate(order)],
        F.col(f"`{leaf}`").alias("digest"), *[F.col(f"`{c}`") for c in carry])
    rows = settle(rows, "leaves")  # digests are computed once, and range bounds are drawn from the small rows
    placed = numbered(rows, "tree_key", [*[f"order_{i}" for i in range(len(order))], "digest"], "numbered")
    kept = placed.select(F.col("tree_key").alias("tree"), "pos", F.col("digest").alias("leaf"), *[F.col(f"`{c}`") for c in carry])
    levels = stored_levels(kept.select("tree", "pos", F.col("leaf").alias("digest")), step, "level")
    roots = levels[-1].select(F.lit("").alias("tree"), F.col("tree").alias("order_0"), "digest")
    top = settle(numbered(roots, "tree", ["order_0", "digest"], "roots"), "top")
    return Manifest(kept, levels, [top, *stored_levels(top.select("tree", "pos", "digest"), step, "top")])


def lowered(nodes: DataFrame, above: DataFrame, step: int, kept: list[str]) -> DataFrame:
    """(tree, pos, kept..., path) of each node: siblings inside its subtree, then the path of the subtree's top.

    `above` holds (tree, pos, path, wide): paths of the tops, and whether the tree had several subtrees on this level.
    """
    runs = grouped(nodes, step, *[F.col(f"`{c}`") for c in kept])
    tops = above.select(F.col("tree").alias("tree_"), F.col("pos").alias("pos_"), F.col("path").alias("rest"), "wide")
    runs = runs.join(tops, (F.col("tree") == F.col("tree_")) & (F.col("above") == F.col("pos_")))
    runs = runs.select("tree", "wide", "rest", F.col("nodes").alias("held"), F.col("nodes.digest").alias("digests"))

    def down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (digests, wide, rest) in enumerate(zip(
                    batch.column("digests").to_pylist(), batch.column("wide").to_pylist(),
                    batch.column("rest").to_pylist(), strict=True)):
                paths = [" ".join([*path, rest] if rest else path)
                         for path in paths_within(digests, step if wide else None)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("tree").take(pa.array([i] * len(paths))), batch.column("held").slice(i, 1).flatten(),
                     pa.array(paths, pa.string())], names=["tree", "held", "path"])

    held = runs.schema["held"].dataType.elementType.simpleString()
    found = runs.mapInArrow(down, f"tree string, held {held}, path string")
    return found.select("tree", *[F.col("held").getField(c).alias(c) for c in ["pos", "digest", *kept]], "path")


def descend(levels: list[DataFrame], roots: DataFrame, step: int, kept: list[str], name: str) -> DataFrame:
    """Paths of the nodes of levels[0], given the roots' own as (tree, path)."""
    above = roots.select("tree", F.lit(0).cast("long").alias("pos"), "path")
    for i in range(len(levels) - 2, -1, -1):
        # the tops' own level says whether a tree had several subtrees; a finished tree is carried up as it is
        several = levels[i + 1].where("pos > 0").select(F.col("tree").alias("wide_tree")).distinct()
        tops = above.join(several, F.col("tree") == F.col("wide_tree"), "left").select(
            "tree", "pos", "path", F.col("wide_tree").isNotNull().alias("wide"))
        above = lowered(levels[i], tops, step, kept if i == 0 else [])
        if i:
            above = settle(above.select("tree", "pos", "path"), name)
    return above


def extract_proofs(manifest: Manifest, step: int = STEP) -> DataFrame:
    """tree, pos, leaf, subroot, root, path and the carried columns of every leaf. `step` as in `build_manifest`."""
    start = manifest.top[-1].select("tree", F.lit("").alias("path"))
    named = descend(manifest.top, start, step, ["order_0"], "paths")
    roots = settle(named.select(F.col("order_0").alias("tree"), F.col("digest").alias("subroot"), "path"), "roots")
    carry = [c for c in manifest.leaves.columns if c not in ("tree", "pos", "leaf")]
    below = [manifest.leaves.withColumnRenamed("leaf", "digest"), *manifest.levels]
    proofs = descend(below, roots, step, carry, "paths")
    # a row per tree, and one row; Spark broadcasts them where they are small
    whole = proofs.join(roots.select(F.col("tree").alias("root_tree"), "subroot"), F.col("tree") == F.col("root_tree"))
    root = manifest.root.scalar()
    return whole.select(
        F.when(F.col("tree") != "", F.substring("tree", 2, 2**31 - 1)).alias("tree"), "pos", F.col("digest").alias("leaf"),
        "subroot", root.alias("root"), "path", *[F.col(f"`{c}`") for c in carry])


def siblings_digest(path: Column) -> Column:
    """SHA-256 of the path's digests one after another."""
    return F.sha2(F.regexp_replace(path, "[LR -]", "").cast("binary"), 256)


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path give; equal to the table's root if, and only if, nothing was changed."""
    def join(h, word):
        sibling = F.substring(word, 2, 64)
        both = F.when(word.startswith("L"), F.concat(sibling, h)).when(word.startswith("R"), F.concat(h, sibling)).otherwise(h)
        return F.sha2(both.cast("binary"), 256)
    return F.aggregate(F.filter(F.split(path, " "), lambda w: w != ""), leaf, join)
