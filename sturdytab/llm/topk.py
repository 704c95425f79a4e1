"""Exact top-k search by inner product as a Voronoi kNN join.

Every component x becomes floor(256 x). A hash-chosen set of at most `PIVOTS` distinct vectors divides the space into
cells; each vector belongs to its nearest pivot p, at distance d. A cell's summary is the k + 1 smallest d. Queries form
groups by the nearest of the first `GROUPS` pivots, c, with radius R. For a vector x = p + f and a query q = c + e of
the group, q.x lies above c.p - |c| d - R (|p| + d); the (k + 1)-th largest of these values over all summaries is
reached by the k best of every query of the group, its own row left out. Since q.x is at most c.x + R |x|, a vector is
sent to a group only if that reaches the group's value. Blocks of a group's queries and vectors are solved by matrix
products, and the blocks' best are merged. A bound that does not prune sends every vector to every group, never more.

Equal vectors are one vector with the k + 1 smallest of their ids, which is all that any query can return; copies are
reduced map-side and by salted keys first. Pivots and summaries are bounded and come to the driver.

Scores are exact: where the norms keep every partial sum below 2^53, blocks are multiplied as doubles, else as 64-bit
integers. Scores that may not fit 64 bits are an error.

Vectors of different lengths are compared as if the shorter one went on with zeros. Null vectors, empty vectors, vectors
with null or non-finite components, and rows without an id take no part. Equal rows count once. If an id has several vectors, each
is a row; the query's own rows, those with its id, are no candidates. Empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sturdytab.llm.common import need
from sturdytab.session import settle

SCALE = 256
PIVOTS = 128
GROUPS = 16
QUERY_BLOCK = 1_000
DATA_BLOCK = 4_000
SALTS = 64
CELLS = 512_000  # numbers of a matrix inside a task
EXACT = 2.0**53  # doubles hold all integers up to it
LARGEST = 2.0**62


def grid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Quantised vectors as packed integers, without those that take no part for their content."""
    for batch in batches:
        ids, packed = [], []
        for i, v in zip(batch.column("id").to_pylist(), batch.column("vector").to_pylist(), strict=True):
            if i is None or v is None or any(x is None for x in v):
                continue
            x = np.array(v, np.float64)
            if len(x) and np.isfinite(x).all():
                if np.abs(x).max() * SCALE >= LARGEST:
                    raise ValueError("a component does not fit 64-bit integers")
                ids.append(i)
                packed.append(np.floor(SCALE * x).astype("<i8").tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(packed, pa.binary())],
                                         names=["id", "vector"])


def integers(column: pa.Array, dim: int) -> np.ndarray:
    """Packed vectors as rows, with zeros at the end of shorter ones."""
    values = [np.frombuffer(x, "<i8") for x in column.to_pylist()]
    if all(len(x) == dim for x in values):
        return np.concatenate(values).reshape(-1, dim) if values else np.zeros((0, dim), np.int64)
    rows = np.zeros((len(values), dim), np.int64)
    for row, x in zip(rows, values, strict=True):
        row[:len(x)] = x
    return rows


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """The same in doubles, which bounds are computed with."""
    return integers(column, dim).astype(np.float64)


def pieces(batch: pa.RecordBatch, dim: int) -> Iterator[pa.RecordBatch]:
    """The rows, few enough at once for a matrix of bounded size."""
    step = max(1, CELLS // dim)
    for start in range(0, batch.num_rows, step):
        yield batch.slice(start, step)


def products(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Exact integer scores, a row per query."""
    def norm(x: np.ndarray) -> float:
        return float(np.sqrt((x.astype(np.float64) ** 2).sum(axis=1).max())) * (1 + 1e-9)

    bound = norm(queries) * norm(vectors)  # no partial sum is beyond it
    if bound < EXACT:
        return (queries.astype(np.float64) @ vectors.T.astype(np.float64)).astype(np.int64)
    if bound >= 2 * LARGEST:
        raise ValueError("scores may not fit 64-bit integers")
    return queries @ vectors.T


def nearest(x: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of and distance to the nearest pivot. The distance is rounded up."""
    at = np.argmin((pivots**2).sum(1) - 2 * x @ pivots.T, axis=1)
    return at, np.sqrt(((x - pivots[at]) ** 2).sum(1)) * (1 + 1e-9) + 1e-9


def placed(pivots: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, pivots.shape[1]):
                at, far = nearest(matrix(batch.column("vector"), pivots.shape[1]), pivots)
                yield pa.RecordBatch.from_arrays([batch.column(c) for c in batch.schema.names]
                                                 + [pa.array(at.astype(np.int32)), pa.array(far)],
                                                 names=[*batch.schema.names, "cell", "far"])

    return run


def group_values(centers: np.ndarray, radius: np.ndarray, pivots: np.ndarray, cells: np.ndarray, far: np.ndarray,
                 k: int) -> np.ndarray:
    """For each group a score that its queries' k best reach; -inf if the summaries hold too few vectors."""
    p, size = pivots[cells], np.sqrt((pivots[cells] ** 2).sum(1))
    norm = np.sqrt((centers**2).sum(1))[:, None]
    low = centers @ p.T - norm * far - radius[:, None] * (size + far)
    low -= 1e-9 * (norm + radius[:, None]) * (size + far) + 1e-6  # what rounding may add
    if low.shape[1] <= k:
        return np.full(len(centers), -np.inf)
    return -np.sort(-low, axis=1)[:, k]


def sent(centers: np.ndarray, radius: np.ndarray, value: np.ndarray, groups: np.ndarray):
    """The groups that each vector may matter to."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        norms = np.sqrt((centers**2).sum(1))
        for batch in (x for whole in batches for x in pieces(whole, centers.shape[1])):
            x = matrix(batch.column("vector"), centers.shape[1])
            size = np.sqrt((x**2).sum(1))[:, None]
            most = x @ centers.T + size * radius + 1e-9 * size * (norms + radius) + 1e-6
            row, to = np.nonzero(most >= value)
            kept = batch.take(pa.array(row))
            yield pa.RecordBatch.from_arrays([pa.array(groups[to].astype(np.int32)), kept.column("ids"),
                                              kept.column("vector")], names=["cell", "ids", "vector"])

    return run


def best_of_block(dim: int, k: int):
    """The k best of one block of vectors for each query of one block."""
    names = ["query_id", "vec_id", "score"]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        queries, vectors = left.column("query_id").to_numpy(), integers(right.column("vector"), dim)
        out: list[list[np.ndarray]] = [[], [], []]
        if len(queries) and len(vectors):
            lists = right.column("ids").combine_chunks()
            ids, starts = lists.flatten().to_numpy(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
            asked = integers(left.column("vector"), dim)
            step = max(1, CELLS // len(vectors))
            for first in range(0, len(queries), step):
                scores = products(asked[first:first + step], vectors)
                # k + 1 vectors: the query's own id may be all that one of them has
                near = scores >= np.partition(scores, -(k + 1), axis=1)[:, -(k + 1), None] if len(vectors) > k else scores == scores
                row, at = np.nonzero(near)
                copies = starts[at + 1] - starts[at]
                place = np.arange(copies.sum()) - np.repeat(np.cumsum(copies) - copies, copies)
                i, q = ids[np.repeat(starts[at], copies) + place], np.repeat(row, copies)
                s = np.repeat(scores[row, at], copies)
                other = i != queries[first + q]
                i, q, s = i[other], q[other], s[other]
                order = np.lexsort((i, -s, q))
                i, q, s = i[order], q[order], s[order]
                best = np.arange(len(q)) - np.searchsorted(q, q) < k
                for column, x in zip(out, (queries[first + q[best]], i[best], s[best]), strict=True):
                    column.append(x)
        columns = [np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in out]
        return pa.table(columns, names=names)

    return run


def distinct_vectors(rows: DataFrame, k: int) -> DataFrame:
    """(vector, ids): the k + 1 smallest ids of each distinct vector. Hot vectors are cut down by salt first."""
    salted = Window.partitionBy("vector", "salt").orderBy("id")
    few = rows.distinct().withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
    few = few.withColumn("n", F.row_number().over(salted)).where(F.col("n") <= k + 1)
    few = few.withColumn("n", F.row_number().over(Window.partitionBy("vector").orderBy("id"))).where(F.col("n") <= k + 1)
    return few.groupBy("vector").agg(F.array_sort(F.collect_list("id")).alias("ids"))


def top_k(vectors: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
          k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest integer inner products of each query, ties to the smaller id."""
    need(vectors, id_col, vector_col)
    need(queries, id_col, vector_col)
    spark = vectors.sparkSession

    def packed(df: DataFrame) -> DataFrame:
        return df.select(F.col(id_col).cast("long").alias("id"),
                         F.col(vector_col).cast("array<double>").alias("vector")).mapInArrow(grid, "id long, vector binary")

    rows = settle(packed(vectors), "vectors")
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    asked = settle(packed(queries).distinct(), "asked")
    longest = [df.agg(F.max(F.length("vector"))).first()[0] for df in (rows, asked)]
    if None in longest:
        return empty
    dim = max(longest) // 8
    query_rows, data_rows = (max(1, min(n, n * 1_024 // dim)) for n in (QUERY_BLOCK, DATA_BLOCK))
    unique = settle(distinct_vectors(rows, k), "unique")
    picked = unique.orderBy(F.xxhash64("vector"), "vector").limit(PIVOTS).collect()
    pivots = matrix(pa.array([r["vector"] for r in picked], pa.binary()), dim)
    centers = pivots[:GROUPS]

    cells = unique.mapInArrow(placed(pivots), "vector binary, ids array<long>, cell int, far double")
    close = Window.partitionBy("cell").orderBy("far")
    summary = cells.select("cell", "far").withColumn("n", F.row_number().over(close)).where(F.col("n") <= k + 1).collect()
    grouped = settle(asked.mapInArrow(placed(centers), "id long, vector binary, cell int, far double"), "grouped")
    reach = grouped.groupBy("cell").agg(F.max("far").alias("radius"), F.count("*").alias("n")).orderBy("cell").collect()
    if not reach:
        return empty
    groups = np.array([r["cell"] for r in reach])
    radius = np.array([r["radius"] for r in reach])
    value = group_values(centers[groups], radius, pivots, np.array([r["cell"] for r in summary]),
                         np.array([r["far"] for r in summary]), k)

    copies = settle(unique.mapInArrow(sent(centers[groups], radius, value, groups),
                                      "cell int, ids array<long>, vector binary"), "copies")
    loads = {r["cell"]: r["n"] for r in copies.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    plan = spark.createDataFrame(
        [(r["cell"], -(-r["n"] // query_rows), -(-loads.get(r["cell"], 0) // data_rows)) for r in reach],
        "cell int, query_blocks int, data_blocks int")  # a row a group
    data = copies.join(F.broadcast(plan), "cell").withColumns({
        "data_block": F.pmod(F.xxhash64("vector"), "data_blocks"),
        "query_block": F.explode(F.sequence(F.lit(0), F.col("query_blocks") - 1))})
    query = grouped.withColumnRenamed("id", "query_id").join(F.broadcast(plan), "cell").where("data_blocks > 0")
    query = query.withColumns({"query_block": F.pmod(F.xxhash64("query_id"), "query_blocks").cast("int"),
                               "data_block": F.explode(F.sequence(F.lit(0), F.col("data_blocks") - 1))})
    keys = [F.col("cell"), F.col("query_block").cast("long"), F.col("data_block").cast("long")]
    task = F.xxhash64(*keys)
    left = query.select(task.alias("task"), "query_id", "vector").groupBy("task")
    right = data.select(task.alias("task"), "ids", "vector").groupBy("task")
    found = left.cogroup(right).applyInArrow(best_of_block(dim, k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
