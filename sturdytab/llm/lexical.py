"""Ranked lexical search by NRA: impact-sorted lists read in sequence, score intervals, exact top k.

Score. Terms are maximal runs of ASCII letters and digits and of all characters beyond ASCII, A-Z in lower case. A term's weight is
floor(1000 ln((2N + 2) / (2 df + 1))); a row's part of the score is weight x ((10^9 tf) div (1000 tf + 12 m)) with
m = 75 + (25 n N) div L, a term of the query counted as often as it stands there. All in 64-bit integers.

Passes. The first reads all texts for N, L and the document frequencies of the queries' terms: partial counts per task, then a sum.
The second deals rows into blocks of bounded size; a block's rows of each term are sorted by impact, and every query reads its
lists from the top, in steps of growing depth, all lists alike. A row seen has a lower bound (the impacts read) and an upper
one (plus the impact where each list that has not shown it stands); a row not seen has the sum of where the lists stand as its
upper bound. Rows whose upper bound is under the k-th best lower bound leave. Reading ends when no unseen row can get in and each row
still in has equal bounds, so membership, ties and scores are exact without a look into a row. The k-th best score of a task's
earlier blocks is a bound from the start. A task returns at most k rows a query, which a salted window brings down to k.

Nothing is shuffled but counts and those results: texts and postings stay in their task. The queries are broadcast in groups of
at most `GROUP_BYTES` of text (a single longer query goes alone); there is one second pass over the texts per group.

A null text has no terms and matches nothing; a query without terms gives no rows. Equal scores go to the smaller id, a null id first,
then to the order of the rows' texts' hashes; rows with equal id and text count each for itself. A repeated query row (same id and
text) counts once; different texts under one id are ranked apart. Weights of 0 add nothing, and only scores above 0 are
returned. Empty tables give an empty result. Long texts are split into terms a part at a time.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sturdytab.llm.common import bounded_batches, need, raw_texts
from sturdytab.session import settle

K = 20
GROUP_BYTES = 4_000_000
PART_BYTES = 1 << 20  # of a text split at once
BLOCK_ROWS, BLOCK_TERMS = 20_000, 2_000_000  # rows and (row, term) pairs of a block
DEPTH = 32  # of the first step of reading
SALTS = 32

# Fixed rule: what is no letter, digit or byte beyond ASCII separates terms; only A-Z change case.
SEPARATED = bytes(b if b >= 0x80 or chr(b).isalnum() else 32 for b in range(256)).lower()


def terms_of(text: bytes) -> Iterator[list[bytes]]:
    """Terms of a text, a part at a time."""
    start = 0
    while start < len(text):
        end = start + PART_BYTES
        while end < len(text) and SEPARATED[text[end]] != 32:  # a cut never falls into a term
            end += 1
        yield text[start:end].translate(SEPARATED).split()
        start = end


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impact(weights: np.ndarray, tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return weights * ((1_000_000_000 * tf) // (1000 * tf + 12 * m))


class Block:
    """Impact-sorted lists over some rows."""

    def __init__(self, rows: list[tuple], terms: np.ndarray, owners: np.ndarray, impacts: np.ndarray, n_terms: int):
        order = np.lexsort((owners, -impacts, terms))
        self.rows, self.owners, self.impacts = rows, owners[order], impacts[order]
        self.at = np.searchsorted(terms[order], np.arange(n_terms + 1))

    def top(self, query: list[tuple[int, int]], k: int, floor: int) -> list[tuple[int, int]]:
        """(row number, score) of all rows with a score above 0 that can be among the best k, given that a score under `floor`
        can't. Scores are exact."""
        lists = [(self.at[t], self.at[t + 1], times) for t, times in query if self.at[t + 1] > self.at[t]]
        if not lists:
            return []
        n = len(self.rows)
        lower, seen_at = np.zeros(n, np.int64), np.zeros(n, np.int64)
        live = np.ones(n, bool)
        stands = [int(self.impacts[a]) * times for a, _, times in lists]
        read, depth, floor = 0, DEPTH, max(floor, 1)
        while True:
            for i, (a, b, times) in enumerate(lists):
                x, y = min(a + read, b), min(a + depth, b)
                rows = self.owners[x:y]  # a list shows a row once
                lower[rows] += self.impacts[x:y] * times
                now = int(self.impacts[y]) * times if y < b else 0
                # what this list is known to hold of a row it has shown is no longer open
                seen_at[self.owners[a:x]] += now - stands[i]
                seen_at[rows] += now
                stands[i] = now
            unseen = sum(stands)
            if k < n:
                floor = max(floor, int(np.partition(lower, n - k)[n - k]))
            upper = lower + unseen - seen_at
            live &= upper >= floor
            if not unseen or not np.any(live & (upper > lower)):
                break
            read, depth = depth, depth * 4
        found = np.flatnonzero(live & (lower > 0) & (lower >= floor))
        return list(zip(found.tolist(), lower[found].tolist(), strict=True))


def counted(docs: DataFrame, text_col: str, words: list[bytes]) -> tuple[int, int, list[int]]:
    """N, L and the document frequency of each word."""
    shared = docs.sparkSession.sparkContext.broadcast(words)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {w: i for i, w in enumerate(shared.value)}
        held, total, df = 0, 0, Counter()
        for batch in batches:
            for text in raw_texts(batch.column("text")):
                found, n = set(), 0
                for part in terms_of(text):
                    n += len(part)
                    found.update(map(number.get, set(part)))
                found.discard(None)
                df.update(found)
                held, total = held + (n > 0), total + n
        keys = [-2, -1, *df]
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([held, total, *df.values()], pa.int64())],
                                         names=["key", "n"])

    partial = docs.select(F.col(text_col).alias("text")).mapInArrow(count, "key bigint, n bigint")
    rows = {r["key"]: r["n"] for r in partial.groupBy("key").agg(F.sum("n").alias("n")).collect()}  # a row per word of the queries
    return rows.get(-2, 0), rows.get(-1, 0), [rows.get(i, 0) for i in range(len(words))]


def searched(docs: DataFrame, id_col: str, text_col: str, words: list[bytes], queries: list[list[tuple[int, int]]], k: int,
             n_docs: int, n_terms: int, weights: list[int]) -> DataFrame:
    """(query, doc, tie, score, part): each task's best rows of each query."""
    shared = docs.sparkSession.sparkContext.broadcast((words, queries, weights))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, queries, weights = shared.value
        number = {w: i for i, w in enumerate(words)}
        worth = np.array(weights, np.int64)
        best: list[list] = [[] for _ in queries]  # heaps of (score, order, doc, tie), the worst first

        def close(rows, terms, owners, tfs, lengths):
            if not rows:
                return
            t, o = np.array(terms, np.int64), np.array(owners, np.int64)
            m = 75 + (25 * np.array(lengths, np.int64) * n_docs) // n_terms
            block = Block(rows, t, o, impact(worth[t], np.array(tfs, np.int64), m[o]), len(words))
            for query, heap in zip(queries, best, strict=True):
                for at, score in block.top(query, k, heap[0][0] if len(heap) == k else 0):
                    doc, tie = rows[at]
                    # the smaller id, and a null one before all, is the better: negated for the heap
                    entry = (score, (doc is None, 0 if doc is None else -doc, -tie), doc, tie)
                    if len(heap) < k:
                        heapq.heappush(heap, entry)
                    elif entry[:2] > heap[0][:2]:
                        heapq.heapreplace(heap, entry)

        rows, terms, owners, tfs, lengths = [], [], [], [], []
        for batch in batches:
            ids, ties = batch.column("doc").to_pylist(), batch.column("tie").to_pylist()
            for doc, tie, text in zip(ids, ties, raw_texts(batch.column("text")), strict=True):
                tf, n = Counter(), 0
                for part in terms_of(text):
                    n += len(part)
                    tf.update(map(number.get, part))
                tf.pop(None, None)
                if not tf:
                    continue
                terms += tf.keys()
                owners += [len(rows)] * len(tf)
                tfs += tf.values()
                lengths.append(n)
                rows.append((doc, tie))
                if len(rows) >= BLOCK_ROWS or len(terms) >= BLOCK_TERMS:
                    close(rows, terms, owners, tfs, lengths)
                    rows, terms, owners, tfs, lengths = [], [], [], [], []
        close(rows, terms, owners, tfs, lengths)
        found = [(q, doc, tie, score) for q, heap in enumerate(best) for score, _, doc, tie in heap]
        if found:
            query, doc, tie, score = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(query, pa.int32()), pa.array(doc, pa.int64()), pa.array(tie, pa.int64()), pa.array(score, pa.int64()),
                 pa.array([TaskContext.get().partitionId()] * len(query), pa.int32())],
                names=["query", "doc", "tie", "score", "part"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(text_col).alias("tie"), F.col(text_col).alias("text"))
    return rows.mapInArrow(search, "query int, doc bigint, tie bigint, score bigint, part int")


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The best k of each query with their rank: first per salt, so that no task holds what all tasks found."""
    order = [F.desc("score"), F.asc_nulls_first("doc"), "tie"]
    salted = found.withColumn("salt", F.pmod("part", F.lit(SALTS)))
    first = salted.withColumn("n", F.row_number().over(Window.partitionBy("query", "salt").orderBy(*order))).where(F.col("n") <= k)
    last = Window.partitionBy("query").orderBy(*order)
    return first.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= k)


def top_documents(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                  item_text: str = "text", k: int = K, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """item_id, rank (from 1), doc_id, score of the best k rows for each item; the id columns keep their names and `docs`'
    ids must be whole numbers."""
    need(docs, id_col, text_col)
    need(items, item_col, item_text)
    if item_col == id_col or {item_col, id_col} & {"rank", "score"}:
        raise ValueError("id columns must differ from each other and from rank and score")
    spark = docs.sparkSession
    bounded_batches(spark)
    asked = settle(items.select(F.col(item_col).alias("item"), F.col(item_text).alias("text")).distinct(), "items")
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = max(1, math.ceil(size / group_bytes))
    dealt = settle(asked.withColumn("group", F.pmod(F.xxhash64("item", "text"), F.lit(groups))), "groups") if groups > 1 else \
        asked.withColumn("group", F.lit(0))
    parts = []
    for group in range(groups):
        rows = dealt.where(F.col("group") == group).select("item", "text").collect()  # at most some GROUP_BYTES of text
        counts = [Counter(t for part in terms_of((r["text"] or "").encode()) for t in part) for r in rows]
        words = sorted(set().union(*counts)) if counts else []
        if not words:
            continue
        number = {w: i for i, w in enumerate(words)}
        n_docs, n_terms, df = counted(docs, text_col, words)
        if not n_terms:
            continue
        weights = [weight(n_docs, n) for n in df]
        queries = [[(number[w], times) for w, times in c.items() if weights[number[w]]] for c in counts]
        best = ranked(searched(docs, id_col, text_col, words, queries, k, n_docs, n_terms, weights), k)
        names = spark.createDataFrame([(i, r["item"]) for i, r in enumerate(rows)],
                                      f"query int, item {asked.schema['item'].dataType.simpleString()}")
        parts.append(best.join(F.broadcast(names), "query").select("item", "rank", "doc", "score"))
    kind = docs.schema[id_col].dataType.simpleString()
    empty = spark.createDataFrame([], f"item {asked.schema['item'].dataType.simpleString()}, rank int, doc bigint, score bigint")
    out = parts[0] if parts else empty
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select(F.col("item").alias(item_col), "rank", F.col("doc").cast(kind).alias(id_col), "score")
