"""SimHash near-dedup by anchor points.

Fingerprint: words `[^\\x20\\x09-\\x0D]+` of the text with A-Z lower-cased, shingles of `width` words joined by a space,
repeats included (fewer words: the whole sequence), XXH64 with seed 42 of each; a bit is 1 if set in over half of them.
No words, an empty or a null text: fingerprint zero, linked like any other.

Links: fingerprints at `THRESHOLD` = 4 or fewer differing bits. The 64 bits are three segments of 21, 21 and 22 bits
that allow 1, 1 and 0 differing bits: two linked fingerprints keep to at least one of these, as breaking all three
takes 2 + 2 + 1 = 5 bits. In a segment with one allowed bit the anchors are a covering code of radius 1, the perfect
Hamming code on 15 bits times all words of the other bits. A fingerprint is at home at its nearest anchor and visits
every anchor within radius plus allowance = 2, so it meets at its home all that are within 1 bit there. In the segment
without an allowance every word is an anchor. Homes are compared with all that are at the anchor, on all 64 bits.

Copies collapse to one fingerprint before anything is dealt. An anchor with more than `CROWD` fingerprints is split
into blocks, and each pair of blocks is a task's work of its own. A task returns a spanning forest, not all pairs.

Rows with a null id take part; a component's id is its smallest non-null id, null if it has none. Repeated rows give
repeated results. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sturdytab.llm.common import bounded_batches, need, partitions, raw_texts, slices
from sturdytab.llm.components import components, local_roots
from sturdytab.session import settle

WIDTH = 4
SEED = 42
THRESHOLD = 4
CROWD = 4096
SEGMENTS = ((0, 21, 1), (21, 21, 1), (42, 22, 0))  # first bit, bits, allowed differences
BROADCAST_KEYS = 50_000
PAIR_BLOCK = 1_000_000


def shingle_hashes(text: bytes, width: int = WIDTH) -> list[int]:
    """XXH64 of every shingle, repeats included; fewer words than `width` are one shingle, no words none."""
    words = text.lower().split()
    if not words:
        return []
    if len(words) <= width:
        return [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    line = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[:len(words) - width + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return [digest(line[a:b], SEED) for a, b in zip(starts, ends[width - 1:].tolist(), strict=True)]


def fingerprint(text: bytes, width: int = WIDTH) -> int:
    """The 64-bit SimHash as a signed integer."""
    return fingerprint_of(shingle_hashes(text, width))


def fingerprint_of(hashes: list[int]) -> int:
    if not hashes:
        return 0
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 65_536):
        part = np.array(hashes[i:i + 65_536], "<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """(id, fp): one row per row of `docs`, fp as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            fps = [fingerprint(t, width) for t in raw_texts(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(fps, pa.int64())], names=["id", "fp"])

    need(docs, id_col, text_col)
    bounded_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(
        run, "id long, fp long")


def anchors_of(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of the fingerprint, anchor, home) of every stay. An anchor is numbered by segment and code word."""
    who, where, home = [], [], []
    everyone = np.arange(len(fps))
    bits = fps.view(np.uint64)
    for number, (first, size, allowed) in enumerate(SEGMENTS):
        word = ((bits >> np.uint64(first)) & np.uint64((1 << size) - 1)).astype(np.int64)

        def stay(rows, at, is_home, number=number):
            who.append(rows)
            where.append(at | (number << 40))
            home.append(np.full(len(rows), is_home))

        if not allowed:
            stay(everyone, word, True)
            continue
        low = word & 0x7FFF
        syndrome = np.zeros(len(fps), np.int64)
        for i in range(15):
            syndrome ^= np.where((low >> i) & 1, i + 1, 0)
        nearest = np.where(syndrome > 0, word ^ (1 << np.maximum(syndrome - 1, 0)), word)
        stay(everyone, nearest, True)
        high = [1 << k for k in range(15, size)]
        for flip in high:  # one differing bit outside the code, the nearest word inside
            stay(everyone, nearest ^ flip, False)
        for i in range(1, 16):  # two differing bits inside: the pairs of positions whose sum is the syndrome
            j = i ^ syndrome
            rows = np.flatnonzero((syndrome > 0) & (j > i))
            stay(rows, word[rows] ^ (1 << (i - 1)) ^ (1 << (j[rows] - 1)), False)
        rows = np.flatnonzero(syndrome == 0)
        for x, one in enumerate(high):  # two differing bits outside, from code words only
            for two in high[x + 1:]:
                stay(rows, word[rows] ^ one ^ two, False)
    return np.concatenate(who), np.concatenate(where), np.concatenate(home)


def stays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = batch.column("fp").to_numpy(zero_copy_only=False).astype(np.int64)
        for i in range(0, len(fps), 20_000):
            who, where, home = anchors_of(fps[i:i + 20_000])
            yield pa.RecordBatch.from_arrays(
                [pa.array(where), pa.array(fps[i:i + 20_000][who]), pa.array(home)], names=["anchor", "fp", "home"])


def crowd_links(fps: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links of one large group: rows already joined are not told again."""
    label = np.arange(len(fps))
    a, b = [], []
    for i in np.flatnonzero(home):
        near = np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= THRESHOLD)
        labels, one = np.unique(label[near], return_index=True)
        if len(labels) > 1:
            a.append(np.full(len(labels), fps[i]))
            b.append(fps[near[one]])
            label[np.isin(label, labels)] = labels[0]
    return (np.concatenate(a), np.concatenate(b)) if a else (fps[:0], fps[:0])


def group_links(group: np.ndarray, fps: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs among sorted whole groups: each home against all rows of its group."""
    edge = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1], [True])))
    sizes = np.diff(edge)
    bits = fps.view(np.uint64)
    a, b = [], []
    for g in np.flatnonzero(sizes > 512):
        part = slice(edge[g], edge[g + 1])
        x, y = crowd_links(bits[part], home[part])
        a.append(x), b.append(y)
    of = np.repeat(np.arange(len(sizes)), sizes)
    hosts = np.flatnonzero(home & (sizes[of] > 1) & (sizes[of] <= 512))
    upto = np.cumsum(sizes[of[hosts]])
    start = 0
    while start < len(hosts):
        stop = max(start + 1, int(np.searchsorted(upto, (upto[start - 1] if start else 0) + PAIR_BLOCK, "right")))
        h = hosts[start:stop]
        n = sizes[of[h]]
        one = np.repeat(h, n)
        two = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(edge[of[h]], n)
        near = np.bitwise_count(bits[one] ^ bits[two]) <= THRESHOLD
        a.append(bits[one[near]]), b.append(bits[two[near]])
        start = stop
    if not a:
        return fps[:0], fps[:0]
    a, b = np.concatenate(a).view(np.int64), np.concatenate(b).view(np.int64)
    return a[a != b], b[a != b]


def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by group: links of each group as a star forest over some hundred thousand rows at a time."""
    held: list[tuple[np.ndarray, ...]] = []
    n = 0

    def flush(upto: int, columns: tuple[np.ndarray, ...]):
        hi, lo = local_roots(*group_links(*(c[:upto] for c in columns)))
        return pa.RecordBatch.from_arrays([pa.array(hi), pa.array(lo)], names=["hi", "lo"])

    for batch in batches:
        if not batch.num_rows:
            continue
        anchor, part = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("anchor", "part"))
        new = np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (part[1:] != part[:-1])))
        if held and (anchor[0], part[0]) == held[-1][3]:
            new[0] = False
        number = np.cumsum(new) + (held[-1][0][-1] if held else 0)
        held.append((number, batch.column("fp").to_numpy(zero_copy_only=False).astype(np.int64),
                     batch.column("home").to_numpy(zero_copy_only=False), (anchor[-1], part[-1])))
        n += batch.num_rows
        if n >= 200_000:
            columns = tuple(np.concatenate([h[i] for h in held]) for i in range(3))
            upto = int(np.searchsorted(columns[0], columns[0][-1]))  # the last group may go on
            if upto:
                yield flush(upto, columns)
                held = [tuple(c[upto:] for c in columns) + (held[-1][3],)]
                n -= upto
    if held:
        columns = tuple(np.concatenate([h[i] for h in held]) for i in range(3))
        yield flush(len(columns[0]), columns)


def fingerprint_links(fps: DataFrame) -> DataFrame:
    """Edges (hi, lo) that connect the distinct fingerprints `fp` as all links do."""
    spark = fps.sparkSession
    at = fps.mapInArrow(stays, "anchor long, fp long, home boolean")
    crowded = settle(at.groupBy("anchor").count().where(F.col("count") > CROWD), "crowded")
    many = crowded.count()
    if many:
        crowded = F.broadcast(crowded) if many <= BROADCAST_KEYS else crowded
        blocks = F.ceil(F.coalesce("count", F.lit(1)) / CROWD).cast("long")
        at = at.join(crowded, "anchor", "left").withColumn("blocks", blocks)
        at = at.withColumn("own", F.pmod(F.xxhash64("fp"), "blocks"))
        at = at.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        at = at.withColumn("part", F.least("own", "other") * F.col("blocks") + F.greatest("own", "other"))
    else:
        at = at.withColumn("part", F.lit(0).cast("long"))
    dealt = at.select("anchor", "part", "fp", "home").repartition(partitions(spark), "anchor", "part")
    return dealt.sortWithinPartitions("anchor", "part").mapInArrow(links, "hi long, lo long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """One row per document: id, fp (signed), component (the smallest id reachable over links, its own included)."""
    fps = settle(fingerprints(docs, id_col, text_col, width), "fingerprints")
    classes = settle(fps.groupBy("fp").agg(F.min("id").alias("first")), "classes")
    forest = components(fingerprint_links(classes.select("fp")))
    rooted = settle(classes.join(forest.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")), "rooted")
    smallest = settle(rooted.groupBy("root").agg(F.min("first").alias("component")), "smallest")
    named = settle(rooted.join(smallest, "root").select("fp", "component"), "named")
    return fps.join(named, "fp").select(F.col("id").alias(id_col), "fp", "component")
