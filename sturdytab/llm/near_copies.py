"""Near copies by SimHash fingerprints and exact shingle similarity.

A text is the set of its shingles of `WIDTH` words (those of `simhash`, by their 64-bit hashes). Two texts are linked if
the sets' Jaccard similarity is 0.8 or more; no words are the empty set, linked to one another only. Equal sets are one
class and are judged once.

The first candidates come from the SimHash operator: fingerprints of the same shingles, linked by its anchors at 4 or fewer differing
bits. A text is compared with the first text of its fingerprint and with the first one of its fingerprint's component. These links come
first, and what they join is not compared again.

Most pairs near 0.8 differ in more bits than anchors can cover. So candidates also share one of `BANDS` keys of `ROWS` MinHash values each, and the smaller set has 0.8 of the larger one's size. A pair
at 0.8 shares none with a chance below 1e-7 (14.8 are expected), one at 0.3 shares one in one case of 170; SimHash fingerprints of a
pair at 0.8 differ in some 10 of 64 bits, too many to be looked up.
Of the texts of a key the one whose keys have most texts leads: in a group of near copies that is the text that all were copied from, if
it is there. First each text is compared with one other, of the leads of its keys that with which it shares most. Then with the leads
of its other keys, as far as they are not yet in one component with it. So a large group of near copies costs a few comparisons a text.

What is left are texts that meet under a lead and are not yet in one component with each other. A family a little below 0.8, say texts
with one long passage in common, has as many such pairs as the square of its size, so they are not compared one by one. What each
text shares with the lead bounds what two can share within it; where that is too little they must have shingles outside the lead
in common, else differ from the lead in like shingles. How many they need follows from their sizes, and is at least one. So only
texts with such a shingle in common meet, and of these only at one with enough behind it in the order of ascending counts:
of the shingles that both have, the first one has all others behind it. No candidate pair that could join two components is left out, and every
comparison is exact.

Rows with a null id take part; a component's id is its smallest non-null id, null if it has none. Repeated rows give
repeated results. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sturdytab.llm.common import bounded_batches, need, raw_texts, slices, trimmed
from sturdytab.llm.components import components
from sturdytab.llm.simhash import SEED, fingerprint_links, fingerprint_of, shingle_hashes
from sturdytab.operators.sampling import attach_by_key
from sturdytab.session import settle

WIDTH = 5
BANDS, ROWS = 88, 8
CHUNK = 2048  # shingles hashed at once
CROWD = 256  # comparisons with one text that a task may have

DRAWN = np.random.default_rng(SEED).integers(0, 2**32, (3, BANDS * ROWS), np.uint32)
FLIPS, FACTORS = DRAWN[0][:, None], DRAWN[1][:, None] | np.uint32(1)
MIX = np.uint64(0x9E3779B97F4A7C15)


def shingle_set(hashes: list[int]) -> np.ndarray:
    return np.unique(np.array(hashes, np.uint64))


def key_of(shingles: np.ndarray) -> int:
    """Signed 64-bit key of a set."""
    return xxhash.xxh64_intdigest(shingles.tobytes(), SEED) - 2**63


def bands_of(shingles: np.ndarray) -> np.ndarray:
    """One signed key a band; none for the empty set."""
    if not len(shingles):
        return np.zeros(0, np.int64)
    low = np.full(BANDS * ROWS, 2**32 - 1, np.uint32)
    high = (shingles >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(high), CHUNK):
        np.minimum(low, ((high[i:i + CHUNK] ^ FLIPS) * FACTORS).min(axis=1), out=low)
    keys = np.arange(1, BANDS + 1, dtype=np.uint64) * MIX
    for column in low.reshape(BANDS, ROWS).T:
        keys = (keys ^ column) * MIX
        keys ^= keys >> np.uint64(29)
    return keys.view(np.int64)


def described(shingles: np.ndarray, hashes: list[int]) -> np.ndarray:
    """The number of shingles and the fingerprint, then the bands."""
    return np.concatenate((np.array([len(shingles), fingerprint_of(hashes)], np.int64), bands_of(shingles)))


def mapped(docs: DataFrame, make, column: str) -> DataFrame:
    """(id, key, column) with an array of longs made of each text's set of shingles and their hashes with repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            keys, made = [], []
            for text in raw_texts(batch.column("text")):
                hashes = shingle_hashes(text, WIDTH)
                shingles = shingle_set(hashes)
                keys.append(key_of(shingles)), made.append(make(shingles, hashes))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(keys, pa.int64()), pa.array(made, pa.list_(pa.int64()))], names=["id", "key", column])

    return docs.mapInArrow(trimmed(run), f"id long, key long, {column} array<long>")


def beside(pairs: DataFrame, values: DataFrame, *carry: str) -> DataFrame:
    """The pairs (hi, lo) with x, the value of hi, and y, that of lo, from (key, value). A text compared with many is copied to
    several tasks."""
    blocks = settle(pairs.groupBy("lo").count().select("lo", F.ceil(F.col("count") / CROWD).alias("blocks")), "blocks")
    dealt = pairs.join(blocks, "lo").select("hi", "lo", *carry, F.pmod(F.xxhash64("hi"), "blocks").alias("part"))
    ones = values.select(F.col("key").alias("hi"), F.col("value").alias("x"))
    others = values.select(F.col("key").alias("lo"), F.col("value").alias("y")).join(blocks, "lo").select(
        "lo", "y", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("part"))
    return dealt.join(ones, "hi").join(others, ["lo", "part"])


def alike(x, y):
    """Whether sets of these sizes can have a similarity of 0.8."""
    return 5 * F.least(x, y) >= 4 * F.greatest(x, y)


def sets_of(pairs: DataFrame, classes: DataFrame, texts: DataFrame) -> DataFrame:
    """(key, value): the sets of the pairs' texts. Only their shingles are made again."""
    asked = settle(pairs.select(F.col("hi").alias("key")).union(pairs.select("lo")).distinct().join(
        classes.select("key", "first"), "key"), "asked")
    ids = asked.select(F.col("first").alias("asked_id")).distinct()
    some = mapped(texts.join(ids, F.col("id").eqNullSafe(F.col("asked_id")), "left_semi"),
                  lambda s, _: s.view(np.int64), "value")
    return settle(some.join(asked.select("key"), "key", "left_semi").groupBy("key").agg(
        F.first("value").alias("value")), "sets")


def similar(pairs: DataFrame, classes: DataFrame, texts: DataFrame) -> DataFrame:
    """Of the pairs (hi, lo) of keys, in any order, those whose sets have a similarity of 0.8 or more, hi > lo."""
    sets = sets_of(pairs, classes, texts)
    both = F.size(F.array_intersect("x", "y"))
    return settle(beside(pairs, sets).where(5 * both >= 4 * (F.size("x") + F.size("y") - both)).select(
        F.greatest("hi", "lo").alias("hi"), F.least("hi", "lo").alias("lo")), "linked")


def apart(pairs: DataFrame, linked: DataFrame) -> DataFrame:
    """The pairs whose texts the links do not join."""
    roots = components(linked)
    named = pairs.join(roots.select(F.col("node").alias("hi"), F.col("root").alias("high_root")), "hi", "left").join(
        roots.select(F.col("node").alias("lo"), F.col("root").alias("low_root")), "lo", "left")
    return settle(named.where(F.coalesce("high_root", "hi") != F.coalesce("low_root", "lo")).select("hi", "lo"), "apart")


def fingerprint_pairs(classes: DataFrame) -> DataFrame:
    """Pairs (hi, lo) of keys: each text with the first of its fingerprint, and with the first of the fingerprint that its own is
    joined to by links of the SimHash operator."""
    prints = classes.select("key", F.element_at("bands", 2).alias("fp"))
    firsts = settle(prints.groupBy("fp").agg(F.min("key").alias("lo")), "fingerprints")
    forest = components(fingerprint_links(firsts.select("fp")))
    joined = settle(forest.join(firsts.withColumnRenamed("fp", "root"), "root").select(F.col("node").alias("fp"), "lo"), "joined")
    pairs = prints.join(firsts.union(joined), "fp").where("key <> lo")
    return settle(pairs.select(F.col("key").alias("hi"), "lo").distinct(), "print_pairs")


def needed(x, y):
    """Shingles that sets of these sizes share at least at a similarity of 0.8."""
    return F.floor((4 * (x + y) + 8) / 9)


def sharing(rows: DataFrame, behind) -> DataFrame:
    """Pairs (hi, lo) of keys that have an element in common, under the same lead and from different roots; from (lead, key, root, size,
    common, elements, least). At one of these elements both need as many from there on, in the order of ascending counts, as
    `behind` says for two rows; `least` is the fewest that it can say for a row."""
    able = rows.where(F.size("elements") >= F.col("least"))
    each = settle(able.select("lead", "key", "root", "size", "common", "lead_size", "least", F.size("elements").alias("length"),
                              F.explode("elements").alias("element")), "elements")
    at = ["lead", "element"]
    counts = settle(each.groupBy(*at).agg(F.count("*").alias("n"), (F.min("root") < F.max("root")).alias("mixed")).where("n > 1"), "counts")
    counted = attach_by_key(each, counts, at, "n", each.count())
    place = F.row_number().over(Window.partitionBy("lead", "key").orderBy(F.coalesce("n", F.lit(1)), "element"))
    placed = counted.withColumn("left", F.col("length") - place + 1)
    one = settle(placed.where("mixed and left >= least").select(*at, "lead_size", "key", "root", "size", "common", "left"), "placed")
    two = one.select(*at, *[F.col(c).alias(f"{c}_2") for c in ("key", "root", "size", "common", "left")])
    pairs = one.join(two, at).where("key > key_2 and root <> root_2").where(alike(F.col("size"), F.col("size_2"))).where(behind)
    return pairs.select(F.col("key").alias("hi"), F.col("key_2").alias("lo"))


def met_leads(members: DataFrame, sets: DataFrame) -> DataFrame:
    """What each text hi of (hi, lo, root) has in common with its lead lo, has beyond it and lacks, by the sets (key, value)."""
    met = beside(members, sets, "root").select(
        F.col("lo").alias("lead"), F.col("hi").alias("key"), "root", F.size("x").alias("size"), F.size("y").alias("lead_size"),
        F.array_except("x", "y").alias("outside"), F.array_except("y", "x").alias("missing"))
    return settle(met.withColumn("common", F.col("size") - F.size("outside")), "met_leads")


def meeting(met: DataFrame) -> DataFrame:
    """Pairs (hi, lo) of texts with the same lead that can have a similarity of 0.8, of different components `root`. Each text must
    have been compared with its lead, or be in one component with it."""
    wanted, both = needed(F.col("size"), F.col("size_2")), F.least("common", "common_2")
    left = F.least("left", "left_2")
    # too little within the lead: the rest lies outside
    outer = met.withColumn("elements", F.col("outside")).withColumn(
        "least", F.greatest(F.lit(1), F.ceil(4 * F.col("size") / 5) - F.col("common")))
    beyond = sharing(outer, (wanted > both) & (left >= wanted - both))
    # enough within the lead: of the shingles in which each differs from it, so many are the same
    inner = met.where("5 * common >= 4 * size").withColumn("elements", F.concat("outside", "missing")).withColumn(
        "least", F.greatest(F.lit(1), needed(F.col("size"), F.col("lead_size")) - F.col("common")))
    within = sharing(inner, (wanted <= both) & (left >= wanted - F.col("common") - F.col("common_2") + F.col("lead_size")))
    return beyond.union(within).distinct()


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, component (the smallest id reachable over links, its own included)."""
    need(docs, id_col, text_col)
    spark = docs.sparkSession
    bounded_batches(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    keyed = settle(mapped(texts, described, "bands"), "keyed")
    classes = settle(keyed.groupBy("key").agg(F.min("id").alias("first"), F.first("bands").alias("bands")), "classes")
    linked = similar(fingerprint_pairs(classes), classes, texts)
    at = classes.select("key", F.element_at("bands", 1).alias("n_shingles"),
                        F.explode(F.slice("bands", 3, BANDS)).alias("band"))
    total = classes.count() * BANDS
    # no band is gathered in a task: its smallest key and its size are combined before they are shuffled, and joined
    shared = settle(at.groupBy("band").agg(F.count("*").alias("n")).where("n > 1"), "shared")
    at = settle(attach_by_key(at, shared, "band", "n", total).where("n is not null").select(
        "band", "key", "n_shingles", "n"), "at")
    at = settle(at.join(at.groupBy("key").agg(F.sum("n").alias("met")), "key"), "met")
    leads = settle(at.groupBy("band").agg(F.max(F.struct("met", "key", "n_shingles")).alias("lead"), F.first("n").alias("n")), "leads")
    at = settle(attach_by_key(at.drop("n"), leads, "band", "n", total).select("band", "key", "n_shingles", "lead"), "at")
    stars = at.where(F.col("key") != F.col("lead.key")).where(alike(F.col("n_shingles"), F.col("lead.n_shingles")))
    stars = settle(stars.groupBy(F.col("key").alias("hi"), F.col("lead.key").alias("lo"), "lead.met").count(), "stars")
    best = settle(stars.groupBy("hi").agg(F.max_by("lo", F.struct("count", "met", "lo")).alias("lo")), "best")
    linked = settle(linked.union(similar(apart(best, linked), classes, texts)), "linked")
    others = apart(stars.join(best, ["hi", "lo"], "left_anti").select("hi", "lo"), linked)
    linked = settle(linked.union(similar(others, classes, texts)), "linked")

    roots = components(linked).withColumnRenamed("node", "key")
    rooted = at.select("band", "key", "lead").join(roots, "key", "left").select(
        "band", "key", "lead", F.coalesce("root", "key").alias("root"))
    rooted = settle(rooted, "band_roots")
    unlike = settle(rooted.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("top"), F.count("*").alias("n")).where(
        "low < top").select("band", "n"), "unlike")
    mixed = attach_by_key(rooted, unlike, "band", "n", total).where("n is not null")
    members = settle(mixed.where(F.col("key") != F.col("lead.key")).select(
        F.col("key").alias("hi"), F.col("lead.key").alias("lo"), "root").distinct(), "members")
    rest = meeting(met_leads(members, sets_of(members, classes, texts)))
    seen = stars.select(F.greatest("hi", "lo").alias("hi"), F.least("hi", "lo").alias("lo"))
    rest = settle(rest.join(seen, ["hi", "lo"], "left_anti"), "rest")
    forest = components(linked.union(similar(rest, classes, texts)))

    rooted = settle(classes.join(forest.withColumnRenamed("node", "key"), "key", "left").select(
        "key", "first", F.coalesce("root", "key").alias("root")), "rooted")
    smallest = settle(rooted.groupBy("root").agg(F.min("first").alias("component")), "smallest")
    named = rooted.join(smallest, "root").select("key", "component")
    return keyed.select("id", "key").join(named, "key").select(F.col("id").alias(id_col), "component")
