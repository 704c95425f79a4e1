"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

Words are `[^\\x20\\x09-\\x0D]+` of the lower-cased text, shingles five consecutive words (fewer words: the whole
sequence; none: no shingle). A document holds an item if at least 0.8 of the item's distinct shingles occur in it.

Search. Items are partitioned by size, the power of two of their distinct shingles q. An item may miss at most
m = q - ceil(0.8 q) shingles, so of any m + 1 of them a document that holds the item has at least one. The item's
MinHash signature is the m + 1 smallest hashes of its shingles. A partition's bound is the largest hash in its
signatures: documents sketch themselves with their hashes up to the largest bound of the partitions that fit into them
and meet the signatures on equal hashes. So no pair is missed, however long the document; equal hashes of different
shingles only cost a check. Every pair found is then counted exactly on the shingles themselves.

Classical MinHash bands on whole documents would miss short items in long documents, as their Jaccard similarity
falls with the document's length; containment keeps the item's own size in the bound instead.

All work is DataFrame expressions. Signatures are broadcast while they are at most `BROADCAST_HASHES` rows, and joined
by shuffle beyond. Only texts that pass a filter of the ids found are shuffled to be counted. A null or empty text has no shingle and holds nothing; an item without words is in no document.
Rows with a null id take part, a null id counting as one id. Rows that share ids are judged alone and the largest
containment of each pair of ids is returned. Empty tables give an empty result. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sturdytab.llm.common import maybe_among, need
from sturdytab.session import settle

WIDTH = 5
CONTAINMENT = 0.8
BROADCAST_HASHES = 100_000


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def places(words: Column, width: int) -> Column:
    """Starts of the shingles, from 0; one if there are fewer words, none without words."""
    return F.when(F.size(words) > 0, F.sequence(F.lit(0), F.greatest(F.size(words) - width, F.lit(0)))).otherwise(
        F.array().cast("array<int>"))


def shingle_hashes(words: Column, width: int) -> Column:
    return F.transform(places(words, width), lambda i: F.xxhash64(*(F.get(words, i + j) for j in range(width))))


def shingles(words: Column, width: int) -> Column:
    return F.array_distinct(F.transform(places(words, width), lambda i: F.array_join(F.slice(words, i + 1, width), " ")))


def signatures(items: DataFrame, width: int, containment: float) -> DataFrame:
    """Each distinct item with its shingles, the number it needs, its size partition and its MinHash signature."""
    worded = items.withColumn("words", words_of(F.col("text")))
    sized = worded.withColumns({"shingles": shingles(F.col("words"), width),
                                "hashes": F.array_sort(F.array_distinct(shingle_hashes(F.col("words"), width)))})
    sized = sized.where(F.size("shingles") > 0).withColumn("n_shingles", F.size("shingles"))
    needed = F.ceil(F.col("n_shingles") * F.lit(containment) - 1e-9).cast("int")
    return sized.withColumns({
        "needed": needed,
        "part": F.floor(F.log2("n_shingles")).cast("int"),
        "signature": F.slice("hashes", 1, F.col("n_shingles") - needed + 1),
    }).select("item", "n_shingles", "needed", "part", "shingles", "signature")


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 item_col: str = "item_id", item_text_col: str = "text", width: int = WIDTH,
                 containment: float = CONTAINMENT) -> DataFrame:
    """(id, item, n_shingles, n_shared, containment) of every document that holds an item."""
    need(docs, id_col, text_col)
    need(items, item_col, item_text_col)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    signed = settle(signatures(items.select(F.col(item_col).alias("item"), F.col(item_text_col).alias("text"))
                               .distinct(), width, containment), "signatures")
    signed = signed.withColumn("item_key", F.xxhash64(F.col("item"), F.array_join("shingles", "\n")))
    minima = signed.select("item_key", "needed", "part", F.explode("signature").alias("hash"))
    bounds = signed.select("part", "needed", F.element_at("signature", -1).alias("top")).groupBy("part").agg(
        F.min("needed").alias("least"), F.max("top").alias("top"), F.sum("needed").alias("n")).collect()
    # one row a power of two of item sizes: at most 31
    small = sum(b["n"] for b in bounds) <= BROADCAST_HASHES

    sketched = texts.withColumn("words", words_of(F.col("text")))
    room = F.greatest(F.size("words") - width + 1, F.lit(1))
    bound = F.greatest(F.lit(-(2**63)), *(F.when(room >= b["least"], F.lit(b["top"])) for b in bounds)) \
        if bounds else F.lit(-(2**63))
    sketched = sketched.select("id", room.alias("room"), bound.alias("bound"),
                               shingle_hashes(F.col("words"), width).alias("hashes"))
    # no words beside the rows; explode_outer, as explode's inferred filter would compute the hashes from the text again
    met = sketched.select("id", "room", "bound", F.explode_outer("hashes").alias("hash"))
    met = met.where("hash <= bound").select("id", "room", "hash")
    pairs = met.join(F.broadcast(minima) if small else minima, "hash").where("room >= needed")
    pairs = settle(pairs.groupBy("id", "item_key").agg(F.lit(1).alias("one")).select("id", "item_key"), "pairs")

    wanted = signed.select("item_key", "item", "n_shingles", "needed", F.col("shingles").alias("item_shingles"))
    found = pairs.withColumnRenamed("id", "pair_id").join(F.broadcast(wanted) if small else wanted, "item_key")
    asked = maybe_among(texts, pairs, "id").where("maybe").select("id", "text")
    checked = asked.join(found, F.col("id").eqNullSafe(F.col("pair_id"))).withColumn("words", words_of(F.col("text")))
    shared = F.size(F.array_intersect(shingles(F.col("words"), width), F.col("item_shingles")))
    checked = checked.select("id", "item", "n_shingles", "needed", shared.alias("n_shared"))
    best = checked.groupBy("id", "item").agg(
        F.max(F.struct((F.col("n_shared") / F.col("n_shingles")).alias("containment"), "n_shingles", "n_shared", "needed"))
        .alias("b"))
    return best.where("b.n_shared >= b.needed").select(F.col("id").alias(id_col), F.col("item").alias(item_col), "b.n_shingles", "b.n_shared",
                       "b.containment")
