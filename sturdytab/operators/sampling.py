"""Exact seeded sampling without a global sort.

The k rows with the smallest hashes are drawn. Hashes are uniform, so the k-th smallest is known up to
O(sqrt(n)) ranks in advance: one scan counts the hashes below that bracket (they collapse into one group
before the shuffle) and keeps only those inside, whose order gives the exact threshold. Drawing the rows is
then a row-local filter `hash <= threshold`, with no join and no shuffle of the table.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from sturdytab.functions.hashing import (
    EVERY_ROW, FIXED_WIDTH, MAX_CELLS, NO_ROW, hex_point, row_digest, seeded_hash,
)
from sturdytab.session import settle
from sturdytab.table import MAX_CLASSES

INLINE_CLASSES = 64
ROWS_PER_BUCKET = 1_000_000
COPIES_PER_CHUNK = 100_000
HOT_SHARE = 1_000
BROADCAST_ROWS = 200_000
NARROW_CHARS = 64


def by_class(df: DataFrame, label: str, values: dict, names: list[str], kinds: list[str]) -> DataFrame:
    """Add columns looked up by class: a CASE for few classes, else a broadcast of at most MAX_CLASSES rows."""
    if len(values) <= INLINE_CLASSES:
        out = []
        for i, (name, kind) in enumerate(zip(names, kinds)):
            c = F.lit(None).cast(kind)
            for key, row in values.items():
                c = F.when(F.col(f"`{label}`").eqNullSafe(F.lit(key)), F.lit(row[i]).cast(kind)).otherwise(c)
            out.append(c.alias(name))
        return df.select("*", *out)
    if len(values) > MAX_CLASSES:
        raise ValueError(f"more than {MAX_CLASSES} classes")
    kind = df.schema[label].dataType.simpleString()
    schema = ", ".join([f"by_label {kind}"] + [f"{n} {k}" for n, k in zip(names, kinds)])
    lookup = df.sparkSession.createDataFrame([(k, *row) for k, row in values.items()], schema)
    hit = F.col(f"`{label}`").eqNullSafe(F.col("by_label"))
    return df.join(F.broadcast(lookup), hit, "left").drop("by_label")


def _brackets(n: int, ks: list[int], spread: float) -> list[tuple[str, str]]:
    """Disjoint hash ranges that should hold the k-th smallest of n hashes for each k."""
    spans = []
    for k in sorted(ks):
        share = k / n
        half = (spread * math.sqrt(n * share * (1 - share)) + 8 * spread) / n
        low, high = max(0.0, share - half), min(1.0, share + half)
        if spans and low <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], high)
        else:
            spans.append([low, high])
    return [(hex_point(low), hex_point(high)) for low, high in spans]


def kth_hashes(hashes: DataFrame, sizes: dict, quotas: dict) -> dict:
    """Thresholds for a frame (label, h): {label: n}, {label: [k, ...]} -> {label: {k: k-th smallest h}}.

    k <= 0 gives a threshold no hash passes, k >= n one that all pass. Equal hashes at a threshold would draw more
    than k rows: they mean that rows share a key, and are an error.
    """
    found = {label: {} for label in quotas}
    open_ks = {}
    for label, ks in quotas.items():
        for k in ks:
            if k <= 0:
                found[label][k] = NO_ROW
            elif k >= sizes.get(label, 0):
                found[label][k] = EVERY_ROW
            else:
                open_ks.setdefault(label, set()).add(k)
    spread = 8.0
    while open_ks:
        hits = _kth_round(hashes, sizes, {g: sorted(ks) for g, ks in open_ks.items()}, spread)
        for label, got in hits.items():
            found[label].update(got)
            open_ks[label] -= set(got)
        open_ks = {g: ks for g, ks in open_ks.items() if ks}
        spread *= 16  # a bracket that missed is widened until it covers everything
    return found


def _kth_round(hashes, sizes, quotas, spread):
    spans = {g: _brackets(sizes[g], ks, spread) for g, ks in quotas.items()}
    width = max(len(s) for s in spans.values())
    bounds = {g: [x for span in s for x in span] + ["h", "h"] * (width - len(s)) for g, s in spans.items()}
    names = [f"{side}{i}" for i in range(width) for side in ("lo", "hi")]
    placed = by_class(hashes, "label", bounds, names, ["string"] * len(names))
    # slot 2i: between brackets, only counted; slot 2i+1: inside bracket i, kept; beyond the last: dropped
    slot = F.lit(None).cast("int")
    for i in reversed(range(width)):
        slot = (
            F.when((F.col("h") < F.col(f"lo{i}")) & (F.col(f"lo{i}") != "h"), F.lit(2 * i))
            .when((F.col("h") <= F.col(f"hi{i}")) & (F.col(f"lo{i}") <= F.col("h")), F.lit(2 * i + 1))
            .otherwise(slot)
        )
    counted = (
        placed.select("label", slot.alias("slot"), "h")
        .where(F.col("slot").isNotNull())
        .groupBy("label", "slot", F.when(F.col("slot") % 2 == 1, F.col("h")).alias("h"))
        .agg(F.count("*").alias("n"))
    )
    # O(sqrt(n)) rows per class: only bracket contents and one counted row per gap
    upto = Window.partitionBy("label").orderBy("slot", "h").rowsBetween(Window.unboundedPreceding, 0)
    running = counted.select("label", "slot", "h", F.sum("n").over(upto).alias("upto"))
    most = max(len(ks) for ks in quotas.values())
    wanted = {g: list(ks) + [None] * (most - len(ks)) for g, ks in quotas.items()}
    running = by_class(running, "label", wanted, [f"k{i}" for i in range(most)], ["bigint"] * most)
    picked = running.groupBy("label").agg(
        *[F.min(F.when(F.col("upto") >= F.col(f"k{i}"), F.struct("slot", "h", "upto"))).alias(f"at{i}")
          for i in range(most)]
    )
    out = {}
    for row in picked.collect():  # one row per class
        got = {}
        for i, k in enumerate(wanted[row["label"]]):
            at = row[f"at{i}"]
            if k is not None and at is not None and at["slot"] % 2 == 1:
                if at["upto"] != k:
                    raise ValueError("keys are not unique: rows at the threshold have the same hash")
                got[k] = at["h"]
        out[row["label"]] = got
    return out


def kth_hash(hashes: DataFrame, n: int, ks: list[int]) -> dict[int, str]:
    """Ungrouped form: a frame (h) of n hashes -> {k: k-th smallest h}."""
    return kth_hashes(hashes.select(F.lit(0).alias("label"), "h"), {0: n}, {0: list(ks)})[0]


def prefix_sums(df: DataFrame, groups: list[str], h: str, weight: Column, rows: int) -> DataFrame:
    """Add `before`, the sum of `weight` over rows of the same groups with a smaller hash, and `total`, over all.

    Sums per hash bucket give the offsets, a window inside each bucket the rest, so no window holds more
    than about ROWS_PER_BUCKET rows however few groups there are. Group columns must not be NULL.
    """
    digits = max(1, math.ceil(math.log(max(rows, 1) / ROWS_PER_BUCKET + 1, 16)))
    keyed = df.withColumn("bucket", F.substring(F.col(h), 1, digits)).withColumn("w", weight.cast("bigint"))
    whole = Window.partitionBy(*(groups or [F.lit(0)]))
    ahead = whole.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        keyed.groupBy(*groups, "bucket").agg(F.sum("w").alias("w"))
        .select(
            *groups, "bucket", F.coalesce(F.sum("w").over(ahead), F.lit(0)).alias("offset"),
            F.sum("w").over(whole).alias("total"),
        )
    )
    inside = Window.partitionBy(*groups, "bucket").orderBy(h).rowsBetween(Window.unboundedPreceding, -1)
    return (
        keyed.join(offsets, [*groups, "bucket"])
        .withColumn("before", F.col("offset") + F.coalesce(F.sum("w").over(inside), F.lit(0)))
        .drop("bucket", "offset", "w")
    )


def is_hot(size: str, total: int) -> Column:
    """Keys that own more than 1 / HOT_SHARE of the rows; there are fewer than HOT_SHARE of them."""
    return F.col(size) * HOT_SHARE > total


def attach_by_key(rows: DataFrame, lookup: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """Left join of a lookup with one row per key, which must hold every hot key.

    A lookup of at most BROADCAST_ROWS rows is broadcast. Beyond that only its hot part is, which is below
    HOT_SHARE rows, and just the rows of other keys are shuffled, so no task gets a hot key.
    """
    if lookup.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(lookup), key, "left")
    hot = lookup.where(is_hot(size, total))
    hot_rows = rows.join(F.broadcast(hot), key)
    cold_rows = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(
        lookup.where(~is_hot(size, total)), key, "left")
    return hot_rows.unionByName(cold_rows)


def weight_cuts(df: DataFrame, parts: int, rows: int) -> dict:
    """Cut rows (label, h, weight) of each label into parts of equal weight in hash order.

    Returns {label: [first hash of part 1, part 2, ...]}: a row belongs to part p when exactly p of them are <= h.
    Sums per hash bucket tell which bucket a cut lies in; only rows of those buckets are ordered.
    """
    digits = max(1, math.ceil(math.log(max(rows, 1) / ROWS_PER_BUCKET + 1, 16)))
    keyed = df.select("label", "h", "weight", F.substring("h", 1, digits).alias("bucket"))
    whole = Window.partitionBy("label")
    ahead = whole.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = keyed.groupBy("label", "bucket").agg(F.sum("weight").alias("w")).select(
        "label", "bucket", F.coalesce(F.sum("w").over(ahead), F.lit(0)).alias("offset"),
        F.sum("w").over(whole).alias("total"))
    cuts = range(1, parts)

    def reached(before, p):
        return before * parts >= F.col("total") * p

    # the last bucket that starts before the cut
    at = sums.groupBy("label").agg(F.first("total").alias("total"), *[
        F.max(F.when(~reached(F.col("offset"), p), F.struct("bucket", "offset"))).alias(f"at{p}") for p in cuts])
    found = {r["label"]: r for r in at.collect()}  # one row per label
    if len(found) > MAX_CLASSES:
        raise ValueError(f"more than {MAX_CLASSES} labels")
    names = ["total"] + [f"{n}{p}" for p in cuts for n in ("bucket", "offset")]
    kinds = ["bigint"] + ["string", "bigint"] * (parts - 1)
    values = {g: [r["total"], *[r[f"at{p}"][n] for p in cuts for n in ("bucket", "offset")]] for g, r in found.items()}
    near = by_class(keyed, "label", values, names, kinds)
    near = near.where(F.col("bucket").isin(*[F.col(f"bucket{p}") for p in cuts]))
    inside = Window.partitionBy("label", "bucket").orderBy("h").rowsBetween(Window.unboundedPreceding, -1)
    near = near.withColumn("sofar", F.coalesce(F.sum("weight").over(inside), F.lit(0)))
    first = near.groupBy("label").agg(*[
        F.min(F.when((F.col("bucket") == F.col(f"bucket{p}")) & reached(F.col(f"offset{p}") + F.col("sofar"), p),
                     F.col("h"))).alias(f"h{p}") for p in cuts])
    hits = {r["label"]: r for r in first.collect()}
    # no row of the bucket reaches the cut: the part starts right behind the bucket
    return {g: [hits[g][f"h{p}"] or r[f"at{p}"]["bucket"] + EVERY_ROW for p in cuts] for g, r in found.items()}


def shuffled(df: DataFrame, keys: list[str], seed: int) -> DataFrame:
    """Rows in a seeded random order. Only for output: no operator here depends on row order."""
    return df.orderBy(seeded_hash(seed, "shuffle", *[F.col(f"`{k}`") for k in keys]))


def number_copies(df: DataFrame, ordinal: str = "copy_no") -> DataFrame:
    """Number the copies of identical rows from 1.

    Copies are counted first and expanded again in chunks spread over the cluster, so a row that makes up a
    third of the table never sits in one task.
    """
    columns = [F.col(f"`{c}`") for c in df.columns]
    counted = df.groupBy(*columns).agg(F.count("*").alias("copies"))
    last_chunk = F.floor((F.col("copies") - 1) / COPIES_PER_CHUNK)
    chunks = counted.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), last_chunk)))
    spread = chunks.repartition(*columns, F.col("chunk"))
    first = F.col("chunk") * COPIES_PER_CHUNK + 1
    last = F.least(F.col("copies"), (F.col("chunk") + 1) * COPIES_PER_CHUNK)
    return spread.withColumn(ordinal, F.explode(F.sequence(first, last))).drop("copies", "chunk")


def _is_narrow(df: DataFrame) -> bool:
    """Few cells and, on average, little text: one scan of the text columns."""
    texts = [f for f in df.schema if not isinstance(f.dataType, FIXED_WIDTH)]
    if len(df.columns) > MAX_CELLS or any(not isinstance(f.dataType, T.StringType) for f in texts):
        return False
    if not texts:
        return True
    chars = sum((F.coalesce(F.length(f"`{f.name}`"), F.lit(0)) for f in texts), F.lit(0))
    return (df.agg(F.avg(chars)).first()[0] or 0) <= NARROW_CHARS


def with_row_key(df: DataFrame, name: str = "row_key") -> DataFrame:
    """A unique key for a table that has none: digest of the row plus its copy number.

    Narrow rows are counted and numbered as they are. Of wide rows only digests are shuffled to find the repeated
    ones; rows without a copy then get their key on the spot, and only the repeated rows are numbered.
    """
    marked = df.withColumn("digest_", row_digest(df, df.columns))
    columns = [F.col(f"`{c}`") for c in df.columns]

    def key(copy_no: Column) -> Column:
        return F.md5(F.concat_ws("|", F.lower(F.hex("digest_")), copy_no.cast("string"))).alias(name)

    if _is_narrow(df):
        return number_copies(marked).select(*columns, key(F.col("copy_no")))
    repeated = settle(
        marked.groupBy("digest_").agg(F.count("*").alias("n")).where("n > 1").select("digest_"), "repeated")
    if repeated.count() > BROADCAST_ROWS:
        return number_copies(marked).select(*columns, key(F.col("copy_no")))
    single = marked.join(F.broadcast(repeated), "digest_", "left_anti").select(*columns, key(F.lit(1)))
    copies = number_copies(marked.join(F.broadcast(repeated), "digest_", "left_semi"))
    return single.unionByName(copies.select(*columns, key(F.col("copy_no"))))


# ---- drawing with replacement -------------------------------------------------------------------

NO_CHANCE = 1e-40


def most_arrivals(until: float) -> int:
    """A number of arrivals that one row in 10^40 reaches by then."""
    most, chance = 1, until
    while chance > NO_CHANCE:
        most += 1
        chance *= until / most
    return most


def _gap(seed: int, step: Column, keys: list[Column]) -> Column:
    """An exponential waiting time from a hash."""
    whole = F.conv(F.substring(seeded_hash(seed, "arrival", step, *keys), 1, 15), 16, 10).cast("bigint")
    return -F.log((whole + F.lit(0.5)) / F.lit(float(1 << 60)))


def arrivals(seed: int, keys: list[Column], until: float) -> Column:
    """The arrival times of a row's own seeded Poisson process, up to `until`, as an array.

    Merged over all rows, each next arrival falls on any row with equal chance, whatever came before: the
    first k arrivals are k draws with replacement. A row needs no other row to know its times, and most rows
    hash only once. The search stops at a number of arrivals no row has in practice; one that did would be an
    error, not a loss.
    """
    first = _gap(seed, F.lit(1), keys)
    steps = F.sequence(F.lit(2), F.lit(most_arrivals(until) + 2))
    until = F.lit(float(until))

    def step(state, at):
        last = F.element_at(state, -1)
        later = F.concat(state, F.array(last + _gap(seed, at, keys)))
        return F.when(last > until, state).otherwise(later)

    times = F.aggregate(steps, F.array(first), step)
    checked = F.when(F.element_at(times, -1) > until, times).otherwise(
        F.raise_error(F.lit("more arrivals than expected: draw fewer rows at once")).cast("array<double>"))
    return F.when(first > until, F.array().cast("array<double>")).otherwise(
        F.filter(checked, lambda t: t <= until))


def kth_arrival(df: DataFrame, keys: list[str], n: int, k: int, seed: int) -> float:
    """Time of the k-th arrival over all n rows, from one scan: arrivals before the bracket are only counted."""
    columns = [F.col(f"`{c}`") for c in keys]
    spread = 8.0
    while True:
        half = spread * (math.sqrt(k) + 8) / n
        low, high = max(0.0, k / n - half), k / n + half
        times = df.select(F.explode(arrivals(seed, columns, high)).alias("t"))
        counted = times.groupBy(F.when(F.col("t") >= low, F.col("t")).alias("t")).agg(F.count("*").alias("n"))
        upto = Window.partitionBy(F.lit(0)).orderBy(F.asc_nulls_first("t")).rowsBetween(Window.unboundedPreceding, 0)
        at = counted.select("t", F.sum("n").over(upto).alias("upto")).agg(
            F.min("upto").alias("least"), F.max("upto").alias("most"),
            F.min(F.when(F.col("upto") >= k, F.col("t"))).alias("t"),
            F.max(F.when(F.col("t").isNull(), F.col("upto"))).alias("below"),
        ).first()
        if at["t"] is not None and (at["below"] or 0) < k:
            return at["t"]
        spread *= 4


def draws(seed: int, keys: list[str], until: float) -> Column:
    """How often a row is drawn when the draws end at time `until`."""
    return F.size(arrivals(seed, [F.col(f"`{c}`") for c in keys], until))
