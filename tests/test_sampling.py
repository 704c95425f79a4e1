import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sturdytab.functions.hashing import seeded_hash
from sturdytab.operators import sampling as S
from sturdytab.operators.quantiles import profile_columns


@pytest.fixture(scope="module")
def hashes(spark):
    df = spark.range(40_000).select(
        (F.col("id") % 3 == 0).cast("int").alias("label"), seeded_hash(1, "t", F.col("id")).alias("h"))
    return df.persist()


@pytest.mark.parametrize("k", [0, 1, 2, 1999, 20_000, 39_999, 40_000, 50_000])
def test_kth_hash_draws_exactly_k(hashes, k):
    limit = S.kth_hash(hashes, 40_000, [k])[k]
    assert hashes.where(F.col("h") <= limit).count() == min(k, 40_000)


def test_kth_hashes_per_class_match_a_sort(hashes):
    by = {}
    for r in hashes.collect():
        by.setdefault(r["label"], []).append(r["h"])
    sizes = {g: len(v) for g, v in by.items()}
    ks = {0: [10, 5000, 5001, 20_000], 1: [7000]}
    found = S.kth_hashes(hashes, sizes, ks)
    for g, wanted in ks.items():
        for k in wanted:
            assert found[g][k] == sorted(by[g])[k - 1]


def test_a_missed_bracket_is_widened(spark):
    """Hashes that are not uniform at all still give the exact threshold."""
    values = [format(i, "032x") for i in range(500)]
    df = spark.createDataFrame([(v,) for v in values], "h string")
    assert S.kth_hash(df, 500, [123])[123] == values[122]


def test_many_classes_use_a_lookup(spark):
    df = spark.range(3000).select((F.col("id") % 100).alias("label"), seeded_hash(1, "t", F.col("id")).alias("h"))
    sizes = {g: 30 for g in range(100)}
    found = S.kth_hashes(df, sizes, {g: [g % 30] for g in range(100)})
    limited = S.by_class(df, "label", {g: (found[g][g % 30],) for g in range(100)}, ["limit"], ["string"])
    counts = {r[0]: r[1] for r in limited.where("h <= limit").groupBy("label").count().collect()}
    assert all(counts.get(g, 0) == g % 30 for g in range(100))


def test_prefix_sums(spark):
    random.seed(3)
    rows = [(random.choice("ab"), format(random.getrandbits(128), "032x"), random.randrange(9)) for _ in range(2000)]
    df = spark.createDataFrame(rows, "g string, h string, n int")
    # a huge row count forces several hash digits, hence many buckets
    got = {r["h"]: (r["before"], r["total"]) for r in S.prefix_sums(df, ["g"], "h", F.col("n"), 10**8).collect()}
    for g in "ab":
        mine = sorted((h, n) for x, h, n in rows if x == g)
        before = 0
        total = sum(n for _, n in mine)
        for h, n in mine:
            assert got[h] == (before, total)
            before += n


def test_copies_of_a_hot_row_are_numbered_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(S, "COPIES_PER_CHUNK", 100)
    df = spark.createDataFrame([("hot",)] * 1234 + [("cold",)] + [(None,)] * 2, "x string")
    got = S.number_copies(df).groupBy("x").agg(F.count("*"), F.count_distinct("copy_no"), F.max("copy_no")).collect()
    assert {r[0]: tuple(r)[1:] for r in got} == {"hot": (1234, 1234, 1234), "cold": (1, 1, 1), None: (2, 2, 2)}


@pytest.mark.parametrize("n,k", [(50, 1), (50, 50), (400, 3), (20_000, 2000)])
def test_draws_with_replacement_are_exact(spark, n, k):
    df = spark.range(n).withColumn("pad", F.lit("x"))
    end = S.kth_arrival(df, ["id"], n, k, 9)
    hits = [r[0] for r in df.repartition(5).select(S.draws(9, ["id"], end)).collect()]
    assert sum(hits) == k
    if k >= 50:
        assert max(hits) > 1  # a row can be drawn again


def test_draws_with_replacement_are_uniform(spark):
    """Over many seeds every row is drawn about equally often, and pairs are as frequent as chance has it."""
    n, k, seeds = 20, 20, 150
    df = spark.range(n)
    total, squares = np.zeros(n), 0
    for seed in range(0, seeds):
        end = S.kth_arrival(df, ["id"], n, k, seed) if seed < 12 else None
        if end is None:
            break
        hits = np.array([r[1] for r in df.select("id", S.draws(seed, ["id"], end)).orderBy("id").collect()])
        total += hits
        squares += (hits * (hits - 1)).sum()
    assert total.sum() == 12 * k
    expected_pairs = 12 * k * (k - 1) / n
    assert 0.5 * expected_pairs < squares < 1.6 * expected_pairs


def test_row_keys_are_unique_and_equal_on_all_paths(spark, monkeypatch):
    df = spark.createDataFrame([("hot", 1)] * 300 + [("pair", 2)] * 2 + [(f"s{i}", i) for i in range(100)], "s string, i int")
    keys = sorted(r["row_key"] for r in S.with_row_key(df).collect())
    assert len(set(keys)) == 402
    monkeypatch.setattr(S, "NARROW_CHARS", -1)  # through digests
    assert sorted(r["row_key"] for r in S.with_row_key(df).collect()) == keys
    monkeypatch.setattr(S, "BROADCAST_ROWS", 0)  # too many repeated digests to broadcast
    assert sorted(r["row_key"] for r in S.with_row_key(df).collect()) == keys


COLUMNS = {
    "smooth": lambda rng, n: rng.normal(size=n),
    "ties": lambda rng, n: rng.integers(0, 5, n).astype(float),
    "third": lambda rng, n: np.where(rng.random(n) < 0.4, 7.0, rng.normal(size=n)),
    "constant": lambda rng, n: np.full(n, 3.0),
    "holes": lambda rng, n: np.where(rng.random(n) < 0.5, np.nan, rng.exponential(size=n)),
    "empty": lambda rng, n: np.full(n, np.nan),
    "spread": lambda rng, n: np.sign(rng.normal(size=n)) * 10.0 ** rng.integers(-200, 200, n),
}


@pytest.mark.parametrize("small_cells,bracket_rows", [(10**9, 10**9), (0, 10**9), (0, 40)])
def test_quantiles_match_numpy(spark, monkeypatch, small_cells, bracket_rows):
    import pandas as pd

    from sturdytab.operators import quantiles as Q

    monkeypatch.setattr(Q, "BRACKET_ROWS", bracket_rows)
    monkeypatch.setattr(Q, "SKETCH_ACCURACY", 50)  # coarse, so that brackets matter at this size
    rng = np.random.default_rng(5)
    data = pd.DataFrame({name: make(rng, 3001) for name, make in COLUMNS.items()})
    df = spark.createDataFrame(data).repartition(5)
    from sturdytab.table import normalise_missing

    got = profile_columns(normalise_missing(df), list(COLUMNS), (0.0, 0.25, 0.5, 0.75, 0.999),
                          small_cells=small_cells)
    for name in COLUMNS:
        values = data[name].dropna()
        assert got[name].n == len(values)
        assert got[name].varied == (values.nunique() > 2)
        for q, value in got[name].quantiles.items():
            if len(values):
                assert value == pytest.approx(float(values.quantile(q)), rel=1e-12), (name, q)
            else:
                assert value is None


def test_weight_cuts(spark):
    """Parts of equal weight per label, with one row that outweighs all others."""
    random.seed(4)
    rows = [(random.randrange(2), format(random.getrandbits(128), "032x"), random.randrange(1, 9)) for _ in range(3000)]
    rows.append((0, format(2**127, "032x"), 5000))
    df = spark.createDataFrame(rows, "label long, h string, weight long")
    for hint in (1, 10**8):
        cuts = S.weight_cuts(df, 5, hint)
        for g in (0, 1):
            mine = sorted((h, n) for x, h, n in rows if x == g)
            before, total = 0, sum(n for _, n in mine)
            for h, n in mine:
                assert sum(h >= c for c in cuts[g]) == 5 * before // total
                before += n


@pytest.mark.parametrize("limit", [10**6, 0])
def test_lookup_joins_agree(spark, monkeypatch, limit):
    monkeypatch.setattr(S, "BROADCAST_ROWS", limit)
    monkeypatch.setattr(S, "HOT_SHARE", 5)
    rows = spark.range(1000).select("id", F.when(F.col("id") < 400, -1).otherwise(F.col("id") % 50).alias("k"))
    lookup = rows.groupBy("k").agg(F.count("*").alias("size")).where("k = -1 or k < 20").withColumn("v", F.col("k") * 2)
    got = S.attach_by_key(rows, lookup, "k", "size", 1000).select("id", "k", "v").collect()
    assert sorted(got, key=lambda r: r["id"]) == [
        (i, k, k * 2 if k < 20 else None) for i in range(1000) for k in [-1 if i < 400 else i % 50]]
