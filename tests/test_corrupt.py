import pytest
from pyspark.sql import functions as F

from sturdytab import LabelledTable
from sturdytab.functions.scalars import floor_count, half_even_count
from sturdytab.operators import corrupt as C


@pytest.fixture(scope="module")
def table(spark):
    df = spark.range(1200).select(
        "id", (F.col("id") % 97).cast("int").alias("i"), (F.col("id") * 0.37 % 11).alias("d"),
        F.concat(F.lit("t"), F.col("id") % 5).alias("s"),
        F.when(F.col("id") % 10 < 6, "a").when(F.col("id") % 10 < 9, "b").otherwise("c").alias("y"))
    return LabelledTable(df, "y", ("id",), "made")


@pytest.mark.parametrize("n,rate,floor,even", [(33, 0.05, 1, 2), (25, 0.10, 2, 2), (35, 0.10, 3, 4), (100, 0.29, 28, 29)])
def test_counts(n, rate, floor, even):
    assert (floor_count(n, rate), half_even_count(n, rate)) == (floor, even)


@pytest.mark.parametrize("rate", [0, 0.05, 0.1, 0.2, 1])
def test_missing_counts(table, rate):
    r = C.corruption_check(table, C.inject_missing(table, rate)).first()
    assert r["cells_nulled"] == int(3600 * rate) == r["cells_changed"]
    assert r["labels_changed"] == r["removed_rows"] == r["added_rows"] == 0


def test_severities_are_nested_and_equal_to_single_runs(table):
    levels = C.inject_missing(table, [0.05, 0.1, 0.2]).df.persist()
    null = {s: {(r["id"], c) for r in levels.where(F.col("severity") == s).collect() for c in ("i", "d", "s")
                if r[c] is None} for s in (0.05, 0.1, 0.2)}
    assert null[0.05] < null[0.1] < null[0.2]
    single = C.inject_missing(table, 0.1).df.collect()
    assert null[0.1] == {(r["id"], c) for r in single for c in ("i", "d", "s") if r[c] is None}


def test_results_do_not_depend_on_partitions(spark, table):
    moved = table.with_df(table.df.repartition(7, "s"))
    for make in (lambda t: C.inject_missing(t, 0.1), lambda t: C.inject_duplicates(t, 0.1),
                 lambda t: C.inject_label_noise(t, 0.1), lambda t: C.inject_outliers(t, 0.1),
                 lambda t: C.inject_imbalance(t, 5)):
        one, two = (sorted(make(t).df.collect(), key=str) for t in (table, moved))
        assert one == two


def test_duplicates(table):
    for preset, seed in ((C.LIBRARY, 1), (C.EXPERIMENT, 2)):
        out = C.inject_duplicates(table, 0.1, seed, preset)
        assert out.df.count() == out.known_rows == 1320
        assert out.df.select(*out.keys).distinct().count() == 1320
        per_row = out.df.groupBy("id").count().agg(F.max("count")).first()[0]
        assert per_row >= 2 if preset.replacement else per_row == 2


def test_label_noise(table):
    out = C.inject_label_noise(table, 0.1)
    r = C.corruption_check(table, out).first()
    assert (r["labels_changed"], r["cells_changed"]) == (120, 0)


def test_label_noise_on_null_labels_and_few_classes(spark):
    df = spark.createDataFrame([(i, ["p", "n", None][i % 3]) for i in range(30)], "id int, y string")
    out = C.inject_label_noise(LabelledTable(df, "y", ("id",)), 1.0).df
    pairs = {(r[0], r[1]) for r in df.join(out.withColumnRenamed("y", "new"), "id").select("y", "new").collect()}
    assert pairs <= {("p", "n"), ("n", "p"), (None, "p"), (None, "n")} and len(pairs) >= 3
    one = LabelledTable(df.withColumn("y", F.lit("p")), "y", ("id",))
    with pytest.raises(ValueError):
        C.inject_label_noise(one, 0.5)
    assert C.inject_label_noise(one, 0.5, preset=C.PROBE) is one


def test_label_noise_with_many_classes_takes_the_lookup_path(spark, monkeypatch, table):
    usual = sorted(C.inject_label_noise(table, 0.5).df.collect())
    monkeypatch.setattr(C, "INLINE_LABELS", 1)
    assert sorted(C.inject_label_noise(table, 0.5).df.select(*table.df.columns).collect()) == usual


def test_outliers(table):
    for preset in (C.LIBRARY, C.EXPERIMENT):
        out = C.inject_outliers(table, 0.1, 3, preset)
        r = C.corruption_check(table, out).first()
        assert (r["rows_changed"], r["cells_changed"], r["labels_changed"]) == (120, 120, 0)
        assert [f.dataType for f in out.df.schema] == [f.dataType for f in table.df.schema]


def test_outlier_fallback_without_spread(spark):
    df = spark.createDataFrame([(i, v, v % 2) for i, v in enumerate([5] * 9 + [7, 9])], "id int, a int, y int")
    table = LabelledTable(df, "y", ("id",))
    assert {r["a"] for r in C.inject_outliers(table, 1.0).df.collect()} == {13, -3}
    assert sorted(C.inject_outliers(table, 1.0, preset=C.EXPERIMENT).df.collect()) == sorted(df.collect())
    binary = LabelledTable(df.withColumn("a", F.col("a") % 2), "y", ("id",))
    with pytest.raises(ValueError):
        C.inject_outliers(binary, 0.5)
    assert C.inject_outliers(binary, 0.5, preset=C.PROBE) is binary


def test_imbalance_quotas():
    counts = {"a": 9, "b": 6, "c": 1, None: 4}
    assert C.imbalance_quotas(counts, 2, 1) == {"a": 9, "b": 4, "c": 1}
    assert C.imbalance_quotas(counts, 10, 1) == {"a": 9, "b": 1, "c": 1}
    assert C.imbalance_quotas(counts, 10, 0) == {"a": 9, "b": 0, "c": 0}


def test_imbalance(table):
    counts = {r[0]: r[1] for r in C.inject_imbalance(table, 5).df.groupBy("y").count().collect()}
    assert counts == {"a": 720, "b": 144, "c": 120}
    with pytest.raises(ValueError):
        C.inject_imbalance(table, 1)
    assert C.inject_imbalance(table, 1, preset=C.PROBE) is table


def test_rate_guards(table):
    for make in (C.inject_missing, C.inject_duplicates, C.inject_label_noise, C.inject_outliers):
        with pytest.raises(ValueError):
            make(table, 1.5)
    with pytest.raises(ValueError):
        C.corrupt(table, "typo", 0.1, 42)


@pytest.mark.parametrize("condition", list(C.CONDITIONS))
def test_conditions_keep_their_counts(table, condition):
    kinds = [c for c, _ in C.CONDITIONS[condition]]
    out = C.corrupt_combined(table, condition, 42)
    rows = 984 if "imbalance" in kinds else 1200
    rows += round(rows * 0.1) if "duplicates" in kinds else 0
    assert out.df.count() == out.known_rows == rows


def test_keyless_table_with_a_hot_row(spark):
    df = spark.createDataFrame([("x", 1, "p")] * 300 + [("x", 1, "n")] * 100 + [("z", i, "p") for i in range(200)],
                               "s string, i int, y string")
    out = C.inject_label_noise(LabelledTable(df, "y"), 0.1)
    assert out.keys == () and out.df.columns == df.columns and out.df.count() == 600
    before, after = ({r[0]: r[1] for r in d.groupBy("y").count().collect()} for d in (df, out.df))
    assert before != after and sum(after.values()) == 600


def test_row_groups_of_a_keyless_table_keep_their_size(spark):
    df = spark.createDataFrame([("x", 1, "p")] * 50 + [("z", 2, "n")] * 50, "s string, i int, y string")
    out = C.inject_missing(LabelledTable(df, "y"), 0.25).df
    assert out.agg(F.sum(F.col("s").isNull().cast("int") + F.col("i").isNull().cast("int"))).first()[0] == 50
    assert out.count() == 100


def test_keys_with_separators_and_repeated_keys(spark):
    rows = [(a, b, "x" if i % 2 else "y") for i, (a, b) in enumerate([("a|b", "c"), ("a", "b|c"), ("a", None), ("a", "nan")])]
    rows += [(str(i), str(i), "x" if i % 2 else "y") for i in range(500)]
    df = spark.createDataFrame(rows, "a string, b string, y string")
    pairs = LabelledTable(df, "y", ("a", "b"))
    hashes = df.select(C.seeded_hash(1, "row", F.col("a"), F.col("b")).alias("h"))
    assert hashes.distinct().count() == 504
    out = C.inject_label_noise(pairs, 0.1).df.withColumnRenamed("y", "z").join(df, df.columns[:1]).where("y <> z")
    assert out.where("a not in ('a', 'a|b')").count() >= 46
    twice = LabelledTable(df.where("a <> 'a'").select("a", "b", "y", F.explode(F.array(F.lit(1), F.lit(2))).alias("v")),
                          "y", ("a", "b"))
    with pytest.raises(ValueError):
        C.inject_label_noise(twice, [0.101, 0.103, 0.105, 0.107])


def test_severities_stay_where_nothing_changes(spark, table):
    one = LabelledTable(table.df.where("y = 'a'"), "y", ("id",))
    for preset, run, levels in ((C.EXPERIMENT, C.inject_label_noise, [0.1, 0.2]), (C.PROBE, C.inject_imbalance, [2.0, 5.0])):
        got = run(one, levels, preset=preset)
        assert {r["severity"]: r["count"] for r in got.df.groupBy("severity").count().collect()} == dict.fromkeys(levels, 720)
        assert "severity" in got.keys
    got = C.inject_imbalance(table, [1.0, 5.0], preset=C.PROBE)
    sizes = {(r["severity"], r["y"]): r["count"] for r in got.df.groupBy("severity", "y").count().collect()}
    assert sizes == {(1.0, "a"): 720, (1.0, "b"): 360, (1.0, "c"): 120, (5.0, "a"): 720, (5.0, "b"): 144, (5.0, "c"): 120}


def test_check_of_several_severities(table):
    got = {r["severity"]: r for r in C.corruption_check(table, C.inject_missing(table, [0.1, 0.2])).collect()}
    assert {s: (r["clean_rows"], r["corrupted_rows"], r["cells_nulled"]) for s, r in got.items()} == {
        0.1: (1200, 1200, 360), 0.2: (1200, 1200, 720)}
    keyless = LabelledTable(table.df.drop("id"), "y")
    with pytest.raises(ValueError):
        C.corruption_check(keyless, C.inject_missing(keyless, 0.1))
    made = C.keyed(keyless)
    assert C.corruption_check(made, C.inject_missing(made, 0.1)).first()["cells_nulled"] == 360
