import pytest

from sturdytab.operators.sampling import shuffled
from sturdytab.plans.grid import LEFT_OUT_MULTI_SEED, LEFT_OUT_SINGLE_SEED, combinations_for, conditions_for
from sturdytab.session import scratch_path, settle
from sturdytab.sources.tables import Source, load, read_csv, write_table


def test_catalog(spark):
    path = scratch_path(spark, "catalog")
    df = spark.createDataFrame([(1, None, "NA", "p"), (2, 1.5, 'a "b", c\nd', "n")], "id int, v double, s string, y string")
    write_table(df, f"{path}/csv", fmt="csv")
    write_table(df, f"{path}/parquet")
    catalog = {
        "text": Source(f"{path}/csv", "y", ("id",), ("v", "s"), "csv", df.schema, multi_line=True),
        "columns": Source(f"{path}/parquet", "y", ("id",), ("v",)),
        "absent": Source(f"{path}/nothing", "y"),
    }
    table = load(spark, catalog, "text")
    assert (table.features, table.numeric, table.categorical) == (["v", "s"], ["v"], ["s"])
    assert sorted(table.df.select("id", "s").collect()) == [(1, None), (2, 'a "b", c\nd')]
    assert load(spark, catalog, "columns").df.columns == ["id", "v", "y"]
    with pytest.raises(KeyError):
        load(spark, catalog, "typo")
    with pytest.raises(Exception):
        load(spark, catalog, "absent")
    with pytest.raises(Exception):
        write_table(df, f"{path}/csv", fmt="csv")  # nothing is overwritten


def test_csv_misfit_is_an_error(spark):
    path = scratch_path(spark, "misfit")
    write_table(spark.createDataFrame([("x",)], "v string"), path, fmt="csv")
    from pyspark.sql.types import IntegerType, StructField, StructType

    with pytest.raises(Exception):
        read_csv(spark, path, StructType([StructField("v", IntegerType())])).collect()


def test_csv_types_and_header(spark):
    path = scratch_path(spark, "typed")
    rows = [("1", "3.5", "NA", "2020-01-01", "true", "7"), ("2", "NA", "", "NA", "false", "x"),
            ("30000000000", "4.5", None, "2021-02-03", "true", "8")]
    write_table(spark.createDataFrame(rows, "k string, x string, none string, d string, b string, t string"), path,
                fmt="csv")
    df = read_csv(spark, path)
    assert [k for _, k in df.dtypes] == ["bigint", "double", "string", "date", "boolean", "string"]
    assert sorted(r.x for r in df.collect() if r.x is not None) == [3.5, 4.5]
    from pyspark.sql.types import LongType, StringType, StructField, StructType

    swapped = StructType([StructField("t", StringType()), StructField("k", LongType())])
    assert sorted(map(tuple, read_csv(spark, path, swapped).collect())) == [("7", 1), ("8", 30000000000), ("x", 2)]
    with pytest.raises(ValueError):
        read_csv(spark, path, StructType([StructField("absent", StringType())]))


def test_settled_frames_are_equal(spark):
    df = spark.createDataFrame([(1, "a", None), (2, None, 0.5)], "i int, s string, d double")
    assert sorted(settle(df).collect()) == sorted(df.collect())
    assert settle(df).schema == df.schema


def test_grids():
    assert len(conditions_for("mobile_price", LEFT_OUT_SINGLE_SEED)) == 15
    assert len(conditions_for("car_evaluation", LEFT_OUT_SINGLE_SEED)) == 9
    assert len(conditions_for("bank_marketing", LEFT_OUT_SINGLE_SEED)) == 15
    assert len(conditions_for("bank_marketing", LEFT_OUT_MULTI_SEED)) == 12
    sizes = [len(combinations_for(d)) for d in ("car_evaluation", "bank_marketing", "mobile_price", "maternal_health")]
    assert sizes == [2, 3, 6, 6]


def test_shuffle_is_seeded(spark):
    df = spark.range(100)
    one, two, other = ([r[0] for r in shuffled(d, ["id"], s).collect()] for d, s in ((df, 1), (df.repartition(7), 1), (df, 2)))
    assert one == two != other and sorted(one) == sorted(other)
