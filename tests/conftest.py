import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]").appName("tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def f1(spark):
    """The audit fixture: eight rows with missing cells, a duplicate, conflicts and a NULL label."""
    rows = [(1, "x", "p"), (1, "x", "n"), (2, "x", "p"), (2, "x", "p"), (None, "y", "n"), (None, "y", "p"),
            (100, None, "p"), (3, "z", None)]
    from sturdytab import LabelledTable

    return LabelledTable(spark.createDataFrame(rows, "a int, b string, y string"), "y", (), "f1")
