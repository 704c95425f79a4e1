"""Registry of the runnable queries, the tables they read and the SQL text helpers of their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sturdytab.sources.tables import Source, load
from sturdytab.table import LabelledTable

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# dataset -> (table, key columns, feature columns, target)
DATASETS = {
    "orders": ("orders", ("o_orderkey",), ("o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority"),
               "o_orderstatus"),
    "part": ("part", ("p_partkey",), ("p_name", "p_brand", "p_size", "p_retailprice"), "p_type"),
    "part_brand": ("part", ("p_partkey",), ("p_brand", "p_size"), "p_type"),
    "events": ("events", ("event_id",), ("ts", "user_id", "value", "props"), "event_type"),
    "events_user": ("events", ("event_id",), ("user_id", "props"), "event_type"),
    "customer": ("customer", ("c_custkey",), ("c_name", "c_nationkey", "c_acctbal"), "c_mktsegment"),
    "lineitem": ("lineitem", (),
                 ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
                  "l_discount", "l_tax", "l_linestatus", "l_shipdate"), "l_returnflag"),
    "lineitem_terms": ("lineitem", (), ("l_tax", "l_discount", "l_linestatus"), "l_returnflag"),
    "labels": ("labels", ("doc_id",), ("toxic",), "quality"),
}
NUMERIC = {
    "orders": ["o_custkey", "o_totalprice"],
    "part": ["p_size", "p_retailprice"],
    "part_brand": ["p_size"],
    "events": ["user_id", "value"],
    "events_user": ["user_id"],
    "customer": ["c_nationkey", "c_acctbal"],
    "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
                 "l_discount", "l_tax"],
    "lineitem_terms": ["l_tax", "l_discount"],
    "labels": ["toxic"],
}
TEMPORAL = {"o_orderdate", "ts", "l_shipdate"}


def catalog(sf_dir: str) -> dict[str, Source]:
    return {
        name: Source(f"{sf_dir}/{table}.parquet", target, keys, features)
        for name, (table, keys, features, target) in DATASETS.items()
    }


def dataset(spark: SparkSession, sf_dir: str, name: str) -> LabelledTable:
    """Key columns that are no features are not part of the audit; lineitem has no key."""
    return load(spark, catalog(sf_dir), name)


def raw(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def query(name: str, sql: str | None = None):
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


# ---- SQL text helpers ---------------------------------------------------------------------------

def sql_hash(seed: int, tag: str, *parts: str) -> str:
    texts = [f"cast({p} as varchar)" for p in parts]
    cells = ", ".join(f"coalesce(cast(length({t}) as varchar) || ':' || {t}, '-')" for t in texts)
    return f"md5(concat_ws('|', '{seed}', '{tag}', {cells}))"


def sql_choice(h: str, n: str) -> str:
    return f"(cast('0x' || substr({h}, 1, 15) as bigint) % ({n}))"


def sql_list(columns) -> str:
    return ", ".join(columns)
