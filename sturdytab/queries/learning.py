"""Training queries over labels joined with documents, checked by rows; and file round trips.

They run the published grids on whole tables with the published model sizes; README gives their times.
"""

from __future__ import annotations

from functools import partial

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F, types as T

from sturdytab.operators.categories import category_dictionary, category_indexes, dictionary_sizes
from sturdytab.learn.models import LIGHT, FittedModel, fit_features, fit_model
from sturdytab.operators.corrupt import CONDITIONS, CORRUPTIONS, RATES
from sturdytab.operators.split import group_split, train_test
from sturdytab.plans import adaptive, experiments as E
from sturdytab.plans.grid import SINGLE_CONDITIONS
from sturdytab.queries.base import dataset, query, raw
from sturdytab.session import scratch_path, settle
from sturdytab.sources import tables
from sturdytab.table import LabelledTable, drop_empty_columns

FEATURES = ("lang", "source", "n_chars", "toxic")


def graded_documents(spark, sf) -> LabelledTable:
    """Quality label with the language, source, length and toxicity of the document."""
    documents = raw(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")
    joined = raw(spark, sf, "labels").join(documents, "doc_id")
    return LabelledTable(joined, "quality", ("doc_id",), "graded_documents")


def _split(spark, sf):
    """Training and test part, written once and read by every fit."""
    table = graded_documents(spark, sf)
    return train_test(table, settle(group_split(table), "split"))


def _scores_only(df):
    """Without wall times, which differ between runs."""
    return df.drop("training_time_seconds")


@query("train_clean")
def train_clean(spark, sf):
    """Five models on the clean training part of a group-aware split."""
    return _scores_only(E.run_clean(*_split(spark, sf)))


def _family(spark, sf, corruption):
    """Every published severity of one corruption under every seed, five models each, with drops against the clean scores."""
    train, test = _split(spark, sf)
    clean = E.run_clean(train, test)
    results = E.run_single(train, test, [c for c in SINGLE_CONDITIONS if c[0] == corruption])
    return _scores_only(E.results_with_drops(results, clean))


for _kind in CORRUPTIONS:
    query(f"train_{_kind}")(partial(_family, corruption=_kind))


def _combination(spark, sf, condition):
    """One published combination under every seed, five models each."""
    return _scores_only(E.run_combined(*_split(spark, sf), conditions=(condition,)))


for _name in CONDITIONS:
    query(f"train_combined_{_name}")(partial(_combination, condition=_name))


@query("train_reduced_source")
def train_reduced_source(spark, sf):
    """A stratified subset of the training rows: clean, four single corruptions and three combinations under every seed."""
    return _scores_only(E.run_reduced_source(*_split(spark, sf)))


@query("train_probe_selection")
def train_probe_selection(spark, sf):
    """Cross-validated probes under all five impurities and the estimate each model gets."""
    impurities = [*E.REDUCED_SINGLE, ("imbalance", 5.0)]
    probes = E.probe_scores(graded_documents(spark, sf), impurities)
    return adaptive.wide_profile(adaptive.selection_profile(probes), [c for c, _ in impurities])


@query("adaptive_run")
def adaptive_run(spark, sf):
    """The whole way from the table to the chosen model; the report row without wall times."""
    result = adaptive.run_adaptive(graded_documents(spark, sf))
    return result.report().select(
        "dataset", "target", "selected_model", "estimated_combined_macro_f1", "final_test_metrics.*",
        F.to_json("detected_impurities").alias("detected_impurities"))


@query("scored_rows", """select doc_id, true as known_class, true as as_before_saving
  from documents left join labels using (doc_id)""")
def scored_rows(spark, sf):
    """A saved decision tree, read back, scores documents it was not trained on as well as its own: does each get a known
    class, and the one that the tree gave before it was saved?"""
    table = graded_documents(spark, sf)
    features = fit_features(table, LIGHT)
    path = scratch_path(spark, "model")
    model = fit_model("Decision Tree", features, features.prepared(table.df), LIGHT)
    model.save(path)
    new = raw(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")
    toxic = raw(spark, sf, "labels").select("doc_id", "toxic")
    before = adaptive.score_rows(model, new.join(toxic, "doc_id", "left")).withColumnRenamed("prediction", "before")
    scored = adaptive.score_rows(FittedModel.load(path), before)
    return scored.select("doc_id", F.coalesce(F.col("prediction").isin(*features.classes), F.lit(False)).alias("known_class"),
                         F.col("prediction").eqNullSafe(F.col("before")).alias("as_before_saving"))


@query("one_hot_documents", """with l as (select lang, dense_rank() over (order by lang) - 1 as i,
    (select count(distinct lang) from documents) as w from (select distinct lang from documents))
  select doc_id, cast(i as integer) as position, cast(w as integer) as width
  from documents join l using (lang)""")
def one_hot_documents(spark, sf):
    """One-hot vectors of the language: where the single one is, and how long the vector is."""
    table = LabelledTable(raw(spark, sf, "documents").select("doc_id", "lang", "source"), "source", ("doc_id",))
    stages = fit_features(table, LIGHT).stages
    vector = vector_to_array("model_features")
    return stages.transform(table.df).select(
        "doc_id", (F.array_position(vector, 1.0) - 1).cast("int").alias("position"),
        F.size(vector).alias("width"))


@query("one_hot_wide_customer", """with n as (select c_name, dense_rank() over (order by c_name) - 1 as i from
    (select distinct c_name from customer)), s as (select c_mktsegment, dense_rank() over (order by c_mktsegment) - 1 as i
    from (select distinct c_mktsegment from customer))
  select c_custkey, cast(n.i as bigint) as name_position,
    cast(s.i + (select count(*) from n) as bigint) as segment_position,
    cast((select count(*) from n) + (select count(*) from s) as bigint) as width
  from customer left join n using (c_name) left join s using (c_mktsegment)""")
def one_hot_wide_customer(spark, sf):
    """Sparse one-hot places of a column that has a value for every row, and of a narrow one, from a dictionary table."""
    df = raw(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment")
    columns = ["c_name", "c_mktsegment"]
    dictionary = category_dictionary(df, columns)
    names, segments = dictionary_sizes(dictionary, columns)
    coded = category_indexes(df, dictionary, columns, df.count())
    return coded.select("c_custkey", F.col("c_name_index").cast("bigint").alias("name_position"),
                        (F.col("c_mktsegment_index") + names).cast("bigint").alias("segment_position"),
                        F.lit(names + segments).cast("bigint").alias("width"))


# ---- files --------------------------------------------------------------------------------------

_SHOWN = """select c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment from customer"""


@query("file_csv_header", _SHOWN)
def file_csv_header(spark, sf):
    """A table written as CSV and read back with its schema."""
    df = raw(spark, sf, "customer")
    path = scratch_path(spark, "csv")
    tables.write_table(df, path, fmt="csv")
    return tables.read_csv(spark, path, df.schema)


@query("file_csv_inferred", _SHOWN.replace("c_custkey,", "c_custkey::integer as c_custkey,"))
def file_csv_inferred(spark, sf):
    path = scratch_path(spark, "csv")
    tables.write_table(raw(spark, sf, "customer"), path, fmt="csv")
    return tables.read_csv(spark, path)


@query("file_csv_headerless", _SHOWN)
def file_csv_headerless(spark, sf):
    df = raw(spark, sf, "customer")
    path = scratch_path(spark, "csv")
    df.write.option("header", False).option("quote", '"').option("escape", '"').csv(path)
    return tables.read_headerless_csv(spark, path, df.schema)


@query("file_csv_missing_texts", """select c_custkey::integer as c_custkey, c_mktsegment, c_name,
  case when c_custkey % 3 <> 0 then c_acctbal end as c_acctbal from customer""")
def file_csv_missing_texts(spark, sf):
    """A numeric column with missing texts keeps its type."""
    path = scratch_path(spark, "csv")
    missing = F.when(F.col("c_custkey") % 3 != 0, F.col("c_acctbal").cast("string")).otherwise("NA")
    tables.write_table(raw(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_name", missing.alias("c_acctbal")),
                       path, fmt="csv")
    return tables.read_csv(spark, path)


@query("file_csv_other_order", _SHOWN)
def file_csv_other_order(spark, sf):
    """Columns stand in another order in the file than in the schema."""
    df = raw(spark, sf, "customer")
    path = scratch_path(spark, "csv")
    tables.write_table(df.select(*reversed(df.columns)), path, fmt="csv")
    return tables.read_csv(spark, path, df.schema)


@query("file_partitioned_levels", """select severity, cast(count(*) as bigint) as rows from
  (select unnest([0.05e0, 0.1e0, 0.2e0]) as severity from orders) group by 1""")
def file_partitioned_levels(spark, sf):
    """All severities of a corruption written in one pass, one partition each, and counted from the files."""
    from sturdytab.operators.corrupt import inject_missing

    path = scratch_path(spark, "levels")
    levels = inject_missing(dataset(spark, sf, "orders"), list(RATES))
    tables.write_table(levels.df, path, by=("severity",))
    back = spark.read.schema(levels.df.schema).parquet(path)
    return back.groupBy(F.col("severity").cast("double").alias("severity")).agg(F.count("*").alias("rows"))


@query("file_report", """select 'labels' as dataset, cast(quality as varchar) as label, cast(count(*) as bigint) as n,
  round_even(count(*)::double / (select count(*) from labels) * 100, 2) as percent from labels group by quality""")
def file_report(spark, sf):
    """The nested audit report written as JSON; its class maps read back as rows."""
    from sturdytab.operators.audit import report_with_classes

    path = scratch_path(spark, "report")
    report = report_with_classes(dataset(spark, sf, "labels"))
    tables.write_report(report, path)
    schema = T.StructType([f for f in report.schema if f.name in ("dataset", "class_counts", "class_percentages")])
    back = spark.read.schema(schema).json(f"{path}/json")
    return back.select("dataset", "class_percentages", F.explode("class_counts").alias("label", "n")).select(
        "dataset", "label", "n", F.element_at("class_percentages", F.col("label")).alias("percent"))


@query("file_summary", """select 'rows' as item, '' as name, count(*)::double as value from customer
  union all select 'columns', '', 5.0 union all select 'type', 'bigint', 1.0 union all select 'type', 'int', 1.0
  union all select 'type', 'string', 1.0 union all select 'type', 'double', 1.0
  union all select 'class', c_mktsegment, count(*)::double from customer group by 2
  union all select 'class_percent', c_mktsegment,
    round_even(count(*)::double / (select count(*) from customer) * 100, 2) from customer group by 2""")
def file_summary(spark, sf):
    return tables.summary(LabelledTable(raw(spark, sf, "customer"), "c_mktsegment", (), "customer"))


@query("file_head", _SHOWN + " order by c_custkey limit 5")
def file_head(spark, sf):
    """The first five rows by key, as the feature of a summary."""
    return raw(spark, sf, "customer").orderBy("c_custkey").limit(5)


@query("dropped_empty_columns", "select c_custkey, c_name, c_mktsegment from customer")
def dropped_empty_columns(spark, sf):
    """A feature column without any value goes."""
    df = raw(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment", F.lit(None).cast("double").alias("empty"))
    return drop_empty_columns(df, "c_mktsegment")


@query("features_and_target", "select p_name, p_brand, p_size, p_retailprice from part")
def features_and_target(spark, sf):
    """The feature side of a split into features and target, without the key."""
    features, _ = dataset(spark, sf, "part").split()
    return features.drop("p_partkey")
