"""Audit, class balance and meta-feature queries."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from sturdytab.functions.scalars import as_number
from sturdytab.operators import audit, meta
from sturdytab.operators.quantiles import profile_columns
from sturdytab.operators.sampling import number_copies
from sturdytab.queries.base import DATASETS, NUMERIC, TEMPORAL, dataset, query, raw, sql_list
from sturdytab.table import (
    LabelledTable, drop_empty_columns, drop_index_columns, known_target, normalise_missing,
)

AUDITED = ("orders", "part", "events", "customer", "lineitem")
REPEATED = ("events_user", "lineitem_terms", "part_brand")  # projections with duplicates and conflicts


def rounded(df, digits, *columns):
    """Round the named double columns so that summation order cannot show."""
    return df.select(*[F.round(c, digits).alias(c) if c in columns else F.col(c) for c in df.columns])


# ---- audit report -------------------------------------------------------------------------------

def _outlier_sql(name, least=0):
    """Rows outside the 1.5 IQR fences of any numeric feature."""
    table, _, _, _ = DATASETS[name]
    fences = ", ".join(
        f"quantile_cont({c}::double, 0.25) as {c}_1, quantile_cont({c}::double, 0.75) as {c}_3, count({c}) as {c}_n"
        for c in NUMERIC[name])
    tests = " or ".join(
        f"coalesce(q.{c}_n >= {least} and q.{c}_3 - q.{c}_1 <> 0 and "
        f"(t.{c} < q.{c}_1 - 1.5 * (q.{c}_3 - q.{c}_1) or t.{c} > q.{c}_3 + 1.5 * (q.{c}_3 - q.{c}_1)), false)"
        for c in NUMERIC[name])
    return f"(select count(*) from {table} t, (select {fences} from {table}) q where {tests})"


def _facts_sql(name, least=0):
    table, _, features, target = DATASETS[name]
    every = sql_list([*features, target])
    nulls = " + ".join(f"(count(*) - count({c}))" for c in features)
    return f"""
      select (select count(*) from {table}) as n,
        (select {nulls} from {table}) as null_features,
        (select count(*) - count({target}) from {table}) as null_target,
        (select count(*) from {table}) - (select count(*) from (select distinct {every} from {table})) as dups,
        {_outlier_sql(name, least)} as outs,
        (select coalesce(sum(c), 0) from (select count(*) as c, count(distinct {target}) as d
           from {table} group by {sql_list(features)}) where d > 1) as confl,
        (select count(distinct {target}) from {table}) as classes,
        (select max(c) / min(c) from (select count(*) as c from {table} group by {target})) as ratio,
        (select -sum(p * log2(p)) from (select count(*) / (select count(*) from {table}) as p
           from {table} group by {target})) as entropy"""


def report_sql(name):
    _, _, features, target = DATASETS[name]
    m = len(features)
    return f"""with f as ({_facts_sql(name)})
      select '{name}' as dataset, cast(n as bigint) as rows, cast({m + 1} as bigint) as columns,
        cast({m} as bigint) as features, '{target}' as target,
        cast({len(NUMERIC[name])} as bigint) as numerical_features,
        cast({m - len(NUMERIC[name])} as bigint) as categorical_features,
        cast(null_features + null_target as bigint) as missing_cells,
        round_even((null_features + null_target)::double / (n * {m + 1}) * 100, 4) as missing_rate_percent,
        cast(dups as bigint) as duplicate_rows, round_even(dups::double / n * 100, 4) as duplicate_rate_percent,
        round_even(outs::double / n * 100, 4) as outlier_row_rate_percent,
        round_even(confl::double / n * 100, 4) as potential_label_conflict_rate_percent,
        cast(classes as bigint) as number_of_classes, round_even(ratio, 4) as imbalance_ratio
      from f"""


def fraction_sql(name):
    _, _, features, target = DATASETS[name]
    m, numeric = len(features), len(NUMERIC[name])
    text = len([c for c in features if c not in NUMERIC[name] and c not in TEMPORAL])
    return f"""with f as ({_facts_sql(name, 4)})
      select '{name}' as dataset, cast(n as bigint) as n_rows, cast({m} as bigint) as n_features,
        cast({numeric} as bigint) as n_numeric, cast({text} as bigint) as n_categorical,
        round({numeric}::double / {m}, 9) as numeric_ratio, round({text}::double / {m}, 9) as categorical_ratio,
        cast(classes + (null_target > 0)::int as bigint) as n_classes, round(ratio, 9) as imbalance_ratio,
        round(entropy, 9) as class_entropy, cast(null_features as bigint) as missing_cells,
        round(null_features::double / (n * {m}), 9) as missing_rate,
        cast(dups as bigint) as duplicate_rows, round(dups::double / n, 9) as duplicate_rate,
        cast(outs as bigint) as outlier_rows, round(outs::double / n, 9) as outlier_rate,
        round(confl::double / n, 9) as potential_label_conflict_rate
      from f"""


FRACTIONS = ("numeric_ratio", "categorical_ratio", "imbalance_ratio", "class_entropy", "missing_rate",
             "duplicate_rate", "outlier_rate", "potential_label_conflict_rate")


def _fractions(spark, sf, name):
    return rounded(audit.fraction_audit(dataset(spark, sf, name)), 9, *FRACTIONS)


for _name in (*AUDITED, *REPEATED):
    query(f"audit_{_name}", report_sql(_name))(
        lambda spark, sf, name=_name: audit.report_audit(dataset(spark, sf, name)))
    query(f"audit_fractions_{_name}", fraction_sql(_name))(partial(_fractions, name=_name))


IMPURITY_TABLES = ("orders", "events", "events_user", "customer", "lineitem_terms", "labels", "part_brand")


def _impurity_sql(name):
    return f"""select * from (with a as ({fraction_sql(name)}),
      l as (select dataset, unnest([
        {{'ord': 1, 'corruption': 'missing', 'severity': case when missing_rate > 0
           then greatest(0.01, least(0.2, missing_rate)) end}},
        {{'ord': 2, 'corruption': 'duplicates', 'severity': case when duplicate_rate > 0
           then greatest(0.01, least(0.2, duplicate_rate)) end}},
        {{'ord': 3, 'corruption': 'outliers', 'severity': case when outlier_rate > 0 and n_numeric > 0
           then greatest(0.01, least(0.2, outlier_rate)) end}},
        {{'ord': 4, 'corruption': 'label_noise', 'severity': case when potential_label_conflict_rate > 0
           then greatest(0.01, least(0.2, potential_label_conflict_rate)) end}},
        {{'ord': 5, 'corruption': 'imbalance', 'severity': case when imbalance_ratio > 1.5 and imbalance_ratio <= 10
           then greatest(2.0, least(10.0, round_even(imbalance_ratio, 0))) end}}]) as s from a)
      select dataset, s.ord as ord, s.corruption as corruption, round(s.severity::double, 6) as severity
      from l where s.severity is not null)"""


@query("impurities", " union all ".join(_impurity_sql(n) for n in IMPURITY_TABLES))
def impurities(spark, sf):
    audits = None
    for name in IMPURITY_TABLES:
        one = audit.fraction_audit(dataset(spark, sf, name))
        audits = one if audits is None else audits.unionByName(one)
    return rounded(audit.detect_impurities(audits), 6, "severity")


@query("audit_many", " union all ".join(f"select * from ({report_sql(n)})" for n in ("part", "customer")))
def audit_many(spark, sf):
    """Two sound tables and one without its target: the failure does not hide the other reports."""
    broken = ("broken", lambda: LabelledTable(raw(spark, sf, "region"), "no_such_column", name="broken"))
    reports, failures = audit.audit_many([dataset(spark, sf, "part"), broken, dataset(spark, sf, "customer")])
    assert list(failures) == ["broken"]
    return reports


# ---- pieces of the audit ------------------------------------------------------------------------

@query("surplus_documents", """select cast(count(*) as bigint) as rows,
  cast(count(*) - (select count(*) from (select distinct text, lang from documents)) as bigint) as duplicate_rows
  from documents""")
def surplus_documents(spark, sf):
    return audit.surplus_rows(raw(spark, sf, "documents"), ["text", "lang"])


def _conflict_sql(name):
    table, _, features, target = DATASETS[name]
    return f"""select cast(count(*) as bigint) as groups, cast(sum(c) as bigint) as rows,
      cast(count(*) filter (where d > 1) as bigint) as conflict_groups,
      cast(coalesce(sum(c) filter (where d > 1), 0) as bigint) as conflict_rows,
      cast(max(d) as bigint) as most_labels
      from (select count(*) as c, count(distinct {target}) as d from {table} group by {sql_list(features)})"""


def _conflicts(spark, sf, name):
    t = dataset(spark, sf, name)
    many = F.col("labels") > 1
    return audit.feature_groups(t.df, t.features, t.target).agg(
        F.count("*").alias("groups"), F.sum("rows").alias("rows"),
        F.count_if(many).alias("conflict_groups"),
        F.coalesce(F.sum(F.when(many, F.col("rows"))), F.lit(0)).alias("conflict_rows"),
        F.max("labels").alias("most_labels"))


for _name in ("events_user", "part_brand", "lineitem_terms"):
    query(f"conflict_groups_{_name}", _conflict_sql(_name))(partial(_conflicts, name=_name))


@query("conflict_rows_part", """select p_partkey, p_brand, p_size, p_type, cast(labels as bigint) as labels from part
  join (select p_brand as b, p_size as s, count(distinct p_type) as labels from part group by 1, 2)
  on p_brand is not distinct from b and p_size is not distinct from s""")
def conflict_rows_part(spark, sf):
    return audit.conflict_flags(dataset(spark, sf, "part_brand")).select(
        "p_partkey", "p_brand", "p_size", "p_type", "labels")


@query("outlier_rows_events", """select event_id, value from events,
  (select quantile_cont(value, 0.25) as q1, quantile_cont(value, 0.75) as q3 from events)
  where value < q1 - 1.5 * (q3 - q1) or value > q3 + 1.5 * (q3 - q1)""")
def outlier_rows_events(spark, sf):
    df = dataset(spark, sf, "events").df
    profiles = profile_columns(df, ["value"], (0.25, 0.75))
    return df.where(audit.outlier_row(profiles)).select("event_id", "value")


def _profile_sql(name):
    table, _, _, _ = DATASETS[name]
    return " union all ".join(
        f"""select '{c}' as "column", cast(count({c}) as bigint) as n, round(min({c})::double, 6) as low,
        round(max({c})::double, 6) as high, round(stddev_samp({c}), 6) as std,
        count(distinct {c}) > 2 as varied, round(quantile_cont({c}::double, 0.25), 6) as q1,
        round(quantile_cont({c}::double, 0.5), 6) as median, round(quantile_cont({c}::double, 0.75), 6) as q3
        from {table}""" for c in NUMERIC[name])


def _profile(spark, sf, name, small_cells=None):
    settings = {} if small_cells is None else {"small_cells": small_cells}
    found = profile_columns(dataset(spark, sf, name).df, NUMERIC[name], **settings)
    rows = [(c, p.n, p.low, p.high, p.std, p.varied, p.quantiles[0.25], p.quantiles[0.5], p.quantiles[0.75])
            for c, p in found.items()]  # one row per column
    schema = ("column string, n long, low double, high double, std double, varied boolean, "
              "q1 double, median double, q3 double")
    return rounded(spark.createDataFrame(rows, schema), 6, "low", "high", "std", "q1", "median", "q3")


for _name in ("orders", "events", "lineitem"):
    query(f"column_profile_{_name}", _profile_sql(_name))(partial(_profile, name=_name))
query("column_profile_bracketed", _profile_sql("lineitem"))(partial(_profile, name="lineitem", small_cells=0))


@query("occurrence_numbers_documents", """select lang, source, occurrence, cast(count(*) as bigint) as n from
  (select lang, source, row_number() over (partition by text, lang, source) as occurrence from documents)
  group by 1, 2, 3""")
def occurrence_numbers_documents(spark, sf):
    numbered = number_copies(raw(spark, sf, "documents").select("text", "lang", "source"), "occurrence")
    return numbered.groupBy("lang", "source", "occurrence").agg(F.count("*").alias("n"))


# ---- classes ------------------------------------------------------------------------------------

def _distribution_sql(name):
    table, _, _, target = DATASETS[name]
    return f"""select cast({target} as varchar) as label, cast(count(*) as bigint) as n,
      round_even(count(*)::double / (select count(*) from {table}) * 100, 2) as percent,
      row_number() over (order by count(*) desc, {target}) as place from {table} group by {target}"""


def _distribution(spark, sf, name):
    """Counts, percents and the place by count, label. The window spans one row per class."""
    from pyspark.sql import Window

    t = dataset(spark, sf, name)
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("n"), "label"))
    return audit.class_distribution(t.df, t.target).select(
        F.col("label").cast("string").alias("label"), "n", "percent", place.cast("bigint").alias("place"))


def _advice_sql(name):
    table, _, _, target = DATASETS[name]
    return f"""select cast(sum(c) as bigint) as labelled_rows, cast(count(*) as bigint) as classes,
      cast(max(c) as bigint) as largest, cast(min(c) as bigint) as smallest, round(max(c) / min(c), 6) as ratio,
      case when max(c) / min(c) >= 5 then 'strong natural imbalance: keep as it is'
        when max(c) / min(c) > 1 then 'some natural imbalance: keep as baseline'
        else 'balanced: suitable for controlled imbalance' end as advice, '2,5,10' as suggested_ratios
      from (select count(*) as c from {table} where {target} is not null group by {target})"""


def _advice(spark, sf, name):
    t = dataset(spark, sf, name)
    return rounded(audit.imbalance_advice(t.df, t.target), 6, "ratio")


def _class_facts_sql(name):
    table, _, _, target = DATASETS[name]
    return f"""select cast(count(*) as bigint) as classes, cast(count(label) as bigint) as known_classes,
      round(max(c) / min(c), 9) as ratio, round(-sum(c / t * log2(c / t)), 9) as entropy
      from (select {target} as label, count(*) as c, (select count(*) from {table}) as t from {table} group by 1)"""


def _class_facts(spark, sf, name):
    t = dataset(spark, sf, name)
    return rounded(audit.class_facts(t.df, t.target, True), 9, "ratio", "entropy")


for _name in ("orders", "labels", "events"):
    query(f"class_distribution_{_name}", _distribution_sql(_name))(partial(_distribution, name=_name))
    query(f"imbalance_advice_{_name}", _advice_sql(_name))(partial(_advice, name=_name))
    query(f"class_facts_{_name}", _class_facts_sql(_name))(partial(_class_facts, name=_name))


# ---- meta-features ------------------------------------------------------------------------------

def _meta_sql(name):
    table, _, features, target = DATASETS[name]
    numeric = NUMERIC[name]
    text = [c for c in features if c not in numeric and c not in TEMPORAL]

    def mean(columns):
        if not columns:
            return "0.0::double"
        return "(" + " + ".join(f"count(distinct {c})" for c in columns) + f")::double / {len(columns)}"

    return f"""select '{name}' as dataset, cast(count(*) as bigint) as n_rows,
      cast({len(features)} as bigint) as n_features, cast({len(numeric)} as bigint) as n_numeric,
      cast({len(text)} as bigint) as n_categorical,
      round({len(numeric)}::double / {len(features)}, 9) as numeric_ratio,
      round({len(text)}::double / {len(features)}, 9) as categorical_ratio,
      cast(count(distinct {target}) as bigint) as n_classes,
      round((select max(c) / min(c) from (select count(*) as c from {table} where {target} is not null
        group by {target})), 9) as imbalance_ratio,
      round(entropy({target}), 9) as class_entropy,
      round({mean(numeric)}, 6) as avg_numeric_cardinality, round({mean(text)}, 6) as avg_categorical_cardinality
      from {table}"""


def _meta(spark, sf, name):
    return rounded(meta.meta_features(dataset(spark, sf, name)), 9, "numeric_ratio", "categorical_ratio",
                   "imbalance_ratio", "class_entropy", "avg_numeric_cardinality", "avg_categorical_cardinality")


for _name in AUDITED:
    query(f"meta_features_{_name}", _meta_sql(_name))(partial(_meta, name=_name))


def _rates_sql():
    metas = " union all ".join(f"select * from ({_meta_sql(n)})" for n in AUDITED)
    reports = " union all ".join(f"select * from ({report_sql(n)})" for n in ("lineitem", "events"))
    return f"""with m as ({metas}), a as ({reports}) select m.*,
      round(coalesce(missing_rate_percent / 100, 0), 6) as missing_rate,
      round(coalesce(duplicate_rate_percent / 100, 0), 6) as duplicate_rate,
      round(coalesce(outlier_row_rate_percent / 100, 0), 6) as outlier_rate
      from m left join a on a.dataset = m.dataset"""


@query("meta_with_quality_rates", _rates_sql())
def meta_with_quality_rates(spark, sf):
    """All meta-features joined with two of the five audit reports; the others get rate 0."""
    metas, reports = None, None
    for name in AUDITED:
        one = _meta(spark, sf, name)
        metas = one if metas is None else metas.unionByName(one)
    for name in ("lineitem", "events"):
        one = audit.report_audit(dataset(spark, sf, name))
        reports = one if reports is None else reports.unionByName(one)
    return rounded(meta.with_quality_rates(metas, reports), 6, "missing_rate", "duplicate_rate", "outlier_rate")


@query("column_cardinality_part", " union all ".join(
    f"""select '{c}' as "column", cast(count(distinct {c}) as bigint) as n_distinct from part"""
    for c in ("p_name", "p_brand", "p_type", "p_size", "p_retailprice")))
def column_cardinality_part(spark, sf):
    return meta.column_cardinality(
        raw(spark, sf, "part"), ["p_name", "p_brand", "p_type", "p_size", "p_retailprice"])


# ---- missing state, cleaning --------------------------------------------------------------------

# Events with missing states made by rules on the key: NaN and NULL values, missing texts, NULL labels.
HOLES = {
    "value": "case when event_id % 7 = 0 then {nan} when event_id % 11 = 0 then null else value end",
    "props": "case when event_id % 5 = 0 then 'N/A' when event_id % 13 = 0 then null else props end",
    "event_type": "case when event_id % 17 = 0 then null else event_type end",
}
HOLES_NORMAL_SQL = """select event_id, user_id,
  case when event_id % 7 = 0 or event_id % 11 = 0 then null else value end as value,
  case when event_id % 5 = 0 or event_id % 13 = 0 then null else props end as props,
  case when event_id % 17 = 0 then null else event_type end as event_type from events"""


def events_with_holes(spark, sf):
    columns = [f"{rule.format(nan=chr(39) + 'NaN' + chr(39) + '::double')} as {name}" for name, rule in HOLES.items()]
    return raw(spark, sf, "events").selectExpr("event_id", "user_id", *columns)


@query("missing_normalised", HOLES_NORMAL_SQL)
def missing_normalised(spark, sf):
    from sturdytab.table import MISSING_TOKENS

    return normalise_missing(events_with_holes(spark, sf), MISSING_TOKENS)


# Audits of the table with holes: missing cells, NULL labels and, without the key, repeated rows.
DATASETS["events_holes"] = (f"({HOLES_NORMAL_SQL})", (), ("user_id", "value", "props"), "event_type")
NUMERIC["events_holes"] = ["user_id", "value"]


def _holes_table(spark, sf):
    return LabelledTable(missing_normalised(spark, sf).drop("event_id"), "event_type", (), "events_holes")


@query("audit_events_holes", report_sql("events_holes"))
def audit_events_holes(spark, sf):
    return audit.report_audit(_holes_table(spark, sf))


@query("audit_fractions_events_holes", fraction_sql("events_holes"))
def audit_fractions_events_holes(spark, sf):
    return rounded(audit.fraction_audit(_holes_table(spark, sf)), 9, *FRACTIONS)


@query("impurities_events_holes", _impurity_sql("events_holes"))
def impurities_events_holes(spark, sf):
    return rounded(audit.detect_impurities(audit.fraction_audit(_holes_table(spark, sf))), 6, "severity")


@query("meta_features_events_holes", _meta_sql("events_holes"))
def meta_features_events_holes(spark, sf):
    return rounded(meta.meta_features(_holes_table(spark, sf)), 9, "numeric_ratio", "categorical_ratio",
                   "imbalance_ratio", "class_entropy", "avg_numeric_cardinality", "avg_categorical_cardinality")


@query("null_cells_events", f"""with e as ({HOLES_NORMAL_SQL}) select cast(count(*) as bigint) as n,
  cast(5 * count(*) - count(event_id) - count(user_id) - count(value) - count(props) - count(event_type) as bigint)
    as missing_cells, round((5 * count(*) - count(event_id) - count(user_id) - count(value) - count(props)
    - count(event_type))::double / (5 * count(*)), 9) as missing_rate from e""")
def null_cells_events(spark, sf):
    df = missing_normalised(spark, sf)
    return df.agg(F.count("*").alias("n"), audit.null_cells(df.columns).alias("missing_cells")).select(
        "n", "missing_cells", F.round(F.col("missing_cells") / (F.col("n") * 5), 9).alias("missing_rate"))


@query("cleaned_events", f"""with e as ({HOLES_NORMAL_SQL}) select event_id, user_id, value, props, event_type
  from e where event_type is not null""")
def cleaned_events(spark, sf):
    """Index columns and empty columns dropped, rows without a target removed."""
    df = missing_normalised(spark, sf).select(
        "*", F.col("event_id").alias("Unnamed: 0"), F.lit(None).cast("double").alias("nothing"))
    return known_target(drop_empty_columns(drop_index_columns(df), "event_type"), "event_type")


@query("class_facts_null_labels", f"""with e as ({HOLES_NORMAL_SQL}),
  c as (select event_type as label, count(*) as c from e group by 1)
  select 'null is a class' as reading, cast(count(*) as bigint) as classes, round(max(c) / min(c), 9) as ratio,
    round(-sum(c / t * log2(c / t)), 9) as entropy from (select c, sum(c) over () as t from c)
  union all select 'null is ignored', cast(count(*) as bigint), round(max(c) / min(c), 9),
    round(-sum(c / t * log2(c / t)), 9) from (select c, sum(c) over () as t from c where label is not null)""")
def class_facts_null_labels(spark, sf):
    df = missing_normalised(spark, sf)
    both = None
    for reading, null_is_class in (("null is a class", True), ("null is ignored", False)):
        one = audit.class_facts(df, "event_type", null_is_class).select(
            F.lit(reading).alias("reading"), "classes", F.round("ratio", 9).alias("ratio"),
            F.round("entropy", 9).alias("entropy"))
        both = one if both is None else both.unionByName(one)
    return both


@query("coerced_numbers", """select event_id, try_cast(substr(props, 7, 1) as double) as first_char,
  try_cast(substr(props, 7, length(props) - 7) as double) as k from events""")
def coerced_numbers(spark, sf):
    """Text that is no number becomes NULL instead of an error."""
    inner = F.substring("props", F.lit(7), F.length("props") - 7)
    return raw(spark, sf, "events").select(
        "event_id", as_number(F.substring("props", 7, 1)).alias("first_char"), as_number(inner).alias("k"))


@query("fraction_classes_events_holes", f"""with e as ({HOLES_NORMAL_SQL})
  select 'events_holes' as dataset, cast((select count(*) from e) as bigint) as n_rows, coalesce(event_type, 'nan') as label,
    cast(count(*) as bigint) as n, round_even(count(*)::double / (select count(*) from e) * 100, 2) as percent
  from e group by event_type""")
def fraction_classes_events_holes(spark, sf):
    """The class distribution of the audit in fractions, as rows; NULL labels are a class."""
    table = _holes_table(spark, sf)
    report = audit.with_classes(audit.fraction_audit(table), table)
    return report.select("dataset", "n_rows", "class_percentages", F.explode("class_counts").alias("label", "n")).select(
        "dataset", "n_rows", "label", "n", F.element_at("class_percentages", F.col("label")).alias("percent"))
