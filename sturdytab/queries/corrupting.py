"""Corruption, sampling, split and preparation queries. Oracles rank all hashes instead of using thresholds."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, functions as F

from sturdytab.functions.hashing import hash_choice, row_digest, seeded_hash
from sturdytab.operators import corrupt as C
from sturdytab.operators.metrics import confusion, label_scores, scores
from sturdytab.operators.prep import class_list, fit_prep
from sturdytab.operators.sampling import by_class, kth_hash, number_copies, prefix_sums
from sturdytab.operators.split import (
    group_split, holdout_split, stratified_folds, stratified_subset,
)
from sturdytab.queries.auditing import rounded
from sturdytab.queries.base import DATASETS, NUMERIC, dataset, query, raw, sql_choice, sql_hash
from sturdytab.table import LabelledTable

INTEGER = {"o_custkey": "bigint", "user_id": "bigint", "p_size": "integer", "toxic": "integer"}


class SqlTable:
    """A relation with the layout of a dataset, for chaining corruptions in SQL."""

    def __init__(self, name):
        table, (self.key,), self.features, self.target = DATASETS[name]
        self.numeric = NUMERIC[name]
        self.ctes: list[str] = []
        self.last = table
        self.keys = [self.key]

    @property
    def columns(self):
        return [*self.keys, *self.features, self.target]

    def step(self, text):
        name = f"s{len(self.ctes)}"
        self.ctes.append(f"{name} as ({text})")
        self.last = name
        return self

    def count(self, rate, how, cells=1):
        total = f"({cells} * count(*))::double * {rate}e0"
        whole = f"floor({total})" if how == "floor" else f"round_even({total}, 0)"
        return f"(select cast({whole} as bigint) from {self.last})"

    def ranked(self, tag, seed):
        h = sql_hash(seed, tag, *self.keys)
        return f"(select *, row_number() over (order by {h}) as r_ from {self.last})"

    def missing(self, rate, seed, how="floor"):
        m = len(self.features)
        keys = ", ".join(self.keys)
        cells = f"""select {keys}, list(j) as js from (select {keys}, j,
          row_number() over (order by {sql_hash(seed, 'cell', 'j', *self.keys)}) as r
          from {self.last}, range({m}) t(j)) where r <= {self.count(rate, how, m)} group by {keys}"""
        out = [f"t.{k}" for k in self.keys]
        out += [f"case when list_contains(js, {j}) then null else t.{c} end as {c}" for j, c in enumerate(self.features)]
        on = " and ".join(f"t.{k} = c.{k}" for k in self.keys)
        return self.step(f"select {', '.join(out)}, t.{self.target} from {self.last} t left join ({cells}) c on {on}")

    def duplicates(self, rate, seed, how="round"):
        out = ", ".join(self.columns)
        text = f"""select {out}, cast(unnest(case when r_ <= {self.count(rate, how)} then [0, 1] else [0] end)
          as integer) as copy_no from {self.ranked('copy', seed)}"""
        self.step(text)
        self.keys = [*self.keys, "copy_no"]
        return self

    def duplicates_with_replacement(self, rate, seed):
        """The first k arrivals over all rows; no row has 12 of them this early."""
        out, keys = ", ".join(f"t.{c}" for c in self.columns), ", ".join(self.keys)
        whole = f"cast('0x' || substr({sql_hash(seed, 'arrival', 'step', *self.keys)}, 1, 15) as bigint)"
        times = f"""select {keys}, sum(-ln(({whole} + 0.5e0) / 1152921504606846976e0)) over (
          partition by {keys} order by step) as time from {self.last}, range(1, 13) s(step)"""
        on = " and ".join(f"t.{k} = d.{k}" for k in self.keys)
        text = f"""select {out}, cast(unnest(range(0, coalesce(hits, 0) + 1)) as integer) as copy_no
          from {self.last} t left join (select {keys}, count(*) as hits from (select *,
            row_number() over (order by time) as r from ({times})) where r <= {self.count(rate, 'floor')}
            group by {keys}) d on {on}"""
        self.step(text)
        self.keys = [*self.keys, "copy_no"]
        return self

    def label_noise(self, rate, seed, how="floor"):
        t = self.target
        others = f"""list_filter((select list(distinct {t} order by {t}) from {self.last} where {t} is not null),
          lambda x: x is distinct from {t})"""
        pick = sql_choice(sql_hash(seed, "pick", *self.keys), f"len({others})")
        out = ", ".join([*self.keys, *self.features])
        return self.step(f"""select {out}, case when r_ <= {self.count(rate, how)}
          then list_extract({others}, {pick} + 1) else {t} end as {t} from {self.ranked('row', seed)}""")

    def outliers(self, rate, seed, how="floor", magnitude="median6"):
        stats = ", ".join(
            f"quantile_cont({c}::double, 0.25) as {c}_1, quantile_cont({c}::double, 0.5) as {c}_2, "
            f"quantile_cont({c}::double, 0.75) as {c}_3" for c in self.numeric)
        pick = sql_choice(sql_hash(seed, "pick", *self.keys), str(len(self.numeric)))
        sign = sql_choice(sql_hash(seed, "sign", *self.keys), "2")
        out = []
        for c in self.columns:
            if c not in self.numeric:
                out.append(c)
                continue
            i, iqr = self.numeric.index(c), f"({c}_3 - {c}_1)"
            if magnitude == "median6":
                low, high = f"{c}_2 - 6 * {iqr}", f"{c}_2 + 6 * {iqr}"
            else:
                low, high = f"{c}_1 - 3 * {iqr}", f"{c}_3 + 3 * {iqr}"
            if c in INTEGER:
                low, high = (f"cast(round_even({v}, 0) as {INTEGER[c]})" for v in (low, high))
            out.append(f"""case when r_ <= {self.count(rate, how)} and {pick} = {i}
              then case when {sign} = 1 then {high} else {low} end else {c} end as {c}""")
        return self.step(f"""select {', '.join(out)} from {self.ranked('row', seed)},
          (select {stats} from {self.last})""")

    def imbalance(self, ratio, seed, min_keep=1):
        t, out = self.target, ", ".join(self.columns)
        sizes = f"select {t} as c_, count(*) as n_ from {self.last} where {t} is not null group by 1"
        h = sql_hash(seed, "keep", *self.keys)
        return self.step(f"""select {out} from (select *, row_number() over (partition by {t} order by {h}) as r_
            from {self.last}), (select first(c_ order by n_ desc, c_) as major_, max(n_) as most_ from ({sizes}))
          where {t} is not null and ({t} = major_ or r_ <= greatest({min_keep},
            cast(floor(most_ / {ratio}e0) as bigint)))""")

    def sql(self, extra=""):
        out = []
        for c in self.columns:
            if c in ("o_orderdate", "ts"):
                out.append(f"strftime({c}, '%Y-%m-%d %H:%M:%S.%f') as {c}")
            elif c in ("o_totalprice", "value", "p_retailprice"):
                out.append(f"round({c}, 6) as {c}")
            elif c in INTEGER:
                out.append(f"cast({c} as double) as {c}")
            else:
                out.append(c)
        return f"with {', '.join(self.ctes)} select {', '.join(out)}{extra} from {self.last}"


def shown(table: LabelledTable):
    """The corrupted table for comparison: times as text, doubles rounded, nullable integers as double."""
    out = []
    for c in table.df.columns:
        if c in ("o_orderdate", "ts"):
            out.append(F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(c))
        elif c in ("o_totalprice", "value", "p_retailprice"):
            out.append(F.round(c, 6).alias(c))
        elif c in INTEGER:
            out.append(F.col(c).cast("double").alias(c))
        else:
            out.append(F.col(c))
    return table.df.select(*out)


def corruption_query(name, on, sql, make):
    query(name, sql)(lambda spark, sf: shown(make(dataset(spark, sf, on))))


def levels_sql(on, levels, make):
    """UNION ALL of the single-level oracles with a severity column."""
    parts = [make(SqlTable(on), s).sql(f", {s}e0 as severity") for s in levels]
    return " union all ".join(f"select * from ({p})" for p in parts)


# ---- single corruptions -------------------------------------------------------------------------

for _rate in C.RATES:
    corruption_query(f"corrupt_missing_{int(_rate * 100):02d}", "orders",
                     SqlTable("orders").missing(_rate, 42).sql(),
                     partial(C.inject_missing, rate=_rate))
corruption_query("corrupt_missing_levels", "orders",
                 levels_sql("orders", C.RATES, lambda t, s: t.missing(s, 42)),
                 partial(C.inject_missing, rate=list(C.RATES)))
corruption_query("corrupt_missing_half_even", "part_brand",
                 SqlTable("part_brand").missing(0.0667, 42, "round").sql(),
                 partial(C.inject_missing, rate=0.0667, preset=C.EXPERIMENT))
corruption_query("corrupt_duplicates_with_replacement", "orders",
                 SqlTable("orders").duplicates_with_replacement(0.1, 42).sql(),
                 partial(C.inject_duplicates, rate=0.1))
corruption_query("corrupt_duplicates_with_replacement_levels", "events",
                 levels_sql("events", C.RATES, lambda t, s: t.duplicates_with_replacement(s, 42)),
                 partial(C.inject_duplicates, rate=list(C.RATES)))
corruption_query("corrupt_duplicates_distinct", "orders",
                 SqlTable("orders").duplicates(0.1, 342).sql(),
                 partial(C.inject_duplicates, rate=0.1, seed=342, preset=C.EXPERIMENT))
corruption_query("corrupt_duplicates_levels", "events",
                 levels_sql("events", C.RATES, lambda t, s: t.duplicates(s, 342)),
                 partial(C.inject_duplicates, rate=list(C.RATES), seed=342, preset=C.EXPERIMENT))
corruption_query("corrupt_label_noise_orders", "orders",
                 SqlTable("orders").label_noise(0.1, 42).sql(),
                 partial(C.inject_label_noise, rate=0.1))
corruption_query("corrupt_label_noise_labels", "labels",
                 SqlTable("labels").label_noise(0.1, 142, "round").sql(),
                 partial(C.inject_label_noise, rate=0.1, seed=142, preset=C.EXPERIMENT))
corruption_query("corrupt_label_noise_levels", "events",
                 levels_sql("events", C.RATES, lambda t, s: t.label_noise(s, 42)),
                 partial(C.inject_label_noise, rate=list(C.RATES)))
corruption_query("corrupt_outliers_median", "part",
                 SqlTable("part").outliers(0.1, 42).sql(),
                 partial(C.inject_outliers, rate=0.1))
corruption_query("corrupt_outliers_quartile", "events",
                 SqlTable("events").outliers(0.1, 242, "round", "quartile3").sql(),
                 partial(C.inject_outliers, rate=0.1, seed=242, preset=C.EXPERIMENT))
corruption_query("corrupt_outliers_levels", "orders",
                 levels_sql("orders", C.RATES, lambda t, s: t.outliers(s, 42)),
                 partial(C.inject_outliers, rate=list(C.RATES)))
for _ratio in C.RATIOS:
    corruption_query(f"corrupt_imbalance_{int(_ratio)}to1", "events",
                     SqlTable("events").imbalance(_ratio, 42).sql(),
                     partial(C.inject_imbalance, ratio=_ratio))
corruption_query("corrupt_imbalance_labels", "labels",
                 SqlTable("labels").imbalance(10.0, 442, 0).sql(),
                 partial(C.inject_imbalance, ratio=10.0, seed=442, preset=C.EXPERIMENT))
corruption_query("corrupt_imbalance_levels", "orders",
                 levels_sql("orders", C.RATIOS, lambda t, s: t.imbalance(s, 42)),
                 partial(C.inject_imbalance, ratio=list(C.RATIOS)))


# ---- combined corruptions -----------------------------------------------------------------------

def combined_sql(on, components, seed, seeds=None):
    table = SqlTable(on)
    stage = {"imbalance": 0, "duplicates": 2}
    for corruption, severity in sorted(components, key=lambda c: stage.get(c[0], 1)):
        s = seeds[corruption] if seeds else seed + C.SEED_OFFSETS[corruption]
        if corruption == "imbalance":
            table.imbalance(severity, s, 0)
        elif corruption == "outliers":
            table.outliers(severity, s, "round", "quartile3")
        else:
            getattr(table, corruption)(severity, s, "round")
    return table.sql()


for _name, _parts in C.CONDITIONS.items():
    corruption_query(f"corrupt_{_name}", "events", combined_sql("events", _parts, 42),
                     partial(C.corrupt_combined, components=_name, seed=42))
corruption_query("corrupt_combined_fixed_seeds", "orders",
                 combined_sql("orders", C.CONDITIONS["missing_noise_outliers"], 0, C.FIXED_SEEDS),
                 partial(C.corrupt_combined, components="missing_noise_outliers", seed=0, seeds=C.FIXED_SEEDS))


# ---- a table without a key ----------------------------------------------------------------------

_CONTENT_KEY = """md5(concat_ws('|', sha256(concat(
    coalesce(concat(length(text), ':', text), '-'), coalesce(concat(length(lang), ':', lang), '-'),
    coalesce(concat(length(source), ':', source), '-'))),
  cast(row_number() over (partition by text, lang, source) as varchar)))"""


@query("corrupt_keyless_documents", f"""with k as (select text, lang, source, {_CONTENT_KEY} as row_key from documents),
  c as (select list(distinct lang order by lang) as classes from documents),
  r as (select *, row_number() over (order by {sql_hash(42, 'row', 'row_key')}) as r_,
    list_filter(classes, lambda x: x <> lang) as others from k, c)
  select md5(text) as text_id, source, case when r_ <= cast(floor((select count(*) from k)::double * 0.1e0) as bigint)
    then list_extract(others, {sql_choice(sql_hash(42, 'pick', 'row_key'), 'len(others)')} + 1) else lang end as lang
  from r""")
def corrupt_keyless_documents(spark, sf):
    """Label noise on a table without key columns: copies of a row are told apart by number."""
    table = LabelledTable(raw(spark, sf, "documents").select("text", "lang", "source"), "lang")
    return C.inject_label_noise(table, 0.1).df.select(F.md5("text").alias("text_id"), "source", "lang")


# ---- self-check ---------------------------------------------------------------------------------

def check_sql(on, kind, table: SqlTable):
    base = DATASETS[on][0]
    key = DATASETS[on][1][0]
    diff = [f"case when b.{c} is distinct from a.{c} then 1 else 0 end" for c in table.features]
    nulled = " + ".join(f"case when b.{c} is not null and a.{c} is null then 1 else 0 end" for c in table.features)
    added = "a.copy_no > 0" if "copy_no" in table.keys else "false"
    both = f"b.{key} is not null and a.{key} is not null and not coalesce({added}, false)"
    return f"""select * from (with {', '.join(table.ctes)} select '{kind}' as corruption,
      cast(count(*) filter (where b.{key} is not null and not coalesce({added}, false)) as bigint) as clean_rows,
      cast(count(a.{key}) as bigint) as corrupted_rows,
      cast(count(*) filter (where a.{key} is null) as bigint) as removed_rows,
      cast(count(*) filter (where {added}) as bigint) as added_rows,
      cast(coalesce(sum({nulled}) filter (where {both}), 0) as bigint) as cells_nulled,
      cast(coalesce(sum({' + '.join(diff)}) filter (where {both}), 0) as bigint) as cells_changed,
      cast(count(*) filter (where {both} and {' + '.join(diff)} > 0) as bigint) as rows_changed,
      cast(count(*) filter (where {both} and b.{table.target} is distinct from a.{table.target}) as bigint)
        as labels_changed
      from {base} b full join {table.last} a on a.{key} = b.{key})"""


@query("corruption_check", " union all ".join([
    check_sql("orders", "missing", SqlTable("orders").missing(0.1, 53, "round")),
    check_sql("orders", "duplicates", SqlTable("orders").duplicates(0.1, 86, "round")),
    check_sql("orders", "label_noise", SqlTable("orders").label_noise(0.1, 64, "round")),
    check_sql("orders", "outliers", SqlTable("orders").outliers(0.1, 75, "round", "quartile3")),
    check_sql("orders", "imbalance", SqlTable("orders").imbalance(5.0, 97, 0)),
]))
def corruption_check(spark, sf):
    """Each corruption applied by name, then compared with the clean table row by row."""
    clean = dataset(spark, sf, "orders")
    out = None
    for kind in ("missing", "duplicates", "label_noise", "outliers", "imbalance"):
        severity = 5.0 if kind == "imbalance" else 0.1
        one = C.corruption_check(clean, C.corrupt(clean, kind, severity, 42)).select(
            F.lit(kind).alias("corruption"), "*")
        out = one if out is None else out.unionByName(one)
    return out


def ratio_sql(on, kind, table: SqlTable):
    base, target = DATASETS[on][0], DATASETS[on][3]
    states = [f"""select '{kind}' as corruption, '{state}' as state, cast(count(*) as bigint) as classes,
      cast(max(n) as bigint) as largest, cast(min(n) as bigint) as smallest, max(n)::double / min(n) as ratio
      from (select count(*) as n from {rows} where {target} is not null group by {target})"""
              for state, rows in (("clean", base), ("corrupted", table.last))]
    return f"select * from (with {', '.join(table.ctes)} {' union all '.join(states)})"


@query("corruption_class_ratios", " union all ".join([
    ratio_sql("orders", "imbalance", SqlTable("orders").imbalance(5.0, 97, 0)),
    ratio_sql("orders", "label_noise", SqlTable("orders").label_noise(0.1, 64, "round")),
    ratio_sql("orders", "duplicates", SqlTable("orders").duplicates(0.1, 86, "round")),
]))
def corruption_class_ratios(spark, sf):
    """Rows of the largest and the smallest class, and their ratio, before and after each corruption that moves it."""
    clean = dataset(spark, sf, "orders")
    out = None
    for kind, severity in (("imbalance", 5.0), ("label_noise", 0.1), ("duplicates", 0.1)):
        one = C.class_ratio_check(clean, C.corrupt(clean, kind, severity, 42)).select(F.lit(kind).alias("corruption"), "*")
        out = one if out is None else out.unionByName(one)
    return out


# ---- sampling primitives ------------------------------------------------------------------------

@query("smallest_hashes_orders", f"""select o_orderkey, o_orderstatus from
  (select *, row_number() over (order by {sql_hash(7, 'row', 'o_orderkey')}) as r from orders)
  where r <= (select cast(floor(count(*)::double * 0.07e0) as bigint) from orders)""")
def smallest_hashes_orders(spark, sf):
    """Exactly k rows in seeded random order, as a row-local filter."""
    df = raw(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    n = df.count()
    h = seeded_hash(7, "row", F.col("o_orderkey"))
    k = int(n * 0.07)
    return df.where(h <= kth_hash(df.select(h.alias("h")), n, [k])[k])


@query("hash_ranks_orders", f"""select o_orderkey, o_orderstatus, cast(row_number() over (
    partition by o_orderstatus order by {sql_hash(7, 'rank', 'o_orderkey')}) as bigint) as place,
  cast(count(*) over (partition by o_orderstatus) as bigint) as class_rows from orders""")
def hash_ranks_orders(spark, sf):
    """Place of every row in a seeded random order of its class."""
    df = raw(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    ranked = prefix_sums(df.withColumn("h", seeded_hash(7, "rank", F.col("o_orderkey"))),
                         ["o_orderstatus"], "h", F.lit(1), df.count())
    return ranked.select("o_orderkey", "o_orderstatus", (F.col("before") + 1).alias("place"),
                         F.col("total").alias("class_rows"))


@query("touched_counts", """select t as dataset, n, rate, cast(floor(n::double * rate) as bigint) as truncated,
  cast(round_even(n::double * rate, 0) as bigint) as half_even from (
    select 'orders' as t, count(*) as n from orders union all select 'labels', count(*) from labels
    union all select 'events', count(*) from events), (values (0.05e0), (0.1e0), (0.2e0), (0.0125e0)) r(rate)""")
def touched_counts(spark, sf):
    """Rows that a corruption of each rate touches, by the counts of the two kinds of preset."""
    sizes = {name: raw(spark, sf, name).count() for name in ("orders", "labels", "events")}
    rows = [(name, n, rate, C.LIBRARY.count(n, rate), C.EXPERIMENT.count(n, rate))
            for name, n in sizes.items() for rate in (*C.RATES, 0.0125)]
    return spark.createDataFrame(rows, "dataset string, n long, rate double, truncated long, half_even long")


@query("conditions_by_dataset", """with d as (select distinct event_type as dataset from events),
  c(corruption, severity) as (values ('missing', 0.05e0), ('missing', 0.1), ('missing', 0.2), ('duplicates', 0.05),
    ('duplicates', 0.1), ('duplicates', 0.2), ('label_noise', 0.05), ('label_noise', 0.1), ('label_noise', 0.2),
    ('outliers', 0.05), ('outliers', 0.1), ('outliers', 0.2), ('imbalance', 2), ('imbalance', 5), ('imbalance', 10)),
  x(dataset, corruption) as (values ('click', 'outliers'), ('click', 'imbalance'), ('error', 'imbalance'))
  select d.dataset, c.corruption, c.severity, case when c.corruption = 'imbalance'
      then 'imbalance_' || cast(c.severity::bigint as varchar) || 'to1'
      else c.corruption || '_' || cast(cast(floor(round(c.severity * 100, 9)) as bigint) as varchar) end as condition
  from d, c where not exists (select 1 from x where x.dataset = d.dataset and x.corruption = c.corruption)""")
def conditions_by_dataset(spark, sf):
    """The condition grid without the corruptions that do not apply to a dataset."""
    from sturdytab.plans.grid import applicable_conditions

    names = raw(spark, sf, "events").select(F.col("event_type").alias("dataset")).distinct()
    return applicable_conditions(names, {"click": ("outliers", "imbalance"), "error": ("imbalance",)})


@query("distinct_classes", """select 'events' as dataset, event_type as label from events group by 2
  union all select 'orders', o_orderstatus from orders group by 2""")
def distinct_classes(spark, sf):
    events = raw(spark, sf, "events").select(F.lit("events").alias("dataset"), F.col("event_type").alias("label"))
    orders = raw(spark, sf, "orders").select(F.lit("orders").alias("dataset"), F.col("o_orderstatus").alias("label"))
    return events.distinct().unionByName(orders.distinct())


# ---- splits -------------------------------------------------------------------------------------

def _group_split_sql(name, seed=42, folds=5):
    table, (key,), features, target = DATASETS[name]
    text = ", ".join(f"coalesce(cast({c} as varchar), 'nan')" for c in features)
    group = sql_hash(seed, "group", f"concat_ws('||', {text})")
    return f"""with r as (select {key}, {target} as label, {group} as g from {table}),
      gl as (select g, label, count(*) as n from r group by 1, 2),
      gr as (select g, g as h, sum(n) as size, first(label order by n desc, label) as dominant from gl group by g),
      f as (select g, cast(floor({folds} * (sum(size) over (partition by dominant order by h) - size)
        / sum(size) over (partition by dominant)) as integer) as fold from gr)
      select r.{key}, r.label, f.fold from r join f using (g)"""


def _group_split(spark, sf, name):
    t = dataset(spark, sf, name)
    return group_split(t).select(*t.keys, F.col(t.target).alias("label"), "fold")


for _name in ("part_brand", "events_user"):
    query(f"split_groups_{_name}", _group_split_sql(_name))(partial(_group_split, name=_name))


def _ranked_sql(name, tag, value, seed=42):
    table, (key,), _, target = DATASETS[name]
    return f"""select {key}, label, {value} from (select {key}, {target} as label,
      row_number() over (partition by {target} order by {sql_hash(seed, tag, key)}) as r,
      count(*) over (partition by {target}) as n from {table} where {target} is not null)"""


def _holdout(spark, sf, name):
    t = dataset(spark, sf, name)
    return holdout_split(t).select(*t.keys, F.col(t.target).alias("label"), "part")


def _folds(spark, sf, name):
    t = dataset(spark, sf, name)
    return stratified_folds(t).select(*t.keys, F.col(t.target).alias("label"), "fold")


for _name in ("labels", "orders"):
    query(f"split_holdout_{_name}", _ranked_sql(
        _name, "holdout", "case when r <= round_even(0.2e0 * n, 0) then 'test' else 'train' end as part"))(
        partial(_holdout, name=_name))
    query(f"split_folds_{_name}", _ranked_sql(
        _name, "fold", "cast(floor((r - 1) * 3 / n) as integer) as fold"))(partial(_folds, name=_name))


@query("subset_orders", f"""with c as (select o_orderstatus as label, count(*) as n from orders group by 1),
  q as (select label, n, n * 1000 // sum(n) over () as base, (n * 1000) % sum(n) over () as rest from c),
  p as (select *, base + case when row_number() over (order by rest desc, label)
    <= 1000 - sum(base) over () then 1 else 0 end as quota from q)
  select o_orderkey, o_orderstatus from (select *, row_number() over (partition by o_orderstatus
    order by {sql_hash(42, 'subset', 'o_orderkey')}) as r from orders) join p on label = o_orderstatus
  where r <= quota""")
def subset_orders(spark, sf):
    """Exactly 1,000 rows with the class shares of the table."""
    return stratified_subset(dataset(spark, sf, "orders"), 1000).df.select("o_orderkey", "o_orderstatus")


# ---- preparation --------------------------------------------------------------------------------

@query("prepared_orders", f"""with {', '.join(SqlTable('orders').missing(0.2, 42).ctes)},
  a as (select median(o_custkey::double) as m1, median(o_totalprice) as m2 from s0),
  b as (select o_orderpriority as top from s0 where o_orderpriority is not null group by 1
    order by count(*) desc, 1 limit 1),
  i as (select o_orderkey, o_orderstatus, coalesce(o_custkey::double, m1) as x1, coalesce(o_totalprice, m2) as x2,
    coalesce(o_orderpriority, top) as x3 from s0, a, b)
  select o_orderkey, o_orderstatus, round((x1 - (select avg(x1) from i)) / (select stddev_pop(x1) from i), 6)
      as o_custkey, round((x2 - (select avg(x2) from i)) / (select stddev_pop(x2) from i), 6) as o_totalprice,
    x3 as o_orderpriority from i""")
def prepared_orders(spark, sf):
    """Median and mode imputation, then scaling by the population deviation; time columns are no features."""
    noisy = C.inject_missing(dataset(spark, sf, "orders"), 0.2)
    prepared = fit_prep(noisy).transform(noisy.df, ["o_orderkey", "o_orderstatus"])
    return rounded(prepared, 6, "o_custkey", "o_totalprice")


@query("label_codes_events", """select event_id, event_type, cast(dense_rank() over (order by event_type) - 1 as integer)
  as code, event_type as decoded from events""")
def label_codes_events(spark, sf):
    """Labels coded by ascending class and decoded again."""
    df = raw(spark, sf, "events").select("event_id", "event_type")
    classes = class_list(df, "event_type")
    coded = by_class(df, "event_type", {c: (i,) for i, c in enumerate(classes)}, ["code"], ["int"])
    return by_class(coded, "code", {i: (c,) for i, c in enumerate(classes)}, ["decoded"], ["string"])


# ---- metrics ------------------------------------------------------------------------------------

def _rule() -> Column:
    """A prediction by rule that also gives a label the truth does not know."""
    names = F.array(*[F.lit(x) for x in ("click", "error", "purchase", "signup", "other")])
    return F.when(F.col("value") > 20, F.col("event_type")).otherwise(
        F.element_at(names, (F.pmod("user_id", F.lit(5)) + 1).cast("int")))


_RULE_SQL = """select event_type as truth, case when value > 20 then event_type
  else list_extract(['click', 'error', 'purchase', 'signup', 'other'], user_id % 5 + 1) end as prediction from events"""
_LABELS_SQL = """with c as (select truth, prediction, count(*) as n from ({source}) group by 1, 2),
  l as (select label, coalesce(support, 0) as support, coalesce(predicted, 0) as predicted, coalesce(hits, 0) as hits
    from (select truth as label from c union select prediction from c) a
    left join (select truth as label, sum(n) as support from c group by 1) using (label)
    left join (select prediction as label, sum(n) as predicted from c group by 1) using (label)
    left join (select truth as label, sum(n) as hits from c where truth = prediction group by 1) using (label)),
  s as (select *, case when predicted > 0 then hits / predicted else 0 end as p,
    case when support > 0 then hits / support else 0 end as r,
    case when support + predicted > 0 then 2 * hits / (support + predicted) else 0 end as f from l)"""
_SCORES_SQL = """select round(sum(hits) / sum(support), 9) as accuracy,
  round(avg(r) filter (where support > 0), 9) as balanced_accuracy, round(avg(p), 9) as macro_precision,
  round(avg(r), 9) as macro_recall, round(avg(f), 9) as macro_f1 from s"""


def _rule_confusion(spark, sf):
    return confusion(raw(spark, sf, "events").withColumn("guess", _rule()), "event_type", "guess")


@query("confusion_events", f"""select truth, prediction, cast(count(*) as bigint) as n from ({_RULE_SQL})
  group by 1, 2""")
def confusion_events(spark, sf):
    return _rule_confusion(spark, sf)


@query("label_scores_events", _LABELS_SQL.format(source=_RULE_SQL) + """ select label,
  cast(support as bigint) as support, cast(predicted as bigint) as predicted, cast(hits as bigint) as hits,
  round(p::double, 9) as precision, round(r::double, 9) as recall, round(f::double, 9) as f1 from s""")
def label_scores_events(spark, sf):
    return rounded(label_scores(_rule_confusion(spark, sf)), 9, "precision", "recall", "f1")


SCORE_COLUMNS = ("accuracy", "balanced_accuracy", "macro_precision", "macro_recall", "macro_f1")


@query("macro_scores_events", _LABELS_SQL.format(source=_RULE_SQL) + _SCORES_SQL)
def macro_scores_events(spark, sf):
    return rounded(scores(_rule_confusion(spark, sf)), 9, *SCORE_COLUMNS)


_LENGTH_SQL = """select quality as truth, case when n_chars > 400 then 1 else 0 end as prediction
  from labels join documents using (doc_id)"""


@query("macro_scores_documents", _LABELS_SQL.format(source=_LENGTH_SQL) + _SCORES_SQL)
def macro_scores_documents(spark, sf):
    """Quality predicted from the text length."""
    joined = raw(spark, sf, "labels").join(raw(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id")
    guess = joined.withColumn("guess", (F.col("n_chars") > 400).cast("int"))
    return rounded(scores(confusion(guess, "quality", "guess")), 9, *SCORE_COLUMNS)
