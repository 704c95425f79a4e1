"""Robustness profiles and model selection over score tables derived from lineitem and part.

No given table holds model scores, so they are derived by a fixed rule: the dataset is return flag + line
status, the model the part type, the seed the order key modulo 3. Line numbers 1-4 are the single corruptions
(score from the mean discount), 5-7 the combined conditions (score from the mean tax).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from sturdytab.operators import profile as P, selector as S
from sturdytab.queries.auditing import rounded
from sturdytab.queries.base import query, raw
from sturdytab.session import settle

SINGLE = {1: "missing", 2: "label_noise", 3: "duplicates", 4: "outliers"}
COMBINED = {5: "missing_noise", 6: "missing_noise_duplicates", 7: "missing_noise_outliers"}
SEVERITY = 0.1
CONDITIONS = {
    "missing_noise": [("missing", 0.1), ("label_noise", 0.1)],
    "missing_noise_duplicates": [("missing", 0.1), ("label_noise", 0.1), ("duplicates", 0.1)],
    "missing_noise_outliers": [("missing", 0.1), ("label_noise", 0.1), ("outliers", 0.1)],
}

BASE_SQL = """base as (select concat(l_returnflag, l_linestatus) as dataset, p_type as model,
    l_orderkey % 3 as seed, l_linenumber as ln, cast(round(l_discount * 100) as bigint) as d,
    cast(round(l_tax * 100) as bigint) as x from lineitem join part on p_partkey = l_partkey),
  m as (select model, row_number() over (order by model) as ord from (select distinct model from base)),
  cl as (select dataset, model, round(sum(d)::double / count(*) / 10 + 0.1, 6) as cf from base group by 1, 2),
  sg as (select dataset, seed, model, case ln when 1 then 'missing' when 2 then 'label_noise' when 3 then 'duplicates'
    else 'outliers' end as corruption, round(sum(d)::double / count(*) / 10, 6) as f
    from base where ln <= 4 group by 1, 2, 3, 4),
  cb as (select dataset, seed, model, case ln when 5 then 'missing_noise' when 6 then 'missing_noise_duplicates'
    else 'missing_noise_outliers' end as condition, round(sum(x)::double / count(*) / 8, 6) as f
    from base where ln >= 5 group by 1, 2, 3, 4),
  comp(condition, corruption) as (values ('missing_noise', 'missing'), ('missing_noise', 'label_noise'),
    ('missing_noise_duplicates', 'missing'), ('missing_noise_duplicates', 'label_noise'),
    ('missing_noise_duplicates', 'duplicates'), ('missing_noise_outliers', 'missing'),
    ('missing_noise_outliers', 'label_noise'), ('missing_noise_outliers', 'outliers'))"""


def score_base(spark, sf):
    part = raw(spark, sf, "part").select("p_partkey", F.col("p_type").alias("model"))
    lines = raw(spark, sf, "lineitem").select(
        F.concat("l_returnflag", "l_linestatus").alias("dataset"), F.col("l_partkey").alias("p_partkey"),
        (F.col("l_orderkey") % 3).alias("seed"), F.col("l_linenumber").alias("ln"),
        F.round(F.col("l_discount") * 100).cast("bigint").alias("d"),
        F.round(F.col("l_tax") * 100).cast("bigint").alias("x"))
    return lines.join(part, "p_partkey")


def score_tables(spark, sf):
    """(clean, single, combined, models); the model list is the few part types in name order.

    The large tables are read once: sums per (dataset, seed, model, line number) are kept, all scores follow from them.
    """
    sums = settle(score_base(spark, sf).groupBy("dataset", "seed", "model", "ln").agg(
        F.sum("d").alias("d"), F.sum("x").alias("x"), F.count("*").alias("n")), "scores")

    def label(names):
        out = F.lit(None)
        for number, name in names.items():
            out = F.when(F.col("ln") == number, name).otherwise(out)
        return out

    def mean(value, over):
        return F.sum(value).cast("double") / F.sum("n") / over

    clean = sums.groupBy("dataset", "model").agg(F.round(mean("d", 10) + 0.1, 6).alias("clean_f1"))
    single = sums.where("ln <= 4").groupBy("dataset", "seed", "model", label(SINGLE).alias("corruption")).agg(
        F.round(mean("d", 10), 6).alias("macro_f1")).withColumn("severity", F.lit(SEVERITY))
    combined = sums.where("ln >= 5").groupBy("dataset", "seed", "model", label(COMBINED).alias("condition")).agg(
        F.round(mean("x", 8), 6).alias("macro_f1"))
    models = sorted(r[0] for r in sums.select("model").distinct().collect())  # a handful of part types
    return clean, single, combined, models


# ---- profiles -----------------------------------------------------------------------------------

PROFILE_SQL = f"""with {BASE_SQL},
  j as (select sg.*, cf, cf - f as drop_, (cf - 0.05) - (f - 0.02) as acc_drop from sg left join cl using (dataset, model))"""


def profile_results(spark, sf):
    """Single scores in the layout of experiment results; accuracies are fixed offsets of the macro F1."""
    clean, single, _, _ = score_tables(spark, sf)
    results = single.select(
        "dataset", "model", "seed", "corruption", "severity", "macro_f1",
        (F.col("macro_f1") - 0.02).alias("accuracy"), (F.col("macro_f1") - 0.01).alias("balanced_accuracy"))
    base = clean.select("dataset", "model", F.col("clean_f1").alias("macro_f1"),
                        (F.col("clean_f1") - 0.05).alias("accuracy"),
                        (F.col("clean_f1") - 0.03).alias("balanced_accuracy"))
    return P.with_drops(P.with_clean_scores(results, base))


PROFILE_COLUMNS = ("mean_macro_f1", "mean_macro_f1_drop", "worst_macro_f1", "worst_macro_f1_drop",
                   "mean_accuracy_drop", "robustness_score")
PROFILE_AGGS = """round(avg(f), 9) as mean_macro_f1, round(avg(drop_), 9) as mean_macro_f1_drop,
  round(min(f), 9) as worst_macro_f1, round(max(drop_), 9) as worst_macro_f1_drop,
  round(avg(acc_drop), 9) as mean_accuracy_drop, round(least(1, 1 - greatest(0, avg(drop_))), 9) as robustness_score"""


@query("result_drops", PROFILE_SQL + """ select dataset, model, seed, corruption, f as macro_f1,
  cf as clean_macro_f1, round(cf - f, 6) as macro_f1_drop, round(acc_drop, 6) as accuracy_drop,
  round((cf - 0.03) - (f - 0.01), 6) as balanced_accuracy_drop, round(1 - (cf - f), 6) as robustness_score,
  round(case when cf > 0 then greatest(0, cf - f) / cf else 0 end, 6) as relative_drop from j""")
def result_drops(spark, sf):
    """Drops against the clean scores, the record robustness and the relative drop."""
    out = P.with_robustness(profile_results(spark, sf)).withColumn(
        "relative_drop", P.relative_drop(F.col("clean_macro_f1"), F.col("macro_f1")))
    return rounded(out.select(
        "dataset", "model", "seed", "corruption", "macro_f1", "clean_macro_f1", "macro_f1_drop", "accuracy_drop",
        "balanced_accuracy_drop", "robustness_score", "relative_drop"), 6,
        "macro_f1_drop", "accuracy_drop", "balanced_accuracy_drop", "robustness_score", "relative_drop")


@query("profile_models", PROFILE_SQL + f" select dataset, model, corruption, {PROFILE_AGGS} from j group by 1, 2, 3")
def profile_models(spark, sf):
    return rounded(P.model_profile(profile_results(spark, sf)), 9, *PROFILE_COLUMNS)


@query("profile_datasets", PROFILE_SQL + f" select dataset, model, {PROFILE_AGGS} from j group by 1, 2")
def profile_datasets(spark, sf):
    return rounded(P.dataset_profile(profile_results(spark, sf)), 9, *PROFILE_COLUMNS)


@query("profile_winners", f"""with {BASE_SQL},
  a as (select dataset, condition, model, round(avg(f), 9) as f from cb group by 1, 2, 3)
  select dataset, condition, model, f as macro_f1, round(f - 0.01, 9) as balanced_accuracy from
  (select *, row_number() over (partition by dataset, condition order by f desc, model) as r from a) where r = 1""")
def profile_winners(spark, sf):
    """Best model per dataset and condition; the first in name order wins a tie."""
    _, _, combined, _ = score_tables(spark, sf)
    means = S.mean_actuals(combined).select(
        "dataset", "condition", "model", F.col("actual").alias("macro_f1"),
        F.round(F.col("actual") - 0.01, 9).alias("balanced_accuracy"))
    return P.condition_winners(means, F.col("model"))


# ---- per-seed selector --------------------------------------------------------------------------

SEED_SQL = f"""with {BASE_SQL},
  v as (select k.dataset, k.condition, k.seed, m.model, m.ord, cl.cf, case when sg.f is null then 1e0
      else 1 - least(1, greatest(0, case when cl.cf > 0 then greatest(0, cl.cf - sg.f) / cl.cf else 0 end)) end as kept
    from (select distinct dataset, condition, seed from cb) k, m
    join cl on cl.dataset = k.dataset and cl.model = m.model join comp on comp.condition = k.condition
    left join sg on sg.dataset = k.dataset and sg.seed = k.seed and sg.model = m.model
      and sg.corruption = comp.corruption),
  e as (select dataset, condition, seed, model, ord, round(max(cf) * product(kept), 9) as est
    from v group by 1, 2, 3, 4, 5),
  r as (select e.*, cb.f, row_number() over (partition by seed, dataset, condition order by est desc, ord) as rp,
      row_number() over (partition by seed, dataset, condition order by f desc, ord) as ra
    from e join cb using (dataset, condition, seed, model)),
  s as (select seed, dataset, condition, max(case when rp = 1 then model end) as selected_model,
      max(case when ra = 1 then model end) as oracle_model, max(case when rp = 1 then est end) as selected_predicted_f1,
      max(case when rp = 1 then f end) as selected_actual_f1, max(case when ra = 1 then f end) as oracle_f1
    from r group by 1, 2, 3)"""


@query("selector_per_seed", SEED_SQL + """ select *, round(oracle_f1 - selected_actual_f1, 9) as regret,
  selected_model = oracle_model as correct from s""")
def selector_per_seed(spark, sf):
    clean, single, combined, models = score_tables(spark, sf)
    return rounded(S.per_seed_selection(clean, single, combined, models, CONDITIONS), 9, "regret")


@query("selector_summary", SEED_SQL + """ select case when grouping(seed) = 1 then 'OVERALL' else cast(seed as varchar) end
  as seed, cast(count(*) as bigint) as conditions_tested,
  cast(count(*) filter (where selected_model = oracle_model) as bigint) as correct_selections,
  round(count(*) filter (where selected_model = oracle_model) / count(*), 9) as selection_accuracy,
  round(avg(oracle_f1 - selected_actual_f1), 9) as mean_regret from s group by rollup (seed)""")
def selector_summary(spark, sf):
    clean, single, combined, models = score_tables(spark, sf)
    selected = S.per_seed_selection(clean, single, combined, models, CONDITIONS)
    return rounded(S.seed_summary(selected), 9, "selection_accuracy", "mean_regret")


# ---- formulas, blends, strategies ---------------------------------------------------------------

FORMULA_SQL = f"""{BASE_SQL},
  v as (select k.dataset, k.condition, k.seed, m.model, m.ord, cl.cf, greatest(coalesce(sg.f, cl.cf), 0) as f
    from (select distinct dataset, condition, seed from cb) k cross join m
    join cl on cl.dataset = k.dataset and cl.model = m.model join comp on comp.condition = k.condition
    left join sg on sg.dataset = k.dataset and sg.seed = k.seed and sg.model = m.model
      and sg.corruption = comp.corruption),
  a as (select dataset, condition, seed, model, ord, cf,
      case when cf <= 0 then 0 else cf * product(least(greatest(f / cf, 0), 1)) end as f1,
      exp(avg(ln(greatest(f, 1e-12)))) as f2, avg(f) as f3, count(*) / sum(1 / greatest(f, 1e-12)) as f4,
      min(f) as f5, greatest(0, cf - sum(greatest(cf - f, 0))) as f6, avg(f) as f7
    from v group by dataset, condition, seed, model, ord, cf),
  u as (select dataset, condition, seed, model, ord, cf, ford,
      case ford when 1 then f1 when 2 then f2 when 3 then f3 when 4 then f4 when 5 then f5 when 6 then f6 else f7 end as agg,
      list_extract(['multiplicative', 'geometric_mean', 'arithmetic_mean', 'harmonic_mean', 'minimum',
        'additive_drop', 'mean_f1'], cast(ford as integer)) as formula from a cross join range(1, 8) t(ford))"""
STRATEGY_SQL = FORMULA_SQL + """,
  p as (select dataset, condition, model, ord, ford, formula, w.i, round(avg(w.i * 0.05e0 * agg
      + (1 - w.i * 0.05e0) * cf), 9) as pred
    from u cross join range(21) w(i) group by dataset, condition, model, ord, ford, formula, w.i),
  t as (select dataset, condition, model, round(avg(f), 9) as act from cb group by 1, 2, 3),
  r as (select p.*, act,
      row_number() over (partition by p.dataset, p.condition, ford, i order by pred desc, ord) as rp,
      row_number() over (partition by p.dataset, p.condition, ford, i order by act desc, ord) as ra
    from p join t on t.dataset = p.dataset and t.condition = p.condition and t.model = p.model),
  e as (select dataset, condition, ford, formula, i, max(case when rp = 1 then model end) as sel,
      max(case when ra = 1 then model end) as ora, max(case when rp = 1 then pred end) as sel_pred,
      max(case when rp = 1 then act end) as sel_act, max(case when ra = 1 then act end) as ora_act,
      max(case when ra = 1 then act end) - max(case when rp = 1 then act end) as regret
    from r group by dataset, condition, ford, formula, i),
  h as (select hd.dataset as held, e.ford, e.formula, e.i, count(*) as cases,
      count(*) filter (where sel = ora) as hits,
      round(avg(case when sel = ora then 1e0 else 0e0 end), 9) as acc, round(avg(regret), 9) as reg
    from e join (select distinct dataset from e) hd on e.dataset <> hd.dataset group by hd.dataset, e.ford, e.formula, e.i),
  best as (select * from (select *, row_number() over (partition by held order by acc desc, reg, i, ford) as rn from h)
    where rn = 1)"""


@query("selector_formulas", f"""with {FORMULA_SQL} select dataset, condition, seed, model, round(cf, 9) as clean_f1,
  formula, round(agg, 9) as aggregate from u""")
def selector_formulas(spark, sf):
    clean, single, combined, models = score_tables(spark, sf)
    out = S.formula_scores(clean, single, combined, models, CONDITIONS)
    return rounded(out.select("dataset", "condition", "seed", "model", "clean_f1", "formula", "aggregate"), 9,
                   "clean_f1", "aggregate")


@query("selector_blend", f"""with {STRATEGY_SQL} select dataset, condition, model, formula, cast(i as integer) as
  weight_step, pred as estimate from p""")
def selector_blend(spark, sf):
    clean, single, combined, models = score_tables(spark, sf)
    out = S.blended(S.formula_scores(clean, single, combined, models, CONDITIONS))
    return out.select("dataset", "condition", "model", "formula", "weight_step", "estimate")


@query("selector_evaluated", f"""with {STRATEGY_SQL} select dataset, condition, formula, cast(i as integer) as
  weight_step, sel as selected_model, ora as oracle_model, sel_pred as selected_predicted_f1,
  sel_act as selected_actual_f1, ora_act as oracle_f1, round(regret, 9) as regret, sel = ora as correct from e""")
def selector_evaluated(spark, sf):
    evaluated = S.evaluated_strategies(*score_tables(spark, sf), CONDITIONS)
    return rounded(evaluated.drop("formula_ord"), 9, "regret")


@query("selector_strategy_scores", f"""with {STRATEGY_SQL} select held as held_out, formula, cast(i as integer) as
  weight_step, cast(cases as bigint) as source_cases, cast(hits as bigint) as source_correct,
  acc as source_accuracy, reg as source_mean_regret from h""")
def selector_strategy_scores(spark, sf):
    evaluated = S.evaluated_strategies(*score_tables(spark, sf), CONDITIONS)
    return S.strategy_scores(evaluated).drop("formula_ord")


@query("selector_strategies", f"""with {STRATEGY_SQL} select held as held_out, formula, cast(i as integer) as
  weight_step, acc as source_accuracy, reg as source_mean_regret from best""")
def selector_strategies(spark, sf):
    evaluated = S.evaluated_strategies(*score_tables(spark, sf), CONDITIONS)
    return S.best_strategies(S.strategy_scores(evaluated)).select(
        "held_out", "formula", "weight_step", "source_accuracy", "source_mean_regret")


def _leave_one_out(spark, sf):
    evaluated = S.evaluated_strategies(*score_tables(spark, sf), CONDITIONS)
    return S.leave_one_out(evaluated, S.best_strategies(S.strategy_scores(evaluated)))


LOO_SQL = STRATEGY_SQL + """, loo as (select e.*, cast(e.i as integer) * 0.05e0 as weight from e join best
  on best.held = e.dataset and best.ford = e.ford and best.i = e.i)"""


@query("selector_leave_one_out", f"""with {LOO_SQL} select dataset, condition, formula, round(weight, 9) as weight,
  sel as selected_model, ora as oracle_model, sel_pred as selected_predicted_f1, sel_act as selected_actual_f1,
  ora_act as oracle_f1, round(regret, 9) as regret, sel = ora as correct from loo""")
def selector_leave_one_out(spark, sf):
    return rounded(_leave_one_out(spark, sf), 9, "weight", "regret")


@query("selector_leave_one_out_summary", f"""with {LOO_SQL} select cast(count(distinct dataset) as bigint) as datasets,
  cast(count(*) as bigint) as cases, cast(count(*) filter (where sel = ora) as bigint) as correct,
  round(count(*) filter (where sel = ora) / count(*), 9) as selection_accuracy, round(avg(regret), 9) as mean_regret
  from loo""")
def selector_leave_one_out_summary(spark, sf):
    return rounded(S.overall_summary(_leave_one_out(spark, sf)), 9, "selection_accuracy", "mean_regret")


@query("selector_missing_baselines", f"""with {BASE_SQL} select d.dataset, m.model from (select distinct dataset from cb) d
  cross join m left join cl on cl.dataset = d.dataset and cl.model = m.model and cl.dataset <> 'AF'
  where cl.cf is null""")
def selector_missing_baselines(spark, sf):
    """The check before selecting: with the clean scores of one dataset left out, exactly its pairs are reported."""
    clean, _, combined, models = score_tables(spark, sf)
    return S.missing_baselines(combined, clean.where("dataset <> 'AF'"), models)


@query("score_rows_selected", f"""with {BASE_SQL} select dataset, seed, model, corruption, f as macro_f1 from sg
  where dataset in ('AF', 'NO', 'RO') and corruption = 'label_noise'""")
def score_rows_selected(spark, sf):
    """Scores of the evaluation datasets under one corruption."""
    _, single, _, _ = score_tables(spark, sf)
    return single.where(F.col("dataset").isin("AF", "NO", "RO") & (F.col("corruption") == "label_noise")).drop("severity")
