import pytest
from pyspark.sql import functions as F

from sturdytab.operators import profile as P, selector as S

COND = {"one": [("missing", 0.1), ("label_noise", 0.1), ("duplicates", 0.1)]}


def frames(spark, clean, single, combined):
    return (
        spark.createDataFrame(clean, "dataset string, model string, clean_f1 double"),
        spark.createDataFrame(single, "dataset string, seed long, model string, corruption string, severity double, macro_f1 double"),
        spark.createDataFrame(combined, "dataset string, condition string, seed long, model string, macro_f1 double"),
    )


def test_formulas(spark):
    parts = frames(
        spark, [("d", "m", 0.8)],
        [("d", 1, "m", "missing", 0.1, 0.6), ("d", 1, "m", "label_noise", 0.1, 0.4), ("d", 1, "m", "duplicates", 0.1, 0.9)],
        [("d", "one", 1, "m", 0.5)])
    got = {r["formula"]: r["aggregate"] for r in S.formula_scores(*parts, ["m"], COND).collect()}
    want = {"multiplicative": 0.3, "geometric_mean": 0.6, "arithmetic_mean": 0.633333, "harmonic_mean": 0.568421,
            "minimum": 0.4, "additive_drop": 0.2, "mean_f1": 0.633333}
    assert {k: round(v, 6) for k, v in got.items()} == want
    blend = S.blended(S.formula_scores(*parts, ["m"], COND))
    assert blend.where("formula = 'multiplicative' and weight_step = 10").first()["estimate"] == 0.55


def test_absent_components_and_worthless_models(spark):
    parts = frames(spark, [("d", "m", 0.8), ("d", "z", 0.0)], [], [("d", "one", 1, "m", 0.5), ("d", "one", 1, "z", 0.1)])
    got = S.formula_scores(*parts, ["m", "z"], COND)
    assert {round(r["aggregate"], 9) for r in got.where("model = 'm'").collect()} == {0.8}
    assert got.where("model = 'z' and formula = 'multiplicative'").first()["aggregate"] == 0.0
    per_seed = S.per_seed_selection(*parts, ["m", "z"], COND).first()
    assert (per_seed["selected_model"], per_seed["selected_predicted_f1"], per_seed["correct"]) == ("m", 0.8, True)


def test_ties_go_to_the_earlier_model(spark):
    parts = frames(spark, [("d", "b", 0.5), ("d", "a", 0.5)], [], [("d", "one", 1, "a", 0.4), ("d", "one", 1, "b", 0.4)])
    row = S.per_seed_selection(*parts, ["b", "a"], COND).first()
    assert (row["selected_model"], row["oracle_model"], row["regret"]) == ("b", "b", 0.0)


def test_strategy_ties_go_to_smaller_weight_then_earlier_formula(spark):
    parts = frames(
        spark, [(d, m, 0.5) for d in "xy" for m in "ab"], [],
        [(d, "one", 1, m, f) for d in "xy" for m, f in (("a", 0.4), ("b", 0.3))])
    evaluated = S.evaluated_strategies(*parts, ["a", "b"], COND)
    best = S.best_strategies(S.strategy_scores(evaluated)).collect()
    assert {(r["held_out"], r["formula"], r["weight_step"], r["source_accuracy"]) for r in best} == {
        ("x", "multiplicative", 0, 1.0), ("y", "multiplicative", 0, 1.0)}
    loo = S.leave_one_out(evaluated, S.best_strategies(S.strategy_scores(evaluated)))
    assert S.overall_summary(loo).first().asDict() == {
        "datasets": 2, "cases": 2, "correct": 2, "selection_accuracy": 1.0, "mean_regret": 0.0}


def test_a_source_that_is_never_held_out(spark):
    parts = frames(spark, [(d, "a", 0.5) for d in "xyz"], [], [(d, "one", 1, "a", 0.4) for d in "xyz"])
    scores = S.strategy_scores(S.evaluated_strategies(*parts, ["a"], COND), ["x", "y"])
    assert {r["held_out"] for r in scores.collect()} == {"x", "y"}
    assert {r["source_cases"] for r in scores.collect()} == {2}


def test_duplicate_lookup_rows_do_not_multiply(spark):
    parts = frames(spark, [("d", "a", 0.5), ("d", "a", 0.5)],
                   [("d", 1, "a", "missing", 0.1, 0.4)] * 3, [("d", "one", 1, "a", 0.4)])
    assert S.component_scores(*parts, ["a"], COND).count() == 3


# Mean published macro F1 over three seeds: the best model of each condition.
PUBLISHED = [
    ("car_evaluation", "missing_noise", "Random Forest", 0.6878),
    ("car_evaluation", "missing_noise_duplicates", "SVM", 0.7309),
    ("mobile_price", "missing_imbalance", "Logistic Regression", 0.7837),
]


def test_published_winners(spark):
    rows = []
    for dataset, condition, model, f1 in PUBLISHED:
        rows += [(dataset, condition, model, f1, 0.5), (dataset, condition, "Decision Tree", f1 - 0.01, 0.5)]
    df = spark.createDataFrame(rows, "dataset string, condition string, model string, macro_f1 double, balanced_accuracy double")
    got = P.condition_winners(df, F.col("model"))
    assert sorted((r[0], r[1], r[2], r[3]) for r in got.collect()) == sorted(PUBLISHED)


def test_profile_scores_are_limited(spark):
    df = spark.createDataFrame(
        [("d", "m", "c", 0.9, -0.2, 0.0), ("d", "n", "c", 0.2, 0.6, 0.1), (None, "n", "c", 0.2, 0.6, 0.1),
         ("d", "o", "c", 0.2, None, 0.1)],
        "dataset string, model string, corruption string, macro_f1 double, macro_f1_drop double, accuracy_drop double")
    got = {r["model"]: r["robustness_score"] for r in P.model_profile(df).collect()}
    assert got == {"m": 1.0, "n": 0.4, "o": None}


@pytest.mark.parametrize("clean,f,expected", [(0.8, 0.6, 0.25), (0.8, 0.9, 0.0), (0.0, 0.5, 0.0)])
def test_relative_drop(spark, clean, f, expected):
    got = spark.range(1).select(P.relative_drop(F.lit(clean), F.lit(f))).first()[0]
    assert got == pytest.approx(expected)
