import pytest

from plumbline import fixed
from plumbline.operators import goals, trials

GOAL = "metric string, baseline double, chance double, ks double, low double, high double"


@pytest.mark.parametrize("row,threshold,flags", [
    (("roc_auc", 0.7444, 0.5, None, None, None), 0.8083, set()),
    (("f1", 0.995, 0.5, None, None, None), 0.99, set()),
    (("accuracy", 0.5, 0.89, None, None, None), 0.91, {"raised_to_clear_chance"}),
    (("accuracy", 0.5, 0.98, None, None, None), 1.0, {"raised_to_clear_chance", "exceeds_ceiling"}),
    (("mae", 10.0, 9.0, None, None, None), 7.5, set()),
    (("mae", 10.0, 7.0, None, None, None), 6.86, {"lowered_to_clear_chance"}),
    (("mae", 0.0, None, None, None, None), 0.0, {"demands_zero_error"}),
    (("balanced_accuracy", 0.6, 0.5, 0.6, None, None), 0.8, {"raised_to_ranking_floor"}),
    (("balanced_accuracy", 0.6, 0.5, 0.2, 0.5, 0.75), 0.7, {"exceeds_ranking_ceiling", "inside_baseline_ci"}),
    (("pr_auc", None, None, None, None, None), 0.70, set()), (("rmse", None, None, None, None, None), None, set()),
    (("own", None, None, None, None, None), 0.85, set()),
])
def test_bars(spark, row, threshold, flags):
    out = goals.derive_bars(spark.createDataFrame([row], GOAL)).first()
    assert out["threshold"] == threshold
    assert {n for n in goals.NOTES if out[n]} == flags
    if "exceeds_ranking_ceiling" in flags:
        assert (out["required_ks"], out["ks_shortfall"], out["passable_margin"]) == (0.4, 0.2, None)


def test_passable_margin_rounds_down(spark):
    out = goals.derive_bars(spark.createDataFrame([("balanced_accuracy", 0.6, None, 0.3, None, None)], GOAL), margin=0.5).first()
    assert out["threshold"] == 0.8 and out["passable_margin"] == 0.125


BASE = dict(run="r", iteration=1, model="logreg", metric="balanced_accuracy", direction="maximize", bar=0.8, score=0.7,
            status="ok", error_type=None, recall=0.7, specificity=0.7, roc_auc=0.75, headroom=0.02, ceiling=0.9,
            train_score=0.76, train_val_gap=None, weight=1.0, imbalance=2.5, pipeline="median", params="a", wall_sec=1.0)
SCHEMA = ("run string, iteration int, model string, metric string, direction string, bar double, score double, status string, error_type string, "
          "recall double, specificity double, roc_auc double, headroom double, ceiling double, train_score double, train_val_gap double, "
          "weight double, imbalance double, pipeline string, params string, wall_sec double")


def table(spark, *rows):
    return spark.createDataFrame([{**BASE, **r} for r in rows], SCHEMA)


@pytest.mark.parametrize("rows,rule,failure", [
    ([dict(status="error", error_type="oom")], "error", "oom"),
    ([dict(status="error", error_type="config_error")], "error", "data_issue"),
    ([dict(status="error", error_type="crash")], "error", "unknown"),
    ([dict(train_score=0.9)], "overfit", "overfitting"),
    ([dict(train_val_gap=0.2)], "overfit", "overfitting"),
    ([dict(metric="rmse", direction="minimize", score=13.0, train_score=10.0, bar=5.0)], "overfit", "overfitting"),
    ([dict(score=0.8), dict(iteration=2, score=0.7, roc_auc=0.746)], "collapse", "data_issue"),
    ([dict(recall=0.6)], "skew", "hyperparam"), ([dict(recall=0.6, headroom=0.001)], "other", "hyperparam"),
    ([dict(train_score=0.7)], "underfit", "underfitting"),
    ([dict(), dict(iteration=2), dict(iteration=3)], "plateau", "wrong_model_family"),
    ([dict(headroom=0.001, ceiling=0.75)], "ranking_limited", "wrong_model_family"),
    ([dict(score=0.85, train_score=0.86)], "cleared", "hyperparam"), ([dict()], "other", "hyperparam"),
])
def test_every_diagnosis_branch(spark, rows, rule, failure):
    out = trials.diagnose(table(spark, *rows)).orderBy("iteration").collect()[-1]
    assert (out["rule"], out["failure_type"]) == (rule, failure)


def test_stop_order(spark):
    rows = [dict(run="goal", score=0.9), dict(run="goal", iteration=2, score=0.5),
            *[dict(run="max", iteration=i, score=0.1 * i) for i in range(1, 7)],
            *[dict(run="stall", iteration=i, score=0.5) for i in range(1, 5)],
            dict(run="time", iteration=1, wall_sec=4000.0), dict(run="open")]
    out = {r["run"]: (r["stopped_at"], r["reason"]) for r in trials.stop_reasons(table(spark, *rows)).collect()}
    assert out == {"goal": (1, "goal_reached"), "max": (5, "max_iterations"), "stall": (3, "stalled"),
                   "time": (1, "out_of_time"), "open": (None, None)}


def test_failed_attempts_never_win_and_stall(spark):
    rows = [dict(status="error", score=0.99), dict(iteration=2, score=0.5), dict(iteration=3, status="error"), dict(iteration=4, score=0.4)]
    out = trials.stalls(table(spark, *rows)).orderBy("iteration").collect()
    assert [r["improved"] for r in out] == [False, True, False, False]
    assert [r["stall_count"] for r in out] == [1, 0, 1, 2]


def test_weight_steps_and_interpolation(spark):
    first = trials.propose_weight(table(spark, dict(recall=0.5))).first()["proposed_weight"]
    up = trials.propose_weight(table(spark, dict(recall=0.5, weight=2.0))).first()["proposed_weight"]
    down = trials.propose_weight(table(spark, dict(recall=0.9, weight=3.0))).first()["proposed_weight"]
    between = trials.propose_weight(table(
        spark, dict(recall=0.5, weight=1.0), dict(iteration=2, recall=0.9, weight=4.0))).orderBy("iteration").collect()[1]["proposed_weight"]
    assert (first, up, down, between) == (2.5, 3.0, 2.0, 2.5)


def test_candidate_order_and_families():
    assert trials.candidate_order(fixed.REGRESSION)[:2] == ["ridge", "linreg"]
    assert trials.cheapest(["gbdt", "kernel"], fixed.REGRESSION) == {"gbdt": "hist_gbdt", "kernel": None}
