"""The loop that plans itself: rules of the next attempt, its ledger, and what attempts share."""

import uuid

import pytest
from pyspark.sql import functions as F

from plumbline import fixed
from plumbline.operators import policy
from plumbline.plans import fits, search
from plumbline.session import shared_folder

ROW = dict(iteration=1, model="hist_gbdt", metric="balanced_accuracy", direction="maximize", score=0.7, status="ok", error_type=None, recall=0.7, specificity=0.7,
           roc_auc=0.8, ceiling=0.9, headroom=0.1, train_score=0.72, train_val_gap=None, bar=0.75, weight=1.0, imbalance=3.0, params={}, ran={}, wall_sec=1.0,
           pipeline="", tuned=False, origin="given")


def plan(spark, *rows, task=fixed.CLASSIFICATION):
    order = [p.split()[0] for p in search.TRIAL_SCHEMA.replace("map<string, string>", "map").split(", ")]
    table = spark.createDataFrame([tuple({"run": "r", **ROW, **r}[c] for c in order) for r in rows], search.TRIAL_SCHEMA)
    return policy.next_attempts(table, fits.PARAMS, task).first()


@pytest.mark.parametrize("row, origin, model, params", [
    ({"status": "error", "error_type": "oom", "params": {"max_iter": "90"}}, "oom", "logreg", {"max_iter": 300, "train_subsample": 0.5, "n_estimators": 50}),
    ({"status": "error", "error_type": "too_slow", "model": "decision_tree"}, "too_slow", "decision_tree", {"max_iter": 60, "train_subsample": 0.4}),
    ({"train_score": 0.9}, "overfitting", "hist_gbdt", {"l2_regularization": 1.0, "max_depth": 4, "learning_rate": 0.05}),
    ({"score": 0.6, "train_score": 0.6, "recall": 0.6, "specificity": 0.6, "params": {"max_iter": "100"}}, "underfitting", "hist_gbdt",
     {"max_iter": 300, "learning_rate": 0.08, "max_leaf_nodes": 63}),
    ({"recall": 0.5, "specificity": 0.9}, "weight", "hist_gbdt", {"class_weight": {"0": 1, "1": 3.0}}),
    ({"score": 0.8, "train_score": 0.8}, "hyperparam", "hist_gbdt", {"learning_rate": 0.05, "max_depth": 8, "max_iter": 400}),
    ({"status": "error", "error_type": "unsupported_model"}, "wrong_model_family", "random_forest", {"n_estimators": 300}),
])
def test_each_diagnosis_has_its_prescription(spark, row, origin, model, params):
    got = plan(spark, row)
    assert (got["origin"], got["model"], got["iteration"], policy.typed(got["params"])) == (origin, model, 2, params)


def test_a_repeat_takes_an_untried_model_then_more_rounds(spark):
    again = {"train_score": 0.9, "params": {"max_depth": "4", "learning_rate": "0.05"}}
    got = plan(spark, again)
    assert got["repeated"] and got["origin"] == "new_model" and got["model"] == "logreg"
    models = [c for c in policy.T.candidate_order(fixed.CLASSIFICATION) if c != "hist_gbdt"]
    rows = [{"iteration": i, "model": m} for i, m in enumerate(models, 1)]
    got = plan(spark, *rows, {**again, "iteration": len(rows) + 1})
    assert got["origin"] == "new_rounds" and policy.typed(got["params"])["learning_rate"] == 0.025


def test_ignored_parameters_make_no_new_attempt(spark):
    got = plan(spark, {"train_score": 0.9, "model": "logreg", "params": {}})
    assert got["repeated"] and got["origin"] == "new_model"  # depth, rate and l2 mean nothing to it


def test_runs_are_planned_apart(spark):
    order = [p.split()[0] for p in search.TRIAL_SCHEMA.replace("map<string, string>", "map").split(", ")]
    rows = [tuple({**ROW, "run": f"r{i}", "train_score": 0.9 if i % 2 else 0.8, "score": 0.7 if i % 2 else 0.8}[c] for c in order) for i in range(20)]
    got = policy.next_attempts(spark.createDataFrame(rows, search.TRIAL_SCHEMA), fits.PARAMS).collect()
    assert {(int(r["run"][1:]) % 2, r["origin"]) for r in got} == {(1, "overfitting"), (0, "hyperparam")} and len(got) == 20


@pytest.fixture(scope="module")
def data(spark):
    rows = spark.range(600).select("id", ((F.col("id") * 37) % 101 / 101.0).alias("a"), ((F.col("id") * 53) % 97 / 97.0).alias("b")).withColumn(
        "y", ((F.col("a") + F.col("b")) % 0.5 > 0.35).cast("int"))
    return search.prepare(rows, ["id"], "y", ["a", "b"], fixed.CLASSIFICATION)


def test_the_loop_follows_its_ledger(spark, data):
    path = f"{shared_folder(spark)}/ledger-{uuid.uuid4().hex}"
    out = search.closed_search(data, ("decision_tree", {"max_depth": 1}), "balanced_accuracy", 0.9999, path, "x", max_iterations=4, stall_limit=4)
    written = search.read_ledger(spark, path).orderBy("iteration").collect()
    assert [r["iteration"] for r in written] == [1, 2, 3, 4] and out.reason == "max_iterations"
    assert written[0]["origin"] == "given" and all(r["origin"] != "given" for r in written[1:])
    checked = policy.audited(search.read_ledger(spark, path), fits.PARAMS).collect()
    assert len(checked) == 3 and all(r["follows"] for r in checked)
    best = max(out.trials, key=lambda t: t.metrics.get("balanced_accuracy", -1))
    assert out.best is best and set(out.holdout) >= {"balanced_accuracy"}


def test_steps_are_fitted_once_and_scores_are_removed(spark, data):
    before = len(data.kept)
    first = search.run_trial(data, 1, "logreg", {"C": 1.0})
    kept = len(data.kept)
    second = search.run_trial(data, 2, "logreg", {"C": 0.1})
    assert first.status == second.status == "ok" and len(data.kept) == kept <= before + 1 and first.steps is second.steps


def test_a_share_of_the_train_rows_and_what_ran(spark, data):
    trial = search.run_trial(data, 1, "decision_tree", {"max_depth": 60, "train_subsample": 0.5})
    row = dict(zip([p.split()[0] for p in search.TRIAL_SCHEMA.replace("map<string, string>", "map").split(", ")], search.trial_row(trial, "r", "f1")))
    assert trial.status == "ok" and row["ran"]["max_depth"] == "30" and row["params"]["max_depth"] == "60" and "train_subsample(0.5)" in row["pipeline"]
