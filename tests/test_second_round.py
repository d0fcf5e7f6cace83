"""Rules mended in the second round."""

import pytest
from pyspark.sql import functions as F

from plumbline import fixed
from plumbline.operators import metrics, splits, trials
from plumbline.plans import fits, search
from plumbline.session import small_side
from plumbline.sources import readers


def test_multiclass_chance_scores(spark):
    rows = spark.createDataFrame([(1,)] * 5 + [(0,)] * 3 + [(2,)] * 2, "y int")
    one = metrics.chance_scores(rows, rows, "y", binary=False).first()
    assert one["accuracy"] == pytest.approx(0.5) and one["balanced_accuracy"] == pytest.approx(1 / 3)
    assert "roc_auc" not in one.asDict()


def test_held_rows_keep_the_class_shares(spark):
    rows = spark.range(1000).select(F.col("id").alias("k"), (F.col("id") % 20 == 0).cast("int").alias("y"), F.lit("train").alias("split"))
    held = {r["y"]: r["n"] for r in splits.hold_back(rows, ["k"], 0.1, "stop", label="y").where("held").groupBy("y").agg(F.count("*").alias("n")).collect()}
    assert held == {0: 95, 1: 5}


def test_names_and_parameters_say_what_runs():
    assert fits.resolve_name("random-forest", fixed.CLASSIFICATION) == "random_forest"
    with pytest.raises(fits.UnsupportedModel):
        fits.resolve_name("knn", fixed.CLASSIFICATION)
    assert fits.resolve_params("mlp", {"batch_size": 10, "learning_rate_init": 0.1})[1] == ["batch_size", "learning_rate_init"]
    assert fits.resolve_params("ridge", {"max_iter": 5}) == ({}, ["max_iter"])
    assert fits.resolve_params("decision_tree", {"max_depth": 99})[0]["max_depth"] == fits.MAX_DEPTH
    assert fits.resolve_params("xgboost", {"early_stopping_rounds": 20}) == ({"early_stopping": True}, ["early_stopping_rounds"])
    assert search.stops_early({"early_stopping": True}) and search.stops_early({"early_stopping_rounds": 3})
    assert not any(search.stops_early(p) for p in ({}, {"early_stopping_rounds": 0}, {"early_stopping_rounds": -1}, {"early_stopping": False}))


def test_errors_have_kinds_and_no_refused_model_is_offered():
    assert search.error_kind(MemoryError()) == "oom" and search.error_kind(TimeoutError()) == "too_slow"
    assert search.error_kind(fits.UnsupportedModel("x")) == "unsupported_model" and search.error_kind(ValueError("x")) == "config_error"
    assert search.error_kind(RuntimeError("job aborted")) == "data_issue"
    for task in (fixed.CLASSIFICATION, fixed.REGRESSION):
        for name in trials.candidate_order(task):
            assert fits.resolve_name(name, task) == name


def test_a_failed_attempt_does_not_end_the_search_and_its_table_is_diagnosed(spark):
    rows = spark.range(400).select(F.col("id").alias("k"), ((F.col("id") * 7919) % 101 / 101.0).alias("x"), ((F.col("id") * 7919) % 101 > 50).cast("int").alias("y"))
    data = search.prepare(rows, ["k"], "y", ["x"], fixed.CLASSIFICATION)
    found = search.search(data, [("knn", {}), ("logreg", {}), ("decision_tree", {"max_depth": 2})], "accuracy", None, max_iterations=3)
    assert [t.status for t in found.trials] == ["error", "ok", "ok"]
    table = trials.ledger(trials.diagnose(search.trial_table(spark, found, "r", "accuracy", bar=0.99)).drop("rule", "failure_type", "collapse_of"))
    out = {r["iteration"]: r for r in table.collect()}
    assert out[1]["rule"] == "error" and out[1]["failure_type"] == "wrong_model_family"


def test_steps_do_not_move_with_the_stop_rows(spark):
    base = spark.range(2000).select(F.col("id").alias("k"), (F.col("id") % 3).cast("double").alias("x"), (F.col("id") % 2).cast("int").alias("y"))
    data = search.prepare(base, ["k"], "y", ["x"], fixed.CLASSIFICATION)
    params = {"max_iter": 2, "max_depth": 2, "early_stopping": True}
    first = search.run_trial(data, 1, "hist_gbdt", params, [{"step": "scale"}])
    held = splits.hold_back(data.part("train"), ["k"], fixed.STOP_FRACTION, "stop", label="y").where("held").select("k")
    moved = data.rows.join(held.withColumn("__h", F.lit(1)), "k", "left").withColumn("x", F.when(F.col("__h") == 1, 1e6).otherwise(F.col("x"))).drop("__h")
    second = search.run_trial(search.Prepared(moved.select(data.rows.columns), data.layout, data.keys, data.task, data.classes), 1, "hist_gbdt", params, [{"step": "scale"}])
    assert first.status == second.status == "ok" and first.fit.applied["max_depth"] == 2
    probe = base.where("k < 5")
    assert [r["x"] for r in first.steps.apply(probe).orderBy("k").collect()] == [r["x"] for r in second.steps.apply(probe).orderBy("k").collect()]


def test_jdbc_urls():
    assert readers.jdbc_url("postgresql+psycopg2://h/db") == "jdbc:postgresql://h/db"
    assert readers.jdbc_url("jdbc:mysql://h/db") == "jdbc:mysql://h/db"
    assert readers.jdbc_url("oracle://h:1/s") == "jdbc:oracle:thin:@//h:1/s"
    for bad in ("/data/x.db", "sqlite:///x.db", "x.sqlite"):
        with pytest.raises(ValueError, match="export"):
            readers.jdbc_url(bad)


def test_small_side_counts_bytes(spark, monkeypatch):
    from plumbline import session

    monkeypatch.setattr(session, "BROADCAST_BYTES", 1000)
    wide = spark.range(10).select("id", F.repeat(F.lit("x"), 500).alias("t"))
    assert "hint" not in small_side(wide)._jdf.queryExecution().logical().toString().lower()
    assert "hint" in small_side(wide.select("id"))._jdf.queryExecution().logical().toString().lower()
