import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline import fixed
from plumbline.operators import drift, encoding, steps
from plumbline.plans import card, fits, predict, search
from plumbline.sources import readers, runs, sinks


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    n = 400
    x = rng.normal(size=(n, 2))
    t = rng.integers(0, 3, n)
    y = (x[:, 0] + 0.5 * x[:, 1] + (t == 1) + rng.normal(scale=0.7, size=n) > 0.3).astype(int)
    data = [(i, float(x[i, 0]) if i % 11 else None, float(x[i, 1]), "abc"[t[i]] if i % 13 else None, f"id{i}", int(y[i]), float(3 * x[i, 0] - x[i, 1] + 5)) for i in range(n)]
    return spark.createDataFrame(data, "k int, a double, b double, t string, wide string, y int, z double").repartition(4).cache()


def test_linear_fits_equal_closed_forms(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(200, 3))
    z = x @ [1.0, -2.0, 0.5] + 3 + rng.normal(size=200)
    y = (z > 3).astype(float)
    df = spark.createDataFrame([(*map(float, r), float(a), float(b)) for r, a, b in zip(x, z, y)], "p double, q double, r double, z double, y double")
    names = ["p", "q", "r"]
    xc, zc = x - x.mean(0), z - z.mean()
    ridge, _ = fits.coefficients(fits.fit(df, "ridge", fixed.REGRESSION, names, "z", {"alpha": 7.0}))
    assert ridge == pytest.approx(np.linalg.solve(xc.T @ xc + 7 * np.eye(3), xc.T @ zc), abs=1e-9)
    plain, _ = fits.coefficients(fits.fit(df, "linreg", fixed.REGRESSION, names, "z"))
    assert plain == pytest.approx(np.linalg.lstsq(xc, zc, rcond=None)[0], abs=1e-9)
    net, _ = fits.coefficients(fits.fit(df, "elasticnet", fixed.REGRESSION, names, "z", {"alpha": 0.2, "l1_ratio": 0.5}))
    w = np.zeros(3)
    for _ in range(2000):
        for j in range(3):
            left = zc - xc @ w + xc[:, j] * w[j]
            rho = xc[:, j] @ left / 200
            w[j] = np.sign(rho) * max(abs(rho) - 0.1, 0) / (xc[:, j] @ xc[:, j] / 200 + 0.1)
    assert net == pytest.approx(w, abs=1e-4)
    coef, b = fits.coefficients(fits.fit(df, "logreg", fixed.CLASSIFICATION, names, "y", {"C": 0.5}))
    p = 1 / (1 + np.exp(-(x @ coef + b)))
    assert np.abs(0.5 * x.T @ (p - y) + coef).max() < 1e-2 and abs((p - y).sum()) < 1e-2


def test_names_and_parameters():
    assert fits.resolve_name("RF", fixed.CLASSIFICATION) == "random_forest"
    for bad, task in (("linreg", fixed.CLASSIFICATION), ("mlp", fixed.REGRESSION), ("nonsense", fixed.REGRESSION), ("extra_trees", fixed.CLASSIFICATION)):
        with pytest.raises(ValueError):
            fits.resolve_name(bad, task)
    assert fits.resolve_params("hist_gbdt", {"n_estimators": 5000, "max_leaf_nodes": 31}) == ({"max_iter": 3000}, ["max_leaf_nodes"])


def test_layout_round_trip_and_refusals(spark, rows):
    layout = encoding.fit_encoding(rows, ["a", "b", "t", "wide"])
    assert layout.columns == ["a", "b", "t=a", "t=b", "t=c", "t=<missing>"] and layout.too_wide == ["wide"]
    again = encoding.Layout.from_json(layout.to_json())
    assert again == layout
    batch = spark.createDataFrame([("x", 1.0, "zz"), ("2.5", None, "a")], "a string, b double, t string")
    out = encoding.apply_encoding(batch, again).collect()
    assert out[0]["a"] is None and out[0]["t=a"] == out[0]["t=<missing>"] == 0.0 and out[1]["a"] == 2.5 and out[1]["t=a"] == 1.0
    with pytest.raises(ValueError):
        encoding.apply_encoding(batch.drop("b"), again)
    again.version = 3
    with pytest.raises(ValueError):
        encoding.apply_encoding(batch, again)


def test_steps_drop_empty_columns_and_refuse_interactions_before_impute(spark):
    df = spark.createDataFrame([(1.0, None), (None, None), (3.0, None), (3.0, None)], "a double, e double")
    fitted = steps.fit_steps(df, [{"step": "interactions"}, {"step": "impute", "strategy": "most_frequent"}, {"step": "scale"}], ["a", "e"])
    assert fitted.columns == ["a"] and fitted.applied == ["impute(most_frequent)", "scale(all)"]
    assert any("interactions" in line for line in fitted.log)
    scaled = [r["a"] for r in fitted.apply(df).collect()]
    assert np.mean(scaled) == pytest.approx(0) and np.std(scaled) == pytest.approx(1)


def test_most_frequent_takes_the_smallest_on_ties(spark):
    df = spark.createDataFrame([(v,) for v in (5.0, 2.0, 5.0, 2.0, 9.0)], "a double")
    assert steps.fill_values(df, ["a"], "most_frequent") == {"a": 2.0}


def test_search_save_load_predict(spark, rows, tmp_path):
    data = search.prepare(rows.drop("z"), ["k"], "y", ["a", "b", "t"], fixed.CLASSIFICATION)
    found = search.search(data, [("svr", {}), ("logreg", {}), ("decision_tree", {"max_depth": 3})], "f1", 0.5, tune_cut=False)
    assert [t.status for t in found.trials] == ["error", "ok"] and found.reason == "goal_reached"
    assert found.best.model == "logreg" and 0.5 < found.holdout["roc_auc"] <= 1.0
    path = str(tmp_path / "model")
    predict.save(spark, path, data.layout, found.best, ["no", "yes"], "f1")
    saved = predict.load(spark, path)
    out = predict.predict(rows.drop("y", "z"), saved, "k")
    assert out.columns == ["k", "prediction", "proba_no", "proba_yes"] and out.count() == 400
    direct = {r["k"]: r["pred"] for r in search.predict(found.best, data.rows, ["k"]).collect()}
    assert all({"no": 0, "yes": 1}[r["prediction"]] == direct[r["k"]] for r in out.collect())
    labelled = out.join(rows.select("k", F.when(F.col("k") % 50 == 0, "odd").when(F.col("y") == 1, "yes").otherwise("no").alias("label")), "k")
    counts, scores = predict.score_batch(labelled, "label", ["no", "yes"], resamples=50)
    assert {r["label_state"]: r["rows"] for r in counts.collect()} == {"scored": 392, "unknown": 8}
    assert {"accuracy", "roc_auc", "brier", "calibration_error"} <= {r["metric"] for r in scores.collect()}


def test_tuned_cut_and_early_stop_hold_rows_back(spark):
    df = spark.range(2500).select(F.col("id").alias("k"), ((F.col("id") * 37) % 1000 / 1000.0).alias("a"))
    df = df.withColumn("y", ((F.col("a") > 0.8) | (F.col("k") % 29 == 0)).cast("int"))
    data = search.prepare(df, ["k"], "y", ["a"], fixed.CLASSIFICATION)
    trial = search.run_trial(data, 1, "hist_gbdt", {"max_iter": 3, "max_depth": 2, "early_stopping": True}, metric="f1", tune_cut=True)
    assert trial.status == "ok" and trial.cut is not None and 0 < trial.cut < 1
    assert trial.fit.held_rows == 120


def test_card_holds_no_values(spark, rows):
    out = card.build_card(rows.drop("z"), "y", "demo", ["k"], notes=["note"], with_baseline=False)
    sinks.check_card(out)
    row = out.first()
    assert row["task"] == "binary_classification" and row["n_rows"] == 400 and row["caveats"] == ["note"]
    text = out.toJSON().first()
    assert "id17" not in text
    with pytest.raises(ValueError):
        sinks.check_card(out.withColumn("sample", F.lit(1)))


def test_drift_reports_new_codes_and_levels(spark, rows):
    layout = drift.record_stats(rows, encoding.fit_encoding(rows, ["a", "b", "t"]))
    batch = rows.select(F.when(F.col("k") % 3 == 0, F.lit(None)).otherwise(F.col("a")).alias("a"),
                        F.when(F.col("k") % 10 == 0, F.lit(-999.0)).otherwise(F.col("b")).alias("b"),
                        F.when(F.col("k") % 7 == 0, "new").otherwise(F.col("t")).alias("t"), F.lit(1).alias("more"))
    found = {(r["kind"], r["column"], r["detail"]) for r in drift.drift(batch, layout).collect()}
    assert {("missing_rate_shift", "a", None), ("sentinel_shift", "b", "-999"), ("unseen_levels", "t", "new"), ("extra_columns", "more", None)} <= found
    assert drift.drift(rows.select("a", "b", "t"), layout).count() == 0


def test_sources(spark, tmp_path, monkeypatch):
    with pytest.raises(ValueError):
        readers.jdbc_options("jdbc:x", "t; drop", None)
    with pytest.raises(ValueError):
        readers.jdbc_options("jdbc:x", "t", "select 1")
    with pytest.raises(ValueError):
        readers.check_location("postgresql://me:secret@host/db")
    monkeypatch.setenv(readers.PASSWORD_VARIABLE, "pw")
    assert readers.jdbc_options("jdbc:x", "t") == {"url": "jdbc:x", "dbtable": '"t"', "password": "pw"}
    assert [readers.source_kind(s) for s in ("a.csv", "a.parquet", "postgresql://h/d", "a.sqlite", "a")] == ["csv", "parquet", "sql", "sqlite", "csv"]
    for run in ("one", "two"):
        (tmp_path / run).mkdir()
        (tmp_path / run / "history.json").write_text(
            '{"goal": {"metric": "f1"}, "iterations": 1,\n "stop_reason": "stalled", "best": {"iteration": 1, "score": 0.5},\n'
            ' "history": [{"iteration": 1, "model": "logreg", "status": "ok", "metrics": {"f1": 0.5}}]}')
    histories = runs.read_histories(spark, str(tmp_path), one_per_file=True)
    assert sorted(r["run"] for r in runs.registry(histories).collect()) == ["one", "two"]
    assert [r["score"] for r in runs.attempts(histories).collect()] == [0.5, 0.5]
