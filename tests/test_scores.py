import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import bootstrap, calibration, cuts, metrics, ranking


def frame(spark, n=400, seed=0, places=2):
    rng = np.random.default_rng(seed)
    p = np.round(rng.uniform(size=n), places)
    y = (rng.uniform(size=n) < p).astype(int)
    rows = [(int(a), float(b), int(b >= 0.5), int(i % 25)) for i, (a, b) in enumerate(zip(y, p))]
    return y, p, spark.createDataFrame(rows, "y int, proba double, pred int, g int")


def brute(y, p):
    pos, neg = p[y == 1], p[y == 0]
    auc = (pos[:, None] > neg[None]).mean() + 0.5 * (pos[:, None] == neg[None]).mean()
    ap = ks = 0.0
    for s in np.unique(p):
        hit = p >= s
        tp, fp = (y[hit] == 1).sum(), (y[hit] == 0).sum()
        ap += ((p == s) & (y == 1)).sum() / len(pos) * tp / (tp + fp)
        ks = max(ks, tp / len(pos) - fp / len(neg))
    return auc, ap, ks


@pytest.mark.parametrize("places", [1, 2, 12])
def test_ranking_equals_brute_force(spark, places):
    y, p, df = frame(spark, places=places)
    r = ranking.ranking(df, "y", "proba").first()
    auc, ap, ks = brute(y, p)
    assert (r["roc_auc"], r["pr_auc"], r["ks"]) == pytest.approx((auc, ap, ks), abs=1e-12)


def test_one_class_has_no_auc(spark):
    df = spark.createDataFrame([(1, 0.2), (1, 1.0)], "y int, proba double")
    r = ranking.ranking(df, "y", "proba").first()
    assert r["roc_auc"] is None and r["ks"] is None and r["pr_auc"] == 1.0


def test_ceiling_bounds_every_cut_and_segments_add_up(spark):
    y, p, df = frame(spark)
    ceiling = ranking.ranking(df, "y", "proba").first()["best_cut_ceiling"]
    scored = cuts.cut_scores(ranking.cumulative(ranking.score_counts(df, "y", "proba")))
    assert max(r["balanced_accuracy"] for r in scored.collect()) <= ceiling + 1e-4
    whole = {(r["label"], r["pred"]): r["n"] for r in metrics.confusion(df, "y", "pred").collect()}
    parts = metrics.confusion(df, "y", "pred", ["g"]).groupBy("label", "pred").agg(F.sum("n").alias("n"))
    assert {(r["label"], r["pred"]): r["n"] for r in parts.collect()} == whole


def test_score_quantiles_equal_numpy(spark):
    _, p, df = frame(spark, 137)
    curve = ranking.cumulative(ranking.score_counts(df, "y", "proba"))
    got = {r["k"]: r["value"] for r in cuts.score_quantiles(curve).collect()}
    assert len(got) == 99
    for k, v in got.items():
        assert v == pytest.approx(np.quantile(p, k / 100), abs=1e-9)


def test_cut_takes_the_middle_of_the_plateau(spark):
    rows = [(0, 0.1)] * 50 + [(1, 0.9)] * 50
    df = spark.createDataFrame(rows, "y int, proba double")
    best = cuts.sweep_cuts(df, "y", "proba", "accuracy").first()
    inside = [c["cut"] for c in cuts.candidate_cuts(ranking.cumulative(ranking.score_counts(df, "y", "proba"))).collect() if 0.1 < c["cut"] <= 0.9]
    assert best["score"] == 1.0 and best["cut"] == sorted(inside)[len(inside) // 2]
    flat = spark.createDataFrame([(1, 0.0)] * 10, "y int, proba double")
    assert cuts.sweep_cuts(flat, "y", "proba", "accuracy").count() == 0


def test_cut_refusals():
    assert cuts.cut_refusal("roc_auc", "classification", 2, 1000) and cuts.cut_refusal("f1", "regression", 0, 1000)
    assert cuts.cut_refusal("f1", "classification", 3, 1000) and cuts.cut_refusal("f1", "classification", 2, 199)
    assert cuts.cut_refusal("f1", "classification", 2, 200) is None
    assert cuts.fixed_cut(0.3) == 0.3 and cuts.fixed_cut(1.0) is None and cuts.fixed_cut(True) is None


def test_bins_close_on_the_right(spark):
    df = spark.createDataFrame([(1, v) for v in (0.0, 0.1, 0.30000000000000004, 0.3, 1.0)], "y int, proba double")
    bins = {r["bin"]: r["rows"] for r in calibration.reliability(df, "y", "proba").collect()}
    assert bins == {0: 2, 2: 1, 3: 1, 9: 1}
    table = calibration.reliability(df, "y", "proba")
    assert calibration.calibration_error(table).first()["calibration_error"] is None


def test_macro_zero_division_and_unseen_class(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("c", "a")], "y string, pred string")
    r = metrics.label_scores(metrics.confusion(df, "y", "pred"), binary=False).first()
    assert r["precision"] == pytest.approx((0.5 + 0 + 0) / 3) and r["recall"] == pytest.approx(0.5 / 3)
    assert r["balanced_accuracy"] == pytest.approx(0.25)


def test_regression_constant_truth(spark):
    df = spark.createDataFrame([("x", 1.0, 1.0), ("x", 1.0, 1.0), ("z", 1.0, 1.0), ("z", 1.0, 2.0)], "g string, y double, p double")
    assert {r["g"]: r["r2"] for r in metrics.regression_scores(df, "y", "p", ["g"]).collect()} == {"x": 1.0, "z": 0.0}


def test_bootstrap_weights_look_poisson_and_repeat(spark):
    units = spark.range(4000).select(F.col("id").alias("u"))
    w = bootstrap.weighted(units, "u", 42, 10)
    total = w.agg(F.sum("w").alias("s"), F.sum(F.col("w") * F.col("w")).alias("q")).first()
    assert total["s"] / 40000 == pytest.approx(1.0, abs=0.03) and total["q"] / 40000 == pytest.approx(2.0, abs=0.1)
    assert w.exceptAll(bootstrap.weighted(units.repartition(7), "u", 42, 10)).count() == 0


def test_intervals_cover_the_score_and_agree_between_units(spark):
    _, _, df = frame(spark, 1000)
    score = metrics.label_scores(metrics.confusion(df, "y", "pred")).first()["accuracy"]
    row = bootstrap.bootstrap(bootstrap.label_draws(df, "y", "pred"), df).where("metric = 'accuracy'").first()
    keyed = df.withColumn("id", F.monotonically_increasing_id())
    unit = bootstrap.bootstrap(bootstrap.label_draws(keyed, "y", "pred", unit="id"), keyed, unit="id").where("metric = 'accuracy'").first()
    assert row["low"] < score < row["high"] and unit["low"] < score < unit["high"]
    assert row["high"] - row["low"] == pytest.approx(unit["high"] - unit["low"], rel=0.25)
    assert (row["unit"], unit["unit"]) == ("row", "group")


def test_few_units_give_no_interval(spark):
    _, _, df = frame(spark, 19)
    assert bootstrap.bootstrap(bootstrap.label_draws(df, "y", "pred"), df).count() == 0


def test_paired_delta_of_equal_models_is_zero_and_lost_rows_void_it(spark):
    _, _, df = frame(spark, 300)
    rows = df.withColumn("id", F.monotonically_increasing_id())
    same = bootstrap.paired_delta(bootstrap.pair_predictions(rows, rows, ["id"], "y", "pred")).where("metric = 'f1'").first()
    assert (same["status"], same["delta"], same["low"], same["high"], same["p_better"]) == ("measured", 0.0, 0.0, 0.0, 0.0)
    lost = bootstrap.paired_delta(bootstrap.pair_predictions(rows, rows.where("g <> 3"), ["id"], "y", "pred"))
    assert {(r["status"], r["reason"]) for r in lost.collect()} <= {("skipped", "split_changed")}
