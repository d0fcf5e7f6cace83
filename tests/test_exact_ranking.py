"""Ranking curves and their draws on exact scores, wherever the scores lie."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import bootstrap, ranking


def saturated(spark, n=3000, scale=2e-4):
    """Scores that all lie below ``scale``, one in 20 positive, with ties."""
    rng = np.random.default_rng(3)
    y = (rng.random(n) < 0.05).astype(int)
    p = np.round(np.clip(rng.normal(0.4 + 0.25 * y, 0.2), 0, 1), 3) * scale
    g = rng.integers(0, 40, n)
    rows = [(int(a), float(b), int(c), int(c) % 2) for a, b, c in zip(y, p, g)]
    return y, p, g, spark.createDataFrame(rows, "y int, proba double, g int, half int").repartition(5)


def plain(y, p, w):
    """Weighted area and step sum, ties half."""
    pairs = {}
    for a, b, c in zip(y, p, w):
        pos, neg = pairs.get(b, (0.0, 0.0))
        pairs[b] = (pos + c * a, neg + c * (1 - a))
    tp = fp = area = steps = 0.0
    for s in sorted(pairs, reverse=True):
        pos, neg = pairs[s]
        tp, fp = tp + pos, fp + neg
        area += neg * (tp - pos / 2)
        steps += pos * tp / (tp + fp) if pos else 0.0
    return area / (tp * fp), steps / tp


def test_saturated_scores_spread_over_ranges(spark):
    y, p, _, df = saturated(spark, 20_000)
    counts = ranking.score_counts(df, "y", "proba")
    rows = counts.groupBy("b").agg(F.sum(F.col("pos") + F.col("neg")).alias("n")).collect()
    assert len(rows) > 200 and max(r["n"] for r in rows) < 20_000 * 0.05
    got = ranking.ranking(df, "y", "proba").first()
    want = plain(y, p, np.ones(len(y)))
    assert got["roc_auc"] == pytest.approx(want[0], abs=1e-12) and got["pr_auc"] == pytest.approx(want[1], abs=1e-12)


def test_group_draws_equal_a_plain_version(spark):
    y, p, g, df = saturated(spark)
    got = {(r["r"], r["metric"]): r["value"] for r in bootstrap.ranking_draws(df, "y", "proba", unit="g", resamples=25).collect()}
    weights = {(r["g"], r["r"]): r["w"] for r in bootstrap.weighted(df.select("g").distinct(), "g", 42, 25).collect()}
    for r in range(25):
        auc, ap = plain(y, p, np.array([weights.get((int(k), r), 0) for k in g], float))
        assert got[r, "roc_auc"] == pytest.approx(auc, abs=1e-12) and got[r, "pr_auc"] == pytest.approx(ap, abs=1e-12)


@pytest.mark.parametrize("by", [[], ["half"]])
def test_row_draws_lie_around_the_exact_score(spark, by):
    _, _, _, df = saturated(spark)
    draws = bootstrap.ranking_draws(df, "y", "proba", by=by, resamples=200).where("metric = 'roc_auc'")
    exact = {tuple(r[c] for c in by): r["roc_auc"] for r in ranking.ranking(df, "y", "proba", by).collect()}
    for r in draws.groupBy(*by).agg(F.avg("value").alias("m"), F.stddev("value").alias("s"), F.count("*").alias("n")).collect():
        assert r["n"] == 200 and abs(r["m"] - exact[tuple(r[c] for c in by)]) < 0.02 and 0.005 < r["s"] < 0.06
    again = bootstrap.ranking_draws(df.repartition(2), "y", "proba", by=by, resamples=200).where("metric = 'roc_auc'")
    rounded = lambda d: d.withColumn("value", F.round("value", 9))
    assert rounded(draws).exceptAll(rounded(again)).count() == 0


def test_a_score_with_more_rows_than_a_block(spark, monkeypatch):
    y, p, g, df = saturated(spark, 900)
    want = sorted(tuple(r) for r in bootstrap.ranking_draws(df, "y", "proba", unit="g", resamples=7).withColumn("value", F.round("value", 10)).collect())
    heavy = df.withColumn("proba", F.lit(0.5)).where("g < 3")
    r = bootstrap.ranking_draws(heavy, "y", "proba", unit="g", resamples=5).where("metric = 'roc_auc'").collect()
    assert all(x["value"] == pytest.approx(0.5) for x in r)
    monkeypatch.setattr(bootstrap, "WEIGHT_BLOCK", 3)
    rows = df.toPandas().assign(score=lambda d: d["proba"], u=lambda d: d["g"].astype("int64") * 7919, n=1)[["score", "y", "u", "n"]]
    zero = np.zeros(7)
    small = bootstrap._curve_sums(rows, zero, zero, True, 42, 7)
    monkeypatch.setattr(bootstrap, "WEIGHT_BLOCK", 10_000)
    for a, b in zip(small, bootstrap._curve_sums(rows, zero, zero, True, 42, 7)):
        assert np.allclose(a, b, rtol=0, atol=1e-9)
    assert want


def test_empty_and_null_scores(spark):
    df = spark.createDataFrame([(1, None, 1)], "y int, proba double, g int")
    assert bootstrap.ranking_draws(df, "y", "proba", unit="g", resamples=3).count() == 0
    assert ranking.cumulative(ranking.score_counts(df, "y", "proba")).count() == 0
