"""Ranking metrics from one cumulative table over distinct scores.

A sketch of the scores gives ``RANGES`` ranges that hold about the same number of rows each, wherever the scores lie. Totals
per range (at most ``RANGES`` rows a segment) give every range its offset; running totals inside a range do the rest. So
no task ever sorts all scores of a model, also when nearly all of them lie close to 0 or 1.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.keys import join_on, quoted
from plumbline.operators.quantiles import quantiles_of

RANGES = 512


def score_edges(df: DataFrame, proba: str) -> list[float]:
    """Rising bounds between ranges of about equal share of the rows; fewer where scores repeat."""
    shares = [k / RANGES for k in range(1, RANGES)]
    row = df.agg(F.expr(f"{quantiles_of(f'CAST({quoted(proba)} AS DOUBLE)', shares)} AS edges")).first()
    return sorted(set(row["edges"] or []))


def with_ranges(df: DataFrame, proba: str, edges: Sequence[float], name: str = "b") -> DataFrame:
    """Adds ``name``: how many edges lie at or below the score."""
    if not edges:
        return df.withColumn(name, F.lit(0.0))
    return Bucketizer(splits=[float("-inf"), *edges, float("inf")], inputCol=proba, outputCol=name, handleInvalid="keep").transform(df)


def score_counts(df: DataFrame, label: str, proba: str, by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """Rows (by..., b, score, pos, neg) per distinct score; ``b`` rises with the score."""
    w = weight or "1"
    known = df.where(F.col(proba).isNotNull()).withColumn("__score", F.col(proba).cast("double"))
    ranged = with_ranges(known, "__score", score_edges(df, proba), "__b")
    return ranged.groupBy(*by, F.col("__b").alias("b"), F.col(proba).alias("score")).agg(
        F.expr(f"sum(IF({quoted(label)} = 1, {w}, 0)) AS pos"), F.expr(f"sum(IF({quoted(label)} = 1, 0, {w})) AS neg"))


def cumulative(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Adds tp, fp (rows at or above the score) and total_pos, total_neg."""
    sums = counts.groupBy(*by, "b").agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    # At most RANGES rows per segment.
    whole = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))
    above = whole.orderBy(F.desc("b")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        *by, "b", F.coalesce(F.sum("p").over(above), F.lit(0)).alias("p_off"), F.coalesce(F.sum("n").over(above), F.lit(0)).alias("n_off"),
        F.sum("p").over(whole).alias("total_pos"), F.sum("n").over(whole).alias("total_neg"))
    own = Window.partitionBy(*by, "b").orderBy(F.desc("score"))
    leaf = counts.withColumn("p_own", F.sum("pos").over(own)).withColumn("n_own", F.sum("neg").over(own))
    return join_on(leaf, offsets, [*by, "b"]).select(
        *by, "score", "pos", "neg", F.expr("p_off + p_own AS tp"), F.expr("n_off + n_own AS fp"), "total_pos", "total_neg")


def ranking(df: DataFrame, label: str, proba: str, by: Sequence[str] = ()) -> DataFrame:
    """One row per segment: positives, negatives, roc_auc (ties half), pr_auc (step sum), ks, best-cut ceiling."""
    return ranking_scores(cumulative(score_counts(df, label, proba, by), by), by)


def ranking_scores(curve: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    out = curve.groupBy(*by).agg(
        F.expr("any_value(total_pos) AS positives"), F.expr("any_value(total_neg) AS negatives"),
        F.expr("sum(neg * (tp - pos / 2D)) AS area"),
        F.expr("sum(IF(pos > 0, pos * (tp / (tp + fp)), 0D)) AS steps"),
        F.expr("greatest(0D, max(try_divide(tp, total_pos) - try_divide(fp, total_neg))) AS gap"))
    both = "positives > 0 AND negatives > 0"
    return out.select(
        *by, "positives", "negatives",
        F.expr(f"CASE WHEN {both} THEN try_divide(area, CAST(positives AS DOUBLE) * negatives) END AS roc_auc"),
        F.expr("CASE WHEN positives > 0 THEN try_divide(steps, positives) ELSE 0D END AS pr_auc"),
        F.expr(f"CASE WHEN {both} THEN gap END AS ks"),
        F.expr(f"CASE WHEN {both} THEN round((1 + gap) / 2, 4) END AS best_cut_ceiling"))


def required_ks(bar: Column) -> Column:
    value = 2.0 * bar - 1.0
    return F.when(value.between(0.0, 1.0), F.round(value, 4))


def passable_margin(baseline: Column, ceiling: Column) -> Column:
    """Largest margin whose bar stays under the ceiling, floored to three decimals; NULL without room."""
    margin = F.try_divide(ceiling - baseline, 1.0 - baseline)
    return F.when((baseline < 1.0) & (margin > 0), F.floor(F.round(margin * 1000, 9)) / 1000.0)


def cut_headroom(ceiling: Column, balanced_accuracy: Column) -> Column:
    return F.round(ceiling - balanced_accuracy, 6)
