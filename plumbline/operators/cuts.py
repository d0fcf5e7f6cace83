"""Choose the decision cut on held-back rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline import fixed
from plumbline.functions.columns import switch
from plumbline.operators.keys import join_on
from plumbline.operators.ranking import cumulative, score_counts
from plumbline.session import stage

LABEL_METRICS = ("f1", "accuracy", "balanced_accuracy", "precision", "recall")


def fixed_cut(value) -> float | None:
    """A configured cut if it is a number inside (0, 1), else None."""
    if isinstance(value, bool) or not isinstance(value, (int, float)) or not 0.0 < value < 1.0:
        return None
    return round(float(value), 6)


def cut_refusal(metric: str, task: str, n_classes: int, held_rows: int) -> str | None:
    """Why no cut is tuned, or None."""
    if task != fixed.CLASSIFICATION or n_classes != 2:
        return "only a binary target has a cut"
    if fixed.METRIC_ALIASES.get(metric, metric) not in LABEL_METRICS:
        return f"{metric} does not depend on the cut"
    if held_rows < fixed.CUT_MIN_ROWS:
        return f"{held_rows} held-back rows, {fixed.CUT_MIN_ROWS} needed"
    return None


def refused(metric: str, task: str, n_classes: Column, held_rows: Column) -> Column:
    """``cut_refusal`` for many fits at once: its reason per row, or NULL."""
    if cut_refusal(metric, task, 2, fixed.CUT_MIN_ROWS):
        return F.lit(cut_refusal(metric, task, 2, fixed.CUT_MIN_ROWS))
    few = F.concat(held_rows.cast("string"), F.lit(f" held-back rows, {fixed.CUT_MIN_ROWS} needed"))
    return F.when(n_classes != 2, cut_refusal(metric, task, 0, 0)).when(held_rows < fixed.CUT_MIN_ROWS, few)


def score_quantiles(curve: DataFrame, by: Sequence[str] = (), parts: int = 100) -> DataFrame:
    """Rows (by..., k, value): the k/parts quantiles, k = 1..parts-1, read off the cumulative table.

    Each distinct score covers a run of ranks; the ranks k*(n-1)/parts inside it follow by integer
    arithmetic, so nothing is ranked again.
    """
    ranks = curve.select(
        *by, "score", F.expr("total_pos + total_neg AS n"),
        F.expr("total_pos + total_neg - tp - fp AS first"), F.expr("total_pos + total_neg - tp - fp + pos + neg - 1 AS last"))
    # k with first <= floor(k*(n-1)/parts) <= last, and the same one rank up for the upper neighbour.
    def side(shift: int, name: str) -> DataFrame:
        low = f"greatest(1, (CAST(first - {shift} AS BIGINT) * {parts} + n - 2) div (n - 1))"
        high = f"least({parts - 1}, (CAST(last - {shift} + 1 AS BIGINT) * {parts} + n - 2) div (n - 1) - 1)"
        ready = ranks.where("n > 1").withColumn("lo", F.expr(low)).withColumn("hi", F.expr(high)).where("lo <= hi")
        return ready.select(*by, F.col("n"), F.explode(F.sequence("lo", "hi")).alias("k"), F.lit(name).alias("side"), "score")

    pairs = side(0, "a").unionByName(side(1, "b")).groupBy(*by, "k", "n").agg(
        F.expr("max(IF(side = 'a', score, NULL)) AS a"), F.expr("max(IF(side = 'b', score, NULL)) AS b"))
    share = f"((k * (n - 1)) % {parts}) / {parts}D"
    return pairs.select(*by, "k", F.expr(f"IF({share} = 0, a, a + (b - a) * {share}) AS value"))


def candidate_cuts(curve: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rows (by..., cut): 99 score quantiles, an even grid of 49 and 0.5; at most 149 per segment."""
    even = [round(0.02 * (i + 1), 6) for i in range(fixed.CUT_GRID)] + [0.5]
    listed = ", ".join(f"{v!r}D" for v in even)
    grid = curve.select(*by).distinct() if by else curve.limit(1).select(F.lit(1).alias("__one"))
    grid = grid.select(*by, F.expr(f"explode(array({listed})) AS cut"))
    # The range test comes before the rounding: a quantile just under 1 may round to 1.
    inside = score_quantiles(curve, by).where("value > 0 AND value < 1")
    quantiles = inside.select(*by, F.expr("round(round(value, 9), 6) AS cut"))
    return grid.unionByName(quantiles).distinct()


def cut_scores(curve: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rows (by..., cut, tp, fp, p, n) with the label metrics at each cut.

    Every distinct score is binned by how many cuts it passes; the sums above a cut follow from the bins.
    """
    cuts = candidate_cuts(curve, by)
    if by:
        lists = cuts.groupBy(*by).agg(F.array_sort(F.collect_list("cut")).alias("cuts"))
        passed = join_on(curve, lists, by).select(
            *by, F.expr("aggregate(cuts, 0, (acc, c) -> acc + IF(c <= score, 1, 0)) AS b"), "pos", "neg", "cuts")
    else:
        # At most 149 cuts: a comparison tree inside generated code.
        listed = sorted(r["cut"] for r in cuts.collect())
        passed = curve.select(switch(F.col("score"), listed).alias("b"), "pos", "neg", F.lit(listed).alias("cuts"))
    bins = passed.groupBy(*by, "b").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.expr("any_value(cuts) AS cuts"))
    # At most 150 bins per segment.
    filled = bins.groupBy(*by).agg(F.expr("any_value(cuts) AS cuts"), F.collect_list(F.struct("b", "pos", "neg")).alias("bins"))
    sums = filled.select(*by, F.expr(
        "inline(transform(cuts, (c, i) -> struct(c AS cut, "
        "aggregate(filter(bins, x -> x.b > i), 0L, (acc, x) -> acc + x.pos) AS tp, "
        "aggregate(filter(bins, x -> x.b > i), 0L, (acc, x) -> acc + x.neg) AS fp, "
        "aggregate(bins, 0L, (acc, x) -> acc + x.pos) AS p, aggregate(bins, 0L, (acc, x) -> acc + x.neg) AS n)))"))
    return sums.select(
        "*", F.expr("(tp + n - fp) / (p + n) AS accuracy"), F.expr("IF(tp + fp > 0, tp / (tp + fp), 0D) AS precision"),
        F.expr("IF(p > 0, tp / p, 0D) AS recall"), F.expr("IF(p + tp + fp > 0, 2 * tp / (p + tp + fp), 0D) AS f1"),
        F.expr("CASE WHEN p > 0 AND n > 0 THEN (tp / p + (n - fp) / n) / 2 WHEN p > 0 THEN tp / p ELSE (n - fp) / n END AS balanced_accuracy"))


def sweep_cuts(df: DataFrame, label: str, proba: str, metric: str, by: Sequence[str] = ()) -> DataFrame:
    """One row per segment: the best cut (middle of the plateau), its score; no row when every cut ties."""
    metric = fixed.METRIC_ALIASES.get(metric, metric)
    if metric not in LABEL_METRICS:
        raise ValueError(cut_refusal(metric, fixed.CLASSIFICATION, 2, fixed.CUT_MIN_ROWS))
    # Staged: the quantiles and the sweep both read it.
    curve = stage(cumulative(score_counts(df, label, proba, by), by), "curve")
    scored = cut_scores(curve, by)
    part = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))
    best = scored.withColumn("best", F.max(metric).over(part)).withColumn("cuts", F.count(F.lit(1)).over(part))
    tied = best.where(F.col(metric) == F.col("best")).groupBy(*by).agg(
        F.expr("any_value(best) AS best"), F.expr("any_value(cuts) AS cuts"), F.array_sort(F.collect_list("cut")).alias("plateau"))
    return tied.where("size(plateau) < cuts").select(
        *by, F.expr("plateau[size(plateau) div 2] AS cut"), F.col("best").alias("score"), "cuts",
        F.expr("size(plateau) AS plateau_cuts"))
