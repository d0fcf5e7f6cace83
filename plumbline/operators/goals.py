"""The bar a run has to reach, from a measured baseline."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline import fixed
from plumbline.functions.columns import metric_constant, metric_direction, metric_for_task
from plumbline.operators.ranking import passable_margin, required_ks

NOTES = ("raised_to_clear_chance", "lowered_to_clear_chance", "raised_to_ranking_floor", "exceeds_ceiling",
         "demands_zero_error", "exceeds_ranking_ceiling", "inside_baseline_ci")


def default_bar(metric):
    """Bar without a measurement: the registry's, or the general one for an unknown metric."""
    known = metric_constant(metric, 0, "string").isNotNull()
    return F.when(known, metric_constant(metric, 5, "double")).otherwise(F.lit(fixed.UNKNOWN_METRIC_BAR))


def derive_bars(scores: DataFrame, margin: float = fixed.GOAL_MARGIN) -> DataFrame:
    """Adds threshold, source and notes to rows (metric, baseline, chance, ks, low, high).

    Everything is a row expression; a NULL baseline falls back to the default bar.
    """
    df = scores
    for name in ("chance", "ks", "low", "high"):
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast("double"))
    metric, base, chance = F.col("metric"), F.col("baseline"), F.col("chance")
    down = metric_direction(metric) == fixed.MINIMIZE
    bounded = F.coalesce(metric_constant(metric, 2, "boolean"), F.lit(False))
    raw = F.when(down, F.greatest(F.lit(0.0), base * (1.0 - margin))).when(
        bounded, base + (1.0 - base) * margin).otherwise(base * (1.0 + margin))
    df = df.withColumn("__raw", raw).withColumn("__down", down).withColumn("__bounded", bounded & ~down)
    lowered = F.col("__down") & chance.isNotNull() & (F.col("__raw") > chance * (1.0 - fixed.GOAL_MIN_LIFT))
    clamped = F.least(F.col("__raw"), F.lit(fixed.GOAL_CEILING))
    raised = F.col("__bounded") & chance.isNotNull() & (clamped < chance + fixed.GOAL_MIN_LIFT)
    df = df.withColumn("__lowered", F.coalesce(lowered, F.lit(False))).withColumn("__raised", F.coalesce(raised, F.lit(False)))
    step = F.when(F.col("__lowered"), chance * (1.0 - fixed.GOAL_MIN_LIFT)).when(
        F.col("__raised"), chance + fixed.GOAL_MIN_LIFT).when(F.col("__bounded"), clamped).otherwise(F.col("__raw"))
    symmetric = (metric == "balanced_accuracy") & F.col("ks").between(0.0, 1.0)
    ceiling = F.when(symmetric, F.round((1.0 + F.col("ks")) / 2.0, 4))
    df = df.withColumn("__step", step).withColumn("ranking_ceiling", ceiling)
    floored = F.coalesce(F.col("__bounded") & (F.col("__step") < F.col("ranking_ceiling")), F.lit(False))
    df = df.withColumn("__floored", floored)
    bar = F.when(F.col("__floored"), F.least(F.col("ranking_ceiling"), F.lit(fixed.GOAL_CEILING))).otherwise(F.col("__step"))
    measured = base.isNotNull()
    df = df.withColumn("threshold", F.when(measured, F.round(bar, 4)).otherwise(default_bar(metric)))
    bar = F.col("threshold")
    above = measured & F.coalesce(F.col("__bounded") & (bar > F.col("ranking_ceiling")), F.lit(False))
    needed = F.when(above, required_ks(bar))
    return df.select(
        *scores.columns, "threshold",
        F.when(measured, "derived").when(bar.isNotNull(), "fallback").otherwise("unset").alias("source"),
        (measured & F.col("__raised")).alias("raised_to_clear_chance"),
        (measured & F.col("__lowered")).alias("lowered_to_clear_chance"),
        (measured & F.col("__floored")).alias("raised_to_ranking_floor"),
        (measured & F.col("__bounded") & (bar > fixed.GOAL_CEILING)).alias("exceeds_ceiling"),
        (measured & F.col("__down") & (bar <= 0.0)).alias("demands_zero_error"),
        above.alias("exceeds_ranking_ceiling"), needed.alias("required_ks"),
        F.round(needed - F.round("ks", 4), 4).alias("ks_shortfall"),
        F.when(above, passable_margin(base, F.col("ranking_ceiling"))).alias("passable_margin"),
        F.coalesce(measured & bar.between(F.col("low"), F.col("high")), F.lit(False)).alias("inside_baseline_ci"),
    )


def resolve_goals(requests: DataFrame, scores: DataFrame, keys: list[str], margin: float = fixed.GOAL_MARGIN) -> DataFrame:
    """Goal per request (keys..., task, metric, fixed threshold or NULL, mode).

    A metric of the other task is swapped for the task's default and its threshold dropped; a given
    threshold fixes the bar; else the measured bar is derived from ``scores`` (keys..., metric, baseline...).
    """
    wanted = requests.withColumn("asked", F.col("metric")).withColumn("metric", metric_for_task(F.col("metric"), F.col("task")))
    swapped = F.col("asked") != F.col("metric")
    wanted = wanted.withColumn("given", F.when(~swapped, F.col("given"))).withColumn(
        "substituted_from", F.when(swapped, F.col("asked"))).drop("asked")
    joined = wanted.join(scores, [*keys, "metric"], "left")
    derived = derive_bars(joined, margin)
    fixed_mode = F.col("given").isNotNull() | (F.col("mode") == "fixed")
    default = default_bar(F.col("metric"))
    return derived.select(
        *keys, "metric", metric_direction(F.col("metric")).alias("direction"), "substituted_from",
        F.when(fixed_mode, "fixed").otherwise("auto").alias("mode"),
        F.when(F.col("given").isNotNull(), F.col("given")).when(fixed_mode, default).otherwise(F.col("threshold")).alias("threshold"),
        F.when(F.col("given").isNotNull(), "fixed").when(fixed_mode & default.isNotNull(), "fixed_default")
        .when(fixed_mode, "unset").otherwise(F.col("source")).alias("source"))


def goal_met(score, threshold, direction, status=None):
    """True when a scored, error-free attempt reaches the bar."""
    reached = F.when(direction == fixed.MINIMIZE, score <= threshold).otherwise(score >= threshold)
    ok = F.lit(True) if status is None else status != "error"
    return F.coalesce(reached & ok, F.lit(False))
