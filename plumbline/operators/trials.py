"""The trial ledger: running best, stalls, stop reasons, what each prescription bought, diagnosis.

A trial table has one row per attempt: run, iteration, model, metric, direction, bar, score, status,
error_type and diagnostics. Windows run inside one run, whose attempts are bounded by its iteration
limit; runs spread over the cluster.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline import fixed

BEFORE = "OVER (PARTITION BY run ORDER BY iteration ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
UPTO = "OVER (PARTITION BY run ORDER BY iteration ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
MINIMIZE = f"direction = '{fixed.MINIMIZE}'"


# Rows of attempts, or of what they are made of, in one task.
TASK_ROWS = 400_000


def by_run(rows: DataFrame, run: str = "run") -> DataFrame:
    """Deals rows by their run, once: the windows, groupings and joins on the run that follow need no other shuffle.

    The tasks grow in number with the rows, so none holds more at a larger size.
    """
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, math.ceil(rows.count() / TASK_ROWS)), run)


def scored(trials: DataFrame) -> DataFrame:
    """A failed attempt has no score."""
    return trials.withColumn("score", F.expr("CASE WHEN status = 'error' OR isnan(score) THEN NULL ELSE score END"))


def best_so_far(trials: DataFrame) -> DataFrame:
    """Adds previous_best, improved (strictly better) and delta."""
    t = scored(trials).withColumn("previous_best", F.expr(
        f"CASE WHEN {MINIMIZE} THEN min(score) {BEFORE} ELSE max(score) {BEFORE} END"))
    return t.withColumn("improved", F.expr(
        f"CASE WHEN score IS NULL THEN false WHEN previous_best IS NULL THEN true "
        f"WHEN {MINIMIZE} THEN score < previous_best ELSE score > previous_best END")).withColumn(
        "delta", F.expr("round(score - previous_best, 6)"))


def stalls(trials: DataFrame) -> DataFrame:
    """Adds stall_count: attempts since the last improvement."""
    t = best_so_far(trials).withColumn("__island", F.expr(f"sum(CAST(improved AS INT)) {UPTO}"))
    inside = Window.partitionBy("run", "__island").orderBy("iteration")
    leading = F.row_number().over(inside)
    return t.withColumn("stall_count", F.when(F.col("__island") == 0, leading).otherwise(leading - 1)).drop("__island")


def budget(trials: DataFrame, total_sec: float = fixed.TIME_BUDGET_SEC, max_iterations: int = fixed.MAX_ITERATIONS) -> DataFrame:
    """Adds spent_before, loop_remaining and fit_share for every attempt."""
    t = trials.withColumn("spent_before", F.expr(f"coalesce(sum(greatest(wall_sec, 0D)) {BEFORE}, 0D)"))
    t = t.withColumn("loop_remaining", F.expr(f"{total_sec * (1 - fixed.HOLDOUT_RESERVE)!r}D - spent_before"))
    return t.withColumn("fit_share", F.expr(
        f"CASE WHEN loop_remaining <= 0 THEN loop_remaining / greatest(1, {max_iterations} - iteration + 1) "
        f"ELSE greatest(1D, loop_remaining / greatest(1, {max_iterations} - iteration + 1)) END"))


def stop_reasons(trials: DataFrame, total_sec: float = fixed.TIME_BUDGET_SEC, max_iterations: int = fixed.MAX_ITERATIONS, stall_limit: int = fixed.STALL_LIMIT) -> DataFrame:
    """One row per run: the first attempt at which a stop condition holds, and which (NULL: still going)."""
    t = stalls(budget(trials, total_sec, max_iterations))
    t = t.withColumn("reason", F.expr(
        f"CASE WHEN score IS NOT NULL AND bar IS NOT NULL AND IF({MINIMIZE}, score <= bar, score >= bar) THEN 'goal_reached' "
        f"WHEN iteration >= {max_iterations} THEN 'max_iterations' WHEN stall_count >= {stall_limit} THEN 'stalled' "
        f"WHEN loop_remaining - greatest(wall_sec, 0D) <= 0 THEN 'out_of_time' END"))
    return t.groupBy("run").agg(
        F.expr("min(CASE WHEN reason IS NOT NULL THEN iteration END) AS stopped_at"),
        F.expr("min_by(reason, CASE WHEN reason IS NOT NULL THEN iteration END) AS reason"),
        F.count(F.lit(1)).alias("attempts"))


def diagnose(trials: DataFrame) -> DataFrame:
    """Adds ``rule`` and ``failure_type``: the first rule that holds, in fixed order."""
    t = scored(trials)
    # Earlier attempts of the run: bounded by the iteration limit.
    t = t.withColumn("__past", F.expr(f"collect_list(struct(iteration, model, score, roc_auc)) {BEFORE}"))
    t = t.withColumn("__s", F.expr(f"coalesce(score, IF({MINIMIZE}, bar, 0D))"))
    t = t.withColumn("__gap", F.expr(f"coalesce(train_val_gap, IF({MINIMIZE}, __s - train_score, train_score - __s))"))
    t = t.withColumn("__cleared", F.expr(f"score IS NOT NULL AND IF({MINIMIZE}, score <= bar, score >= bar)"))
    bounded = "metric IN (" + ", ".join(f"'{m}'" for m, s in fixed.METRICS.items() if s[2]) + ")"
    known = "metric IN (" + ", ".join(f"'{m}'" for m in fixed.METRICS) + ")"
    labelled = "metric IN (" + ", ".join(f"'{m}'" for m, s in fixed.METRICS.items() if not s[3]) + ")"
    errors = " ".join(f"WHEN '{e}' THEN '{d}'" for e, d in fixed.ERROR_DIAGNOSIS.items())
    t = t.withColumn("collapse_of", F.expr(
        f"CASE WHEN {labelled} AND roc_auc IS NOT NULL THEN try_element_at(filter(__past, p -> p.score - __s > {fixed.METRIC_DROP} "
        f"AND roc_auc >= p.roc_auc - {fixed.RANKING_TOLERANCE}), 1).iteration END"))
    t = t.withColumn("rule", F.expr(f"""CASE
        WHEN status = 'error' THEN 'error'
        WHEN __gap IS NOT NULL AND IF({bounded} OR NOT {known}, __gap > {fixed.OVERFIT_GAP},
             train_score > 0 AND __gap > train_score * {fixed.OVERFIT_GAP_RATIO}) THEN 'overfit'
        WHEN collapse_of IS NOT NULL THEN 'collapse'
        WHEN metric = 'balanced_accuracy' AND coalesce(headroom >= {fixed.CUT_HEADROOM_FLOOR}, true)
             AND abs(recall - specificity) >= {fixed.SKEW_GAP} THEN 'skew'
        WHEN NOT __cleared AND IF({MINIMIZE}, train_score > bar * {1 + fixed.UNDERFIT_MARGIN_RATIO},
             train_score < bar - {fixed.UNDERFIT_MARGIN}) THEN 'underfit'
        WHEN size(filter(__past, p -> p.model = model)) >= 2 THEN 'plateau'
        WHEN metric = 'balanced_accuracy' AND headroom < {fixed.CUT_HEADROOM_FLOOR} AND ceiling < bar THEN 'ranking_limited'
        WHEN __cleared THEN 'cleared' ELSE 'other' END"""))
    return t.withColumn("failure_type", F.expr(
        f"CASE rule WHEN 'error' THEN CASE error_type {errors} ELSE 'unknown' END WHEN 'overfit' THEN 'overfitting' "
        "WHEN 'collapse' THEN 'data_issue' WHEN 'underfit' THEN 'underfitting' WHEN 'plateau' THEN 'wrong_model_family' "
        "WHEN 'ranking_limited' THEN 'wrong_model_family' ELSE 'hyperparam' END"
    )).drop("__past", "__s", "__gap", "__cleared")


def propose_weight(trials: DataFrame) -> DataFrame:
    """Next positive-class weight for attempts the skew rule names; NULL elsewhere.

    One step up or down; the first step starts at the imbalance ratio; once the skew has changed sign
    between two weights of the same model, interpolate to where it crosses zero.
    """
    t = diagnose(trials).withColumn("__skew", F.expr("recall - specificity"))
    t = t.withColumn("__seen", F.expr(f"collect_list(struct(model, weight, __skew AS skew, iteration)) {UPTO}"))
    t = t.withColumn("__seen", F.expr("filter(__seen, p -> p.model = model AND p.skew IS NOT NULL)"))
    t = t.withColumn("__below", F.expr(
        "array_max(transform(filter(__seen, p -> p.skew < 0), p -> struct(p.skew AS skew, -p.iteration AS i, p.weight AS weight)))"))
    t = t.withColumn("__above", F.expr(
        "array_min(transform(filter(__seen, p -> p.skew > 0), p -> struct(p.skew AS skew, p.iteration AS i, p.weight AS weight)))"))

    def clamp(value: str) -> str:
        return f"round(least(greatest({value}, {fixed.WEIGHT_LOW}D), {fixed.WEIGHT_HIGH}D), 3)"

    step = clamp(
        f"CASE WHEN __skew < 0 AND weight = 1 THEN greatest({fixed.WEIGHT_STEP}D, imbalance) "
        f"WHEN __skew < 0 THEN weight * {fixed.WEIGHT_STEP}D ELSE weight / {fixed.WEIGHT_STEP}D END")
    # Multiplied before it is divided: the other order rounds to another thousandth on some skews.
    crossing = clamp("__below.weight + try_divide((__above.weight - __below.weight) * -__below.skew, __above.skew - __below.skew)")
    t = t.withColumn("proposed_weight", F.expr(
        f"CASE WHEN rule = 'skew' THEN CASE WHEN __below.weight < __above.weight AND {crossing} <> {clamp('weight')} "
        f"THEN {crossing} ELSE {step} END END"))
    return t.drop("__skew", "__seen", "__below", "__above")


def ledger(trials: DataFrame) -> DataFrame:
    """Adds, per attempt: delta to the best before, the prescription it answered and whether that paid,
    and whether its preprocessing moved alone or together with the family."""
    t = best_so_far(diagnose(trials))
    t = t.withColumn("prescription", F.expr("lag(failure_type) OVER (PARTITION BY run ORDER BY iteration)"))
    t = t.withColumn("paid", F.expr("CASE WHEN prescription IS NOT NULL THEN improved END"))
    same = "array_sort(map_entries(params))" if dict(t.dtypes)["params"].startswith("map") else "params"
    t = t.withColumn("__built", F.expr(
        f"last(CASE WHEN status <> 'error' THEN struct(model, pipeline, {same} AS params) END, true) "
        "OVER (PARTITION BY run ORDER BY iteration ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"))
    moved = "status <> 'error' AND __built IS NOT NULL AND __built.pipeline <> pipeline"
    return t.withColumn("pipeline_move", F.expr(
        f"CASE WHEN {moved} THEN CASE WHEN __built.model <> model THEN 'with_family' WHEN __built.params = {same} THEN 'alone' "
        "ELSE 'with_params' END END")).drop("__built")


def family_spend(trials: DataFrame) -> DataFrame:
    """Rows (run, model): attempts used and best score."""
    return scored(trials).groupBy("run", "model").agg(
        F.count(F.lit(1)).alias("attempts"),
        F.expr(f"CASE WHEN max({MINIMIZE}) THEN min(score) ELSE max(score) END AS best"))


def wasted_prescriptions(led: DataFrame) -> DataFrame:
    """Rows (run, prescription): prescribed at least once, never followed by a new best."""
    return led.where("prescription IS NOT NULL").groupBy("run", "prescription").agg(
        F.bool_or("paid").alias("paid"), F.count(F.lit(1)).alias("times")).where("NOT paid").drop("paid")


def cut_lever(trials: DataFrame) -> DataFrame:
    """Share of the distance to the bar that a better cut could buy (balanced accuracy only)."""
    t = scored(trials).where("metric = 'balanced_accuracy' AND headroom IS NOT NULL AND bar - score > 0")
    return t.select("run", "iteration", F.expr("round(bar - score, 6) AS shortfall"), F.expr("round(try_divide(headroom, bar - score), 6) AS cut_share"))


def ceiling_spread(trials: DataFrame) -> DataFrame:
    """Per run: best ceiling per family, their spread, and what the best still lacks."""
    per = scored(trials).where("metric = 'balanced_accuracy' AND ceiling IS NOT NULL").groupBy("run", "model").agg(
        F.max("ceiling").alias("c"), F.max("bar").alias("bar"))
    return per.groupBy("run").agg(
        F.count(F.lit(1)).alias("families"), F.min("c").alias("low"), F.max("c").alias("high"), F.max("bar").alias("bar")
    ).where("families >= 2 AND bar - high > 0").select(
        "run", "families", "low", "high", F.expr("round(high - low, 6) AS span"), F.expr("round(bar - high, 6) AS shortfall"))


def signature(model: str = "model", params: str = "params", pipeline: str = "pipeline", tuned: str = "tuned"):
    """Text that two attempts share exactly when the fit would be the same."""
    return F.expr(
        f"concat({model}, '|', array_join(transform(array_sort(map_entries({params})), e -> concat(e.key, '=', e.value)), ','), "
        f"'|prep=', {pipeline}, IF({tuned}, '|cut=tuned', ''))")


# Models that the trainer refuses, so no rule may offer them: neighbours are an operator of their own here.
NOT_FITTED = frozenset({"knn"})


def candidate_order(task: str) -> list[str]:
    """Available models, cheapest first."""
    rows = [c for c in fixed.CANDIDATES if c[0] == task and (c[0], c[1]) not in fixed.UNAVAILABLE and c[1] not in NOT_FITTED]
    return [c[1] for c in sorted(rows, key=lambda c: c[3])]


def novelty(plans: DataFrame, history: DataFrame, task: str = fixed.CLASSIFICATION) -> DataFrame:
    """Adds ``repeated`` and ``next_model``: the plan's own model, or the cheapest untried one on a repeat.

    When every model was tried it stays NULL and ``next_params`` holds a halved learning rate and more rounds.
    """
    # A run's attempts are bounded by its iteration limit.
    tried = history.withColumn("__sig", signature()).groupBy(F.col("run").alias("__run")).agg(
        F.collect_set("__sig").alias("__sigs"), F.collect_set("model").alias("__tried"), F.count(F.lit(1)).alias("__attempts"))
    order = ", ".join(f"'{m}'" for m in candidate_order(task))
    joined = plans.withColumn("signature", signature()).join(tried, F.col("run") == F.col("__run"), "left").withColumn(
        "repeated", F.expr("coalesce(array_contains(__sigs, signature), false)")).drop("__run", "__sigs")
    joined = joined.withColumn("next_model", F.expr(
        f"IF(repeated, try_element_at(filter(array({order}), m -> NOT array_contains(__tried, m)), 1), model)"))
    return joined.withColumn("next_params", F.expr(
        "CASE WHEN next_model IS NULL THEN map('learning_rate', CAST(round(coalesce(try_cast(params['learning_rate'] AS DOUBLE), 0.1D) * 0.5D, 5) AS STRING), "
        "'max_iter', CAST(coalesce(try_cast(params['max_iter'] AS INT), 200) + 100 * __attempts AS STRING)) END")).drop("__tried", "__attempts")


def next_family(history: DataFrame, task: str = fixed.CLASSIFICATION) -> DataFrame:
    """Per run: the first family of the rotation not tried yet, else the default."""
    families = {c[1]: c[2] for c in fixed.CANDIDATES if c[0] == task}
    available = {c[2] for c in fixed.CANDIDATES if c[0] == task and (c[0], c[1]) not in fixed.UNAVAILABLE and c[1] not in NOT_FITTED}
    cases = " ".join(f"WHEN '{m}' THEN '{f}'" for m, f in families.items())
    order = ", ".join(f"'{f}'" for f in fixed.FAMILY_ROTATION if f in available)
    return history.groupBy("run").agg(F.expr(f"collect_set(CASE model {cases} END) AS tried")).select(
        "run", F.expr(f"coalesce(try_element_at(filter(array({order}), f -> NOT array_contains(tried, f)), 1), '{fixed.DEFAULT_FAMILY}') AS family"))


def report_counts(diagnosed: DataFrame) -> DataFrame:
    """Per run: attempts per diagnosis as text, and the dominant one (the earliest made on ties)."""
    counts = diagnosed.groupBy("run", "failure_type").agg(F.count(F.lit(1)).alias("n"), F.min("iteration").alias("first"))
    return counts.groupBy("run").agg(
        F.expr("array_join(array_sort(collect_list(concat(failure_type, '=', n))), ',') AS diagnoses"),
        F.expr("max_by(failure_type, struct(n, -first)) AS dominant"), F.sum("n").alias("attempts"))


def cheapest(families: Sequence[str], task: str) -> dict[str, str | None]:
    """Cheapest available model per family."""
    order = candidate_order(task)
    of = {c[1]: c[2] for c in fixed.CANDIDATES if c[0] == task}
    return {f: next((m for m in order if of[m] == f), None) for f in families}
