"""Prepare, fit candidates in turn or as their ledger asks, keep the best on validation, score the winner once on test.

All attempts of a search read one encoded table. Preprocessing steps are fitted once for each content (step list, family needs,
rows they learn from) and kept; they are projections, so an attempt writes no table of its own but its narrow scores, which
are removed once they are summed.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline import fixed
from plumbline.operators import cuts, metrics, policy, ranking, splits, steps
from plumbline.operators import trials as ledger_rules
from plumbline.operators.encoding import Layout, apply_encoding, fit_encoding
from plumbline.plans import fits
from plumbline.session import discard, stage


@dataclass
class Prepared:
    """A split, encoded table on shared storage, and how it came about."""

    rows: DataFrame
    layout: Layout
    keys: list[str]
    task: str
    classes: int
    group: str | None = None
    seed: int = 42
    kept: dict = field(default_factory=dict)

    def once(self, key: tuple, make: Callable):
        """What ``make`` returned the first time for this content."""
        if key not in self.kept:
            self.kept[key] = make()
        return self.kept[key]

    def part(self, split: str) -> DataFrame:
        return self.rows.where(F.col("split") == split)


def prepare(df: DataFrame, keys: Sequence[str], label: str, features: Sequence[str], task: str, group: str | None = None, seed: int = 42) -> Prepared:
    """Encode and split once; every trial reads the written table."""
    layout = fit_encoding(df, features)
    split = splits.assign_splits(df, keys, label if task == fixed.CLASSIFICATION else None, group, seed)
    keep = [*keys, label, "split", *([group] if group and group not in keys else [])]
    encoded = apply_encoding(split, layout, keep=keep).withColumnRenamed(label, "y")
    rows = stage(encoded, "encoded")
    classes = int(rows.agg(F.count_distinct("y").alias("k")).first()["k"]) if task == fixed.CLASSIFICATION else 0
    return Prepared(rows, layout, list(keys), task, classes, group, seed)


@dataclass
class Trial:
    iteration: int
    model: str
    params: dict
    status: str = "ok"
    error_type: str | None = None
    error: str | None = None
    metrics: dict = field(default_factory=dict)
    applied: list[str] = field(default_factory=list)
    dropped: list[str] = field(default_factory=list)
    cut: float | None = None
    wall_sec: float = 0.0
    fit: fits.Fit | None = None
    steps: steps.FittedSteps | None = None


def score_predictions(pred: DataFrame, task: str, classes: int, by: Sequence[str] = ()) -> DataFrame:
    """Long scores of predictions with ``y``, ``pred`` and maybe ``proba``."""
    if task == fixed.REGRESSION:
        return metrics.long_scores(metrics.regression_scores(pred, "y", "pred", by), ("r2", "mae", "rmse"), by)
    binary = classes == 2
    labelled = pred.withColumn("y", F.col("y").cast("bigint"))
    wide = metrics.label_scores(metrics.confusion(labelled, "y", "pred", by), by, binary)
    names = ["accuracy", "f1", "precision", "recall", "balanced_accuracy", *(["specificity"] if binary else [])]
    out = metrics.long_scores(wide, names, by)
    if binary and "proba" in pred.columns:
        r = ranking.ranking(labelled, "y", "proba", by)
        out = out.unionByName(metrics.long_scores(r, ("roc_auc", "pr_auc", "ks", "best_cut_ceiling"), by))
    return out


def run_trial(data: Prepared, iteration: int, model: str, params: dict, spec: Sequence[dict] = (), metric: str = "f1", tune_cut: bool = False) -> Trial:
    """One attempt: hold rows back, fit the steps and the family on the rest of train, score train and val."""
    started = time.time()
    trial = Trial(iteration, model, dict(params))
    try:
        name = fits.resolve_name(model, data.task)
        rows = data.rows
        cut_rows, rest, stop = None, ("all",), ("none",)
        train = data.part("train")
        params = dict(params)
        share = params.pop("train_subsample", None)
        by_class = "y" if data.task == fixed.CLASSIFICATION else None
        if tune_cut and data.task == fixed.CLASSIFICATION and data.classes == 2:
            marked, held = data.once(("cut",), lambda: _held(splits.hold_back(rows, data.keys, fixed.CUT_FRACTION, "cut", data.group, data.seed, "y"), "cut-rows"))
            if cuts.cut_refusal(metric, data.task, data.classes, held) is None:
                cut_rows, train, rest = marked.where("held").drop("held"), marked.where("NOT held").drop("held"), ("cut",)
        if share is not None and 0 < float(share) < 1:
            train = data.once((*rest, "share", float(share)), lambda: stage(
                splits.train_subsample(train.withColumn("split", F.lit("train")), data.keys, float(share), data.seed), "train-share"))
            rest = (*rest, float(share))
        if name in fixed.NATIVE_MISSING and stops_early(params):
            marked, held = data.once((*rest, "stop"), lambda: _held(splits.hold_back(
                train.withColumn("split", F.lit("train")), data.keys, fixed.STOP_FRACTION, "stop", data.group, data.seed, by_class), "stop-rows"))
            if held >= fixed.STOP_MIN_ROWS:
                train, stop = marked, ("stop",)
        columns = data.layout.columns
        # Fills and scales come from the rows the family learns from, never from those that stop it.
        native, sensitive = name in fixed.NATIVE_MISSING, name in fixed.SCALE_SENSITIVE
        learn = train.where("NOT held").drop("held") if "held" in train.columns else train
        prepared = data.once(("steps", *rest, *stop, json.dumps(list(spec), sort_keys=True), native and bool(spec), sensitive), lambda: steps.fit_steps(
            learn, spec, columns, native_missing=native, scale_sensitive=sensitive))
        trial.fit = fits.fit(prepared.apply(train), name, data.task, prepared_features(prepared, columns), params=params, seed=data.seed)
        trial.steps, trial.applied, trial.dropped = prepared, [*prepared.applied, *([f"train_subsample({share})"] if len(rest) > 1 else [])], trial.fit.dropped
        if cut_rows is not None:
            held_pred = predict(trial, cut_rows, ["y"])
            best = cuts.sweep_cuts(held_pred, "y", "proba", metric).first() if "proba" in held_pred.columns else None
            trial.cut = None if best is None else float(best["cut"])
        scored = stage(predict(trial, rows.where("split IN ('train', 'val')"), [*data.keys, "y", "split"]), "scored")
        long = score_predictions(scored, data.task, data.classes, ["split"])
        for row in long.collect():
            trial.metrics[row["metric"] if row["split"] == "val" else f"train_{row['metric']}"] = float(row["value"])
        discard(scored)
    except Exception as problem:  # noqa: BLE001 - an attempt that fails is a result; the loop goes on
        trial.status, trial.error_type, trial.error = "error", error_kind(problem), str(problem)[:500]
    trial.wall_sec = time.time() - started
    return trial


def _held(marked: DataFrame, label: str) -> tuple[DataFrame, int]:
    rows = stage(marked, label)
    return rows, rows.where("held").count()


def stops_early(params: dict) -> bool:
    """Early stopping is asked for by a flag or by a number of rounds above 0."""
    asked = params.get("early_stopping", params.get("early_stopping_rounds"))
    return bool(asked) and not (isinstance(asked, (int, float)) and asked <= 0)


def error_kind(problem: Exception) -> str:
    """Kind of a failed attempt, by what was raised and what it says."""
    text = f"{type(problem).__name__}: {problem}".lower()
    if isinstance(problem, MemoryError) or "outofmemory" in text or "out of memory" in text or "java heap space" in text:
        return "oom"
    if isinstance(problem, TimeoutError) or "timed out" in text or "timeout" in text:
        return "too_slow"
    if isinstance(problem, fits.UnsupportedModel):
        return "unsupported_model"
    return "config_error" if isinstance(problem, (ValueError, TypeError, KeyError)) else "data_issue"


def prepared_features(prepared: steps.FittedSteps, columns: Sequence[str]) -> list[str]:
    """Step outputs that are features: everything the steps left, minus the carried columns."""
    known = set(columns)
    added = [c for c in prepared.columns if c not in known]
    return [c for c in prepared.columns if c in known] + added


def predict(trial: Trial, rows: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Predictions by a trial's own steps, family and cut."""
    ready = trial.steps.apply(rows)
    out = fits.predict_rows(trial.fit, ready, keep)
    if trial.cut is not None and "proba" in out.columns:
        out = out.withColumn("pred", (F.col("proba") >= F.lit(trial.cut)).cast("bigint"))
    return out


@dataclass
class Outcome:
    trials: list[Trial]
    best: Trial | None
    reason: str
    holdout: dict


def better(score: float | None, best: float | None, metric: str) -> bool:
    if score is None or score != score:
        return False
    if best is None:
        return True
    return score < best if fixed.METRICS[metric][1] == fixed.MINIMIZE else score > best


def search(
    data: Prepared, candidates: Sequence[tuple[str, dict]], metric: str, bar: float | None,
    spec: Sequence[dict] = (), max_iterations: int = fixed.MAX_ITERATIONS, stall_limit: int = fixed.STALL_LIMIT,
    total_sec: float = fixed.TIME_BUDGET_SEC, tune_cut: bool = False,
) -> Outcome:
    """Candidates in order until the goal, the iteration limit, the stall limit or the time is reached.

    The loop holds one row per attempt; rows stay on the cluster. The winner meets the test rows once.
    """
    trials: list[Trial] = []
    best: Trial | None = None
    stall, spent, reason = 0, 0.0, "candidates_used"
    down = fixed.METRICS[metric][1] == fixed.MINIMIZE
    for iteration, (model, params) in enumerate(candidates, start=1):
        trial = run_trial(data, iteration, model, params, spec, metric, tune_cut)
        trials.append(trial)
        spent += trial.wall_sec
        score = trial.metrics.get(metric)
        if better(score, best.metrics.get(metric) if best else None, metric):
            best, stall = trial, 0
        else:
            stall += 1
        reached = score is not None and bar is not None and (score <= bar if down else score >= bar)
        if reached:
            reason = "goal_reached"
        elif iteration >= max_iterations:
            reason = "max_iterations"
        elif stall >= stall_limit:
            reason = "stalled"
        elif spent >= total_sec * (1 - fixed.HOLDOUT_RESERVE):
            reason = "out_of_time"
        else:
            continue
        break
    return Outcome(trials, best, reason, holdout_scores(data, best))


def holdout_scores(data: Prepared, best: Trial | None) -> dict:
    """The winner on the test rows, which nothing has read before."""
    if best is None:
        return {}
    tested = stage(predict(best, data.part("test"), [*data.keys, "y"]), "tested")
    scores = {r["metric"]: float(r["value"]) for r in score_predictions(tested, data.task, data.classes).collect()}
    discard(tested)
    return scores


TRIAL_SCHEMA = (
    "run string, iteration int, model string, metric string, direction string, score double, status string, error_type string, "
    "recall double, specificity double, roc_auc double, ceiling double, headroom double, train_score double, train_val_gap double, bar double, weight double, "
    "imbalance double, params map<string, string>, ran map<string, string>, wall_sec double, pipeline string, tuned boolean, origin string")


def trial_row(t: Trial, run: str, metric: str, bar: float | None = None, imbalance: float | None = None, origin: str = "given") -> tuple:
    """An attempt as a row of the ledger. ``params`` is what was asked for and has a meaning here, ``ran`` what the fit used."""
    direction = fixed.METRICS[metric][1]
    sign = -1.0 if direction == fixed.MINIMIZE else 1.0
    m = t.metrics
    score, train, ceiling = m.get(metric), m.get(f"train_{metric}"), m.get("best_cut_ceiling")
    weight, named = t.params.get("scale_pos_weight"), t.params.get("class_weight")
    if isinstance(named, dict):
        weight = named.get(1, named.get("1"))
    elif named == "balanced":
        weight = imbalance
    asked = {k: v for k, v in t.params.items() if k not in (t.dropped or ())}
    return (
        run, t.iteration, t.model, metric, direction, score, t.status, t.error_type, m.get("recall"), m.get("specificity"), m.get("roc_auc"), ceiling,
        None if ceiling is None or metric != "balanced_accuracy" or score is None else ceiling - score, train,
        None if score is None or train is None else round(sign * (train - score), 6), bar, float(weight or 1.0), imbalance, policy.as_text(asked),
        policy.as_text(t.fit.applied) if t.fit else None, float(t.wall_sec), "; ".join(t.applied), t.cut is not None, origin)


def trial_table(spark, outcome: Outcome, run: str, metric: str, bar: float | None = None, imbalance: float | None = None) -> DataFrame:
    """The attempts as a table for the ledger and its rules: one row each, driver-sized by the iteration limit."""
    return spark.createDataFrame([trial_row(t, run, metric, bar, imbalance) for t in outcome.trials], TRIAL_SCHEMA)


def imbalance_ratio(data: Prepared) -> float | None:
    """Commonest over rarest class, for the first step of the weight search."""
    if data.task != fixed.CLASSIFICATION:
        return None
    row = data.rows.groupBy("y").count().agg(F.round(F.max("count") / F.min("count"), 4).alias("r")).first()
    return row["r"]


def closed_search(
    data: Prepared, start: tuple[str, dict], metric: str, bar: float | None, path: str, run: str = "run",
    spec: Sequence[dict] = (), max_iterations: int = fixed.MAX_ITERATIONS, stall_limit: int = fixed.STALL_LIMIT,
    total_sec: float = fixed.TIME_BUDGET_SEC, tune_cut: bool = False,
) -> Outcome:
    """A search that plans itself: one given attempt, every later one as the ledger below ``path`` asks.

    Each attempt is appended to the ledger as soon as it ends. The stop reason and the next attempt are then read from the table
    (``trials.stop_reasons``, ``policy.next_attempts``), so a search that breaks off goes on from what is written there.
    """
    spark = data.rows.sparkSession
    ratio = imbalance_ratio(data)
    done: list[Trial] = []
    model, params, origin, iteration = start[0], dict(start[1]), "given", 1
    reason = None
    while reason is None:
        trial = run_trial(data, iteration, model, params, spec, metric, tune_cut)
        done.append(trial)
        spark.createDataFrame([trial_row(trial, run, metric, bar, ratio, origin)], TRIAL_SCHEMA).coalesce(1).write.mode("append").parquet(path)
        history = read_ledger(spark, path).where(F.col("run") == run)
        reason = ledger_rules.stop_reasons(history, total_sec, max_iterations, stall_limit).first()["reason"]
        if reason is None:
            plan = policy.next_attempts(history, fits.PARAMS, data.task).first()
            model, params, origin, iteration = plan["model"], policy.typed(plan["params"]), plan["origin"], plan["iteration"]
    best = None
    for trial in done:
        if better(trial.metrics.get(metric), best.metrics.get(metric) if best else None, metric):
            best = trial
    return Outcome(done, best, reason, holdout_scores(data, best))


def read_ledger(spark, path: str) -> DataFrame:
    return spark.read.schema(TRIAL_SCHEMA).parquet(path)
