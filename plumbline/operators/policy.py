"""The next attempt of every run, from its ledger alone: diagnosis, prescription, weight search, novelty.

``trials`` is an append-only trial table (see ``operators.trials``) whose ``params`` map holds what was asked for, as JSON
text per value. ``next_attempts`` reads it and returns one plan per run, so a thousand runs are planned by one job. Windows
run inside one run, whose attempts its iteration limit bounds; the rest is joins on the run.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline import fixed
from plumbline.operators import trials as T


def _by_model(task: str, position: int, otherwise: str = "NULL", model: str = "model") -> str:
    """SQL: the candidate table's entry at ``position`` for the row's model."""
    cases = " ".join(f"WHEN '{c[1]}' THEN {c[position]!r}" for c in fixed.CANDIDATES if c[0] == task)
    return f"CASE {model} {cases} ELSE {otherwise} END"


def _cheapest_of(task: str, family: str = "family") -> str:
    order = T.candidate_order(task)
    families = {c[1]: c[2] for c in fixed.CANDIDATES if c[0] == task}
    first: dict[str, str] = {}
    for model in order:
        first.setdefault(families[model], model)
    cases = " ".join(f"WHEN '{f}' THEN '{m}'" for f, m in first.items())
    return f"CASE {family} {cases} ELSE '{fixed.START_MODEL}' END"


def _in_turn(values: Iterable, number: str) -> str:
    values = list(values)
    return f"element_at(array({', '.join(repr(v) for v in values)}), CAST({number} % {len(values)} AS INT) + 1)"


def _text(value: str) -> str:
    return f"CAST({value} AS STRING)"


def _map(**entries: str) -> str:
    """SQL: a string map; values are SQL numbers."""
    return "map(" + ", ".join(f"'{k}', {_text(v)}" for k, v in entries.items()) + ")"


def merged(base: str, new: str) -> str:
    """SQL: ``base`` with the entries of ``new`` in place of its own."""
    return f"map_concat(map_filter({base}, (k, v) -> NOT map_contains_key({new}, k)), {new})"


def _number(name: str, default: float) -> str:
    return f"coalesce(try_cast(element_at(params, '{name}') AS DOUBLE), {default}D)"


def _whole(value: str) -> str:
    return f"CAST({value} AS BIGINT)"


def effective(params: str, model: str, allowed: dict[str, Iterable[str]], extra: Sequence[str] = ("train_subsample",)) -> Column:
    """The entries that the model's trainer takes; the others change no fit, so they don't make an attempt new."""
    cases = " ".join(
        f"WHEN '{m}' THEN array({', '.join(repr(n) for n in sorted({*names, *extra}))})" for m, names in allowed.items())
    return F.expr(f"map_filter({params}, (k, v) -> array_contains(CASE {model} {cases} ELSE array('') END, k))")


def prescribed(trials: DataFrame, task: str = fixed.CLASSIFICATION) -> DataFrame:
    """Adds, per attempt, what its diagnosis asks of the next one: ``family``, ``next_model``, ``next_params`` and ``origin``.

    ``origin`` is ``weight`` where the weight search names a value, else the failure type.
    """
    t = T.propose_weight(trials)
    own = _by_model(task, 2, f"'{fixed.DEFAULT_FAMILY}'")
    cost = _by_model(task, 3, "0")
    light = f"CASE WHEN {cost} >= {fixed.SHRINK_COST} THEN 'linear' ELSE 'tree' END"
    bare = "map_filter(params, (k, v) -> k NOT IN ('n_estimators', 'max_iter'))"
    shrunk = f"CASE WHEN {cost} >= {fixed.SHRINK_COST} THEN {fixed.SHRINK_ROUNDS_LINEAR} ELSE {fixed.SHRINK_ROUNDS_TREE} END"
    trees = _whole(f"greatest({fixed.OOM_TREES_LEAST}, floor({_number('n_estimators', fixed.OOM_TREES_DEFAULT)} / {fixed.OOM_TREES_DIVISOR}))")
    rounds = _whole(f"least({fixed.UNDERFIT_ROUNDS_MOST}, greatest({fixed.UNDERFIT_ROUNDS_LEAST}, {fixed.UNDERFIT_FACTOR} * {_number('max_iter', fixed.UNDERFIT_ROUNDS_DEFAULT)}))")
    changed = {
        "oom": merged(bare, _map(max_iter=shrunk, train_subsample=repr(fixed.OOM_SUBSAMPLE), n_estimators=trees)),
        "too_slow": merged(bare, _map(max_iter=str(fixed.SLOW_ROUNDS), train_subsample=repr(fixed.SLOW_SUBSAMPLE))),
        "underfitting": merged("params", _map(max_iter=rounds, learning_rate=repr(fixed.UNDERFIT_RATE), max_leaf_nodes=str(fixed.UNDERFIT_LEAVES))),
        "overfitting": merged("params", _map(l2_regularization=repr(fixed.OVERFIT_L2), max_depth=str(fixed.OVERFIT_DEPTH), learning_rate=repr(fixed.OVERFIT_RATE))),
        "wrong_model_family": f"IF(new_family = 'linear', {_map(max_iter=str(fixed.FAMILY_ROUNDS_LINEAR))}, {_map(n_estimators=str(fixed.FAMILY_TREES))})",
        "data_issue": "params" if task == fixed.REGRESSION else merged("params", "map('class_weight', 'balanced')"),
        "hyperparam": merged("params", _map(learning_rate=_in_turn(fixed.TUNE_RATE, "(iteration - 1)"), max_depth=_in_turn(fixed.TUNE_DEPTH, "(iteration - 1)"),
                                            max_iter=_in_turn(fixed.TUNE_ROUNDS, "(iteration - 1)"))),
        "unknown": merged("params", _map(learning_rate=_in_turn(fixed.UNKNOWN_RATE, "(iteration + 1)"), max_depth=_in_turn(fixed.UNKNOWN_DEPTH, "(iteration + 1)"),
                                         max_iter=str(fixed.UNKNOWN_ROUNDS))),
    }
    robust = f"IF(own_family IN ({', '.join(map(repr, fixed.ROBUST_FROM))}), 'gbdt', own_family)"
    family = (f"CASE WHEN failure_type IN ('oom', 'too_slow') THEN {light} WHEN failure_type = 'wrong_model_family' THEN new_family "
              f"WHEN failure_type = 'data_issue' AND {str(task == fixed.REGRESSION).lower()} THEN {robust} ELSE own_family END")
    # Families seen up to the attempt: bounded by the iteration limit.
    seen = f"array_distinct(collect_list(own_family) {T.UPTO})"
    available = {c[2] for c in fixed.CANDIDATES if c[0] == task and c[1] in T.candidate_order(task)}
    rotation = ", ".join(f"'{f}'" for f in fixed.FAMILY_ROTATION if f in available)
    t = t.withColumn("own_family", F.expr(own)).withColumn("__seen", F.expr(seen)).withColumn(
        "new_family", F.expr(f"coalesce(try_element_at(filter(array({rotation}), f -> NOT array_contains(__seen, f)), 1), '{fixed.DEFAULT_FAMILY}')"))
    t = t.withColumn("family", F.expr(family)).withColumn("next_model", F.expr(_cheapest_of(task)))
    cases = " ".join(f"WHEN '{k}' THEN {v}" for k, v in changed.items())
    weighed = merged("params", "map('class_weight', concat('{\"0\": 1, \"1\": ', CAST(proposed_weight AS STRING), '}'))")
    t = t.withColumn("origin", F.expr("IF(proposed_weight IS NOT NULL, 'weight', failure_type)"))
    return t.withColumn("next_params", F.expr(f"CASE WHEN origin = 'weight' THEN {weighed} ELSE CASE failure_type {cases} ELSE params END END")).drop("__seen", "own_family", "new_family")


def next_attempts(trials: DataFrame, allowed: dict[str, Iterable[str]], task: str = fixed.CLASSIFICATION) -> DataFrame:
    """One row per run: run, iteration (of the next attempt), answers, origin, model, params, repeated.

    A plan that would fit what an earlier attempt fitted takes the cheapest untried model instead (origin ``new_model``), or, when
    all were tried, a halved learning rate and more rounds (origin ``new_rounds``). The preprocessing steps stay those of the last attempt.
    """
    full = prescribed(trials, task).withColumn("__last", F.expr("max(iteration) OVER (PARTITION BY run)"))
    plans = full.where("iteration = __last").select(
        "run", (F.col("iteration") + 1).alias("iteration"), F.col("failure_type").alias("answers"), "origin", F.col("next_model").alias("model"),
        F.col("next_params").alias("asked"), effective("next_params", "next_model", allowed).alias("params"), "pipeline", "tuned")
    history = trials.withColumn("params", effective("params", "model", allowed))
    told = T.novelty(plans, history, task)
    return told.select(
        "run", "iteration", "answers",
        F.expr("CASE WHEN NOT repeated THEN origin WHEN next_model IS NULL THEN 'new_rounds' ELSE 'new_model' END").alias("origin"),
        F.expr("coalesce(next_model, model)").alias("model"),
        F.expr(f"CASE WHEN next_params IS NULL THEN asked ELSE {merged('asked', 'next_params')} END").alias("params"), "repeated")


def typed(params: dict[str, str] | None) -> dict:
    """The plan's parameters as values: JSON where it is JSON, else the text."""
    out = {}
    for key, text in (params or {}).items():
        try:
            out[key] = json.loads(text)
        except ValueError:
            out[key] = text
    return out


def as_text(params: dict) -> dict[str, str]:
    """Parameters as the trial table keeps them."""
    return {k: v if isinstance(v, str) else json.dumps(v) for k, v in params.items() if v is not None}


def audited(trials: DataFrame, allowed: dict[str, Iterable[str]], task: str = fixed.CLASSIFICATION) -> DataFrame:
    """Rows (run, iteration, origin, model, params, planned_origin, planned_model, planned_params, follows) for every attempt but the first.

    Each attempt is planned again from the attempts before it. A prefix is a run of its own here, so all are planned by one
    job; prefixes of a run hold at most the square of its iteration limit of rows.
    """
    later = trials.select(F.col("run").alias("__run"), F.col("iteration").alias("__k")).where("__k > 1")
    prefixes = trials.join(later, (F.col("run") == F.col("__run")) & (F.col("iteration") < F.col("__k"))).withColumn("run", F.struct("__run", "__k")).drop("__run", "__k")
    plans = next_attempts(prefixes, allowed, task).select(
        F.col("run.__run").alias("__run"), F.col("run.__k").alias("__k"), F.col("origin").alias("planned_origin"), F.col("model").alias("planned_model"),
        F.col("params").alias("planned_params"))
    asked = lambda c: effective(c, "model", allowed)
    same = F.expr("array_sort(map_entries(__own)) = array_sort(map_entries(__planned)) AND model = planned_model AND origin = planned_origin")
    joined = trials.join(plans, (F.col("run") == F.col("__run")) & (F.col("iteration") == F.col("__k")))
    return joined.withColumn("__own", asked("params")).withColumn("__planned", asked("planned_params")).select(
        "run", "iteration", "origin", "model", "params", "planned_origin", "planned_model", "planned_params", same.alias("follows"))
