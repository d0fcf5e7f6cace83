"""Percentile bootstrap intervals and paired differences over rows or whole groups.

Named units carry hashed Poisson(1) weights: one md5 per unit, then one multiply-and-mod per draw, so a
draw is reproducible in any engine and a unit's rows always move together. Unnamed rows need no
per-row draws: the metrics depend on cell counts only, and those are drawn directly.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline import fixed
from plumbline.functions.columns import metric_constant
from plumbline.operators.keys import beside, join_on, quoted
from plumbline.operators.metrics import confusion, label_scores, long_scores
from plumbline.operators.ranking import score_edges, with_ranges
from plumbline.session import stage

PRIME = 2**31 - 1
LABEL_METRICS = ("accuracy", "f1", "precision", "recall", "balanced_accuracy")


def _hex_number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:7], 16)


def poisson_steps() -> list[int]:
    """Where the uniform integer passes the Poisson(1) distribution function: weight k starts at step k."""
    steps, total, term = [], 0.0, math.exp(-1.0)
    for k in range(10):
        total += term
        steps.append(int(total * PRIME))
        term /= k + 1
    return steps


def unit_number(unit: str, seed: int) -> str:
    return f"CAST(conv(substr(md5(concat('{seed}|', CAST({unit} AS STRING))), 1, 7), 16, 10) AS BIGINT)"


def weighted(units: DataFrame, unit: str, seed: int, resamples: int) -> DataFrame:
    """Every unit row once per draw with its positive weight ``w``; draws are 0..resamples-1.

    The grouped sums that follow collapse the draws before any shuffle.
    """
    pairs = ", ".join(
        f"struct({r} AS r, {_hex_number(f'a|{seed}|{r}') + 1}L AS ka, {_hex_number(f'b|{seed}|{r}')}L AS kb)"
        for r in range(resamples))
    drawn = units.select("*", F.expr(unit_number(unit, seed) + " AS __u")).select("*", F.expr(f"inline(array({pairs}))"))
    cases = " ".join(f"WHEN __m < {step} THEN {k}" for k, step in enumerate(poisson_steps()))
    return drawn.withColumn("__m", F.expr(f"(__u * ka + kb) % {PRIME}")).withColumn(
        "w", F.expr(f"CASE {cases} ELSE 10 END")).where("w > 0").drop("__u", "__m", "ka", "kb")


def _draw_cells(cells: DataFrame, keys: Sequence[str], by: Sequence[str], seed: int, resamples: int) -> DataFrame:
    """Cell counts of each draw for unnamed rows.

    A cell of n rows with independent Poisson(1) weights sums to Poisson(n), so each cell is drawn on its
    own, seeded by its name: no grouping, no shuffle, no per-row work.
    """
    schema = T.StructType(
        [T.StructField("r", T.IntegerType())] + [cells.schema[c] for c in [*by, *keys]] + [T.StructField("n", T.LongType())])
    named = cells.select(*by, *keys, "n", F.xxhash64(F.lit(seed), *[F.col(c).cast("string") for c in [*by, *keys]]).alias("__seed"))

    def draw(batches: Iterator) -> Iterator:
        import numpy as np

        for pdf in batches:
            for at in range(0, len(pdf), 1000):
                part = pdf.iloc[at:at + 1000]
                counts = np.stack([
                    np.random.Generator(np.random.PCG64(int(s) & (2**63 - 1))).poisson(n, resamples)
                    for s, n in zip(part["__seed"], part["n"])
                ])
                out = part[[*by, *keys]].loc[part.index.repeat(resamples)].reset_index(drop=True)
                out.insert(0, "r", np.tile(np.arange(resamples, dtype="int32"), len(part)))
                out["n"] = counts.reshape(-1)
                yield out[out["n"] > 0]

    return named.mapInPandas(draw, schema)


def interval(draws: DataFrame, keys: Sequence[str], resamples: int, value: str = "value") -> DataFrame:
    """Rows (keys..., low, high, resamples): percentile bounds, only if enough draws are defined.

    At most ``resamples`` values per key, so the exact percentile is bounded.
    """
    tail = (1.0 - fixed.CI_LEVEL) / 2.0
    out = draws.groupBy(*keys).agg(
        F.expr(f"percentile({value}, array({tail!r}D, {1 - tail!r}D)) AS q"), F.count(value).alias("resamples"))
    return out.where(F.col("resamples") >= fixed.MIN_VALID_SHARE * resamples).select(
        *keys, F.expr("round(q[0], 6) AS low"), F.expr("round(q[1], 6) AS high"), "resamples")


def _enough_units(df: DataFrame, by: Sequence[str], unit: str | None) -> DataFrame:
    count = F.count(F.lit(1)) if unit is None else F.count_distinct(F.coalesce(F.col(unit).cast("string"), F.lit(fixed.MISSING_LEVEL)))
    return df.groupBy(*by).agg(count.alias("units")).where(F.col("units") >= fixed.MIN_UNITS)


def _keep_enough(result: DataFrame, df: DataFrame, by: Sequence[str], unit: str | None) -> DataFrame:
    return beside(result, _enough_units(df, by, unit), by).withColumn("unit", F.lit("row" if unit is None else "group"))


def label_draws(
    df: DataFrame, label: str, pred: str, by: Sequence[str] = (), unit: str | None = None, binary: bool = True,
    seed: int = 42, resamples: int = fixed.RESAMPLES,
) -> DataFrame:
    """Rows (by..., r, metric, value): the label metrics of every draw."""
    if unit is None:
        cells = _draw_cells(confusion(df, label, pred, by), ["label", "pred"], by, seed, resamples)
    else:
        own = confusion(df, label, pred, [*by, unit])
        cells = weighted(own, quoted(unit), seed, resamples).groupBy(*by, "r", "label", "pred").agg(F.expr("sum(n * w) AS n"))
    return long_scores(label_scores(cells, [*by, "r"], binary), LABEL_METRICS, [*by, "r"])


# Distinct rows whose weights a task holds at a time: this many times the draws, in doubles.
WEIGHT_BLOCK = 2048


def _poisson_block(u, n, unit: bool, seed: int, resamples: int):
    """Weight totals (rows x draws) of rows with ``n`` occurrences and the unit number ``u``.

    A named unit weighs all its rows alike: n times its Poisson(1). Unnamed rows have one each, so n of them sum to
    Poisson(n); a single one takes the hashed weight, more are drawn by a generator seeded with ``u``.
    """
    import numpy as np

    a = np.array([_hex_number(f"a|{seed}|{r}") + 1 for r in range(resamples)], np.int64)
    b = np.array([_hex_number(f"b|{seed}|{r}") for r in range(resamples)], np.int64)
    w = np.searchsorted(np.array(poisson_steps()), (u[:, None] * a + b) % PRIME, side="right").astype(float)
    if unit:
        return w * n[:, None]
    for i in np.flatnonzero(n > 1):
        w[i] = np.random.Generator(np.random.PCG64(int(u[i]))).poisson(n[i], resamples)
    return w


def _curve_sums(rows, start_tp, start_fp, unit: bool, seed: int, resamples: int):
    """Running weighted totals down the scores of one range, one slot per draw: (tp, fp, area, steps) at its end.

    ``rows`` has score, y, u, n. Blocks end between scores, so a tie is never cut.
    """
    import numpy as np

    rows = rows.sort_values("score", ascending=False, kind="stable")
    score, y, u, n = (rows[c].to_numpy() for c in ("score", "y", "u", "n"))
    tp, fp = start_tp.copy(), start_fp.copy()
    area, steps = np.zeros(resamples), np.zeros(resamples)
    bounds = np.concatenate([[0], np.flatnonzero(score[1:] != score[:-1]) + 1, [len(score)]])
    at = 0
    while at < len(bounds) - 1:
        end = max(at + 1, int(np.searchsorted(bounds, bounds[at] + WEIGHT_BLOCK, side="right")) - 1)
        pos, neg = np.zeros((end - at, resamples)), np.zeros((end - at, resamples))
        # One score may hold more rows than a block: its rows are weighed block by block.
        for lo in range(bounds[at], bounds[end], WEIGHT_BLOCK):
            hi = min(lo + WEIGHT_BLOCK, bounds[end])
            w = _poisson_block(u[lo:hi], n[lo:hi], unit, seed, resamples)
            slot = np.searchsorted(bounds, np.arange(lo, hi), side="right") - 1 - at
            for side, mine in ((pos, y[lo:hi] == 1), (neg, y[lo:hi] != 1)):
                np.add.at(side, slot[mine], w[mine])
        tps, fps = tp + np.cumsum(pos, 0), fp + np.cumsum(neg, 0)
        area += (neg * (tps - pos / 2)).sum(0)
        with np.errstate(divide="ignore", invalid="ignore"):
            steps += np.where(pos > 0, pos * (tps / (tps + fps)), 0.0).sum(0)
        tp, fp, at = tps[-1], fps[-1], end
    return tp, fp, area, steps


def ranking_draws(
    df: DataFrame, label: str, proba: str, by: Sequence[str] = (), unit: str | None = None,
    seed: int = 42, resamples: int = fixed.RESAMPLES,
) -> DataFrame:
    """Rows (by..., r, metric, value) for roc_auc and pr_auc of every draw, on the exact scores.

    Rows are dealt into ranges of scores of bounded share. A first pass gives each range its weighted totals, one slot per
    draw; added up from the top they are the ranges' starting points; a second pass runs down each range from there. No
    draw is ever a row of its own before the sums, and a task holds one range (or a segment's part of it).
    """
    import numpy as np
    import pandas as pd

    keys, unnamed = list(by), unit is None
    known = df.where(F.col(proba).isNotNull()).select(*[F.col(c) for c in keys], F.col(proba).cast("double").alias("score"), F.col(label).cast("int").alias("y"),
                                                      (F.lit(None).cast("string") if unnamed else F.col(unit).cast("string")).alias("unit_name"))
    cells = with_ranges(known, "score", score_edges(df, proba)).groupBy(*keys, "b", "score", "y", "unit_name").agg(F.count(F.lit(1)).alias("n"))
    if unnamed:
        number = F.pmod(F.xxhash64(F.lit(seed), *[F.col(c).cast("string") for c in keys], "score", "y"), F.lit(PRIME))
    else:
        number = F.expr(unit_number("unit_name", seed))
    cells = stage(cells.select(*keys, "b", "score", "y", number.alias("u"), "n").where("u IS NOT NULL"), "draw-cells")
    named = [f"__k{i}" for i, _ in enumerate(keys)]
    cells = cells.select(*[F.col(c).alias(k) for c, k in zip(keys, named)], "b", "score", "y", "u", "n")
    key_fields = [T.StructField(k, cells.schema[k].dataType) for k in named]
    slots = T.ArrayType(T.DoubleType())
    with_b = [*key_fields, T.StructField("b", T.DoubleType())]

    def schema(fields: list, *names: str) -> T.StructType:
        return T.StructType([*fields, *[T.StructField(n, slots) for n in names]])

    def keyed(key: tuple, **columns) -> pd.DataFrame:
        return pd.DataFrame({**dict(zip([*named, "b"], [[k] for k in key])), **{c: [v] for c, v in columns.items()}})

    def totals(key, rows):
        pos, neg = np.zeros(resamples), np.zeros(resamples)
        for lo in range(0, len(rows), WEIGHT_BLOCK):
            part = rows.iloc[lo:lo + WEIGHT_BLOCK]
            w = _poisson_block(part["u"].to_numpy(), part["n"].to_numpy(), not unnamed, seed, resamples)
            one = part["y"].to_numpy() == 1
            pos, neg = pos + w[one].sum(0), neg + w[~one].sum(0)
        return keyed(key, pos=pos, neg=neg)

    def starts(rows):
        rows = rows.sort_values("b", ascending=False)
        out = rows[[*named, "b"]].copy()
        for c in ("pos", "neg"):
            values = np.stack(rows[c].to_list())
            ends = np.cumsum(values, 0)
            out[f"{c}_off"], out[f"{c}_all"] = list(ends - values), [ends[-1]] * len(rows)
        return out

    def curve(key, rows, offset):
        if not len(rows):
            return pd.DataFrame({c: [] for c in [*named, "b", "area", "steps", "pos_all", "neg_all"]})
        o = offset.iloc[0]
        _, _, area, steps = _curve_sums(rows, np.asarray(o["pos_off"]), np.asarray(o["neg_off"]), not unnamed, seed, resamples)
        return keyed(key, area=area, steps=steps, pos_all=np.asarray(o["pos_all"]), neg_all=np.asarray(o["neg_all"]))

    sums = cells.groupBy(*named, "b").applyInPandas(totals, schema(with_b, "pos", "neg"))
    # At most one row a range and segment, RANGES of them in a group.
    offsets = sums.groupBy(*named).applyInPandas(starts, schema(with_b, "pos_off", "pos_all", "neg_off", "neg_all"))
    parts = cells.groupBy(*named, "b").cogroup(offsets.groupBy(*named, "b")).applyInPandas(curve, schema(with_b, "area", "steps", "pos_all", "neg_all"))
    slotted = parts.select(*named, F.posexplode(F.arrays_zip("area", "steps", "pos_all", "neg_all")).alias("r", "x"))
    out = slotted.groupBy(*named, "r").agg(F.sum("x.area").alias("area"), F.sum("x.steps").alias("steps"), F.max("x.pos_all").alias("p"), F.max("x.neg_all").alias("n"))
    out = out.select(*[F.col(k).alias(c) for c, k in zip(keys, named)], "r", F.expr("try_divide(area, p * n) AS roc_auc"), F.expr("try_divide(steps, p) AS pr_auc"))
    return long_scores(out, ("roc_auc", "pr_auc"), [*by, "r"])


def error_draws(
    df: DataFrame, truth: str, pred: str, unit: str, by: Sequence[str] = (), seed: int = 42, resamples: int = fixed.RESAMPLES,
) -> DataFrame:
    """Rows (by..., r, metric, value) for r2, mae and rmse from per-unit sums."""
    y, p = f"CAST({truth} AS DOUBLE)", f"CAST({pred} AS DOUBLE)"
    own = df.groupBy(*by, unit).agg(
        F.expr("count(1) AS n"), F.expr(f"sum({y}) AS sy"), F.expr(f"sum({y} * {y}) AS syy"),
        F.expr(f"sum(({y} - {p}) * ({y} - {p})) AS sse"), F.expr(f"sum(abs({y} - {p})) AS sae"))
    sums = weighted(own, quoted(unit), seed, resamples).groupBy(*by, "r").agg(
        *[F.expr(f"sum({c} * w) AS {c}") for c in ("n", "sy", "syy", "sse", "sae")])
    out = sums.select(*by, "r", F.expr("1 - try_divide(sse, syy - sy * sy / n) AS r2"), F.expr("sae / n AS mae"), F.expr("sqrt(sse / n) AS rmse"))
    return long_scores(out, ("r2", "mae", "rmse"), [*by, "r"])


def bootstrap(draws: DataFrame, df: DataFrame, by: Sequence[str] = (), unit: str | None = None, resamples: int = fixed.RESAMPLES) -> DataFrame:
    """Rows (by..., metric, low, high, resamples, units, unit) for drawn scores of ``df``."""
    return _keep_enough(interval(draws, [*by, "metric"], resamples), df, by, unit)


def pair_predictions(candidate: DataFrame, baseline: DataFrame, keys: Sequence[str], label: str, pred: str, extra: Sequence[str] = ()) -> DataFrame:
    """Both predictions on the same rows. Rows on one side only make the pairing void (``unpaired``)."""
    a = candidate.select(*keys, *extra, F.col(label).alias("y"), F.col(pred).alias("pa"), F.lit(True).alias("__a"))
    b = baseline.select(*keys, F.col(pred).alias("pb"), F.lit(True).alias("__b"))
    return join_on(a, b, keys, "full").withColumn("unpaired", F.expr("__a IS NULL OR __b IS NULL")).drop("__a", "__b")


def paired_delta(
    paired: DataFrame, by: Sequence[str] = (), unit: str | None = None, binary: bool = True,
    seed: int = 42, resamples: int = fixed.RESAMPLES,
) -> DataFrame:
    """Rows (by..., metric, status, delta, low, high, p_better, resamples): candidate minus baseline on the same draws."""
    joint = paired.groupBy(*by, *([unit] if unit else []), F.col("y").cast("string").alias("label"),
                           F.col("pa").cast("string").alias("pa"), F.col("pb").cast("string").alias("pb")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("unpaired").cast("bigint")).alias("lost"))
    lost = joint.groupBy(*by).agg(F.sum("lost").alias("lost"))

    def difference(cells: DataFrame, extra: Sequence[str]) -> DataFrame:
        """Both sides scored in one pass, then subtracted."""
        sides = cells.select(*by, *extra, "label", "n", F.expr(
            "inline(array(struct('a' AS side, pa AS pred), struct('b' AS side, pb AS pred)))"))
        keys = [*by, *extra, "side"]
        own = sides.groupBy(*keys, "label", "pred").agg(F.sum("n").alias("n"))
        long = long_scores(label_scores(own, keys, binary), LABEL_METRICS, keys)
        return long.groupBy(*by, *extra, "metric").agg(
            F.expr("max(IF(side = 'a', value, NULL)) - max(IF(side = 'b', value, NULL)) AS value")).where("value IS NOT NULL")

    complete = joint.where("lost = 0")
    if unit is None:
        drawn = _draw_cells(complete.drop("lost"), ["label", "pa", "pb"], by, seed, resamples)
    else:
        drawn = weighted(complete, quoted(unit), seed, resamples).groupBy(*by, "r", "label", "pa", "pb").agg(F.expr("sum(n * w) AS n"))
    deltas = difference(drawn, ["r"])
    better = F.when(metric_constant(F.col("metric"), 1, "string") == fixed.MINIMIZE, F.col("value") < 0).otherwise(F.col("value") > 0)
    tail = (1.0 - fixed.CI_LEVEL) / 2.0
    # At most ``resamples`` values per key.
    drawn_stats = deltas.groupBy(*by, "metric").agg(
        F.expr(f"percentile(value, array({tail!r}D, {1 - tail!r}D)) AS q"), F.count("value").alias("resamples"),
        F.round(F.avg(better.cast("double")), 4).alias("p_better"),
    ).where(F.col("resamples") >= fixed.MIN_VALID_SHARE * resamples).select(
        *by, "metric", F.expr("round(q[0], 6) AS low"), F.expr("round(q[1], 6) AS high"), "resamples", "p_better")
    observed = difference(complete, []).withColumn("delta", F.round("value", 6)).drop("value")
    keys = [*by, "metric"]
    out = join_on(observed, drawn_stats, keys, "left")
    out = beside(out, lost, by)
    return out.select(
        *keys, F.expr("CASE WHEN lost > 0 OR low IS NULL THEN 'skipped' ELSE 'measured' END AS status"),
        F.expr("CASE WHEN lost > 0 THEN 'split_changed' WHEN low IS NULL THEN 'degenerate' END AS reason"),
        *[F.expr(f"CASE WHEN lost = 0 THEN {c} END AS {c}") for c in ("delta", "low", "high", "p_better", "resamples")])


def inside(trials: DataFrame, history: DataFrame, run: str, iteration: str = "iteration") -> DataFrame:
    """Earlier attempts of a run whose score lies inside a later attempt's interval.

    An equi-join on the run with the range as a filter; a run holds at most its iteration limit of rows.
    """
    later = trials.select(run, F.col(iteration).alias("iteration"), "low", "high")
    earlier = history.select(F.col(run).alias("__run"), F.col(iteration).alias("other"), F.col("score").alias("other_score"))
    return later.join(earlier, (F.col(run) == F.col("__run")) & (F.col("other") < F.col("iteration"))
                      & F.col("other_score").between(F.col("low"), F.col("high"))).drop("__run")
