"""Scalar rules: buckets, cuts, keys, hashes, map filters, parameter limits."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline import fixed


def missing_as_null(col: Column, is_float: bool) -> Column:
    """NaN becomes NULL on float columns: NULL is the only missing value from here on."""
    return F.nanvl(col, F.lit(None)) if is_float else col


def bucket(value: Column, edges: Sequence[tuple[float, str]], last: str) -> Column:
    """Label of the first edge at or above ``value``, else ``last``; NULL stays NULL."""
    out = F.when(value.isNull(), F.lit(None).cast("string"))
    for edge, label in edges:
        out = out.when(value <= edge, label)
    return out.otherwise(last)


def to_number(text: Column) -> Column:
    """Text to double; what cannot be read becomes NULL."""
    return text.try_cast("double")


def coercion_failed(text: Column) -> Column:
    return text.isNotNull() & to_number(text).isNull()


def label_at_cut(proba: Column, cut) -> Column:
    """1 from the cut upwards, ties included."""
    return (proba >= (cut if isinstance(cut, Column) else F.lit(float(cut)))).cast("int")


def marker_form(text: Column) -> Column:
    """Trimmed, lower-cased text for exact marker comparison."""
    return F.lower(F.regexp_replace(text, r"^\s+|\s+$", ""))


def group_id(col: Column) -> Column:
    return F.coalesce(col.cast("string"), F.lit(fixed.MISSING_LEVEL))


def adjusted_skew(col: Column) -> Column:
    """Aggregate: bias-adjusted skewness (Spark's own is the population form)."""
    n = F.count(col)
    return F.when(
        n > 2, F.skewness(col) * F.sqrt(n.cast("double") * (n - 1)) / (n - 2)
    )


def distinct_estimate(col: Column) -> Column:
    """Aggregate: distinct non-NULL values from one compact sketch; exact for small counts."""
    return F.coalesce(F.hll_sketch_estimate(F.hll_sketch_agg(F.when(col.isNotNull(), F.xxhash64(col)), F.lit(12))), F.lit(0))


def unit_hash(seed: int | str, *keys: Column) -> Column:
    """md5 hex over the seed and the key columns as text; equal in every engine."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in keys]))


def metric_constant(name: Column, index: int, cast: str) -> Column:
    """One field of the metric registry for a metric-name column (aliases allowed)."""
    pairs = []
    for metric, spec in fixed.METRICS.items():
        pairs += [F.lit(metric), F.lit(spec[index]).cast(cast)]
    return F.element_at(F.create_map(*pairs), canonical_metric(name))


def canonical_metric(name: Column) -> Column:
    pairs = [F.lit(x) for kv in fixed.METRIC_ALIASES.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), name), name)


def metric_direction(name: Column) -> Column:
    return F.coalesce(metric_constant(name, 1, "string"), F.lit(fixed.MAXIMIZE))


def metric_for_task(name: Column, task: Column) -> Column:
    """The metric itself, or the task's default when it belongs to the other task."""
    belongs = metric_constant(name, 0, "string")
    default = F.when(task == fixed.REGRESSION, fixed.DEFAULT_METRIC[fixed.REGRESSION]).when(
        task == fixed.CLASSIFICATION, fixed.DEFAULT_METRIC[fixed.CLASSIFICATION]
    )
    return F.when(belongs.isNull() | default.isNull() | (belongs == task), name).otherwise(default)


def finite_entries(values: Column) -> Column:
    """Map without NaN, infinite or NULL values."""
    return F.map_filter(
        values, lambda k, v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    )


def dropped_keys(before: Column, after: Column) -> Column:
    return F.array_sort(F.array_except(F.map_keys(before), F.map_keys(after)))


def numeric_entries(values: Column) -> Column:
    """Map of text entries reduced to those that read as numbers."""
    return F.map_filter(values, lambda k, v: v.try_cast("double").isNotNull())


def allowed_words(words: Column, allowed: Iterable[str]) -> Column:
    closed = list(allowed)
    return F.filter(words, lambda w: w.isin(closed))


def clamp_param(name: Column, value: Column) -> Column:
    """``value`` inside the limits of parameter ``name``."""
    lows, highs = [], []
    for param, (low, high) in fixed.PARAM_LIMITS.items():
        lows += [F.lit(param), F.lit(float(low))]
        highs += [F.lit(param), F.lit(float(high))]
    low = F.coalesce(F.element_at(F.create_map(*lows), name), F.lit(fixed.PARAM_LIMIT_DEFAULT[0]))
    high = F.coalesce(F.element_at(F.create_map(*highs), name), F.lit(fixed.PARAM_LIMIT_DEFAULT[1]))
    return F.least(F.greatest(value, low), high)


def checked_weights(weights: Column, codes: Column) -> Column:
    """Class-weight map with one positive finite weight per code, clamped; NULL if any is wrong."""
    good = F.forall(
        F.map_values(weights),
        lambda w: w.isNotNull() & ~F.isnan(w) & (w > 0) & (w < float("inf")),
    )
    same = (F.size(F.array_except(F.map_keys(weights), codes)) == 0) & (
        F.size(F.array_except(codes, F.map_keys(weights))) == 0
    )
    clamped = F.transform_values(
        weights, lambda k, w: F.least(F.greatest(w, F.lit(fixed.WEIGHT_LOW)), F.lit(fixed.WEIGHT_HIGH))
    )
    return F.when((F.size(weights) > 0) & good & same, clamped)


def rate_changed(fit: Column, now: Column, rows: Column, floor: float) -> Column:
    """True when two rates differ by the floor and by two standard errors."""
    p = F.least(F.greatest(F.greatest(fit, now), F.lit(0.0)), F.lit(1.0))
    gap = F.abs(now - fit)
    return (rows > 0) & (gap >= floor) & (gap >= 2.0 * F.sqrt(F.try_divide(p * (1.0 - p), rows)))


def switch(value: Column, cuts: Sequence[float]) -> Column:
    """How many of the ascending ``cuts`` are at or below ``value``: a balanced comparison tree."""
    def tree(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(value < F.lit(float(cuts[mid])), tree(low, mid)).otherwise(tree(mid + 1, high))

    return tree(0, len(cuts))
