"""Column profiles: rates, buckets and kinds per column, never values."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline import fixed
from plumbline.functions.columns import bucket
from plumbline.operators.keys import (
    attach, beside, clean, column_kinds, join_on, quoted, rows_from, rows_of, staged_stats, text_literal,
)
from plumbline.operators.quantiles import exact_quantiles, sketch, wide_quantiles
from plumbline.operators.sentinels import detect_sentinels
from plumbline.session import stage

# Below this estimate a column's distinct values are counted exactly; buckets end at 100.
EXACT_BELOW = 200


def missing_rates(df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), states: States | None = None) -> DataFrame:
    """Rows (by..., name, n_rows, n_missing, missing_rate) from one wide aggregate."""
    wide = states.sums if states is not None else clean(df, [*by, *columns]).groupBy(*by).agg(
        F.count(F.lit(1)).alias("__n"), *[F.expr(f"count({quoted(c)}) AS c{i}") for i, c in enumerate(columns)]
    )
    return wide.select(*by, rows_from([
        f"struct({text_literal(c)} AS name, __n AS n_rows, __n - c{i} AS n_missing)" for i, c in enumerate(columns)
    ])).withColumn("missing_rate", F.expr("IF(n_rows > 0, round(n_missing / n_rows, 4), 0D)"))


@dataclass(frozen=True)
class States:
    """What a profile reads first, one staged row per segment each.

    ``sums``: __n, c<i> present rows of each column, k<i> moments of each numeric one: plain sums, in generated code.
    ``sketches``: d<i> distinct estimates; for whole tables s<2i>, s<2i+1> rank sketches of a numeric column and of its size.
    """

    sums: DataFrame
    sketches: DataFrame


def profile_states(df: DataFrame, columns: Sequence[str], countable: Sequence[str], numeric: Sequence[str], target: str | None, by: Sequence[str] = ()) -> States:
    """Two scans for everything that needs no other result first: sums, and sketches, which would keep sums out of generated code."""
    values = clean(df, [*by, *dict.fromkeys([*columns, *countable, *numeric, *([target] if target else [])])])
    sums = ["count(1) AS __n", *[f"count({quoted(c)}) AS c{i}" for i, c in enumerate(columns)], *[f"{_moments(c, target)} AS k{i}" for i, c in enumerate(numeric)]]
    sketches = [f"{_distinct_state(c)} AS d{i}" for i, c in enumerate(countable)]
    for i, c in enumerate(numeric if not by else []):
        x = f"CAST({quoted(c)} AS DOUBLE)"
        sketches += [f"{sketch(x, (0.25, 0.75))} AS s{2 * i}", f"{sketch(f'abs({x})', (0.5,))} AS s{2 * i + 1}"]
    return States(staged_stats(values, by, sums, "profile-sums"), staged_stats(values, by, sketches or ["0 AS none"], "profile-sketches"))


def _distinct_state(column: str) -> str:
    return f"coalesce(hll_sketch_estimate(hll_sketch_agg(CASE WHEN {quoted(column)} IS NOT NULL THEN xxhash64({quoted(column)}) END, 12)), 0)"


def _moments(column: str, target: str | None) -> str:
    x, y = f"CAST({quoted(column)} AS DOUBLE)", f"CAST({quoted(target)} AS DOUBLE)" if target else "CAST(NULL AS DOUBLE)"
    return (f"struct({text_literal(column)} AS name, count({x}) AS present, CASE WHEN count({x}) > 2 THEN "
            f"skewness({x}) * sqrt(CAST(count({x}) AS DOUBLE) * (count({x}) - 1)) / (count({x}) - 2) END AS skew_value, corr({x}, {y}) AS corr)")


def distinct_stats(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Staged one-row-per-segment table with a ``d<i>`` distinct estimate per column."""
    return staged_stats(df, by, [f"{_distinct_state(c)} AS d{i}" for i, c in enumerate(columns)], "distinct")


def low_frequencies(
    df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), below: int = EXACT_BELOW,
    stats: DataFrame | None = None,
) -> DataFrame:
    """Rows (by..., name, value, n) for columns whose distinct estimate is below the limit.

    Wide columns never enter the shuffle, and a hot value is summed before it.
    """
    values = clean(df, [*by, *columns])
    stats = distinct_stats(values, columns, by) if stats is None else stats
    joined, stat = attach(values, stats, by)
    return joined.select(*by, rows_of([
        f"CASE WHEN {stat(f'd{i}')} < {below} AND {quoted(c)} IS NOT NULL "
        f"THEN struct({text_literal(c)} AS name, CAST({quoted(c)} AS STRING) AS value) END"
        for i, c in enumerate(columns)
    ])).groupBy(*by, "name", "value").agg(F.count(F.lit(1)).alias("n"))


def distinct_counts(df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), stats: DataFrame | None = None) -> DataFrame:
    """Rows (by..., name, distinct_count, exact): exact below the limit, else the estimate."""
    values = clean(df, [*by, *columns])
    stats = distinct_stats(values, columns, by) if stats is None else stats
    counted = low_frequencies(values, columns, by, stats=stats).groupBy(*by, "name").agg(
        F.count(F.lit(1)).alias("counted")
    )
    long = stats.select(*by, rows_from([f"struct({text_literal(c)} AS name, d{i} AS est)" for i, c in enumerate(columns)]))
    joined = join_on(long, counted, [*by, "name"], "left")
    exact = F.col("est") < EXACT_BELOW
    return joined.select(
        *by, "name",
        F.when(exact, F.coalesce("counted", F.lit(0))).otherwise(F.col("est")).alias("distinct_count"),
        exact.alias("exact"),
    )


def kind_column(numeric: Column, integer: Column, distinct: Column) -> Column:
    """constant / binary / categorical / discrete / continuous."""
    return (
        F.when(distinct <= 1, "constant").when(distinct == 2, "binary").when(~numeric, "categorical")
        .when(integer & (distinct <= fixed.DISCRETE_MAX_DISTINCT), "discrete").otherwise("continuous")
    )


def shape(df: DataFrame, columns: Sequence[str], target: str | None = None, by: Sequence[str] = (), states: States | None = None) -> DataFrame:
    """Rows (by..., name, present, skew_value, median_abs, q1, q3, outlier_rate, corr) per numeric column."""
    values = clean(df, [*by, *columns, *([target] if target and target not in columns else [])])
    states = profile_states(df, [], [], columns, target, by) if states is None else states
    measures, probs, wanted = {}, {}, []
    for i, c in enumerate(columns):
        measures[f"x{i}"], probs[f"x{i}"] = quoted(c), (0.25, 0.75)
        measures[f"a{i}"], probs[f"a{i}"] = f"abs({quoted(c)})", (0.5,)
        wanted += [(f"x{i}", 0.25, f"q1_{i}"), (f"x{i}", 0.75, f"q3_{i}"), (f"a{i}", 0.5, f"ma_{i}")]
    moments = states.sums.select(*by, rows_from([f"k{i}" for i, _ in enumerate(columns)]))
    sketches = None if by else states.sketches.select(*[f"s{i}" for i in range(2 * len(columns))])
    fences = stage(wide_quantiles(exact_quantiles(values, measures, probs, by, sketches), wanted, by), "fences")
    joined, stat = attach(values, fences, by)
    outside = []
    for i, c in enumerate(columns):
        x, q1, q3 = f"CAST({quoted(c)} AS DOUBLE)", stat(f"q1_{i}"), stat(f"q3_{i}")
        outside.append(
            f"struct({text_literal(c)} AS name, {q1 if not by else f'any_value({q1})'} AS q1, {q3 if not by else f'any_value({q3})'} AS q3, "
            f"{stat(f'ma_{i}') if not by else f'any_value(ma_{i})'} AS median_abs, "
            f"avg(CASE WHEN {q3} > {q1} THEN CASE WHEN {x} < {q1} - 1.5D * ({q3} - {q1}) OR {x} > {q3} + 1.5D * ({q3} - {q1}) "
            f"THEN 1D WHEN {x} IS NOT NULL THEN 0D END END) AS outlier_rate) AS o{i}")
    rates = joined.groupBy(*by).agg(*[F.expr(o) for o in outside]).select(
        *by, rows_from([f"o{i}" for i, _ in enumerate(columns)]))
    keys = [*by, "name"]
    return join_on(moments, rates, keys, "left")


def profile_columns(
    df: DataFrame, target: str | None = None, by: Sequence[str] = (), sentinels: bool = True
) -> DataFrame:
    """One row per (segment, feature column) with buckets and rates.

    ``target`` names a numeric column (class codes 0/1, or a continuous target) for the correlation.
    """
    kinds = column_kinds(df)
    features = [c for c in df.columns if c not in by and c != target]
    countable = [c for c in features if not isinstance(df.schema[c].dataType, (T.ArrayType, T.MapType, T.StructType))]
    keys = [*by, "name"]
    shaped = [c for c in features if kinds[c] == "numeric"]
    states = profile_states(df, features, countable, shaped, target, by)
    base = missing_rates(df, features, by, states)
    base = join_on(base, distinct_counts(df, countable, by, states.sketches), keys, "left")
    facts = F.create_map(*[x for c in features for x in (F.lit(c), F.struct(
        F.lit(df.schema[c].dataType.simpleString()).alias("dtype"), F.lit(kinds[c]).alias("kind"),
        F.lit(isinstance(df.schema[c].dataType, T.IntegralType)).alias("integer")))])
    base = base.withColumn("__f", F.element_at(facts, F.col("name")))
    distinct = F.coalesce(F.col("distinct_count"), F.lit(0))
    numeric = F.col("__f.kind") == "numeric"
    base = base.select(
        *keys, F.col("__f.dtype").alias("dtype"), "n_rows", "missing_rate", "distinct_count",
        bucket(distinct, fixed.DISTINCT_EDGES, fixed.DISTINCT_LAST).alias("distinct"),
        (F.col("__f.kind").isin("numeric", "boolean") | (
            (F.col("__f.kind") == "text") & distinct.between(1, fixed.MAX_ONEHOT_LEVELS)
        )).alias("usable_by_executor"),
        kind_column(numeric, F.col("__f.integer"), distinct).alias("kind"),
    )
    if shaped:
        enough = F.col("present") >= fixed.SHAPE_MIN_ROWS
        base = join_on(base, shape(df, shaped, target, by, states), keys, "left").select(
            *base.columns,
            F.when(enough, bucket(F.col("median_abs"), fixed.MAGNITUDE_EDGES, fixed.MAGNITUDE_LAST)).alias("magnitude"),
            F.when(enough, bucket(F.abs(F.coalesce(F.nanvl("skew_value", F.lit(0.0)), F.lit(0.0))), fixed.SKEW_EDGES, fixed.SKEW_LAST)).alias("skew"),
            F.when(enough, F.round("outlier_rate", 4)).alias("outlier_rate"),
            F.when(enough, bucket(F.abs(F.nanvl("corr", F.lit(None))), fixed.CORRELATION_EDGES, fixed.CORRELATION_LAST)).alias("target_corr"),
        )
    if sentinels:
        found = detect_sentinels(df, [c for c in features if kinds[c] in ("numeric", "text")], by)
        found = found.groupBy(*keys).agg(
            F.array_sort(F.collect_list(F.struct("position", "kind", "value", "rate"))).alias("sentinel_suspects")
        )
        base = join_on(base, found, keys, "left")
    return base


def class_balance(df: DataFrame, target: str, by: Sequence[str] = ()) -> DataFrame:
    """One row per segment: shares sorted descending (4 decimals), class count, imbalance ratio."""
    counts = df.where(F.col(target).isNotNull()).groupBy(*by, target).agg(F.count(F.lit(1)).alias("n"))
    counts = stage(counts, "class-counts")
    totals = counts.groupBy(*by).agg(F.sum("n").alias("total"))
    shares = beside(counts, totals, by).withColumn("share", F.round(F.col("n") / F.col("total"), 4))
    shares = shares.groupBy(*by).agg(
        F.sort_array(F.collect_list("share"), asc=False).alias("class_balance"),
        F.sum("n").alias("n_rows"),
    )
    last = F.element_at("class_balance", -1)
    return shares.withColumn("n_classes", F.size("class_balance")).withColumn(
        "imbalance_ratio", F.when(last > 0, F.round(F.col("class_balance")[0] / last, 2))
    )


def missing_block(rates: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Dataset-level missing figures from the per-column rates."""
    return rates.groupBy(*by).agg(
        F.coalesce(F.round(F.try_divide(F.sum("n_missing"), F.sum("n_rows")), 4), F.lit(0.0)).alias("overall_rate"),
        F.sum((F.col("missing_rate") > 0).cast("bigint")).alias("columns_with_missing"),
        F.max("missing_rate").alias("worst_rate"),
    )


def column_stats(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """What each used column looked like at fit time: missing rate and numeric codes."""
    from plumbline.operators.sentinels import numeric_codes

    codes = numeric_codes(df, columns, by).groupBy(*by, "name").agg(
        F.array_sort(F.collect_list(F.struct("position", F.col("value").cast("double").alias("value"), "rate"))).alias("codes")
    )
    return join_on(missing_rates(df, columns, by), codes, [*by, "name"], "left")


def merge_findings(machine: DataFrame, notes: DataFrame, by: Sequence[str], text: str = "text", order: str = "position") -> DataFrame:
    """Findings first, then notes: whitespace collapsed, cut, exact duplicates dropped, capped per dataset.

    The cap is the card's own list length. Duplicates collapse in a grouped aggregate before the
    ordering, so only distinct texts are ranked.
    """
    both = machine.select(*by, F.lit(0).alias("part"), F.col(order).alias("at"), F.col(text).alias("text")).unionByName(
        notes.select(*by, F.lit(1).alias("part"), F.col(order).alias("at"), F.col(text).alias("text"))
    )
    tidy = F.substring(F.trim(F.regexp_replace("text", r"\s+", " ")), 1, fixed.MAX_FINDING_CHARS)
    distinct = both.withColumn("text", tidy).where("text != ''").groupBy(*by, "text").agg(
        F.min(F.struct("part", "at")).alias("first")
    )
    rank = F.row_number().over(Window.partitionBy(*by).orderBy("first", "text"))
    return distinct.withColumn("position", rank).where(F.col("position") <= fixed.MAX_FINDINGS).select(*by, "position", "text")
