"""Exact interpolated quantiles without holding a column in one task.

A sketch brackets each wanted rank. A scan counts the rows below and inside each bracket: one that missed its rank is
widened, one that holds too many rows is sketched again from inside, until each is small. A last scan counts the distinct
values inside, and the rank is read off that table, whose size ``FEW`` bounds.
A measure without values has no quantile and no row; it keeps no scan going. NaN counts as the greatest value, as in the
built-in percentile; no bracket reaches it, so a rank among the NaN is not looked for.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.keys import attach, join_on, number_literal, rows_from, rows_of, staged_stats, text_literal
from plumbline.session import small_side, stage

# Size of the rank sketch. Its ranks are off by some 0.13 % of the rows; brackets reach more than twice as far on each side.
SKETCH_SIZE = 4096
MARGIN = 0.003
# Groups up to this size are ranked as they are.
SMALL = 40_000
# A bracket with more rows is refined; a refinement cuts it into this many cells.
FEW = 2_000_000
GRID = 256


def _edges(probs: Sequence[float]) -> list[float]:
    return [e for p in probs for e in (max(0.0, p - MARGIN), min(1.0, p + MARGIN))]


def quantiles_of(column: str, ranks: Sequence[float]) -> str:
    """SQL: sketched quantiles of a column without its NaN, NULL where it has no value."""
    at = f"array({', '.join(f'{r!r}D' for r in ranks)})"
    return f"IF(count(nanvl({column}, NULL)) > 0, kll_sketch_get_quantile_double(kll_sketch_agg_double({column}, {SKETCH_SIZE}), {at}), NULL)"


def exact_quantiles(
    df: DataFrame, measures: Mapping[str, str], probs: Mapping[str, Sequence[float]], by: Sequence[str] = (), stats: DataFrame | None = None,
) -> DataFrame:
    """Rows (by..., measure, prob, n, value): linear interpolation at rank ``prob * (n - 1)``.

    ``measures`` maps a name to SQL text over ``df``. Segments up to ``SMALL`` rows use the built-in
    exact percentile, whose value map their size bounds; larger ones go through brackets. ``stats`` may hold the
    measures' states (``sketch``) as s0, s1... of the whole table, if a scan has made them already.
    """
    names = list(measures)
    wide = df.select(*by, *[F.expr(f"CAST({measures[m]} AS DOUBLE) AS m{i}") for i, m in enumerate(names)])
    if not by:
        return _bracketed(wide, names, probs, by, stats)
    sizes = stage(wide.groupBy(*by).agg(F.count(F.lit(1)).alias("__rows")), "sizes")
    large = sizes.where(F.col("__rows") > SMALL)
    if large.isEmpty():
        return _direct(wide, names, probs, by)
    # One row per SMALL input rows at most.
    side = small_side(large.select(*by))
    return _direct(join_on(wide, side, by, "left_anti"), names, probs, by).unionByName(
        _bracketed(join_on(wide, side, by, "left_semi"), names, probs, by))


def _direct(wide: DataFrame, names: Sequence[str], probs: Mapping[str, Sequence[float]], by: Sequence[str]) -> DataFrame:
    found = wide.groupBy(*by).agg(*[
        F.expr(f"struct(count(m{i}) AS n, percentile(m{i}, array({', '.join(f'{p!r}D' for p in probs[m])})) AS q) AS s{i}")
        for i, m in enumerate(names)
    ])
    return found.select(*by, rows_from([
        f"struct({text_literal(m)} AS measure, {p!r}D AS prob, s{i}.n AS n, s{i}.q[{j}] AS value)"
        for i, m in enumerate(names) for j, p in enumerate(probs[m])
    ])).where("n > 0")


def sketch(column: str, probs: Sequence[float]) -> str:
    """SQL: the state that brackets a double ``column``; one scan may hold it beside any other aggregates."""
    return f"struct(count({column}) AS n, count_if(isnan({column})) AS nans, {quantiles_of(column, [0.0, 1.0, *_edges(probs)])} AS e)"


def _among_nans(p: float, state: str) -> str:
    """SQL: does a state's rank ``p`` need one of its NaN, which are its last values?"""
    return f"(ceil({p!r}D * ({state}.n - 1)) >= {state}.n - {state}.nans)"


def _literal(row) -> str:
    """A bracket state as SQL text."""
    listed = lambda values: f"array({', '.join(map(number_literal, values))})"
    return (f"struct({row['n']}L AS n, {row['nans']}L AS nans, {number_literal(row['lo'])} AS lo, {number_literal(row['hi'])} AS hi, "
            f"{listed(row['l'])} AS l, {listed(row['h'])} AS h)")


def _first_brackets(stats: DataFrame, names: Sequence[str], probs: Mapping[str, Sequence[float]], by: Sequence[str]) -> DataFrame:
    """by..., b<i>: count, least and largest value, and the two ends of the bracket around every wanted rank."""
    states = []
    for i, m in enumerate(names):
        # A rank among the NaN gets a bracket of one value, which stays.
        low = ", ".join(f"if(s{i}.n <= {SMALL} OR {_among_nans(p, f's{i}')}, s{i}.e[0], s{i}.e[{2 * j + 2}])" for j, p in enumerate(probs[m]))
        high = ", ".join(
            f"CASE WHEN {_among_nans(p, f's{i}')} THEN s{i}.e[0] WHEN s{i}.n <= {SMALL} THEN s{i}.e[1] ELSE s{i}.e[{2 * j + 3}] END"
            for j, p in enumerate(probs[m]))
        states.append(f"struct(s{i}.n AS n, s{i}.nans AS nans, s{i}.e[0] AS lo, s{i}.e[1] AS hi, array({low}) AS l, array({high}) AS h) AS b{i}")
    return stage(stats.select(*by, *[F.expr(x) for x in states]), "quantile-brackets")


def _counted(wide: DataFrame, brackets: DataFrame, names: Sequence[str], probs: Mapping[str, Sequence[float]], by: Sequence[str], fine: bool) -> DataFrame:
    """One scan: b<i> again, and r<i>_<j>: rows below and inside each bracket, with a sketch of the inside if ``fine``."""
    joined, stat = attach(wide, brackets, by)
    grid = [k / GRID for k in range(GRID + 1)]
    aggs = []
    for i, m in enumerate(names):
        for j, _ in enumerate(probs[m]):
            low, high = stat(f"b{i}.l[{j}]"), stat(f"b{i}.h[{j}]")
            inside = f"m{i} >= {low} AND m{i} <= {high}"
            inner = quantiles_of(f"CASE WHEN {inside} THEN m{i} END", grid) if fine else "CAST(NULL AS ARRAY<DOUBLE>)"
            aggs.append(f"struct(count_if(m{i} < {low}) AS below, count_if({inside}) AS inside, {inner} AS g) AS r{i}_{j}")
    carried = [f"any_value(b{i}) AS b{i}" for i, _ in enumerate(names)] if by else []
    out = joined.groupBy(*by).agg(*[F.expr(x) for x in [*aggs, *carried]])
    if not by:
        row = brackets.first()
        out = out.select("*", *[F.expr(f"{_literal(row[f'b{i}'])} AS b{i}") for i, _ in enumerate(names)])
    return stage(out, "quantile-counts")


def _next(names: Sequence[str], probs: Mapping[str, Sequence[float]], fine: bool) -> tuple[list[str], str]:
    """SQL of the next brackets, and of the number that must be counted again.

    A rank outside its bracket widens it to the end of the values; a bracket with more than ``FEW`` rows shrinks to the
    cells of its sketch around the rank. One that holds a single value, or that no longer shrinks, stays.
    """
    states, open_ones = [], []
    for i, m in enumerate(names):
        lows, highs = [], []
        for j, p in enumerate(probs[m]):
            r, b = f"r{i}_{j}", f"b{i}"
            low, high = f"{b}.l[{j}]", f"{b}.h[{j}]"
            rank = f"{p!r}D * ({b}.n - 1)"
            sought = f"NOT {_among_nans(p, b)}"
            under, over = f"({sought} AND {r}.below > floor({rank}))", f"({sought} AND {r}.below + {r}.inside <= ceil({rank}))"
            big = f"({r}.inside > {FEW} AND {low} < {high} AND NOT ({under}) AND NOT ({over}))"
            cell = lambda where, step: f"{r}.g[CAST(greatest(0, least({GRID}, {where}((({rank}) - {r}.below) / {r}.inside * {GRID}) + {step})) AS INT)]"
            new_low = f"CASE WHEN {under} THEN {b}.lo WHEN {big} THEN coalesce(greatest({low}, {cell('floor', -1)}), {low}) ELSE {low} END"
            new_high = f"CASE WHEN {over} THEN {b}.hi WHEN {big} THEN coalesce(least({high}, {cell('ceil', 1)}), {high}) ELSE {high} END"
            lows.append(new_low)
            highs.append(new_high)
            shrinks = f"({new_low} > {low} OR {new_high} < {high})" if fine else "true"
            # A measure without values has no rank to look for.
            open_ones.append(f"if(coalesce({b}.n > 0 AND ({under} OR {over} OR ({big} AND {shrinks})), false), 1, 0)")
        states.append(f"struct(b{i}.n AS n, b{i}.nans AS nans, b{i}.lo AS lo, b{i}.hi AS hi, array({', '.join(lows)}) AS l, array({', '.join(highs)}) AS h) AS b{i}")
    return states, " + ".join(open_ones)


def _bracketed(
    wide: DataFrame, names: Sequence[str], probs: Mapping[str, Sequence[float]], by: Sequence[str], stats: DataFrame | None = None,
) -> DataFrame:
    """Brackets from the sketch, counted, and refined until every wanted rank lies in a small one."""
    if stats is None:
        stats = staged_stats(wide, by, [f"{sketch(f'm{i}', probs[m])} AS s{i}" for i, m in enumerate(names)], "quantile-sketch")
    most = stats.agg(F.greatest(F.lit(0), *[F.max(f"s{i}.n") for i, _ in enumerate(names)])).first()[0] or 0
    if not by and most <= SMALL:
        return _direct(wide, names, probs, by)
    brackets, fine = _first_brackets(stats, names, probs, by), 2 * MARGIN * most > FEW
    while True:
        counted = _counted(wide, brackets, names, probs, by, fine)
        states, open_ones = _next(names, probs, fine)
        if not counted.agg(F.sum(F.expr(open_ones))).first()[0]:
            break
        brackets, fine = stage(counted.select(*by, *[F.expr(x) for x in states]), "quantile-brackets"), True
    joined, stat = attach(wide, brackets, by)
    elements, inside, wanted, single = [], [], [], []
    for i, m in enumerate(names):
        for j, p in enumerate(probs[m]):
            low, high = stat(f"b{i}.l[{j}]"), stat(f"b{i}.h[{j}]")
            within = f"{low} < {high} AND m{i} >= {low} AND m{i} <= {high}"
            inside.append(f"({within})")
            elements.append(f"CASE WHEN {within} THEN struct({i} AS m, {j} AS j, m{i} AS v) END")
            wanted.append(f"struct({i} AS m, {j} AS j, {text_literal(m)} AS measure, {p!r}D AS prob, b{i}.n AS n, {_among_nans(p, f'b{i}')} AS nan, r{i}_{j}.below AS below)")
            single.append(f"CASE WHEN b{i}.l[{j}] <=> b{i}.h[{j}] THEN struct({i} AS m, {j} AS j, b{i}.l[{j}] AS v, r{i}_{j}.inside AS k) END")
    requests = counted.select(*by, rows_from(wanted)).where("n > 0")
    # The filter keeps the rows of the brackets only; the generator then runs on those. A bracket of one value is counted already.
    counts = joined.where(" OR ".join(inside)).select(*by, rows_of(elements)).groupBy(*by, "m", "j", "v").agg(
        F.count(F.lit(1)).alias("k")).unionByName(counted.select(*by, rows_of(single)))
    # At most FEW distinct values in a bracket.
    running = Window.partitionBy(*by, "m", "j").orderBy("v")
    counts = counts.withColumn("run", F.sum("k").over(running))
    picked = join_on(counts, requests, [*by, "m", "j"]).withColumn("cum", F.col("below") + F.col("run")).groupBy(
        *by, "measure", "prob", "n", "nan").agg(
        F.expr("min(CASE WHEN cum > floor(prob * (n - 1)) THEN struct(cum, v) END) AS a"),
        F.expr("min(CASE WHEN cum > ceil(prob * (n - 1)) THEN struct(cum, v) END) AS b"),
    )
    return picked.select(*by, "measure", "prob", "n", F.expr(
        "CASE WHEN nan THEN CAST('NaN' AS DOUBLE) ELSE a.v + (b.v - a.v) * (prob * (n - 1) - floor(prob * (n - 1))) END AS value"))


def wide_quantiles(quantiles: DataFrame, wanted: Sequence[tuple[str, float, str]], by: Sequence[str]) -> DataFrame:
    """One row per segment with a column per wanted (measure, prob, alias)."""
    return quantiles.groupBy(*by).agg(*[
        F.expr(f"max(CASE WHEN measure = {text_literal(m)} AND prob = {p!r}D THEN value END) AS {alias}")
        for m, p, alias in wanted
    ])
