"""How a new batch differs from the rows a layout was fitted on."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline import fixed
from plumbline.functions.columns import rate_changed
from plumbline.operators.encoding import Layout, encoding_losses, environment_changes, missing_checks
from plumbline.operators.keys import column_kinds, number_literal, quoted, text_literal
from plumbline.operators.profile import column_stats, missing_rates
from plumbline.operators.sentinels import numeric_codes


def record_stats(df: DataFrame, layout: Layout) -> Layout:
    """Store what the used columns looked like at fit: one entry per column, fourteen codes at most."""
    rows = column_stats(df, layout.required).collect()
    layout.column_stats = {
        r["name"]: {"missing_rate": r["missing_rate"], "sentinels": [
            {"value": c["value"], "rate": c["rate"]} for c in (r["codes"] or [])]}
        for r in rows
    }
    return layout


def stats_frame(spark, layout: Layout) -> DataFrame:
    """The recorded statistics as rows (name, fit); one per used column."""
    pairs = [f"({text_literal(n)}, {number_literal(float(e['missing_rate']))})" for n, e in layout.column_stats.items()]
    return spark.sql("SELECT * FROM VALUES " + ", ".join(pairs) + " AS t(name, fit)")


def missing_shift(batch: DataFrame, layout: Layout) -> DataFrame:
    """Rows (column, fit, now) whose missing rate moved."""
    names = [c for c in layout.required if c in layout.column_stats]
    now = missing_rates(batch, names)
    joined = now.join(F.broadcast(stats_frame(batch.sparkSession, layout)), "name")
    rate = F.coalesce(F.try_divide("n_missing", "n_rows"), F.lit(0.0))
    return joined.where(rate_changed(F.col("fit"), rate, F.col("n_rows"), fixed.MISSING_RATE_SHIFT)).select(
        F.col("name").alias("column"), "fit", F.round(rate, 4).alias("now"))


def sentinel_shift(batch: DataFrame, layout: Layout) -> DataFrame:
    """Rows (column, value, fit, now): recorded codes whose rate moved, and codes not seen at fit."""
    kinds = column_kinds(batch)
    recorded = [
        (name, float(c["value"]), float(c["rate"]))
        for name in layout.numeric if name in layout.column_stats
        for c in layout.column_stats[name]["sentinels"]
    ]
    empty = batch.sparkSession.sql(
        "SELECT CAST(NULL AS STRING) AS column, CAST(NULL AS DOUBLE) AS value, CAST(NULL AS DOUBLE) AS fit, CAST(NULL AS DOUBLE) AS now WHERE false")
    moved = empty
    if recorded:
        counts = batch.agg(F.count(F.lit(1)).alias("rows"), *[
            F.expr(f"count_if(try_cast({quoted(n)} AS DOUBLE) = {number_literal(v)}) AS k{i}") for i, (n, v, _) in enumerate(recorded)])
        listed = ", ".join(
            f"struct({text_literal(n)} AS column, {number_literal(v)} AS value, {number_literal(r)} AS fit, coalesce(try_divide(k{i}, rows), 0D) AS now)"
            for i, (n, v, r) in enumerate(recorded))
        moved = counts.select("rows", F.expr(f"inline(array({listed}))")).where(
            rate_changed(F.col("fit"), F.col("now"), F.col("rows"), fixed.SENTINEL_RATE_SHIFT)
        ).select("column", "value", "fit", F.round("now", 4).alias("now"))
    numbers = [c for c in layout.numeric if kinds[c] == "numeric" and c in layout.column_stats]
    fresh = numeric_codes(batch, numbers).select(
        F.col("name").alias("column"), F.col("value").cast("double").alias("value"), F.lit(0.0).alias("fit"), F.col("rate").alias("now"))
    for name, value, _ in recorded:
        fresh = fresh.where(~((F.col("column") == name) & (F.col("value") == value)))
    return moved.unionByName(fresh)


def column_differences(layout: Layout, columns: Sequence[str]) -> dict[str, list[str]]:
    """Columns the layout never saw, and columns it saw and left out."""
    dropped = set(layout.too_wide) | set(layout.unsupported)
    seen = set(layout.required) | dropped
    return {"extra_columns": [c for c in columns if c not in seen], "ignored_at_fit": [c for c in columns if c in dropped]}


def drift(batch: DataFrame, layout: Layout) -> DataFrame:
    """One row per finding: (kind, column, detail, fit, now, rows). Nothing is corrected."""
    losses = encoding_losses(batch, layout).select(
        "kind", "column", F.col("level").alias("detail"), F.lit(None).cast("double").alias("fit"),
        F.lit(None).cast("double").alias("now"), "rows")
    none = F.lit(None).cast("bigint").alias("rows")
    out = losses
    if layout.column_stats:
        shift = missing_shift(batch, layout)
        out = out.unionByName(shift.select(
            F.lit("missing_rate_shift").alias("kind"), "column", F.lit(None).cast("string").alias("detail"), "fit", "now", none))
        codes = sentinel_shift(batch, layout)
        out = out.unionByName(codes.select(
            F.lit("sentinel_shift").alias("kind"), "column", F.col("value").cast("bigint").cast("string").alias("detail"), "fit", "now", none))
    notes = [(kind, c) for kind, names in column_differences(layout, batch.columns).items() for c in names]
    notes += [("missing_checks", c) for c in missing_checks(layout.version)]
    notes += [("environment_changed", c) for c in environment_changes(layout.environment)]
    if notes:
        listed = ", ".join(f"({text_literal(k)}, {text_literal(c)})" for k, c in notes)
        extra = batch.sparkSession.sql(
            f"SELECT kind, column, CAST(NULL AS STRING) AS detail, CAST(NULL AS DOUBLE) AS fit, CAST(NULL AS DOUBLE) AS now, CAST(NULL AS BIGINT) AS rows FROM VALUES {listed} AS t(kind, column)")
        out = out.unionByName(extra)
    return out
