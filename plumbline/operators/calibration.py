"""Are predicted probabilities readable as probabilities: Brier score, reliability table, calibration error."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline import fixed


def brier(df: DataFrame, label: str, proba: str, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.expr(f"round(avg(({proba} - {label}) * ({proba} - {label})), 6) AS brier"))


def reliability(df: DataFrame, label: str, proba: str, by: Sequence[str] = (), bins: int = fixed.CALIBRATION_BINS) -> DataFrame:
    """Rows (by..., bin, low, high, rows, predicted, observed); bins close on the right, empty bins are absent."""
    edges = " ".join(f"WHEN {proba} <= {(i + 1) / bins!r}D THEN {i}" for i in range(bins - 1))
    return df.where(F.col(proba).isNotNull()).groupBy(
        *by, F.expr(f"CASE {edges} ELSE {bins - 1} END AS bin")
    ).agg(
        F.count(F.lit(1)).alias("rows"), F.expr(f"round(avg({proba}), 4) AS predicted"),
        F.expr(f"round(avg(CAST({label} AS DOUBLE)), 4) AS observed"),
    ).select(*by, "bin", F.round(F.col("bin") / bins, 4).alias("low"), F.round((F.col("bin") + 1) / bins, 4).alias("high"),
             "rows", "predicted", "observed")


def calibration_error(table: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Row-weighted gap of the rounded table; NULL below the minimum rows."""
    return table.groupBy(*by).agg(
        F.sum("rows").alias("rows"), F.expr("sum(rows * abs(predicted - observed)) / sum(rows) AS gap")
    ).select(*by, "rows", F.expr(f"CASE WHEN rows >= {fixed.CALIBRATION_MIN_ROWS} THEN round(gap, 6) END AS calibration_error"))
