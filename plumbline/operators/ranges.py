"""Positions and running totals in a global order, by ranges.

Rows are dealt into ranges of about equal size (Spark samples the order), sorted inside each, and written. Totals per range
are small: at most one row for each (range, segment) that occurs; a window over those gives every range its offset, and a
row's own place in its range does the rest. No task holds more than one range, however large a segment is. Rows that are
equal in every sort column are dealt by a last, arbitrary column, so a repeated row spreads too.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.keys import join_on
from plumbline.session import small_side, stage

LOCAL_BITS = 33  # monotonically_increasing_id: partition above, place in it below


def _laid(df: DataFrame, order: Sequence[Column], by: Sequence[str], label: str) -> DataFrame:
    """The rows of ``df`` in range order, written, with ``__range`` and ``__place`` (rising in the order)."""
    tied = df.withColumn("__tie", F.monotonically_increasing_id())
    keys = [*[F.col(c) for c in by], *order, F.col("__tie")]
    placed = tied.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__place", F.monotonically_increasing_id())
    return stage(placed.drop("__tie"), label).withColumn("__range", F.shiftright("__place", LOCAL_BITS))


def _window(by: Sequence[str]):
    """Range totals of one segment: as many rows as ranges, which Spark's partition count bounds."""
    return Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))


def positions(df: DataFrame, order: Sequence[Column], by: Sequence[str] = (), name: str = "position", label: str = "positions") -> DataFrame:
    """Adds ``name`` (long, from 0): the row's place in ``order`` among the rows of its segment. NULL is a segment too."""
    laid = _laid(df, order, by, label)
    ranges = laid.groupBy("__range", *by).agg(F.count("*").alias("__n"), F.min("__place").alias("__first"))
    before = _window(by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranges.select("__range", *by, (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first")).alias("__shift"))
    joined = join_on(laid, small_side(stage(offsets, f"{label}-offsets")), ["__range", *by])
    return joined.withColumn(name, F.col("__place") + F.col("__shift")).drop("__place", "__range", "__shift")
