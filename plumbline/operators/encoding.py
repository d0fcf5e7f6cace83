"""Fitted feature layout: numeric columns, then one 0/1 column per level of each narrow text column."""

from __future__ import annotations

import json
import platform
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field

import pyspark
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline import fixed
from plumbline.functions.columns import to_number
from plumbline.operators.keys import column_kinds, quoted, rows_of, text_literal
from plumbline.operators.profile import distinct_counts, low_frequencies, missing_rates


@dataclass
class Layout:
    """What reaches an estimator, in which order. Driver-sized: at most 50 levels per column."""

    numeric: list[str]
    one_hot: list[dict]
    too_wide: list[str]
    unsupported: list[str]
    version: int = fixed.SCHEMA_VERSION
    column_stats: dict = field(default_factory=dict)
    environment: dict = field(default_factory=dict)
    extra: dict = field(default_factory=dict)

    @property
    def required(self) -> list[str]:
        return self.numeric + [spec["column"] for spec in self.one_hot]

    @property
    def columns(self) -> list[str]:
        return self.numeric + [name for spec in self.one_hot for name in level_columns(spec)]

    def report(self) -> dict:
        return {
            "numeric": len(self.numeric), "one_hot_columns": len(self.one_hot),
            "one_hot_levels": len(self.columns) - len(self.numeric),
            "dropped_high_cardinality": self.too_wide,
            "dropped_unsupported_dtype": self.unsupported,
            "max_cardinality": fixed.MAX_ONEHOT_LEVELS,
        }

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @staticmethod
    def from_json(text: str) -> Layout:
        return Layout(**json.loads(text))


def level_columns(spec: dict) -> list[str]:
    names = [f"{spec['column']}{fixed.LEVEL_SEPARATOR}{level}" for level in spec["levels"]]
    return names + ([f"{spec['column']}{fixed.LEVEL_SEPARATOR}{fixed.MISSING_LEVEL}"] if spec["missing_level"] else [])


def environment() -> dict[str, str]:
    """Library versions; the patch level of Python is left out."""
    return {"python": ".".join(platform.python_version_tuple()[:2]), "pyspark": pyspark.__version__}


def environment_changes(recorded: dict | None) -> list[str]:
    now = environment()
    return sorted(k for k in {*now, *(recorded or {})} if recorded and recorded.get(k) != now.get(k))


def text_levels(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows (name, value, n) for text columns with 1..50 levels: the levels of one-hot columns."""
    few = low_frequencies(df, columns)
    sizes = few.groupBy("name").agg(F.count(F.lit(1)).alias("levels"))
    fits = sizes.where(F.col("levels") <= fixed.MAX_ONEHOT_LEVELS)
    return few.join(fits, "name").select("name", "value", "n")


def fit_encoding(df: DataFrame, features: Sequence[str] | None = None) -> Layout:
    """Fit the layout on these rows."""
    features = list(features or df.columns)
    kinds = column_kinds(df)
    text = [c for c in features if kinds[c] == "text"]
    levels: dict[str, list[str]] = {}
    blank: dict[str, int] = {}
    if text:
        rows = text_levels(df.select(*text), text).groupBy("name").agg(F.array_sort(F.collect_list("value")).alias("levels"))
        # One row per text column, fifty levels at most.
        levels = {r["name"]: list(r["levels"]) for r in rows.collect()}
        blank = {r["name"]: r["n_missing"] for r in missing_rates(df, text).collect()}
    return Layout(
        numeric=[c for c in features if kinds[c] in ("numeric", "boolean")],
        one_hot=[
            {"column": c, "levels": levels[c], "missing_level": blank[c] > 0} for c in text if c in levels
        ],
        too_wide=[c for c in text if c not in levels],
        unsupported=[c for c in features if kinds[c] == "unsupported"],
        environment=environment(),
    )


def check_layout(layout: Layout, columns: Sequence[str]) -> None:
    """Refuse a layout this code cannot read, or a table without the needed columns."""
    if not fixed.MIN_SCHEMA_VERSION <= layout.version <= fixed.SCHEMA_VERSION:
        raise ValueError(f"feature layout version {layout.version} is not readable here")
    absent = [c for c in layout.required if c not in set(columns)]
    if absent:
        more = f" (+{len(absent) - 20} more)" if len(absent) > 20 else ""
        raise ValueError(f"{len(absent)} needed feature column(s) missing: {', '.join(absent[:20])}{more}")


def missing_checks(version: int) -> list[str]:
    return [name for added, names in sorted(fixed.SCHEMA_CHECKS_ADDED.items()) if version < added for name in names]


def numeric_value(df: DataFrame, column: str) -> Column:
    """A numeric feature as double, read from text if the batch delivers text."""
    col = F.col(f"`{column}`")
    if column_kinds(df)[column] in ("numeric", "boolean"):
        return F.nanvl(col.cast("double"), F.lit(None))
    return F.nanvl(to_number(col.cast("string")), F.lit(None))


def apply_encoding(df: DataFrame, layout: Layout, keep: Sequence[str] = ()) -> DataFrame:
    """``keep`` columns plus exactly the layout's columns, as doubles; one projection, no shuffle."""
    check_layout(layout, df.columns)
    out = [F.col(f"`{c}`") for c in keep]
    out += [numeric_value(df, c).alias(c) for c in layout.numeric]
    for spec in layout.one_hot:
        text = F.col(f"`{spec['column']}`").cast("string")
        for level, name in zip(spec["levels"], level_columns(spec)):
            out.append(F.expr(
                f"CASE WHEN CAST({quoted(spec['column'])} AS STRING) = {text_literal(level)} THEN 1D ELSE 0D END AS {quoted(name)}"))
        if spec["missing_level"]:
            out.append(text.isNull().cast("double").alias(level_columns(spec)[-1]))
    return df.select(*out)


def encoding_losses(df: DataFrame, layout: Layout) -> DataFrame:
    """Rows (kind, column, levels, rows): unseen levels, unmatched missing, coerced numbers.

    Unseen levels are grouped per (column, level) before any list is built.
    """
    check_layout(layout, df.columns)
    kinds = column_kinds(df)
    elements = []
    for c in layout.numeric:
        if kinds[c] == "text":
            elements.append(
                f"CASE WHEN {quoted(c)} IS NOT NULL AND try_cast({quoted(c)} AS DOUBLE) IS NULL THEN "
                f"struct('coerced_numeric' AS kind, {text_literal(c)} AS column, CAST(NULL AS STRING) AS level) END")
    for spec in layout.one_hot:
        text, name = f"CAST({quoted(spec['column'])} AS STRING)", text_literal(spec["column"])
        known = ", ".join(text_literal(v) for v in spec["levels"])
        elements.append(
            f"CASE WHEN {text} NOT IN ({known}) THEN struct('unseen_levels' AS kind, {name} AS column, {text} AS level) END")
        if not spec["missing_level"]:
            elements.append(
                f"CASE WHEN {text} IS NULL THEN struct('unmatched_missing' AS kind, {name} AS column, CAST(NULL AS STRING) AS level) END")
    return df.select(rows_of(elements)).groupBy("kind", "column", "level").agg(F.count(F.lit(1)).alias("rows"))
