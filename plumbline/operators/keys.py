"""Joins and per-segment statistics shared by the operators."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.session import small_side, stage


def join_on(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` where NULL matches NULL, keeping the left key columns."""
    renamed = right.select(
        *[F.col(k).alias(f"__{k}") for k in keys], *[c for c in right.columns if c not in keys]
    )
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
    return left.join(renamed, same, how).drop(*[f"__{k}" for k in keys])


def quoted(name: str) -> str:
    """A column name inside SQL text."""
    return "`" + name.replace("`", "``") + "`"


def text_literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def number_literal(value) -> str:
    """A number inside SQL text, exact to the last bit."""
    if value is None:
        return "CAST(NULL AS DOUBLE)"
    return str(value) if isinstance(value, int) else f"CAST('{value!r}' AS DOUBLE)"


def attach(
    df: DataFrame, stats: DataFrame, by: Sequence[str]
) -> tuple[DataFrame, Callable[[str], str]]:
    """Give every row its segment's statistics, as SQL text for a path like ``s0.e[3]``.

    Without segments ``stats`` is one row and becomes literals; with segments it is joined, by
    broadcast while its counted rows stay small. ``stats`` must be staged.
    """
    if by:
        return join_on(df, small_side(stats), by), lambda path: path
    row = stats.first().asDict(recursive=True)

    def literal(path: str) -> str:
        value = row
        for name, index in re.findall(r"(\w+)|\[(\d+)\]", path):
            value = None if value is None else (value[name] if name else value[int(index)])
        return number_literal(value)

    return df, literal


def beside(df: DataFrame, totals: DataFrame, by: Sequence[str]) -> DataFrame:
    """Put each segment's totals on its rows; segments without totals leave.

    Without segments the one row of totals becomes literals, so there is no join at all.
    """
    if by:
        return join_on(df, totals, by)
    row = totals.first()
    if row is None:
        row, df = {c: None for c in totals.columns}, df.where("false")
    return df.select("*", *[F.lit(row[f.name]).cast(f.dataType).alias(f.name) for f in totals.schema.fields])


def staged_stats(df: DataFrame, by: Sequence[str], aggs: Sequence[str], label: str) -> DataFrame:
    return stage(df.groupBy(*by).agg(*[F.expr(a) for a in aggs]), label)


def rows_of(elements: Sequence[str]) -> Column:
    """Generator over the non-NULL structs of a row, given as SQL text."""
    return F.expr(f"inline(filter(array({', '.join(elements)}), e -> e IS NOT NULL))")


def rows_from(elements: Sequence[str]) -> Column:
    """Generator over all structs of a row, given as SQL text."""
    return F.expr(f"inline(array({', '.join(elements)}))")


def kind_of(data_type: T.DataType) -> str:
    """numeric / boolean / text / unsupported, from the declared type only."""
    if isinstance(data_type, T.BooleanType):
        return "boolean"
    if isinstance(data_type, T.NumericType):
        return "numeric"
    if isinstance(data_type, T.StringType):
        return "text"
    return "unsupported"


def column_kinds(df: DataFrame) -> dict[str, str]:
    return {field.name: kind_of(field.dataType) for field in df.schema.fields}


def clean(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The named columns with NaN turned into NULL."""
    types = {f.name: f.dataType for f in df.schema.fields}
    return df.selectExpr(*[
        f"nanvl({quoted(c)}, NULL) AS {quoted(c)}" if isinstance(types[c], (T.DoubleType, T.FloatType)) else quoted(c)
        for c in columns
    ])
