"""Target rules: which task a column is, and how its labels are coded."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline import fixed
from plumbline.operators.keys import clean, column_kinds
from plumbline.operators.profile import distinct_counts
from plumbline.operators.ranges import positions
from plumbline.session import small_side, stage

# Up to so many distinct labels one task numbers them; more are numbered by ranges.
FEW_CLASSES = 100_000


def target_tasks(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows (name, distinct_count, has_fraction, task); ``task`` is ``unusable`` below two values."""
    kinds = column_kinds(df)
    floats = {f.name: isinstance(f.dataType, (T.FractionalType,)) for f in df.schema.fields}
    values = clean(df, columns)
    fractions = values.agg(*[
        (F.coalesce(F.bool_or(F.col(c) % 1 != 0), F.lit(False)) if floats[c] else F.lit(False)).alias(f"f{i}")
        for i, c in enumerate(columns)
    ]).select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("name"), F.lit(kinds[c] == "numeric").alias("numeric"), F.col(f"f{i}").alias("has_fraction"))
        for i, c in enumerate(columns)
    ])))
    joined = distinct_counts(df, columns).join(fractions, "name")
    d = F.col("distinct_count")
    return joined.select(
        "name", d, "has_fraction",
        F.when(d < 2, "unusable")
        .when(~F.col("numeric") | (d == 2), fixed.CLASSIFICATION)
        .when(F.col("has_fraction"), fixed.REGRESSION)
        .when(d <= fixed.CLASSIFICATION_MAX_DISTINCT, fixed.CLASSIFICATION)
        .otherwise(fixed.REGRESSION).alias("task"),
    )


def detect_task(df: DataFrame, column: str) -> str:
    found = target_tasks(df, [column]).first()["task"]
    if found == "unusable":
        raise ValueError(f"target column {column!r} has fewer than two distinct values: nothing to predict")
    return found


def apply_missing_policy(df: DataFrame, target: str, policy: str = "reject") -> tuple[DataFrame, int]:
    """Rows with a target, and how many had none; ``reject`` refuses any missing one."""
    missing = F.col(target).isNull()
    if isinstance(df.schema[target].dataType, (T.DoubleType, T.FloatType)):
        missing = missing | F.isnan(target)
    counts = df.agg(F.count(F.lit(1)).alias("rows"), F.sum(missing.cast("bigint")).alias("gone")).first()
    gone = int(counts["gone"] or 0)
    if gone and policy != "drop":
        raise ValueError(f"target column {target!r} has {gone} missing values in {counts['rows']} rows; use policy 'drop'")
    return df.where(~missing), gone


def class_levels(df: DataFrame, target: str) -> DataFrame:
    """Staged (label, code) table: codes follow the sorted distinct labels."""
    distinct = stage(df.where(F.col(target).isNotNull()).select(F.col(target).alias("label")).distinct(), "labels")
    if distinct.limit(FEW_CLASSES + 1).count() > FEW_CLASSES:
        return stage(positions(distinct, [F.col("label")], name="code", label="levels"), "levels")
    order = Window.partitionBy(F.lit(1)).orderBy("label")
    return stage(distinct.withColumn("code", (F.row_number().over(order) - 1).cast("bigint")), "levels")


def encode_target(df: DataFrame, target: str, task: str, output: str = "y") -> DataFrame:
    """Adds ``output``: class code for classification, double for regression."""
    if task == fixed.REGRESSION:
        return df.withColumn(output, F.col(target).cast("double"))
    levels = small_side(class_levels(df, target))
    joined = df.join(levels.withColumnRenamed("label", "__label"), F.col(target) == F.col("__label"), "left")
    return joined.drop("__label").withColumnRenamed("code", output)


def decode_labels(df: DataFrame, levels: DataFrame, code: str, output: str = "prediction") -> DataFrame:
    """Class codes back to label text; a code without a label stays the code."""
    side = small_side(levels).select(F.col("code").alias("__code"), F.col("label").cast("string").alias("__label"))
    joined = df.join(side, F.col(code) == F.col("__code"), "left")
    return joined.withColumn(output, F.coalesce("__label", F.col(code).cast("string"))).drop("__code", "__label")
