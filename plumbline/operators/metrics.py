"""Label-based and error metrics from small cell tables, for any number of segments and models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline import fixed
from plumbline.functions.columns import metric_constant
from plumbline.operators.keys import beside, join_on


def confusion(df: DataFrame, label: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    """Rows (by..., label, pred, n). The only pass over scored rows that label metrics need."""
    return df.groupBy(*by, F.col(label).cast("string").alias("label"), F.col(pred).cast("string").alias("pred")).agg(
        F.count(F.lit(1)).alias("n")
    )


def confusion_rollup(df: DataFrame, label: str, pred: str, by: Sequence[str]) -> DataFrame:
    """Cells per segment and for all coarser totals (NULL keys, counted in ``level``) from one scan."""
    cells = confusion(df, label, pred, by)
    totals = [cells.select(*by, "label", "pred", "n", F.lit(0).alias("level"))]
    for drop in range(1, len(by) + 1):
        kept = by[: len(by) - drop]
        part = cells.groupBy(*kept, "label", "pred").agg(F.sum("n").alias("n"))
        totals.append(part.select(
            *kept, *[F.lit(None).cast(cells.schema[c].dataType).alias(c) for c in by[len(kept):]], "label", "pred", "n",
            F.lit(drop).alias("level")))
    out = totals[0]
    for part in totals[1:]:
        out = out.unionByName(part)
    return out


def class_table(cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rows (by..., class, tp, truth, predicted) for every class seen in truth or prediction."""
    sides = cells.select(*by, F.expr(
        "inline(array(struct(label AS class, n AS truth, CAST(0 AS BIGINT) AS predicted, IF(label = pred, n, 0) AS tp), "
        "struct(pred AS class, CAST(0 AS BIGINT) AS truth, n AS predicted, CAST(0 AS BIGINT) AS tp)))"))
    return sides.groupBy(*by, "class").agg(
        F.sum("tp").alias("tp"), F.sum("truth").alias("truth"), F.sum("predicted").alias("predicted")
    )


def label_scores(cells: DataFrame, by: Sequence[str] = (), binary: bool = True) -> DataFrame:
    """One row per segment: accuracy, f1, precision, recall, balanced_accuracy (and specificity if binary).

    Binary scores are those of class 1; otherwise the plain mean over classes. Zero division gives 0.
    """
    if binary:
        return _binary_scores(cells, by)
    per = class_table(cells, by).select(
        *by, "tp", "truth", F.expr("IF(predicted > 0, tp / predicted, 0D) AS __p"), F.expr("IF(truth > 0, tp / truth, 0D) AS __r"),
        F.expr("IF(truth + predicted > 0, 2 * tp / (truth + predicted), 0D) AS __f"))
    return per.groupBy(*by).agg(
        F.expr("sum(truth) AS rows"), F.expr("sum(tp) / sum(truth) AS accuracy"), F.expr("avg(__f) AS f1"),
        F.expr("avg(__p) AS precision"), F.expr("avg(__r) AS recall"), F.expr("avg(CASE WHEN truth > 0 THEN __r END) AS balanced_accuracy"))


def _binary_scores(cells: DataFrame, by: Sequence[str]) -> DataFrame:
    """Codes 0 and 1: four sums, one aggregate."""
    def cell(label: str, pred: str, name: str) -> Column:
        return F.expr(f"sum(IF(label = '{label}' AND pred = '{pred}', n, 0L)) AS {name}")

    sums = cells.groupBy(*by).agg(cell("1", "1", "tp"), cell("0", "1", "fp"), cell("1", "0", "fn"), cell("0", "0", "tn"))
    return sums.select(
        *by, F.expr("tp + fp + fn + tn AS rows"), F.expr("try_divide(tp + tn, tp + fp + fn + tn) AS accuracy"),
        F.expr("coalesce(try_divide(2 * tp, 2 * tp + fp + fn), 0D) AS f1"), F.expr("coalesce(try_divide(tp, tp + fp), 0D) AS precision"),
        F.expr("coalesce(try_divide(tp, tp + fn), 0D) AS recall"),
        F.expr("CASE WHEN tp + fn > 0 AND tn + fp > 0 THEN (try_divide(tp, tp + fn) + try_divide(tn, tn + fp)) / 2 "
               "ELSE coalesce(try_divide(tp, tp + fn), try_divide(tn, tn + fp)) END AS balanced_accuracy"),
        F.expr("round(coalesce(try_divide(tn, tn + fp), 0D), 6) AS specificity"))


def regression_scores(df: DataFrame, truth: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    """One row per segment: r2 (constant truth: 1 if exact else 0), mae, rmse."""
    y, p = f"CAST({truth} AS DOUBLE)", f"CAST({pred} AS DOUBLE)"
    sums = df.groupBy(*by).agg(
        F.expr("count(1) AS rows"), F.expr(f"avg(({y} - {p}) * ({y} - {p})) AS mse"),
        F.expr(f"var_pop({y}) AS spread"), F.expr(f"avg(abs({y} - {p})) AS mae"))
    return sums.select(*by, "rows", F.expr(
        "CASE WHEN rows < 2 THEN NULL WHEN spread = 0 THEN IF(mse = 0, 1D, 0D) ELSE 1 - try_divide(mse, spread) END AS r2"),
        "mae", F.expr("sqrt(mse) AS rmse"))


def long_scores(wide: DataFrame, metrics: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Rows (by..., metric, value); a score that is not finite is left out."""
    long = wide.select(*by, F.expr("inline(array(" + ", ".join(
        f"struct('{m}' AS metric, CAST({m} AS DOUBLE) AS value)" for m in metrics) + "))"))
    return long.where("value IS NOT NULL AND NOT isnan(value) AND abs(value) < double('infinity')")


def with_aliases(long: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Scores repeated under their other names."""
    cases = " ".join(f"WHEN '{target}' THEN '{alias}'" for alias, target in fixed.METRIC_ALIASES.items())
    copies = long.withColumn("metric", F.expr(f"CASE metric {cases} END")).where("metric IS NOT NULL")
    return long.unionByName(copies)


def applicable(metric: Column, task: Column, binary: Column, has_proba: Column) -> Column:
    """True when a metric of the registry is defined for these predictions."""
    return (
        (metric_constant(metric, 0, "string") == task)
        & (binary | ~metric_constant(metric, 4, "boolean"))
        & (has_proba | ~metric_constant(metric, 3, "boolean"))
    )


def train_val_gap(long: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rows (by..., metric, train, val, train_val_gap): positive means validation is worse."""
    wide = long.groupBy(*by, "metric").agg(
        F.expr("max(CASE WHEN split = 'train' THEN value END) AS train"),
        F.expr("max(CASE WHEN split = 'val' THEN value END) AS val"))
    sign = F.when(F.coalesce(metric_constant(F.col("metric"), 1, "string"), F.lit(fixed.MAXIMIZE)) == fixed.MINIMIZE, -1.0).otherwise(1.0)
    return wide.where("train IS NOT NULL AND val IS NOT NULL").withColumn(
        "train_val_gap", F.round(sign * (F.col("train") - F.col("val")), 6))


def selection_gap(val: DataFrame, test: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Val and test scores side by side: signed gap (positive: val was optimistic), val inside the test interval."""
    joined = join_on(val.withColumnRenamed("value", "val"), test.withColumnRenamed("value", "test"), keys)
    sign = F.when(metric_constant(F.col("metric"), 1, "string") == fixed.MINIMIZE, -1.0).otherwise(1.0)
    return joined.withColumn("selection_gap", F.round(sign * (F.col("val") - F.col("test")), 6)).withColumn(
        "val_inside_ci", F.col("val").between(F.col("low"), F.col("high")))


def chance_scores(train: DataFrame, val: DataFrame, label: str, by: Sequence[str] = (), binary: bool = True) -> DataFrame:
    """No-feature scores on val: the train majority class (smallest on ties) predicted everywhere.

    Ranking scores exist for two classes only.
    """
    counts = train.groupBy(*by, F.col(label).cast("string").alias("c")).agg(F.count(F.lit(1)).alias("n"))
    first = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))
    major = counts.withColumn("__r", F.row_number().over(first.orderBy(F.desc("n"), "c"))).where("__r = 1")
    cells = val.groupBy(*by, F.col(label).cast("string").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    guess = beside(cells, major.select(*by, F.col("c").alias("pred")), by)
    scores = label_scores(guess, by, binary)
    if not binary:
        return scores
    share = cells.groupBy(*by).agg(F.expr("sum(CASE WHEN label = '1' THEN n ELSE 0 END) / sum(n) AS pr_auc"))
    return beside(scores, share, by).withColumn("roc_auc", F.lit(0.5))
