"""Save a fitted search result as one directory, load it again, predict and score new batches."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline import fixed
from plumbline.operators import bootstrap, calibration
from plumbline.operators.encoding import Layout, apply_encoding
from plumbline.operators.steps import Fitted, FittedSteps
from plumbline.plans import fits, search


@dataclass
class Saved:
    """Layout, steps, model, classes and cut that belong together."""

    layout: Layout
    steps: FittedSteps
    fit: fits.Fit
    classes: list[str]
    cut: float | None
    metric: str

    @property
    def trial(self) -> search.Trial:
        return search.Trial(0, self.fit.name, self.fit.applied, cut=self.cut, fit=self.fit, steps=self.steps)


def save(spark: SparkSession, path: str, layout: Layout, trial: search.Trial, classes: Sequence[str], metric: str) -> None:
    """Model below ``path/model``, everything else as one JSON line below ``path/record``."""
    trial.fit.model.write().overwrite().save(f"{path}/model")
    record = {
        "layout": json.loads(layout.to_json()), "steps": [asdict(s) for s in trial.steps.steps],
        "step_columns": trial.steps.columns, "applied_steps": trial.steps.applied, "name": trial.fit.name, "task": trial.fit.task,
        "features": trial.fit.features, "applied": trial.fit.applied, "classes": list(classes), "cut": trial.cut, "metric": metric,
    }
    spark.createDataFrame([(json.dumps(record),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/record")


def load(spark: SparkSession, path: str) -> Saved:
    """Read a saved directory; refuse a model whose width is not that of its record."""
    record = json.loads(spark.read.text(f"{path}/record").first()["value"])
    model = PipelineModel.load(f"{path}/model")
    width = len(model.stages[0].getInputCols())
    if width != len(record["features"]) or getattr(model.stages[-1], "numFeatures", width) != width:
        raise ValueError(f"the model takes {width} columns, its record lists {len(record['features'])}")
    fit = fits.Fit(model, record["name"], record["task"], record["features"], record["applied"])
    steps = FittedSteps([Fitted(**s) for s in record["steps"]], record["step_columns"], record["applied_steps"], [])
    return Saved(Layout(**record["layout"]), steps, fit, record["classes"], record["cut"], record["metric"])


def predict(df: DataFrame, saved: Saved, key: str) -> DataFrame:
    """key, prediction and one probability per label; a chain of projections without a shuffle."""
    encoded = apply_encoding(df, saved.layout, keep=[key])
    out = search.predict(saved.trial, encoded, [key])
    if saved.fit.task == fixed.REGRESSION:
        return out.select(key, F.col("pred").alias("prediction"))
    labels = F.array(*[F.lit(c) for c in saved.classes])
    text = F.coalesce(F.get(labels, F.col("pred").cast("int")), F.col("pred").cast("string"))
    probas = [F.col("probas")[i].alias(f"proba_{c}") for i, c in enumerate(saved.classes)] if "probas" in out.columns else []
    return out.select(key, text.alias("prediction"), *probas)


def label_codes(df: DataFrame, label: str, classes: Sequence[str]) -> DataFrame:
    """Adds ``y`` (class code by label text) and ``label_state``: scored, missing or unknown."""
    text = F.col(label).cast("string")
    position = F.array_position(F.array(*[F.lit(c) for c in classes]), text)
    return df.withColumn("y", F.when(position > 0, position - 1)).withColumn(
        "label_state", F.when(text.isNull(), "missing").when(position > 0, "scored").otherwise("unknown"))


def score_batch(predicted: DataFrame, label: str, classes: Sequence[str], seed: int = 42, resamples: int = fixed.RESAMPLES) -> tuple[DataFrame, DataFrame]:
    """(counts per label state, long scores with row intervals) for labelled predictions.

    ``predicted`` holds the label column, ``prediction`` text and, when binary, ``proba_<second class>``.
    """
    coded = label_codes(predicted, label, classes)
    counts = coded.groupBy("label_state").agg(F.count(F.lit(1)).alias("rows"))
    position = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col("prediction")) - 1
    rows = coded.where("label_state = 'scored'").withColumn("pred", position.cast("bigint"))
    binary = len(classes) == 2
    if binary and f"proba_{classes[1]}" in predicted.columns:
        rows = rows.withColumn("proba", F.col(f"`proba_{classes[1]}`"))
    long = search.score_predictions(rows, fixed.CLASSIFICATION, len(classes))
    if "proba" in rows.columns:
        extra = calibration.brier(rows, "y", "proba").select(F.lit("brier").alias("metric"), F.col("brier").alias("value"))
        error = calibration.calibration_error(calibration.reliability(rows, "y", "proba"))
        extra = extra.unionByName(error.select(F.lit("calibration_error").alias("metric"), F.col("calibration_error").alias("value")))
        long = long.unionByName(extra.where("value IS NOT NULL"))
    bounds = bootstrap.bootstrap(
        bootstrap.label_draws(rows, "y", "pred", binary=binary, seed=seed, resamples=resamples), rows, resamples=resamples)
    return counts, long.join(bounds.select("metric", "low", "high"), "metric", "left")
