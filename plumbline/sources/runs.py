"""Run histories: nested JSON per run, flattened to an attempt table and a run registry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HISTORY = """run STRING, goal STRUCT<metric: STRING>, iterations INT, stop_reason STRING, config STRUCT<dry_run: BOOLEAN, no_planner: BOOLEAN, max_iterations: INT>,
 best STRUCT<iteration: INT, score: DOUBLE>, holdout STRUCT<status: STRING, metrics: MAP<STRING, DOUBLE>>,
 history ARRAY<STRUCT<iteration: INT, model: STRING, hyperparams: MAP<STRING, STRING>, status: STRING, error_type: STRING, metrics: MAP<STRING, DOUBLE>, failure_type: STRING>>, modified BIGINT"""


def read_histories(spark: SparkSession, path: str, one_per_file: bool = False) -> DataFrame:
    """Histories from JSON lines, or from one JSON document per run directory (``*/history.json``).

    With one file per run the run name is its directory and ``modified`` the file's time.
    """
    reader = spark.read.schema(HISTORY)
    if not one_per_file:
        return reader.json(path)
    df = reader.option("multiLine", True).json(f"{path.rstrip('/')}/*/history.json").select("*", "_metadata.file_path", "_metadata.file_modification_time")
    return df.withColumn("run", F.element_at(F.split("file_path", "/"), -2)).withColumn(
        "modified", F.unix_millis("file_modification_time")).drop("file_path", "file_modification_time")


def registry(histories: DataFrame) -> DataFrame:
    """One row per run: mode, metric, best validation, test, iterations used of allowed, stop reason."""
    return histories.select(
        "run",
        F.expr("CASE WHEN config.dry_run THEN 'dry-run' WHEN config.no_planner THEN 'rules' ELSE 'planner' END AS mode"),
        F.col("goal.metric").alias("metric"), F.round("best.score", 4).alias("best_val"),
        F.expr("CASE WHEN holdout.status = 'ok' THEN round(holdout.metrics[goal.metric], 4) END AS test"),
        F.expr("concat(coalesce(CAST(iterations AS STRING), '?'), '/', coalesce(CAST(config.max_iterations AS STRING), '?')) AS iterations"),
        "stop_reason", "modified")


def newest_first(registered: DataFrame) -> DataFrame:
    return registered.orderBy(F.desc("modified"), "run")


def attempts(histories: DataFrame) -> DataFrame:
    """One row per attempt with the flat fields and the goal metric's score."""
    flat = histories.select("run", F.col("goal.metric").alias("metric"), F.explode("history").alias("a"))
    return flat.select("run", "metric", "a.iteration", "a.model", "a.status", "a.error_type", "a.failure_type",
                       F.expr("a.metrics[metric] AS score"), F.col("a.hyperparams").alias("hyperparams"))
