"""Streams of new rows: predictions as they arrive, and data quality per event-time window."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from plumbline import fixed
from plumbline.functions.columns import rate_changed
from plumbline.operators.keys import rows_of, text_literal

WATERMARK = "10 minutes"


def file_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 1000) -> DataFrame:
    """Parquet files as they land below ``path`` (a folder or a glob)."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def quality_windows(rows: DataFrame, time: str, columns: Sequence[str], codes: dict[str, Sequence[float]], every: str = "1 day") -> DataFrame:
    """Rows (start, rows, missing_<c>, code_<c>) per window; the same plan for a stream and a batch.

    Late rows are accepted up to the watermark; the state holds one row per open window.
    """
    stamped = rows.withColumn("__t", F.col(time).cast("timestamp"))
    if rows.isStreaming:
        stamped = stamped.withWatermark("__t", WATERMARK)
    counts = [F.count(F.lit(1)).alias("rows")]
    counts += [F.sum(F.col(c).isNull().cast("bigint")).alias(f"missing_{c}") for c in columns]
    counts += [F.sum(F.coalesce(F.col(c).isin([float(v) for v in values]), F.lit(False)).cast("bigint")).alias(f"code_{c}") for c, values in codes.items()]
    return stamped.groupBy(F.window("__t", every)).agg(*counts).select(
        F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("start"),
        "rows", *[f"missing_{c}" for c in columns], *[f"code_{c}" for c in codes])


def missing_shifts(rows: DataFrame, time: str, stats: DataFrame, columns: Sequence[str], every: str = "1 day") -> DataFrame:
    """Rows (start, column, fit, now, rows, moved): each window's missing rates beside those at fit; the same plan for a stream and a batch.

    ``stats`` is the saved table (name, fit) of a layout, one row per column: a static side that is broadcast.
    """
    counted = quality_windows(rows, time, columns, {}, every)
    long = counted.select("start", "rows", rows_of([f"struct({text_literal(c)} AS name, missing_{c} AS gone)" for c in columns]))
    rate = F.coalesce(F.try_divide("gone", "rows"), F.lit(0.0))
    return long.join(F.broadcast(stats), "name").select(
        "start", F.col("name").alias("column"), "fit", F.round(rate, 4).alias("now"), "rows",
        rate_changed(F.col("fit"), rate, F.col("rows"), fixed.MISSING_RATE_SHIFT).alias("moved"))


def raise_shifts(shifts: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Run the stream of ``missing_shifts``: every window's last state goes below ``path``/windows, and a column's first shift
    below ``path``/alerts, once however often it moves later. The alerts written so far are the state; a retried batch
    looks only at those of earlier batches and overwrites its own.
    """
    spark, schema = shifts.sparkSession, shifts.schema

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        batch.write.mode("overwrite").parquet(f"{path}/windows/batch={number}")
        moved = batch.where("moved").groupBy("column").agg(F.min_by(F.struct(*[c for c in schema.names if c != "column"]), "start").alias("r")).select("column", "r.*")
        if number:
            raised = spark.read.schema(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in schema)}, batch int").parquet(f"{path}/alerts")
            moved = moved.join(raised.where(F.col("batch") < number).select("column"), "column", "left_anti")
        moved.select(*schema.names).write.mode("overwrite").parquet(f"{path}/alerts/batch={number}")
        batch.unpersist()

    query = shifts.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def keyed_updates(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Process what is there in update mode: every batch writes the rows it changed, open windows included.

    One folder per batch makes a retry overwrite itself; ``latest_rows`` reads the table.
    """
    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    query = stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def latest_rows(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """The last row written for every key below ``path``."""
    rows = spark.read.parquet(path)
    rest = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(*keys, *[f"r.{c}" for c in rest])


def score_stream(stream: DataFrame, predict: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Predict every micro-batch with the batch function; one folder per batch makes a retry overwrite itself."""
    def write(batch: DataFrame, number: int) -> None:
        predict(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
