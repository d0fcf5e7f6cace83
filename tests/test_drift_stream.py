"""A stream's shifts against saved statistics: equal to the batch report, and raised once."""

import uuid

from plumbline.operators import cuts
from plumbline.session import shared_folder
from plumbline.streaming import batch_stream
from pyspark.sql import functions as F


def day(spark, d, missing, n=400):
    return spark.range(n).select(
        F.expr(f"timestamp'2024-03-{d:02d} 00:00:00' + make_interval(0, 0, 0, 0, 0, CAST(id % 1200 AS INT), 0)").alias("ts"),
        F.when(F.col("id") % 10 < missing, F.lit(None)).otherwise(F.col("id").cast("double")).alias("x"), F.lit("v").alias("c"))


def test_a_shift_is_raised_once_and_windows_equal_the_batch(spark):
    folder = f"{shared_folder(spark)}/shift-{uuid.uuid4().hex}"
    days = [day(spark, 1, 1), day(spark, 2, 6), day(spark, 3, 7), day(spark, 4, 1)]
    for i, rows in enumerate(days):
        rows.coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stats = spark.createDataFrame([("x", 0.1), ("c", 0.0)], "name string, fit double")
    stream = batch_stream.file_stream(spark, f"{folder}/in", days[0].schema, files_per_trigger=1)
    batch_stream.raise_shifts(batch_stream.missing_shifts(stream, "ts", stats, ["x", "c"]), f"{folder}/out", f"{folder}/checkpoint")
    alerts = spark.read.parquet(f"{folder}/out/alerts").collect()
    assert [(r["column"], r["start"]) for r in alerts] == [("x", "2024-03-02 00:00:00")]
    got = batch_stream.latest_rows(spark, f"{folder}/out/windows", ["start", "column"])
    want = batch_stream.missing_shifts(spark.read.parquet(f"{folder}/in"), "ts", stats, ["x", "c"])
    order = lambda df: sorted(tuple(r) for r in df.select(*want.columns).collect())
    assert order(got) == order(want) and len(order(want)) == 8
    assert {r[0][8:10] for r in order(want) if r[-1]} == {"02", "03"}


def test_refusals_of_many_fits(spark):
    df = spark.createDataFrame([(2, 500), (2, 10), (3, 500), (1, 0)], "k int, n int")
    for metric, task in (("f1", "classification"), ("roc_auc", "classification"), ("r2", "regression")):
        for r in df.withColumn("why", cuts.refused(metric, task, F.col("k"), F.col("n"))).collect():
            assert (r["why"] is None) == (cuts.cut_refusal(metric, task, r["k"], r["n"]) is None)
