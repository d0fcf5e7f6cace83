import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import quantiles
from plumbline.streaming import batch_stream


def test_segment_quantiles_with_a_hot_segment(spark):
    df = spark.range(70_000).select(
        F.when(F.col("id") < 60_000, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 50)).alias("g"),
        ((F.col("id") * 7919) % 60_013 / 7.0).alias("x"))
    out = {(r["g"], r["prob"]): r["value"] for r in quantiles.exact_quantiles(df, {"x": "x"}, {"x": (0.25, 0.5)}, ["g"]).collect()}
    frame = df.toPandas()
    assert len(out) == 102
    for (g, p), value in out.items():
        assert value == pytest.approx(np.percentile(frame.x[frame.g == g], p * 100), abs=1e-9)


def test_stream_scores_equal_batch_scores(spark, tmp_path):
    rows = spark.range(100).select(F.col("id"), (F.col("id") / 100.0).alias("x"))
    rows.write.parquet(str(tmp_path / "in"))
    score = lambda df: df.select("id", (F.col("x") >= 0.5).cast("int").alias("pred"))
    stream = batch_stream.file_stream(spark, str(tmp_path / "in"), rows.schema)
    batch_stream.score_stream(stream, score, str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    got = spark.read.parquet(str(tmp_path / "out")).select("id", "pred")
    assert got.exceptAll(score(rows)).count() == 0 and got.count() == 100
