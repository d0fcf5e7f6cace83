import math

import pytest
from pyspark.sql import functions as F

from plumbline.operators import splits


def frame(spark, n=3000):
    return spark.range(n).select(
        F.col("id").alias("k"), F.when(F.col("id") % 10 == 0, "rare").otherwise("often").alias("y"),
        F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id") % 97).alias("g"))


def test_sizes_are_exact_and_strata_balanced(spark):
    out = splits.assign_splits(frame(spark), ["k"], label="y")
    counts = {r["split"]: r["count"] for r in out.groupBy("split").count().collect()}
    assert counts == {"test": 600, "val": 600, "train": 1800}
    rare = {r["split"]: r["count"] for r in out.where("y = 'rare'").groupBy("split").count().collect()}
    assert rare == {"test": 60, "val": 60, "train": 180}
    assert out.select("k").distinct().count() == 3000


def test_same_split_after_repartitioning(spark):
    a = splits.assign_splits(frame(spark), ["k"], label="y").select("k", "split")
    b = splits.assign_splits(frame(spark).repartition(13, "g").orderBy(F.desc("k")), ["k"], label="y").select("k", "split")
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_tiny_tables(spark):
    with pytest.raises(ValueError):
        splits.assign_splits(frame(spark, 2), ["k"])
    counts = {r["split"]: r["count"] for r in splits.assign_splits(frame(spark, 3), ["k"]).groupBy("split").count().collect()}
    assert counts == {"test": 1, "val": 1, "train": 1}


@pytest.mark.parametrize("label", [None, "y"])
def test_groups_never_cross_and_hot_group_stays_in_train(spark, label):
    out = splits.assign_splits(frame(spark), ["k"], label=label, group="g").cache()
    assert out.count() == 3000
    assert out.groupBy("g").agg(F.count_distinct("split").alias("n")).where("n > 1").count() == 0
    assert out.where("g = -1").select("split").distinct().collect()[0][0] == "train"
    counts = {r["split"]: r["count"] for r in out.groupBy("split").count().collect()}
    assert all(300 < counts[s] < 900 for s in ("test", "val"))


def test_too_few_groups(spark):
    with pytest.raises(ValueError):
        splits.assign_splits(frame(spark).withColumn("g", F.col("k") % 4), ["k"], group="g")


def test_hold_back_and_subsample(spark):
    split = splits.assign_splits(frame(spark), ["k"])
    held = splits.hold_back(split, ["k"], 0.2, "cut")
    assert held.where("held").count() == math.ceil(0.2 * 1800) and held.count() == 1800
    by_group = splits.hold_back(splits.assign_splits(frame(spark), ["k"], group="g"), ["k"], 0.2, "cut", group="g")
    assert by_group.groupBy("g").agg(F.count_distinct("held").alias("n")).where("n > 1").count() == 0
    assert splits.train_subsample(split, ["k"], 0.001).count() == 50


def test_fingerprint_ignores_order_and_sees_changes(spark):
    df = frame(spark)
    a = splits.fingerprint(df, ["k"], "y").first()
    assert a == splits.fingerprint(df.orderBy(F.desc("k")).repartition(7), ["k"], "y").first()
    assert a != splits.fingerprint(df.where("k <> 5"), ["k"], "y").first()
