"""The dataset card reads a table many times; what made the table runs once."""

from pyspark.sql import functions as F

from plumbline.plans import card


def test_rows_of_a_card_are_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    def feature(x):
        made.add(1)
        return float(x % 17)

    rows = spark.range(400).select("id", (F.col("id") % 3).cast("string").alias("y"), F.udf(feature, "double")("id").alias("x"))
    found = card.build_card(rows, "y", "made", ["id"], with_baseline=False).first()
    assert found["n_rows"] == 400 and found["n_classes"] == 3
    assert made.value == 400
