"""Inputs shared by the named queries, as a DataFrame and as the same SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.session import table

# Orders with their customers; y marks a finished order.
ORDERS_SQL = """
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority, c_nationkey,
       c_acctbal, c_mktsegment, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS y
FROM orders JOIN customer ON o_custkey = c_custkey"""


def orders_customers(spark: SparkSession, folder: str) -> DataFrame:
    orders, customer = table(spark, folder, "orders"), table(spark, folder, "customer")
    joined = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
    return joined.select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority",
        "c_nationkey", "c_acctbal", "c_mktsegment", (F.col("o_orderstatus") == "F").cast("int").alias("y"),
    )


# Events with planted defects: nulls, stacked numeric codes, text markers, unreadable numbers.
DEFECTS_SQL = """
SELECT event_id, user_id, event_type, ts,
       CASE WHEN event_id % 17 = 0 THEN NULL WHEN event_id % 50 = 0 THEN -9999.0
            WHEN event_id % 70 = 0 THEN -999.0 ELSE value END AS amount,
       CASE WHEN event_id % 40 = 0 THEN ' Unknown' WHEN event_id % 90 = 0 THEN NULL ELSE event_type END AS kind_text,
       CASE WHEN event_id % 33 = 0 THEN CAST(user_id AS VARCHAR) || 'x'
            WHEN event_id % 19 = 0 THEN NULL ELSE CAST(user_id AS VARCHAR) END AS user_text,
       event_id % 3 = 0 AS flag, CAST(event_id % 7 AS INTEGER) AS weekday, 5 AS fixed_value
FROM events"""


def defects(spark: SparkSession, folder: str) -> DataFrame:
    return with_defects(table(spark, folder, "events"))


def with_defects(events: DataFrame) -> DataFrame:
    """Events, of a table or a stream, with the planted defects."""
    e, user = F.col("event_id"), F.col("user_id").cast("string")
    return events.select(
        "event_id", "user_id", "event_type", "ts",
        F.when(e % 17 == 0, F.lit(None)).when(e % 50 == 0, F.lit(-9999.0)).when(e % 70 == 0, F.lit(-999.0))
        .otherwise(F.col("value")).alias("amount"),
        F.when(e % 40 == 0, F.lit(" Unknown")).when(e % 90 == 0, F.lit(None)).otherwise(F.col("event_type")).alias("kind_text"),
        F.when(e % 33 == 0, F.concat(user, F.lit("x"))).when(e % 19 == 0, F.lit(None)).otherwise(user).alias("user_text"),
        (e % 3 == 0).alias("flag"), (e % 7).cast("int").alias("weekday"), F.lit(5).alias("fixed_value"),
    )


# Labelled documents with two closed-form scores, so no fitted model is needed.
DOCS_SQL = """
SELECT d.doc_id, d.lang, d.source, d.n_chars, l.quality, l.toxic,
       round(1.0 / (1.0 + exp(-(d.n_chars - 600) / 400.0)), 6) AS proba,
       round(1.0 / (1.0 + exp(-(d.n_chars - 500) / 300.0)), 6) AS proba_b
FROM documents d JOIN labels l ON d.doc_id = l.doc_id"""


def scored_docs(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    n = F.col("n_chars")
    return docs.join(labels, "doc_id").select(
        "doc_id", "lang", "source", "n_chars", "quality", "toxic",
        F.round(1.0 / (1.0 + F.exp(-(n - 600) / 400.0)), 6).alias("proba"),
        F.round(1.0 / (1.0 + F.exp(-(n - 500) / 300.0)), 6).alias("proba_b"),
    )


# Line items as scored rows: binary target linestatus, three-class target returnflag, two models.
LINES_SQL = """
SELECT l_orderkey, l_suppkey, l_returnflag AS flag, CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END AS y,
       round(0.01 * l_quantity + 3.0 * l_discount + 2.0 * l_tax, 6) AS proba,
       round(0.012 * l_quantity + 2.0 * l_discount + 2.0 * l_tax, 6) AS proba_b,
       CASE WHEN l_quantity < 17 THEN 'A' WHEN l_quantity < 34 THEN 'N' ELSE 'R' END AS flag_pred,
       CASE WHEN l_discount < 0.04 THEN 'A' WHEN l_discount < 0.07 THEN 'N' ELSE 'R' END AS flag_pred_b,
       l_extendedprice AS amount, round(l_quantity * 1500.0, 2) AS amount_pred,
       round(l_quantity * 1400.0 + 2000.0, 2) AS amount_pred_b
FROM lineitem"""


def scored_lines(spark: SparkSession, folder: str) -> DataFrame:
    q, d, t = F.col("l_quantity"), F.col("l_discount"), F.col("l_tax")
    return table(spark, folder, "lineitem").select(
        "l_orderkey", "l_suppkey", F.col("l_returnflag").alias("flag"), (F.col("l_linestatus") == "F").cast("int").alias("y"),
        F.round(0.01 * q + 3.0 * d + 2.0 * t, 6).alias("proba"),
        F.round(0.012 * q + 2.0 * d + 2.0 * t, 6).alias("proba_b"),
        F.when(q < 17, "A").when(q < 34, "N").otherwise("R").alias("flag_pred"),
        F.when(d < 0.04, "A").when(d < 0.07, "N").otherwise("R").alias("flag_pred_b"),
        F.col("l_extendedprice").alias("amount"), F.round(q * 1500.0, 2).alias("amount_pred"),
        F.round(q * 1400.0 + 2000.0, 2).alias("amount_pred_b"),
    )


def bucket_sql(value: str, edges, last: str) -> str:
    cases = " ".join(f"WHEN {value} <= {edge} THEN '{label}'" for edge, label in edges)
    return f"CASE WHEN {value} IS NULL THEN NULL {cases} ELSE '{last}' END"


def union_sql(parts) -> str:
    return "\nUNION ALL ".join(parts)


def values_sql(words) -> str:
    return ", ".join("('" + str(w).replace("'", "''") + "')" for w in words)


def list_sql(words) -> str:
    return "(" + ", ".join("'" + str(w).replace("'", "''") + "'" for w in words) + ")"
