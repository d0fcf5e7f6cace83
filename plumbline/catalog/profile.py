"""Named queries: column profiles, missing values, sentinels, targets, findings."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline import fixed
from plumbline.catalog import query
from plumbline.catalog.base import (
    DEFECTS_SQL, ORDERS_SQL, bucket_sql, defects, list_sql, orders_customers, union_sql, values_sql,
)
from plumbline.operators import profile as P
from plumbline.operators import sentinels as S
from plumbline.operators import targets as E
from plumbline.session import table

DISTINCT = bucket_sql("d", fixed.DISTINCT_EDGES, fixed.DISTINCT_LAST)
MAGNITUDE = bucket_sql("median_abs", fixed.MAGNITUDE_EDGES, fixed.MAGNITUDE_LAST)
SKEW = bucket_sql("coalesce(abs(skew_value), 0.0)", fixed.SKEW_EDGES, fixed.SKEW_LAST)
CORR = bucket_sql("abs(corr_value)", fixed.CORRELATION_EDGES, fixed.CORRELATION_LAST)


def profile_sql(base: str, numeric: dict[str, str], text: list[str], other: dict[str, str], target: str | None, by: str = "") -> str:
    """The same profile in SQL: numeric {name: type}, text names, other {name: type}."""
    key, keyc = (f"{by}, ", f"{by}, ") if by else ("", "")
    y = f"CAST({target} AS DOUBLE)" if target else "CAST(NULL AS DOUBLE)"
    long = union_sql(
        f"SELECT {keyc}'{c}' AS name, CAST({c} AS DOUBLE) AS x, {y} AS y FROM base" for c in numeric)
    words = union_sql([f"SELECT {keyc}'{c}' AS name, CAST({c} AS VARCHAR) AS v FROM base" for c in [*numeric, *text, *other]])
    types = {**numeric, **{c: "string" for c in text}, **other}
    dtype = "CASE name " + " ".join(f"WHEN '{c}' THEN '{t}'" for c, t in types.items()) + " END"
    isnum = f"name IN {list_sql(numeric)}"
    integer = f"name IN {list_sql([c for c, t in numeric.items() if t != 'double'] or ['-'])}"
    istext = f"name IN {list_sql(text or ['-'])}"
    bools = f"name IN {list_sql([c for c, t in other.items() if t == 'boolean'] or ['-'])}"
    on = " AND ".join(f"a.{k} = b.{k}" for k in ([by] if by else []) + ["name"])
    return f"""
WITH base AS ({base}), words AS ({words}), nums AS ({long}),
counts AS (SELECT {key}name, count(*) AS n_rows, round((count(*) - count(v)) / CAST(count(*) AS DOUBLE), 4) AS missing_rate,
                  count(DISTINCT v) AS d FROM words GROUP BY {key}name),
moments AS (SELECT {key}name, count(x) AS present, quantile_cont(abs(x), 0.5) AS median_abs, skewness(x) AS skew_value,
                   corr(x, y) AS corr_value, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.75) AS q3
            FROM nums GROUP BY {key}name),
outside AS (SELECT {', '.join(f'a.{k}' for k in ([by] if by else []) + ['name'])},
                   round(avg(CASE WHEN q3 > q1 THEN CASE WHEN x < q1 - 1.5 * (q3 - q1) OR x > q3 + 1.5 * (q3 - q1)
                         THEN 1.0 ELSE 0.0 END END), 4) AS outlier_rate
            FROM nums a JOIN moments b ON {on} WHERE x IS NOT NULL GROUP BY {', '.join(f'a.{k}' for k in ([by] if by else []) + ['name'])})
SELECT {key}name, {dtype} AS dtype, n_rows, missing_rate, {DISTINCT} AS "distinct",
       {isnum} OR {bools} OR ({istext} AND d BETWEEN 1 AND 50) AS usable_by_executor,
       CASE WHEN d <= 1 THEN 'constant' WHEN d = 2 THEN 'binary' WHEN NOT ({isnum}) THEN 'categorical'
            WHEN {integer} AND d <= 20 THEN 'discrete' ELSE 'continuous' END AS kind,
       CASE WHEN present >= 8 THEN {MAGNITUDE} END AS magnitude, CASE WHEN present >= 8 THEN {SKEW} END AS skew,
       CASE WHEN present >= 8 THEN outlier_rate END AS outlier_rate,
       CASE WHEN present >= 8 AND NOT isnan(corr_value) THEN {CORR} END AS target_corr
FROM counts LEFT JOIN moments USING ({key}name) LEFT JOIN outside USING ({key}name)"""


PROFILE_COLUMNS = ("name", "dtype", "n_rows", "missing_rate", "distinct", "usable_by_executor", "kind",
                   "magnitude", "skew", "outlier_rate", "target_corr")
ORDER_NUMERIC = {"o_custkey": "bigint", "o_totalprice": "double", "c_nationkey": "int", "c_acctbal": "double"}


@query("a0_profile_columns", profile_sql(
    ORDERS_SQL, ORDER_NUMERIC, ["o_orderpriority", "c_mktsegment"], {"o_orderdate": "timestamp_ntz"}, "y"))
def profile_orders(spark, folder):
    rows = orders_customers(spark, folder).drop("o_orderkey", "o_orderstatus")
    return P.profile_columns(rows, target="y", sentinels=False).select(*PROFILE_COLUMNS)


@query("a0_profile_by_segment", profile_sql(
    "SELECT l_suppkey, l_quantity, l_extendedprice, l_discount, l_linenumber, l_returnflag, "
    "CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END AS y FROM lineitem",
    {"l_quantity": "double", "l_extendedprice": "double", "l_discount": "double", "l_linenumber": "int"},
    ["l_returnflag"], {}, "y", by="l_suppkey"))
def profile_suppliers(spark, folder):
    rows = table(spark, folder, "lineitem").select(
        "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_linenumber", "l_returnflag",
        (F.col("l_linestatus") == "F").cast("int").alias("y"))
    return P.profile_columns(rows, target="y", by=["l_suppkey"], sentinels=False).select("l_suppkey", *PROFILE_COLUMNS)


DEFECT_COLUMNS = ["amount", "kind_text", "user_text", "flag", "weekday", "fixed_value"]


@query("a1_missing_rate", f"""WITH base AS ({DEFECTS_SQL}) """ + union_sql(
    f"SELECT '{c}' AS name, count(*) AS n_rows, count(*) - count({c}) AS n_missing, "
    f"round((count(*) - count({c})) / CAST(count(*) AS DOUBLE), 4) AS missing_rate FROM base" for c in DEFECT_COLUMNS))
def missing_rate(spark, folder):
    return P.missing_rates(defects(spark, folder), DEFECT_COLUMNS)


@query("a2_distinct_bucket", f"""WITH base AS ({DEFECTS_SQL}), c AS (""" + union_sql(
    f"SELECT '{c}' AS name, count(DISTINCT {c}) AS d FROM base" for c in DEFECT_COLUMNS)
    + f") SELECT name, CASE WHEN d < 100 THEN d END AS exact_distinct, {DISTINCT} AS bucket FROM c")
def distinct_bucket(spark, folder):
    d = P.distinct_counts(defects(spark, folder), DEFECT_COLUMNS)
    from plumbline.functions.columns import bucket

    return d.select(
        "name", F.when(F.col("distinct_count") < 100, F.col("distinct_count")).alias("exact_distinct"),
        bucket(F.col("distinct_count"), fixed.DISTINCT_EDGES, fixed.DISTINCT_LAST).alias("bucket"))


DEFECT_NUMERIC = {"amount": "double", "weekday": "int", "fixed_value": "int"}
DEFECT_PROFILE = profile_sql(DEFECTS_SQL, DEFECT_NUMERIC, ["kind_text", "user_text"], {"flag": "boolean"}, None)


@query("a3_kind", f"SELECT name, kind FROM ({DEFECT_PROFILE})")
def kind(spark, folder):
    return P.profile_columns(defects(spark, folder).select(*DEFECT_COLUMNS), sentinels=False).select("name", "kind")


@query("a4_usable", f"SELECT name, usable_by_executor FROM ({DEFECT_PROFILE})")
def usable(spark, folder):
    return P.profile_columns(defects(spark, folder).select(*DEFECT_COLUMNS), sentinels=False).select("name", "usable_by_executor")


SHAPES = ("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber")


def _shape_sql(select: str) -> str:
    long = union_sql(f"SELECT '{c}' AS name, CAST({c} AS DOUBLE) AS x, l_quantity AS y FROM lineitem" for c in SHAPES)
    return f"WITH nums AS ({long}), m AS (SELECT name, quantile_cont(abs(x), 0.5) AS median_abs, skewness(x) AS skew_value, corr(x, y) AS corr_value, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.75) AS q3 FROM nums GROUP BY name) {select}"


def _shape(spark, folder):
    return P.shape(table(spark, folder, "lineitem"), SHAPES, "l_quantity")


@query("a5_magnitude", _shape_sql(f"SELECT name, round(median_abs, 6) AS median_abs, {MAGNITUDE} AS magnitude FROM m"))
def magnitude(spark, folder):
    from plumbline.functions.columns import bucket

    return _shape(spark, folder).select("name", F.round("median_abs", 6).alias("median_abs"), bucket(
        F.col("median_abs"), fixed.MAGNITUDE_EDGES, fixed.MAGNITUDE_LAST).alias("magnitude"))


@query("a6_skew", _shape_sql(f"SELECT name, round(skew_value, 6) AS skew_value, {SKEW} AS skew FROM m"))
def skew(spark, folder):
    from plumbline.functions.columns import bucket

    return _shape(spark, folder).select("name", F.round("skew_value", 6).alias("skew_value"), bucket(
        F.abs("skew_value"), fixed.SKEW_EDGES, fixed.SKEW_LAST).alias("skew"))


@query("a7_outlier_rate", _shape_sql(
    "SELECT name, round(m.q1, 6) AS q1, round(m.q3, 6) AS q3, round(avg(CASE WHEN q3 > q1 THEN CASE WHEN x < q1 - 1.5 * (q3 - q1) "
    "OR x > q3 + 1.5 * (q3 - q1) THEN 1.0 ELSE 0.0 END END), 4) AS outlier_rate FROM nums JOIN m USING (name) GROUP BY name, q1, q3"))
def outlier_rate(spark, folder):
    return _shape(spark, folder).select(
        "name", F.round("q1", 6).alias("q1"), F.round("q3", 6).alias("q3"), F.round("outlier_rate", 4).alias("outlier_rate"))


@query("a8_target_corr", _shape_sql(f"SELECT name, round(corr_value, 6) AS corr_value, {CORR} AS target_corr FROM m"))
def target_corr(spark, folder):
    from plumbline.functions.columns import bucket

    return _shape(spark, folder).select("name", F.round("corr", 6).alias("corr_value"), bucket(
        F.abs("corr"), fixed.CORRELATION_EDGES, fixed.CORRELATION_LAST).alias("target_corr"))


@query("a9_class_balance", """
WITH c AS (SELECT o_custkey % 5 AS part, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL),
s AS (SELECT part, round(n / CAST(sum(n) OVER (PARTITION BY part) AS DOUBLE), 4) AS share FROM c)
SELECT part, string_agg(CAST(CAST(share * 10000 AS BIGINT) AS VARCHAR), ',' ORDER BY share DESC) AS shares,
       CAST(count(*) AS INTEGER) AS n_classes, round(max(share) / min(share), 2) AS imbalance_ratio FROM s GROUP BY part""")
def class_balance(spark, folder):
    rows = table(spark, folder, "orders").withColumn("part", F.col("o_custkey") % 5)
    out = P.class_balance(rows, "o_orderstatus", ["part"])
    text = F.concat_ws(",", F.transform("class_balance", lambda s: F.round(s * 10000).cast("bigint").cast("string")))
    return out.select("part", text.alias("shares"), "n_classes", "imbalance_ratio")


RATES = union_sql(f"SELECT count(*) AS n, count(*) - count({c}) AS gone FROM base" for c in DEFECT_COLUMNS)


@query("a10_missing_block", f"""WITH base AS ({DEFECTS_SQL}), r AS ({RATES})
SELECT round(CAST(sum(gone) AS DOUBLE) / CAST(sum(n) AS DOUBLE), 4) AS overall_rate, CAST(count(*) FILTER (round(gone / CAST(n AS DOUBLE), 4) > 0) AS BIGINT) AS columns_with_missing,
       max(round(gone / CAST(n AS DOUBLE), 4)) AS worst_rate FROM r""")
def missing_block(spark, folder):
    return P.missing_block(P.missing_rates(defects(spark, folder), DEFECT_COLUMNS))


@query("a11_target_profile", "SELECT * EXCLUDE (name, usable_by_executor, target_corr, n_rows) FROM (" + profile_sql(
    "SELECT o_totalprice FROM orders", {"o_totalprice": "double"}, [], {}, None) + ")")
def target_profile(spark, folder):
    rows = table(spark, folder, "orders").select("o_totalprice")
    return P.profile_columns(rows, sentinels=False).select(
        "dtype", "missing_rate", "distinct", "kind", "magnitude", "skew", "outlier_rate")


MARKERS = "(VALUES " + ", ".join(
    f"('{m}', {i})" for i, m in enumerate(fixed.TEXT_MARKERS)) + ") AS k(value, position)"
TEXT_SQL = union_sql(
    f"SELECT '{c}' AS name, lower(regexp_replace({c}, '^\\s+|\\s+$', '', 'g')) AS value FROM base" for c in ("kind_text", "user_text"))


@query("a12_text_markers", f"""WITH base AS ({DEFECTS_SQL}), t AS ({TEXT_SQL})
SELECT name, 'text_marker' AS kind, value, count(*) AS hits, round(count(*) / CAST((SELECT count(*) FROM base) AS DOUBLE), 4) AS rate,
       CAST(position AS INTEGER) AS position
FROM t JOIN {MARKERS} USING (value) GROUP BY name, value, position HAVING count(*) >= 2""")
def text_markers(spark, folder):
    return S.text_markers(defects(spark, folder), ["kind_text", "user_text"])


# Two rounds unrolled: the lowest value, then the lowest of the rest.
SENTINEL_SQL = """
WITH base AS ({base}), v AS (SELECT {key} AS part, {col} AS x FROM base),
n AS (SELECT part, count(*) AS n_rows FROM v GROUP BY part),
f AS (SELECT part, x, count(*) AS hits FROM v WHERE x IS NOT NULL GROUP BY part, x),
r1 AS (SELECT part, min(x) AS code, count(*) AS d FROM f GROUP BY part),
s1 AS (SELECT v.part, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.75) AS q3, min(x) AS lo, max(x) AS hi, count(*) AS m
       FROM v JOIN r1 USING (part) WHERE x IS NOT NULL AND x <> code GROUP BY v.part),
g1 AS (SELECT r1.part, code, d, hits, lo, m, CASE WHEN q3 > q1 THEN q3 - q1 ELSE hi - lo END AS scale
       FROM r1 JOIN s1 USING (part) JOIN f ON f.part = r1.part AND f.x = r1.code),
t1 AS (SELECT part, code, hits FROM g1 WHERE d >= 5 AND m >= 20 AND hits >= 2 AND code IN ({codes}) AND scale > 0
       AND (lo - code >= 3.0 * scale OR (code < 0 AND lo >= 0 AND lo - code >= scale))),
r2 AS (SELECT f.part, min(x) AS code, count(*) AS d FROM f JOIN t1 USING (part) WHERE x <> t1.code GROUP BY f.part),
s2 AS (SELECT v.part, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.75) AS q3, min(x) AS lo, max(x) AS hi, count(*) AS m
       FROM v JOIN r2 USING (part) WHERE x IS NOT NULL AND x > r2.code GROUP BY v.part),
g2 AS (SELECT r2.part, code, d, hits, lo, m, CASE WHEN q3 > q1 THEN q3 - q1 ELSE hi - lo END AS scale
       FROM r2 JOIN s2 USING (part) JOIN f ON f.part = r2.part AND f.x = r2.code),
t2 AS (SELECT part, code, hits FROM g2 WHERE d >= 5 AND m >= 20 AND hits >= 2 AND code IN ({codes}) AND scale > 0
       AND (lo - code >= 3.0 * scale OR (code < 0 AND lo >= 0 AND lo - code >= scale)))
SELECT {out} 'amount' AS name, 'numeric_code' AS kind, CAST(CAST(code AS BIGINT) AS VARCHAR) AS value, hits,
       round(hits / CAST(n_rows AS DOUBLE), 4) AS rate
FROM (SELECT * FROM t1 UNION ALL SELECT * FROM t2) JOIN n USING (part) WHERE n_rows >= 20"""
CODE_LIST = ", ".join(str(c) for c in fixed.NUMERIC_CODES)


def sentinel_sql(base: str, key: str = "0", out: str = "", col: str = "amount") -> str:
    return SENTINEL_SQL.format(base=base, key=key, codes=CODE_LIST, out=out, col=col)


@query("a13_numeric_codes", sentinel_sql(DEFECTS_SQL))
def numeric_codes(spark, folder):
    return S.numeric_codes(defects(spark, folder), ["amount", "weekday", "fixed_value", "user_id"]).drop("position")


@query("a13_numeric_codes_by_segment", sentinel_sql(DEFECTS_SQL, "event_type", "part AS event_type,"))
def numeric_codes_by(spark, folder):
    return S.numeric_codes(defects(spark, folder), ["amount", "weekday"], ["event_type"]).drop("position")


@query("a14_column_stats", f"""WITH base AS ({DEFECTS_SQL}), s AS ({sentinel_sql(DEFECTS_SQL)}), r AS (""" + union_sql(
    f"SELECT '{c}' AS name, round((count(*) - count({c})) / CAST(count(*) AS DOUBLE), 4) AS missing_rate FROM base"
    for c in ("amount", "weekday", "kind_text")) + """)
SELECT r.name, missing_rate, coalesce((SELECT string_agg(value || ':' || CAST(CAST(round(rate * 10000) AS BIGINT) AS VARCHAR), ',' ORDER BY CAST(value AS BIGINT)) FROM s WHERE s.name = r.name), '') AS codes FROM r""")
def column_stats(spark, folder):
    out = P.column_stats(defects(spark, folder), ["amount", "weekday", "kind_text"])
    text = F.concat_ws(",", F.transform("codes", lambda c: F.concat_ws(
        ":", c["value"].cast("bigint").cast("string"), F.round(c["rate"] * 10000).cast("bigint").cast("string"))))
    return out.select("name", "missing_rate", F.coalesce(text, F.lit("")).alias("codes"))


# Conversations give the notes: one list per conversation, users' turns as findings, the rest as notes.
@query("a15_findings", r"""
WITH t AS (SELECT conv_id, CASE WHEN role = 'user' THEN 0 ELSE 1 END AS part, turn,
                  substr(trim(regexp_replace(text, '\s+', ' ', 'g')), 1, 400) AS text FROM conversations),
d AS (SELECT conv_id, text, min(part * 1000000 + turn) AS first FROM t WHERE text <> '' GROUP BY conv_id, text),
r AS (SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY first, text) AS INTEGER) AS position, text FROM d)
SELECT * FROM r WHERE position <= 20""")
def findings(spark, folder):
    turns = table(spark, folder, "conversations").withColumnRenamed("turn", "position")
    return P.merge_findings(turns.where("role = 'user'"), turns.where("role <> 'user'"), ["conv_id"])


@query("e1_detect_task", """
WITH c AS (SELECT 'o_custkey' AS name, count(DISTINCT o_custkey) AS d, false AS frac, true AS num FROM orders UNION ALL
SELECT 'o_orderstatus', count(DISTINCT o_orderstatus), false, false FROM orders UNION ALL
SELECT 'o_totalprice', count(DISTINCT o_totalprice), bool_or(o_totalprice % 1 <> 0), true FROM orders UNION ALL
SELECT 'few', count(DISTINCT o_custkey % 7), false, true FROM orders UNION ALL
SELECT 'two', count(DISTINCT o_custkey % 2), false, true FROM orders UNION ALL
SELECT 'one', 1, false, true)
SELECT name, CASE WHEN d < 100 THEN d END AS exact_distinct, frac AS has_fraction,
  CASE WHEN d < 2 THEN 'unusable' WHEN NOT num OR d = 2 THEN 'classification' WHEN frac THEN 'regression'
       WHEN d <= 20 THEN 'classification' ELSE 'regression' END AS task FROM c""")
def detect_task(spark, folder):
    rows = table(spark, folder, "orders").select(
        "o_custkey", "o_orderstatus", "o_totalprice", (F.col("o_custkey") % 7).alias("few"),
        (F.col("o_custkey") % 2).alias("two"), F.lit(1).alias("one"))
    out = E.target_tasks(rows, rows.columns)
    return out.select("name", F.when(F.col("distinct_count") < 100, F.col("distinct_count")).alias("exact_distinct"), "has_fraction", "task")


@query("e2_encode_target", """
WITH l AS (SELECT o_orderpriority AS label, row_number() OVER (ORDER BY o_orderpriority) - 1 AS code
           FROM (SELECT DISTINCT o_orderpriority FROM orders))
SELECT o_orderkey, o_orderpriority, code AS y FROM orders JOIN l ON o_orderpriority = label""")
def encode_target(spark, folder):
    rows = table(spark, folder, "orders").select("o_orderkey", "o_orderpriority")
    return E.encode_target(rows, "o_orderpriority", fixed.CLASSIFICATION)


@query("p3_target_missing_policy", f"""WITH base AS ({DEFECTS_SQL})
SELECT kind_text, count(*) AS n, (SELECT count(*) FROM base WHERE kind_text IS NULL) AS n_dropped
FROM base WHERE kind_text IS NOT NULL GROUP BY kind_text""")
def missing_policy(spark, folder):
    kept, gone = E.apply_missing_policy(defects(spark, folder).select("kind_text"), "kind_text", "drop")
    return kept.groupBy("kind_text").agg(F.count(F.lit(1)).alias("n"), F.lit(gone).cast("bigint").alias("n_dropped"))


@query("p9_decode_labels", """
WITH l AS (SELECT o_orderpriority AS label, row_number() OVER (ORDER BY o_orderpriority) - 1 AS code
           FROM (SELECT DISTINCT o_orderpriority FROM orders)),
p AS (SELECT o_orderkey, o_custkey % 7 AS code FROM orders)
SELECT o_orderkey, p.code, coalesce(label, CAST(p.code AS VARCHAR)) AS prediction FROM p LEFT JOIN l ON p.code = l.code""")
def decode_labels(spark, folder):
    rows = table(spark, folder, "orders")
    codes = rows.select("o_orderkey", (F.col("o_custkey") % 7).alias("code"))
    return E.decode_labels(codes, E.class_levels(rows, "o_orderpriority"), "code")
