"""Named queries: encoding, preprocessing steps, splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline import fixed
from plumbline.catalog import query
from plumbline.catalog.base import DEFECTS_SQL, ORDERS_SQL, defects, list_sql, orders_customers, union_sql
from plumbline.operators import encoding as E
from plumbline.operators import splits as L
from plumbline.operators import steps as R
from plumbline.operators.profile import missing_rates
from plumbline.session import table

# --- encoding ---------------------------------------------------------------------

DEFECT_TEXT = ("kind_text", "user_text", "event_type")


@query("e3_fit_levels", f"""WITH base AS ({DEFECTS_SQL}), v AS (""" + union_sql(
    f"SELECT '{c}' AS name, {c} AS level FROM base" for c in DEFECT_TEXT) + """),
n AS (SELECT name, count(DISTINCT level) AS d, count(*) - count(level) AS blank FROM v GROUP BY name),
k AS (SELECT DISTINCT name, level, blank > 0 AS missing_level FROM v JOIN n USING (name) WHERE level IS NOT NULL AND d BETWEEN 1 AND 50)
SELECT *, CAST(row_number() OVER (PARTITION BY name ORDER BY level) - 1 AS INTEGER) AS position FROM k""")
def fit_levels(spark, folder):
    rows = defects(spark, folder).select(*DEFECT_TEXT)
    levels = E.text_levels(rows, DEFECT_TEXT).groupBy("name").agg(F.array_sort(F.collect_list("value")).alias("levels"))
    blanks = missing_rates(rows, DEFECT_TEXT).select("name", (F.col("n_missing") > 0).alias("missing_level"))
    return levels.join(blanks, "name").select("name", "missing_level", F.posexplode("levels").alias("position", "level"))


ENCODED = ["click", "error", "purchase", "signup", "view"]


@query("e4_apply_encoding", f"""WITH base AS ({DEFECTS_SQL})
SELECT event_id, amount, CAST(weekday AS DOUBLE) AS weekday, CASE WHEN flag THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS flag,
       CASE WHEN kind_text IS NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS kind_missing,
       CASE WHEN kind_text = ' Unknown' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS kind_unknown,
       CAST((SELECT count(DISTINCT kind_text) FROM base) AS INTEGER) + 1 AS n_level_columns,
       CASE WHEN kind_text IS NOT NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS level_sum FROM base""")
def apply_encoding(spark, folder):
    rows = defects(spark, folder).select("event_id", "amount", "weekday", "flag", "kind_text")
    layout = E.fit_encoding(rows, ["amount", "weekday", "flag", "kind_text"])
    out = E.apply_encoding(rows, layout, keep=["event_id"])
    levels = [c for c in out.columns if c.startswith("kind_text=")]
    present = sum((F.col(f"`{c}`") for c in levels if not c.endswith(fixed.MISSING_LEVEL)), F.lit(0.0))
    return out.select(
        "event_id", "amount", "weekday", "flag", F.col(f"`kind_text={fixed.MISSING_LEVEL}`").alias("kind_missing"),
        F.col("`kind_text= Unknown`").alias("kind_unknown"), F.lit(len(levels)).alias("n_level_columns"), present.alias("level_sum"))


@query("e5_encoding_report", f"""WITH base AS ({DEFECTS_SQL}), d AS (SELECT count(DISTINCT kind_text) AS k, count(DISTINCT user_text) AS u,
  count(DISTINCT event_type) AS e, count(*) - count(kind_text) AS kb, count(*) - count(user_text) AS ub FROM base)
SELECT 4 AS "numeric", CAST(CASE WHEN k <= 50 THEN 1 ELSE 0 END + CASE WHEN u <= 50 THEN 1 ELSE 0 END + 1 AS INTEGER) AS one_hot_columns,
 CAST(CASE WHEN k <= 50 THEN k + CASE WHEN kb > 0 THEN 1 ELSE 0 END ELSE 0 END + CASE WHEN u <= 50 THEN u + CASE WHEN ub > 0 THEN 1 ELSE 0 END ELSE 0 END + e AS INTEGER) AS one_hot_levels,
 CASE WHEN u > 50 THEN 'user_text' ELSE '' END AS too_wide, 'ts' AS unsupported FROM d""")
def encoding_report(spark, folder):
    rows = defects(spark, folder).drop("event_id", "user_id")
    report = E.fit_encoding(rows).report()
    # The report is counts and names; one row derived from the whole table's levels.
    return rows.groupBy().agg(
        F.lit(report["numeric"]).alias("numeric"), F.lit(report["one_hot_columns"]).alias("one_hot_columns"),
        F.lit(report["one_hot_levels"]).alias("one_hot_levels"),
        F.lit(",".join(report["dropped_high_cardinality"])).alias("too_wide"),
        F.lit(",".join(report["dropped_unsupported_dtype"])).alias("unsupported"))


@query("e6_levels_as_text", """
SELECT l_linenumber = 3 AS same, CAST(count(*) AS BIGINT) AS n, CAST(sum(CASE WHEN l_linenumber = 3 THEN 1 ELSE 0 END) AS DOUBLE) AS hits FROM lineitem GROUP BY 1""")
def levels_as_text(spark, folder):
    fitted = table(spark, folder, "lineitem").select(F.col("l_linenumber").cast("string").alias("line"))
    layout = E.fit_encoding(fitted)
    batch = table(spark, folder, "lineitem").select(F.col("l_linenumber").alias("line"))
    out = E.apply_encoding(batch, layout, keep=["line"])
    return out.groupBy((F.col("line") == 3).alias("same")).agg(F.count(F.lit(1)).alias("n"), F.sum("`line=3`").alias("hits"))


@query("e7_missing_indicator", f"WITH base AS ({DEFECTS_SQL}) SELECT event_id, amount, CASE WHEN amount IS NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS amount__missing FROM base")
def missing_indicator(spark, folder):
    rows = defects(spark, folder).select("event_id", "amount")
    return R.Fitted("missing_indicator", "missing_indicator", ["amount"]).apply(rows)


@query("e8_missing_count", f"""WITH base AS ({DEFECTS_SQL}) SELECT event_id, CAST((amount IS NULL)::INT + (kind_text IS NULL)::INT + (user_text IS NULL)::INT AS DOUBLE) AS missing_count FROM base""")
def missing_count(spark, folder):
    rows = defects(spark, folder).select("event_id", "amount", "kind_text", "user_text")
    step = R.Fitted("missing_count", "missing_count", ["amount", "kind_text", "user_text"])
    return step.apply(rows).select("event_id", "missing_count")


# --- steps ------------------------------------------------------------------------

# Train rows of the events: ids not divisible by five.
TRAIN = "event_id % 5 <> 0"
STEP_SQL = f"WITH base AS ({DEFECTS_SQL}), train AS (SELECT * FROM base WHERE {TRAIN}) "


def _numbers(spark, folder):
    return defects(spark, folder).select(
        "event_id", "amount", F.col("weekday").cast("double").alias("weekday"),
        F.when(F.col("event_id") % 11 == 0, F.lit(None)).otherwise((F.col("user_id") % 13).cast("double")).alias("bin"),
        F.lit(None).cast("double").alias("empty"))


BIN = "CASE WHEN event_id % 11 = 0 THEN NULL ELSE CAST(user_id % 13 AS DOUBLE) END"


@query("r1_column_selection", f"WITH base AS ({DEFECTS_SQL}) SELECT event_id, " + ", ".join(
    f"CASE WHEN kind_text = '{level}' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS \"kind_text={level}\"" for level in (" Unknown", *ENCODED))
    + ", CASE WHEN kind_text IS NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS \"kind_text=<missing>\", 'nothing' AS unknown FROM base")
def column_selection(spark, folder):
    rows = defects(spark, folder).select("event_id", "amount", "kind_text")
    layout = E.fit_encoding(rows, ["amount", "kind_text"])
    encoded = E.apply_encoding(rows, layout, keep=["event_id"])
    chosen, unknown = R.select_columns(layout.columns, ["kind_text", "nothing"])
    return encoded.select("event_id", *[F.col(f"`{c}`") for c in chosen], F.lit(",".join(unknown)).alias("unknown"))


FILLS = {"median": "quantile_cont(x, 0.5)", "mean": "avg(x)"}


@query("r2_impute", STEP_SQL + f""", m AS (SELECT quantile_cont(amount, 0.5) AS med, avg(amount) AS mean FROM train),
f AS (SELECT {BIN} AS v, count(*) AS n FROM train WHERE {BIN} IS NOT NULL GROUP BY 1),
b AS (SELECT v FROM f ORDER BY n DESC, v LIMIT 1)
SELECT event_id, coalesce(amount, med) AS by_median, round(coalesce(amount, mean), 6) AS by_mean, coalesce(amount, -1.0) AS by_constant,
       coalesce({BIN}, b.v) AS by_most_frequent FROM base, m, b""")
def impute(spark, folder):
    rows = _numbers(spark, folder)
    train = rows.where(TRAIN)
    median = R.fill_values(train, ["amount"], "median")["amount"]
    mean = R.fill_values(train, ["amount"], "mean")["amount"]
    mode = R.fill_values(train, ["bin"], "most_frequent")["bin"]
    return rows.select(
        "event_id", F.coalesce("amount", F.lit(median)).alias("by_median"),
        F.round(F.coalesce("amount", F.lit(mean)), 6).alias("by_mean"),
        F.coalesce("amount", F.lit(-1.0)).alias("by_constant"), F.coalesce("bin", F.lit(mode)).alias("by_most_frequent"))


@query("r2_impute_groups", STEP_SQL + f""", m AS (SELECT quantile_cont(weekday, 0.5) AS med, quantile_cont({BIN}, 0.5) AS bmed FROM train)
SELECT event_id, coalesce(amount, -5.0) AS amount, CAST(weekday AS DOUBLE) AS weekday, coalesce({BIN}, bmed) AS bin FROM base, m""")
def impute_groups(spark, folder):
    rows = _numbers(spark, folder).drop("empty")
    fitted = R.fit_steps(rows.where(TRAIN), [{"step": "impute", "strategy": "median", "groups": [
        {"columns": ["amount"], "strategy": "constant", "fill_value": -5.0}, {"columns": ["amount", "bin"], "strategy": "median"}]}],
        ["amount", "weekday", "bin"])
    return fitted.apply(rows)


@query("r3_empty_column", STEP_SQL + ", m AS (SELECT quantile_cont(amount, 0.5) AS med FROM train) SELECT event_id, coalesce(amount, med) AS amount, 'empty' AS dropped FROM base, m")
def empty_column(spark, folder):
    rows = _numbers(spark, folder).select("event_id", "amount", "empty")
    fitted = R.fit_steps(rows.where(TRAIN), [{"step": "impute"}], ["amount", "empty"])
    dropped = ",".join(c for s in fitted.steps for c in s.drop)
    return fitted.apply(rows).withColumn("dropped", F.lit(dropped))


@query("r4_keep_missing", STEP_SQL + ", m AS (SELECT min(amount) AS lo FROM train) SELECT event_id, coalesce(amount, lo - 1.0) AS amount, CASE WHEN amount IS NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS amount__missing FROM base, m")
def keep_missing(spark, folder):
    rows = _numbers(spark, folder).select("event_id", "amount")
    fitted = R.fit_steps(rows.where(TRAIN), [{"step": "impute", "strategy": "none"}], ["amount"], native_missing=True)
    return fitted.apply(rows)


@query("r5_standard_scale", STEP_SQL + ", m AS (SELECT avg(weekday) AS w, stddev_pop(weekday) AS ws FROM train) SELECT event_id, round((weekday - w) / ws, 6) AS weekday, CAST(0.0 AS DOUBLE) AS fixed_value FROM base, m")
def standard_scale(spark, folder):
    rows = defects(spark, folder).select("event_id", F.col("weekday").cast("double").alias("weekday"), F.col("fixed_value").cast("double").alias("fixed_value"))
    fitted = R.fit_steps(rows.where(TRAIN), [{"step": "impute"}, {"step": "scale"}], ["weekday", "fixed_value"])
    return fitted.apply(rows).select("event_id", F.round("weekday", 6).alias("weekday"), "fixed_value")


@query("r6_interactions", STEP_SQL + f""", m AS (SELECT quantile_cont(amount, 0.5) AS a, quantile_cont({BIN}, 0.5) AS b FROM train),
x AS (SELECT event_id, coalesce(amount, a) AS amount, CAST(weekday AS DOUBLE) AS weekday, coalesce({BIN}, b) AS bin FROM base, m)
SELECT *, amount * weekday AS "amount weekday", amount * bin AS "amount bin", weekday * bin AS "weekday bin" FROM x""")
def interactions(spark, folder):
    rows = _numbers(spark, folder).drop("empty")
    fitted = R.fit_steps(rows.where(TRAIN), [{"step": "impute"}, {"step": "interactions"}], ["amount", "weekday", "bin"])
    return fitted.apply(rows)


# Scaling twice changes nothing more: the second pass meets mean 0 and deviation 1.
@query("r7_ordered_steps", STEP_SQL + """SELECT 'missing_indicator(amount); impute(median); scale(weekday); interactions(weekday, bin); scale(all)' AS applied,
 'unknown step ''shuffle'', dropped; impute: no present value in [''empty''], dropped' AS log, count(*) AS rows, round(avg((weekday - m) / s), 4) AS weekday_mean
FROM base, (SELECT avg(weekday) AS m, stddev_pop(weekday) AS s FROM train)""")
def ordered_steps(spark, folder):
    rows = _numbers(spark, folder)
    spec = [{"step": "missing_indicator", "columns": ["amount"]}, {"step": "shuffle"}, {"step": "impute"},
            {"step": "scale", "columns": ["weekday"]}, {"step": "interactions", "columns": ["weekday", "bin"]}, {"step": "scale"}]
    fitted = R.fit_steps(rows.where(TRAIN), spec, ["amount", "weekday", "bin", "empty"])
    out = fitted.apply(rows)
    return out.groupBy(F.lit("; ".join(fitted.applied)).alias("applied"), F.lit("; ".join(fitted.log)).alias("log")).agg(
        F.count(F.lit(1)).alias("rows"), F.round(F.avg("weekday"), 4).alias("weekday_mean"))


@query("r8_auto_steps", STEP_SQL + """, m AS (SELECT quantile_cont(amount, 0.5) AS med FROM train),
x AS (SELECT event_id, coalesce(amount, med) AS v, CASE WHEN amount IS NULL THEN 1.0 ELSE 0.0 END AS mi FROM base, m),
s AS (SELECT avg(v) AS mv, stddev_pop(v) AS sv, avg(mi) AS mm, stddev_pop(mi) AS sm FROM x WHERE """ + TRAIN + """)
SELECT event_id, round((v - mv) / sv, 6) AS amount, round((mi - mm) / sm, 6) AS amount__missing, 'missing_indicator(all); impute(auto); scale(auto)' AS applied FROM x, s""")
def auto_steps(spark, folder):
    rows = _numbers(spark, folder).select("event_id", "amount")
    fitted = R.fit_steps(rows.where(TRAIN), [{"step": "missing_indicator"}], ["amount"], scale_sensitive=True)
    return fitted.apply(rows).select(
        "event_id", F.round("amount", 6).alias("amount"), F.round("amount__missing", 6).alias("amount__missing"),
        F.lit("; ".join(fitted.applied)).alias("applied"))


@query("r9_flag_aliases", STEP_SQL + """, m AS (SELECT avg(amount) AS mean FROM train)
SELECT event_id, round(coalesce(amount, mean), 6) AS amount, CASE WHEN amount IS NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS amount__missing, CASE WHEN amount IS NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS missing_count FROM base, m""")
def flag_aliases(spark, folder):
    rows = _numbers(spark, folder).select("event_id", "amount")
    spec = R.flag_steps({"add_indicator": True, "n_missing": True, "impute": "mean", "scale": False}, "logreg")
    fitted = R.fit_steps(rows.where(TRAIN), spec, ["amount"])
    return fitted.apply(rows).select("event_id", F.round("amount", 6).alias("amount"), "amount__missing", "missing_count")


# --- splits -----------------------------------------------------------------------

# Plain full ranking per class; the Spark side ranks only the boundary buckets.
SPLIT_SQL = """
n AS (SELECT count(*) AS n, CAST(ceil(0.2 * count(*)) AS BIGINT) AS t, CAST(ceil(0.25 * (count(*) - ceil(0.2 * count(*)))) AS BIGINT) AS v FROM rows_),
c0 AS (SELECT stratum, count(*) AS k FROM rows_ GROUP BY stratum),
x0 AS (SELECT stratum, k, k * t / CAST(n AS DOUBLE) AS x FROM c0, n),
q0 AS (SELECT stratum, k, CAST(floor(x) AS BIGINT) + CASE WHEN row_number() OVER (ORDER BY round(x - floor(x), 9) DESC, stratum) <= (SELECT t FROM n) - sum(CAST(floor(x) AS BIGINT)) OVER () THEN 1 ELSE 0 END AS q0 FROM x0),
x1 AS (SELECT stratum, k, q0, (k - q0) * v / CAST(n - t AS DOUBLE) AS x FROM q0, n),
q1 AS (SELECT stratum, q0, CAST(floor(x) AS BIGINT) + CASE WHEN row_number() OVER (ORDER BY round(x - floor(x), 9) DESC, stratum) <= (SELECT v FROM n) - sum(CAST(floor(x) AS BIGINT)) OVER () THEN 1 ELSE 0 END AS q1 FROM x1),
ranked AS (SELECT key, rows_.stratum, q0, q1, row_number() OVER (PARTITION BY rows_.stratum ORDER BY md5('42|' || key), key) AS r FROM rows_ JOIN q1 USING (stratum)),
split_ AS (SELECT key, stratum, CASE WHEN r <= q0 THEN 'test' WHEN r <= q0 + q1 THEN 'val' ELSE 'train' END AS split FROM ranked)
"""
ORDER_ROWS = "WITH rows_ AS (SELECT CAST(o_orderkey AS VARCHAR) AS key, o_orderstatus AS stratum FROM orders), "


def order_split(spark, folder):
    rows = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return L.assign_splits(rows, ["o_orderkey"], label="o_orderstatus")


@query("l1_stratified_split", ORDER_ROWS + SPLIT_SQL + "SELECT CAST(key AS BIGINT) AS o_orderkey, split FROM split_")
def stratified_split(spark, folder):
    return order_split(spark, folder).select("o_orderkey", "split")


@query("l1_plain_split", "WITH rows_ AS (SELECT CAST(event_id AS VARCHAR) AS key, 'all' AS stratum FROM events), " + SPLIT_SQL + "SELECT CAST(key AS BIGINT) AS event_id, split FROM split_")
def plain_split(spark, folder):
    return L.assign_splits(table(spark, folder, "events").select("event_id"), ["event_id"])


GROUP_SPLIT_SQL = """
WITH c AS (SELECT CAST(o_custkey AS VARCHAR) AS g, o_orderstatus AS s, count(*) AS n FROM orders GROUP BY ALL),
m AS (SELECT *, sum(n) OVER (PARTITION BY g) AS weight, row_number() OVER (PARTITION BY g ORDER BY n DESC, s) AS r FROM c),
t AS (SELECT g, weight, s AS stratum FROM m WHERE r = 1),
q AS (SELECT stratum, sum(weight) * 0.2 AS q0, (sum(weight) - sum(weight) * 0.2) * 0.25 AS q1 FROM t GROUP BY stratum),
o AS (SELECT g, weight, q0, q1, sum(weight) OVER (PARTITION BY stratum ORDER BY md5('42|' || g), g) - weight / 2.0 AS middle
      FROM t JOIN q USING (stratum) WHERE weight <= q0),
p AS (SELECT g, CASE WHEN middle < q0 THEN 'test' WHEN middle < q0 + q1 THEN 'val' ELSE 'train' END AS split FROM o
      UNION ALL SELECT g, 'train' FROM t JOIN q USING (stratum) WHERE weight > q0)
SELECT o_orderkey, o_custkey, split FROM orders JOIN p ON CAST(o_custkey AS VARCHAR) = g"""


@query("l2_grouped_split", GROUP_SPLIT_SQL)
def grouped_split(spark, folder):
    rows = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return L.assign_splits(rows, ["o_orderkey"], label="o_orderstatus", group="o_custkey").select("o_orderkey", "o_custkey", "split")


@query("l3_held_back", ORDER_ROWS + SPLIT_SQL + """, t AS (SELECT key, stratum, row_number() OVER (PARTITION BY stratum ORDER BY md5('42|cut|' || key), key) AS r FROM split_ WHERE split = 'train'),
c AS (SELECT stratum, count(*) AS n, sum(count(*)) OVER () AS total FROM t GROUP BY stratum), x AS (SELECT stratum, ceil(0.2 * total) AS q, n * ceil(0.2 * total) / total AS e FROM c),
f AS (SELECT stratum, floor(e) AS whole, q - sum(floor(e)) OVER () AS spare, row_number() OVER (ORDER BY round(e - floor(e), 9) DESC, stratum) AS k FROM x)
SELECT CAST(key AS BIGINT) AS o_orderkey, r <= whole + CASE WHEN k <= spare THEN 1 ELSE 0 END AS held FROM t JOIN f USING (stratum)""")
def held_back(spark, folder):
    return L.hold_back(order_split(spark, folder), ["o_orderkey"], fixed.CUT_FRACTION, "cut", label="o_orderstatus").select("o_orderkey", "held")


@query("l4_train_subsample", ORDER_ROWS + SPLIT_SQL + """, t AS (SELECT key, row_number() OVER (ORDER BY md5('42|subsample|' || key), key) AS r, count(*) OVER () AS n FROM split_ WHERE split = 'train')
SELECT CAST(key AS BIGINT) AS o_orderkey FROM t WHERE r <= greatest(50, CAST(floor(n * 0.3) AS BIGINT))""")
def subsample(spark, folder):
    return L.train_subsample(order_split(spark, folder), ["o_orderkey"], 0.3).select("o_orderkey")


@query("l5_fingerprint", ORDER_ROWS + SPLIT_SQL + """SELECT split, count(*) AS rows, CAST(sum(CAST('0x' || substr(md5('rows|' || key || '|' || stratum), 1, 8) AS BIGINT)) AS BIGINT) AS digest
FROM split_ GROUP BY split""")
def fingerprint(spark, folder):
    return L.fingerprint(order_split(spark, folder), ["o_orderkey"], "o_orderstatus", ["split"]).drop("xor")


# Declared protocols derived from the rows: each customer's seed and grouping.
@query("l6_protocol_check", """
SELECT c_custkey, concat_ws(',', CASE WHEN c_nationkey % 3 = 1 THEN 'test_fraction' END,
  CASE WHEN c_custkey % 5 <> 0 AND 40 + c_custkey % 4 <> 42 THEN 'seed' END, CASE WHEN c_mktsegment = 'BUILDING' THEN 'grouped_by' END) AS differs FROM customer""")
def protocol_check(spark, folder):
    own = {k: F.lit(v) for k, v in L.protocol(42, None, True).items()}
    declared = {
        "test_fraction": F.when(F.col("c_nationkey") % 3 == 1, F.lit(0.3)).otherwise(F.lit(0.2)),
        "seed": F.when(F.col("c_custkey") % 5 != 0, (40 + F.col("c_custkey") % 4).cast("int")),
        "grouped_by": F.when(F.col("c_mktsegment") == "BUILDING", F.lit("c_custkey")),
    }
    return table(spark, folder, "customer").select("c_custkey", F.concat_ws(",", L.protocol_differences(declared, own)).alias("differs"))
