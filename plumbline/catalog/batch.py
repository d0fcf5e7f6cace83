"""Named queries: scalar rules, sources and sinks, drift, text, neighbours."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from plumbline import fixed
from plumbline.catalog import query
from plumbline.catalog.base import DEFECTS_SQL, DOCS_SQL, LINES_SQL, defects, list_sql, scored_docs, scored_lines, union_sql
from plumbline.catalog.prepare import SPLIT_SQL
from plumbline.catalog.profile import sentinel_sql
from plumbline.functions import columns as X
from plumbline.functions import text as S
from plumbline.operators import drift as R
from plumbline.operators import encoding as E
from plumbline.operators import neighbors as N
from plumbline.operators import splits as L
from plumbline.operators.keys import column_kinds, rows_from, text_literal
from plumbline.session import shared_folder, stage, table
from plumbline.sources import readers, runs, sinks

# --- scalar rules -----------------------------------------------------------------

KINDS = {"event_id": "numeric", "user_id": "numeric", "event_type": "text", "ts": "unsupported", "amount": "numeric",
         "kind_text": "text", "user_text": "text", "flag": "boolean", "weekday": "numeric", "fixed_value": "numeric"}


@query("p1_column_kinds", f"WITH base AS ({DEFECTS_SQL}) " + union_sql(f"SELECT '{c}' AS name, '{k}' AS kind, count({c}) AS present FROM base" for c, k in KINDS.items()))
def column_kinds_query(spark, folder):
    rows = defects(spark, folder)
    kinds = column_kinds(rows)
    counts = rows.agg(*[F.count(c).alias(c) for c in rows.columns])
    return counts.select(rows_from([f"struct({text_literal(c)} AS name, {text_literal(k)} AS kind, {c} AS present)" for c, k in kinds.items()]))


@query("p2_feature_columns", f"WITH base AS ({DEFECTS_SQL}) SELECT event_type, ts, amount, kind_text, user_text, weekday FROM base")
def feature_columns(spark, folder):
    return defects(spark, folder).drop("flag", "user_id", "event_id", "fixed_value").select(
        "event_type", "ts", "amount", "kind_text", "user_text", "weekday")


@query("p4_numeric_coercion", f"WITH base AS ({DEFECTS_SQL}) SELECT event_id, TRY_CAST(user_text AS DOUBLE) AS value, user_text IS NOT NULL AND TRY_CAST(user_text AS DOUBLE) IS NULL AS failed FROM base")
def numeric_coercion(spark, folder):
    c = F.col("user_text")
    return defects(spark, folder).select("event_id", X.to_number(c).alias("value"), X.coercion_failed(c).alias("failed"))


@query("p5_bucket", "SELECT event_id, CASE WHEN value <= 1 THEN 'sub_unit' WHEN value <= 10 THEN 'unit' WHEN value <= 100 THEN 'tens' WHEN value <= 1000 THEN 'hundreds' ELSE 'thousands+' END AS bucket FROM events")
def bucket(spark, folder):
    return table(spark, folder, "events").select("event_id", X.bucket(F.col("value"), fixed.MAGNITUDE_EDGES, fixed.MAGNITUDE_LAST).alias("bucket"))


@query("p6_label_at_cut", f"WITH base AS ({LINES_SQL}) SELECT y, CASE WHEN proba >= 0.3 THEN 1 ELSE 0 END AS pred, count(*) AS n FROM base GROUP BY ALL")
def label_at_cut(spark, folder):
    rows = scored_lines(spark, folder)
    return rows.groupBy("y", X.label_at_cut(F.col("proba"), 0.3).alias("pred")).agg(F.count(F.lit(1)).alias("n"))


@query("p7_marker_form", f"WITH base AS ({DEFECTS_SQL}) SELECT event_id, lower(regexp_replace(kind_text, '^\\s+|\\s+$', '', 'g')) AS form, lower(regexp_replace(kind_text, '^\\s+|\\s+$', '', 'g')) IN {list_sql(fixed.TEXT_MARKERS)} AS marker FROM base")
def marker_form(spark, folder):
    form = X.marker_form(F.col("kind_text"))
    return defects(spark, folder).select("event_id", form.alias("form"), form.isin(*fixed.TEXT_MARKERS).alias("marker"))


@query("p8_group_id", f"WITH base AS ({DEFECTS_SQL}) SELECT coalesce(user_text, '<missing>') AS g, count(*) AS n FROM base GROUP BY 1")
def group_id(spark, folder):
    return defects(spark, folder).groupBy(X.group_id(F.col("user_text")).alias("g")).agg(F.count(F.lit(1)).alias("n"))


# A metric map per supplier, with a zero denominator for some.
@query("p10_finite_metrics", """
WITH m AS (SELECT l_suppkey, avg(l_quantity) AS a, CASE WHEN l_suppkey % 4 = 0 THEN NULL ELSE sum(l_tax) / (l_suppkey % 4) END AS b, l_suppkey % 3 = 0 AS bad FROM lineitem GROUP BY l_suppkey)
SELECT l_suppkey, concat_ws(',', 'a', CASE WHEN b IS NOT NULL THEN 'b' END, CASE WHEN NOT bad THEN 'c' END) AS kept, concat_ws(',', CASE WHEN b IS NULL THEN 'b' END, CASE WHEN bad THEN 'c' END) AS dropped FROM m""")
def finite_metrics(spark, folder):
    m = table(spark, folder, "lineitem").groupBy("l_suppkey").agg(F.expr(
        "map('a', avg(l_quantity), 'b', IF(l_suppkey % 4 = 0, double('NaN'), sum(l_tax) / (l_suppkey % 4)), 'c', IF(l_suppkey % 3 = 0, double('Infinity'), 1D)) AS m"))
    kept = X.finite_entries(F.col("m"))
    return m.select("l_suppkey", F.concat_ws(",", F.array_sort(F.map_keys(kept))).alias("kept"), F.concat_ws(",", X.dropped_keys(F.col("m"), kept)).alias("dropped"))


@query("p11_allow_list", """SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'key,score' ELSE 'key' END AS kept, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN c_mktsegment ELSE '' END AS words FROM customer""")
def allow_list(spark, folder):
    rows = table(spark, folder, "customer").select("c_custkey", F.expr(
        "map('key', CAST(c_custkey AS STRING), 'score', IF(c_custkey % 3 = 0, '0.5', 'secret'), 'name', c_name) AS m"), F.array("c_mktsegment", "c_name").alias("w"))
    return rows.select("c_custkey", F.concat_ws(",", F.array_sort(F.map_keys(X.numeric_entries(F.col("m"))))).alias("kept"),
                       F.concat_ws(",", X.allowed_words(F.col("w"), ["BUILDING", "MACHINERY"])).alias("words"))


@query("p12_clamp_params", """
WITH r AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'max_depth' WHEN 1 THEN 'learning_rate' WHEN 2 THEN 'n_neighbors' ELSE 'other' END AS param, (p_size - 20) * (p_retailprice / 10.0::DOUBLE) AS value FROM part)
SELECT p_partkey, param, round(CASE param WHEN 'max_depth' THEN least(greatest(value, 1), 64) WHEN 'learning_rate' THEN least(greatest(value, 0.0001), 1) WHEN 'n_neighbors' THEN least(greatest(value, 1), 200) ELSE value END, 6) AS clamped FROM r""")
def clamp_params(spark, folder):
    rows = table(spark, folder, "part").selectExpr(
        "p_partkey", "CASE p_partkey % 4 WHEN 0 THEN 'max_depth' WHEN 1 THEN 'learning_rate' WHEN 2 THEN 'n_neighbors' ELSE 'other' END AS param",
        "(p_size - 20) * (p_retailprice / 10.0D) AS value")
    return rows.select("p_partkey", "param", F.round(X.clamp_param(F.col("param"), F.col("value")), 6).alias("clamped"))


# Proposed class weights per customer: valid, a missing class, a negative weight, or out of range.
@query("p13_class_weights", """
SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN '0=1.0,1=' || CAST(1.0 + c_nationkey AS VARCHAR) WHEN 3 THEN '0=0.001,1=1000.0' END AS weights FROM customer""")
def class_weights(spark, folder):
    m = F.expr("""CASE c_custkey % 4 WHEN 0 THEN map(0, 1D, 1, 1D + c_nationkey) WHEN 1 THEN map(0, 1D) WHEN 2 THEN map(0, 1D, 1, -2D) ELSE map(0, 1e-9D, 1, 1e9D) END""")
    checked = X.checked_weights(m, F.array(F.lit(0), F.lit(1)))
    text = F.expr("array_join(transform(array_sort(map_entries(w)), e -> concat(e.key, '=', e.value)), ',')")
    return table(spark, folder, "customer").select("c_custkey", checked.alias("w")).select("c_custkey", text.alias("weights"))


@query("p14_metric_names", """
WITH r AS (SELECT s_suppkey, CASE s_suppkey % 6 WHEN 0 THEN 'average_precision' WHEN 1 THEN 'mean_absolute_error' WHEN 2 THEN 'f1' WHEN 3 THEN 'r2_score' WHEN 4 THEN 'rmse' ELSE 'own' END AS asked, CASE WHEN s_nationkey % 2 = 0 THEN 'regression' ELSE 'classification' END AS task FROM supplier),
c AS (SELECT *, CASE asked WHEN 'average_precision' THEN 'pr_auc' WHEN 'mean_absolute_error' THEN 'mae' WHEN 'r2_score' THEN 'r2' ELSE asked END AS canonical FROM r)
SELECT s_suppkey, asked, canonical, CASE WHEN canonical = 'own' THEN asked WHEN (canonical IN ('pr_auc', 'f1')) = (task = 'classification') THEN asked WHEN task = 'regression' THEN 'r2' ELSE 'f1' END AS used,
 CASE WHEN canonical IN ('mae', 'rmse') THEN 'minimize' ELSE 'maximize' END AS direction FROM c""")
def metric_names(spark, folder):
    rows = table(spark, folder, "supplier").selectExpr(
        "s_suppkey", "CASE s_suppkey % 6 WHEN 0 THEN 'average_precision' WHEN 1 THEN 'mean_absolute_error' WHEN 2 THEN 'f1' WHEN 3 THEN 'r2_score' WHEN 4 THEN 'rmse' ELSE 'own' END AS asked",
        "CASE WHEN s_nationkey % 2 = 0 THEN 'regression' ELSE 'classification' END AS task")
    asked = F.col("asked")
    return rows.select("s_suppkey", "asked", X.canonical_metric(asked).alias("canonical"), X.metric_for_task(asked, F.col("task")).alias("used"), X.metric_direction(asked).alias("direction"))


# --- sources and sinks ------------------------------------------------------------

@query("s1_csv_scan", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders WHERE o_totalprice > 1000")
def csv_scan(spark, folder):
    path = f"{shared_folder(spark)}/csv-{uuid.uuid4().hex}"
    rows = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    rows.write.mode("overwrite").option("header", True).csv(path)
    return readers.read_csv(spark, path, "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, o_orderpriority STRING").where("o_totalprice > 1000")


@query("s4_parquet_scan", "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_discount >= 0.05")
def parquet_scan(spark, folder):
    return readers.read_table(spark, f"{folder}/lineitem.parquet").where("l_discount >= 0.05").select("l_orderkey", "l_quantity")


@query("s6_predictions", "WITH base AS (SELECT doc_id, round(1.0 / (1.0 + exp(-(n_chars - 600) / 400.0)), 6) AS proba FROM documents) SELECT doc_id, CASE WHEN proba >= 0.5 THEN 1 ELSE 0 END AS prediction, round(1 - proba, 6) AS \"proba_0\", proba AS \"proba_1\" FROM base")
def predictions(spark, folder):
    scored = table(spark, folder, "documents").withColumn("proba", F.round(1.0 / (1.0 + F.exp(-(F.col("n_chars") - 600) / 400.0)), 6))
    rows = scored.select("*", (F.col("proba") >= 0.5).cast("int").alias("prediction"), F.round(1 - F.col("proba"), 6).alias("proba_0"), F.col("proba").alias("proba_1"))
    path = f"{shared_folder(spark)}/predictions-{uuid.uuid4().hex}"
    sinks.write_predictions(rows, path, "doc_id", ["0", "1"])
    return spark.read.parquet(path)


def _nested(spark, folder):
    """Run histories as rows: one run per order, built from the derived trials."""
    from plumbline.catalog.trials import trials
    from plumbline.operators.trials import diagnose

    t = diagnose(trials(spark, folder))
    return t.groupBy("run").agg(
        F.expr("struct(any_value(metric) AS metric) AS goal"), F.expr("CAST(count(1) AS INT) AS iterations"),
        F.expr("IF(count(1) >= 5, 'max_iterations', 'stalled') AS stop_reason"),
        F.expr("struct(any_value(run) % 2 = 0 AS dry_run, any_value(run) % 3 = 0 AS no_planner, 7 AS max_iterations) AS config"),
        F.expr("struct(max_by(iteration, score) AS iteration, max(score) AS score) AS best"),
        F.expr("struct(IF(any_value(run) % 5 = 0, 'error', 'ok') AS status, map(any_value(metric), min(score)) AS metrics) AS holdout"),
        F.expr("collect_list(struct(iteration, model, params AS hyperparams, status, error_type, map(metric, score, 'roc_auc', roc_auc) AS metrics, failure_type)) AS history"),
        F.expr("1700000000000 + any_value(run) AS modified")).withColumn("run", F.col("run").cast("string"))


def _histories(spark, folder):
    """The run histories as compressed JSON lines: field names and metrics recur in every attempt. A file holds one task's runs."""
    path = f"{shared_folder(spark)}/histories-{uuid.uuid4().hex}"
    _nested(spark, folder).write.mode("overwrite").option("compression", "gzip").json(path)
    return runs.read_histories(spark, path)


def _trials_sql():
    from plumbline.catalog.trials import DIAG, W

    return f"{W}, {DIAG}"


@query("s8_run_registry", _trials_sql() + """ SELECT CAST(run AS VARCHAR) AS run, CASE WHEN run % 2 = 0 THEN 'dry-run' WHEN run % 3 = 0 THEN 'rules' ELSE 'planner' END AS mode, any_value(metric) AS metric, round(max(score), 4) AS best_val,
 CASE WHEN run % 5 <> 0 THEN round(min(score), 4) END AS test, count(*) || '/7' AS iterations, CASE WHEN count(*) >= 5 THEN 'max_iterations' ELSE 'stalled' END AS stop_reason, 1700000000000 + run AS modified FROM df GROUP BY run""")
def run_registry(spark, folder):
    return runs.newest_first(runs.registry(_histories(spark, folder)))


@query("s9_attempts", _trials_sql() + " SELECT CAST(run AS VARCHAR) AS run, metric, iteration, model, status, error_type, failure_type, score, 'depth=' || depth || ',weight=' || CAST(weight * 10 AS INTEGER) AS hyperparams FROM df")
def attempts(spark, folder):
    text = F.expr("array_join(transform(array_sort(map_entries(hyperparams)), e -> concat(e.key, '=', e.value)), ',')")
    return runs.attempts(_histories(spark, folder)).withColumn("hyperparams", text)


# --- drift ------------------------------------------------------------------------

# Fit on the first half of January; the second half has more nulls, an unseen level and an extra column.
HALF = "ts < TIMESTAMP '2024-01-16 00:00:00'"
FIT_SQL = f"SELECT amount, weekday, kind_text, user_text FROM ({DEFECTS_SQL}) WHERE {HALF}"
BATCH_SQL = f"""SELECT CASE WHEN event_id % 9 = 0 THEN NULL ELSE amount END AS amount, weekday, CASE WHEN event_id % 8 = 0 THEN 'refund' ELSE kind_text END AS kind_text, user_text, event_id AS extra FROM ({DEFECTS_SQL}) WHERE NOT ({HALF})"""
BATCH_CODES = f"SELECT CASE WHEN amount = -9999 THEN NULL WHEN extra % 30 = 0 THEN -99999 ELSE amount END AS amount FROM ({BATCH_SQL})"


def fit_half(spark, folder):
    return defects(spark, folder).where(HALF).select("amount", "weekday", "kind_text", "user_text")


def batch_half(spark, folder):
    e = F.col("event_id")
    return defects(spark, folder).where(f"NOT ({HALF})").select(
        F.when(e % 9 == 0, F.lit(None)).otherwise(F.col("amount")).alias("amount"), "weekday",
        F.when(e % 8 == 0, "refund").otherwise(F.col("kind_text")).alias("kind_text"), "user_text", e.alias("extra"))


def fitted_layout(spark, folder):
    rows = fit_half(spark, folder)
    return R.record_stats(rows, E.fit_encoding(rows, ["amount", "weekday", "kind_text", "user_text"]))


@query("x1_rate_shift", """
WITH r AS (SELECT event_type, user_id % 10 AS part, count(*) AS n, avg(CASE WHEN value > 30 THEN 1.0::DOUBLE ELSE 0.0 END) AS now FROM events GROUP BY ALL), f AS (SELECT event_type, avg(CASE WHEN value > 30 THEN 1.0::DOUBLE ELSE 0.0 END) AS fit FROM events GROUP BY ALL)
SELECT event_type, part, abs(now - fit) >= 0.05 AND abs(now - fit) >= 2 * sqrt(greatest(now, fit) * (1 - greatest(now, fit)) / n) AS moved FROM r JOIN f USING (event_type)""")
def rate_shift(spark, folder):
    rows = table(spark, folder, "events").withColumn("hit", (F.col("value") > 30).cast("double"))
    now = rows.groupBy("event_type", (F.col("user_id") % 10).alias("part")).agg(F.count(F.lit(1)).alias("n"), F.avg("hit").alias("now"))
    fit = rows.groupBy("event_type").agg(F.avg("hit").alias("fit"))
    return now.join(fit, "event_type").select("event_type", "part", X.rate_changed(F.col("fit"), F.col("now"), F.col("n"), fixed.MISSING_RATE_SHIFT).alias("moved"))


MISSING_PAIRS = union_sql(f"SELECT '{c}' AS \"column\", (SELECT round(1 - count({c}) / CAST(count(*) AS DOUBLE), 4) FROM fit_) AS fit, (SELECT 1 - count({c}) / CAST(count(*) AS DOUBLE) FROM batch_) AS now, (SELECT count(*) FROM batch_) AS n" for c in ("amount", "weekday", "kind_text"))


@query("x2_missing_shift", f"WITH fit_ AS ({FIT_SQL}), batch_ AS ({BATCH_SQL}), p AS ({MISSING_PAIRS}) SELECT \"column\", fit, round(now, 4) AS now FROM p WHERE abs(now - fit) >= 0.05 AND abs(now - fit) >= 2 * sqrt(greatest(now, fit) * (1 - greatest(now, fit)) / n)")
def missing_shift(spark, folder):
    return R.missing_shift(batch_half(spark, folder), fitted_layout(spark, folder))


@query("x3_sentinel_shift", f"""WITH f AS ({sentinel_sql(FIT_SQL)}), b AS ({BATCH_CODES}), n AS (SELECT count(*) AS n FROM b), found AS ({sentinel_sql(BATCH_CODES)}),
r AS (SELECT CAST(value AS DOUBLE) AS value, rate AS fit, (SELECT count(*) FROM b WHERE amount = CAST(f.value AS DOUBLE)) / CAST((SELECT n FROM n) AS DOUBLE) AS now FROM f)
SELECT 'amount' AS "column", value, fit, round(now, 4) AS now FROM r WHERE abs(now - fit) >= 0.01 AND abs(now - fit) >= 2 * sqrt(greatest(now, fit) * (1 - greatest(now, fit)) / (SELECT n FROM n))
UNION ALL SELECT 'amount', CAST(value AS DOUBLE), 0.0, rate FROM found WHERE value NOT IN (SELECT value FROM f)""")
def sentinel_shift(spark, folder):
    batch = batch_half(spark, folder).withColumn("amount", F.expr("CASE WHEN amount = -9999 THEN NULL WHEN extra % 30 = 0 THEN -99999D ELSE amount END"))
    return R.sentinel_shift(batch, fitted_layout(spark, folder))


@query("x4_encoding_losses", f"""WITH fit_ AS ({FIT_SQL}), b AS ({BATCH_SQL}) SELECT 'unseen_levels' AS kind, 'kind_text' AS "column", kind_text AS level, count(*) AS rows FROM b WHERE kind_text NOT IN (SELECT kind_text FROM fit_ WHERE kind_text IS NOT NULL) GROUP BY kind_text
UNION ALL SELECT 'unmatched_missing', 'weekday_text', NULL, count(*) FROM b WHERE extra % 6 = 0 UNION ALL SELECT 'coerced_numeric', 'amount', NULL, count(*) FROM b WHERE amount IS NOT NULL AND extra % 21 = 0""")
def losses(spark, folder):
    fit = fit_half(spark, folder).withColumn("weekday_text", F.col("weekday").cast("string"))
    layout = E.fit_encoding(fit, ["amount", "kind_text", "weekday_text"])
    batch = batch_half(spark, folder).withColumn(
        "weekday_text", F.when(F.col("extra") % 6 != 0, F.col("weekday").cast("string"))).withColumn(
        "amount", F.when(F.col("extra") % 21 == 0, F.concat(F.col("amount").cast("string"), F.lit("?"))).otherwise(F.col("amount").cast("string")))
    return E.encoding_losses(batch, layout)


@query("x5_extra_columns", f"WITH b AS ({BATCH_SQL}) SELECT 'extra' AS extra_columns, 'user_text' AS ignored_at_fit, count(*) AS rows FROM b")
def extra_columns(spark, folder):
    batch = batch_half(spark, folder)
    found = R.column_differences(fitted_layout(spark, folder), batch.columns)
    return batch.agg(F.count(F.lit(1)).alias("rows")).select(
        F.lit(",".join(found["extra_columns"])).alias("extra_columns"), F.lit(",".join(found["ignored_at_fit"])).alias("ignored_at_fit"), "rows")


@query("x6_drift_report", f"""WITH fit_ AS ({FIT_SQL}), batch_ AS ({BATCH_SQL}), p AS ({MISSING_PAIRS})
SELECT 'unseen_levels' AS kind, 'kind_text' AS "column", kind_text AS detail, CAST(NULL AS DOUBLE) AS fit, CAST(NULL AS DOUBLE) AS now, count(*) AS rows FROM batch_
 WHERE kind_text NOT IN (SELECT kind_text FROM fit_ WHERE kind_text IS NOT NULL) GROUP BY kind_text
UNION ALL SELECT 'missing_rate_shift', "column", NULL, fit, round(now, 4), NULL FROM p WHERE abs(now - fit) >= 0.05 AND abs(now - fit) >= 2 * sqrt(greatest(now, fit) * (1 - greatest(now, fit)) / n)
UNION ALL SELECT kind, name, NULL, NULL, NULL, NULL FROM (VALUES ('extra_columns', 'extra'), ('ignored_at_fit', 'user_text'), ('missing_checks', 'environment'), ('missing_checks', 'column_stats'), ('environment_changed', 'pyspark')) t(kind, name)""")
def drift_report(spark, folder):
    layout = fitted_layout(spark, folder)
    layout.environment = {**layout.environment, "pyspark": "3.0.0"}
    layout.version = 1
    return R.drift(batch_half(spark, folder), layout)


# --- text -------------------------------------------------------------------------

WORD = r"[\p{L}\p{N}_\-.\\/]"
LOG_SQL = r"SELECT doc_id, text || CASE WHEN doc_id % 3 = 0 THEN ' saved to /tmp/run 1/x.parquet and C:\data\b.csv' WHEN doc_id % 3 = 1 THEN ' see Report-2.XLSX or a.jsonl here' ELSE '' END AS body FROM documents"


def _bodies(spark, folder):
    d = F.col("doc_id") % 3
    tail = F.when(d == 0, r" saved to /tmp/run 1/x.parquet and C:\data\b.csv").when(d == 1, " see Report-2.XLSX or a.jsonl here").otherwise("")
    return table(spark, folder, "documents").select("doc_id", F.concat("text", tail).alias("body"))


REDACT = (r"regexp_replace(regexp_replace({0}, '(?:[A-Za-z]:[\\/]|/)[\p{L}\p{N}\p{Mn}_\-.\\/]+', '<path>', 'g'), "
          r"'(?i)[\p{L}\p{N}\p{Mn}_\-.]*[\p{L}\p{N}\p{Mn}_\-]\.(?:csv|tsv|parquet|feather|xlsx?|jsonl?|pkl|npy|npz)\b', '<path>', 'g')")


@query("x7_redact_paths", f"SELECT doc_id, {REDACT.replace('{0}', 'body')} AS redacted FROM ({LOG_SQL})")
def redact_paths(spark, folder):
    return _bodies(spark, folder).select("doc_id", S.redact_paths(F.col("body")).alias("redacted"))


# Logs: the turns of a conversation, with an exception line after some of them.
SCRUB_SQL = r"""WITH t AS (SELECT conv_id, turn, text || CASE WHEN turn % 2 = 0 THEN chr(10) || 'ValueError: bad value ''' || role || ''' in /tmp/a.csv' || chr(10) || 'done "x" ' ELSE '' END AS log FROM conversations),
l AS (SELECT conv_id, turn, list_filter(list_transform(regexp_split_to_array(log, '\r\n|\r|\n'), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> '') AS lines FROM t),
c AS (SELECT conv_id, turn, coalesce(list_filter(lines, lambda s: regexp_matches(s, '^[A-Za-z_][\w.]*(?:Error|Exception|Warning|Interrupt):\s'))[-1], lines[-1], '') AS line FROM l),
q AS (SELECT conv_id, turn, regexp_replace(line, '''[^'']{1,200}''|"[^"]{1,200}"', '''<redacted>''', 'g') AS line FROM c)
SELECT conv_id, turn, substr(REDACTED, 1, 300) AS scrubbed FROM q""".replace("REDACTED", REDACT.replace("{0}", "line"))


@query("x8_scrub_log", SCRUB_SQL)
def scrub_log(spark, folder):
    extra = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("\nValueError: bad value '"), F.col("role"), F.lit("' in /tmp/a.csv\ndone \"x\" "))).otherwise("")
    rows = table(spark, folder, "conversations").select("conv_id", "turn", F.concat("text", extra).alias("log"))
    return rows.select("conv_id", "turn", S.scrub_log(F.col("log")).alias("scrubbed"))


TERMS = ("/data/secret/eaux.csv", "ing the", "tion", "out")


@query("x9_private_terms", "SELECT doc_id, " + " OR ".join(f"contains(text, '{t}')" for t in S.private_forms(TERMS)) + " AS held FROM documents")
def private_terms(spark, folder):
    return table(spark, folder, "documents").select("doc_id", S.holds_private(F.col("text"), TERMS).alias("held"))


# 10,000 registered strings by a rule: two syllables of a consonant and a vowel.
SYLLABLES = [c + v for c in "bcdfghjklmnpqrstvwxz" for v in "aeiou"]
MANY_TERMS = [a + b for a in SYLLABLES for b in SYLLABLES]
MANY_SQL = """WITH p AS (SELECT doc_id, text, unnest(generate_series(1, length(text) - 3)) AS i FROM documents),
h AS (SELECT doc_id, count(DISTINCT s) AS n, min(s) AS low, max(s) AS high FROM (SELECT doc_id, substr(text, i, 4) AS s FROM p)
WHERE regexp_full_match(s, '([bcdfghjklmnpqrstvwxz][aeiou]){2}') GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0) AS n_found, low AS first_found, high AS last_found, coalesce(n, 0) > 0 AS held FROM documents d LEFT JOIN h USING (doc_id)"""


@query("x9_many_terms", MANY_SQL)
def many_terms(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", S.term_hits(F.col("text"), MANY_TERMS).alias("hits"), S.holds_private(F.col("text"), MANY_TERMS).alias("held"))
    return docs.select("doc_id", F.coalesce(F.size("hits").cast("long"), F.lit(0).cast("long")).alias("n_found"), F.array_min("hits").alias("first_found"),
                       F.array_max("hits").alias("last_found"), F.coalesce("held", F.lit(False)).alias("held"))


# Common words of the prose as phrase, cue and denial, so that every branch is met many times.
SCAN = {"phrase": "there", "cues": ("the ", "and "), "denials": (" of", " in")}
CLASS = r"[.;:!?,()\[\]\n]"
PHRASE_SQL = f"""WITH d AS (SELECT doc_id, lower(text) AS x FROM documents), p AS (SELECT doc_id, string_split(x, '{SCAN['phrase']}') AS parts FROM d WHERE contains(x, '{SCAN['phrase']}')),
o AS (SELECT doc_id, parts, unnest(generate_series(1, len(parts) - 1)) AS i FROM p),
w AS (SELECT doc_id, right(array_to_string(parts[:i], '{SCAN['phrase']}'), 60) AS b, left(array_to_string(parts[i + 1:], '{SCAN['phrase']}'), 60) AS a FROM o),
c AS (SELECT doc_id, regexp_extract(b, '[^.;:!?,()\\[\\]\\n]*$') AS b, regexp_extract(a, '^[^.;:!?,()\\[\\]\\n]*') AS a FROM w),
u AS (SELECT doc_id, bool_or(NOT ({' OR '.join(f"contains(b, '{c}')" for c in SCAN['cues'])} OR {' OR '.join(f"contains(a, '{c}')" for c in SCAN['denials'])})) AS used FROM c GROUP BY doc_id)
SELECT d.doc_id, coalesce(used, false) AS used FROM d LEFT JOIN u USING (doc_id)"""


@query("x10_phrase_scan", PHRASE_SQL)
def phrase_scan(spark, folder):
    used = S.undenied(F.lower("text"), [SCAN["phrase"]], cues=SCAN["cues"], denials=SCAN["denials"])
    return table(spark, folder, "documents").select("doc_id", used.alias("used"))


TAILS = (". Then SMOTE on train.", ". We go without SMOTE here; stacking is not available.",
         ". No k-fold, but stacking and an oversampled set", ". Never any smote")
PHRASES = ", ".join(f"('{name}', '{p}')" for name, group in fixed.CLAIM_PHRASES.items() for p in group)


def _any(column: str, words) -> str:
    return "(" + " OR ".join("contains({0}, '{1}')".format(column, w.replace("'", "''")) for w in words) + ")"


@query("x10_claims", f"""WITH b AS (SELECT conv_id, turn, lower(text || CASE turn % 4 {' '.join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(TAILS))} END) AS x FROM conversations),
h(name, phrase) AS (VALUES {PHRASES}), p AS (SELECT conv_id, turn, name, phrase, x, string_split(x, phrase) AS parts FROM b JOIN h ON contains(x, phrase)),
o AS (SELECT *, unnest(generate_series(1, len(parts) - 1)) AS i FROM p),
q AS (SELECT conv_id, turn, name, phrase, x, CAST(list_sum(list_transform(parts[:i], lambda s: length(s))) AS BIGINT) + (i - 1) * length(phrase) AS passed FROM o),
w AS (SELECT conv_id, turn, name, regexp_extract(right(substr(x, 1, passed), 60), '[^.;:!?,()\\[\\]\\n]*$') AS before, regexp_extract(substr(x, passed + length(phrase) + 1, 60), '^[^.;:!?,()\\[\\]\\n]*') AS after FROM q),
u AS (SELECT DISTINCT conv_id, turn, name FROM w WHERE NOT ({_any('before', fixed.NEGATION_CUES)} OR {_any('after', fixed.DENYING_PREDICATES)})),
g AS (SELECT conv_id, turn, string_agg(name, ',' ORDER BY name) AS names FROM u GROUP BY conv_id, turn)
SELECT b.conv_id, b.turn, coalesce(names, '') AS claims FROM b LEFT JOIN g ON b.conv_id = g.conv_id AND b.turn = g.turn""")
def claims(spark, folder):
    k = F.col("turn") % 4
    tail = F.when(k == 0, TAILS[0]).when(k == 1, TAILS[1]).when(k == 2, TAILS[2]).otherwise(TAILS[3])
    rows = table(spark, folder, "conversations").select("conv_id", "turn", F.concat("text", tail).alias("body"))
    return rows.select("conv_id", "turn", F.concat_ws(",", S.claims(F.col("body"))).alias("claims"))


# --- neighbours -------------------------------------------------------------------

KNN_SQL = f"""WITH rows_ AS (SELECT CAST(vec_id AS VARCHAR) AS key, CAST(label AS VARCHAR) AS stratum FROM embeddings), {SPLIT_SQL},
e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v, split FROM embeddings JOIN split_ ON CAST(vec_id AS VARCHAR) = key),
d AS (SELECT q.vec_id, r.vec_id AS neighbor, r.label, sqrt(list_sum(list_transform(list_zip(q.v, r.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS distance FROM e q JOIN e r ON q.split <> 'train' AND r.split = 'train'),
k AS (SELECT *, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY distance, neighbor) AS INTEGER) AS rank FROM d QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY distance, neighbor) <= 5)"""


def _neighbors(spark, folder):
    rows = stage(L.assign_splits(table(spark, folder, "embeddings"), ["vec_id"], label="label"), "vectors")
    return N.nearest(rows.where("split = 'train'"), rows.where("split <> 'train'"), "vec_id", "embedding", "label", 5)


@query("f10_nearest", f"{KNN_SQL} SELECT vec_id, neighbor, label, round(distance, 6) AS distance, rank FROM k")
def nearest(spark, folder):
    return _neighbors(spark, folder).withColumn("distance", F.round("distance", 6))


@query("f10_knn_vote", f"{KNN_SQL}, v AS (SELECT vec_id, label, count(*) AS n FROM k GROUP BY ALL) SELECT vec_id, min_by(label, -n * 1000 + label) AS prediction FROM v GROUP BY vec_id")
def knn_vote(spark, folder):
    return N.vote(_neighbors(spark, folder), "vec_id")


@query("f10_hashed_recall")
def hashed_recall(spark, folder):
    """Neighbours among rows that share a projection bucket, per rank of the exact answer."""
    rows = stage(L.assign_splits(table(spark, folder, "embeddings"), ["vec_id"], label="label"), "vectors")
    reference, queries = rows.where("split = 'train'"), rows.where("split <> 'train'")
    found = N.nearest_hashed(reference, queries, "vec_id", "embedding", "label", 5).select("vec_id", "neighbor", F.lit(True).alias("found"))
    return _neighbors(spark, folder).select("vec_id", "rank", "neighbor").join(found, ["vec_id", "neighbor"], "left").fillna(False, ["found"])
