"""Named queries: fits, class weights, search, batch predict, the card, streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from plumbline import fixed
from plumbline.catalog import query
from plumbline.catalog.base import DEFECTS_SQL, DOCS_SQL, ORDERS_SQL, defects, orders_customers, scored_docs, with_defects
from plumbline.catalog.batch import HALF, fitted_layout
from plumbline.catalog.prepare import SPLIT_SQL
from plumbline.catalog.profile import DEFECT_PROFILE
from plumbline.catalog.scores import rounded
from plumbline.operators import drift as D
from plumbline.operators import policy
from plumbline.operators import trials as T
from plumbline.plans import card as K
from plumbline.plans import fits as M
from plumbline.plans import predict as P
from plumbline.plans import search as H
from plumbline.session import shared_folder, table
from plumbline.sources import sinks
from plumbline.streaming import batch_stream as B

DOC_FEATURES = ["n_chars", "words", "digits", "lang", "source"]


def featured(rows):
    """Documents, of a table or a stream, with features computed from their whole texts: one projection."""
    return rows.select(
        "doc_id", "n_chars", "lang", "source", F.size(F.split("text", r"\s+")).alias("words"),
        (F.length(F.regexp_replace("text", "[^0-9]", "")) / F.greatest(F.length("text"), F.lit(1))).alias("digits"))


def doc_features(spark, folder):
    return featured(table(spark, folder, "documents"))


def doc_table(spark, folder):
    """Labelled documents with features computed from their whole texts."""
    return doc_features(spark, folder).join(table(spark, folder, "labels"), "doc_id")


def doc_data(spark, folder, label="quality"):
    return H.prepare(doc_table(spark, folder), ["doc_id"], label, DOC_FEATURES, fixed.CLASSIFICATION)


def order_table(spark, folder):
    return orders_customers(spark, folder).select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority", "c_nationkey", "c_acctbal", "c_mktsegment", "o_orderstatus")


def trial_frame(spark, *trials):
    """Val scores of attempts, one row per (model, metric)."""
    rows = [(t.model, name, float(value)) for t in trials for name, value in t.metrics.items()]
    return spark.createDataFrame(rows, "model string, metric string, value double")


def one_fit(spark, folder, model, params=None, spec=(), label="quality"):
    trial = H.run_trial(doc_data(spark, folder, label), 1, model, params or {}, spec)
    if trial.status != "ok":
        raise RuntimeError(f"{model}: {trial.error_type}")
    return trial_frame(spark, trial)


@query("f1_baseline_logistic")
def baseline_logistic(spark, folder):
    return K.baseline(doc_table(spark, folder), ["doc_id"], "quality", DOC_FEATURES, fixed.CLASSIFICATION)


# One feature: the penalised slope is the covariance sum over (n + alpha) on the scaled feature.
@query("f2_ridge_one_feature", "WITH rows_ AS (SELECT CAST(o_orderkey AS VARCHAR) AS key, 'all' AS stratum FROM orders), " + SPLIT_SQL + f""", d AS (SELECT o_orderkey, c_acctbal AS x, o_totalprice AS y, split FROM ({ORDERS_SQL}) JOIN split_ ON CAST(o_orderkey AS VARCHAR) = key),
m AS (SELECT avg(x) AS mx, stddev_pop(x) AS sx, avg(y) AS my, count(*) AS n FROM d WHERE split = 'train'),
w AS (SELECT sum((x - mx) / sx * (y - my)) / (max(n) + 1.0) AS w FROM d, m WHERE split = 'train')
SELECT o_orderkey, round(my + w * (x - mx) / sx, 3) AS prediction FROM d, m, w WHERE split = 'val'""")
def ridge_one_feature(spark, folder):
    rows = order_table(spark, folder).select("o_orderkey", "c_acctbal", "o_totalprice")
    data = H.prepare(rows, ["o_orderkey"], "o_totalprice", ["c_acctbal"], fixed.REGRESSION)
    trial = H.run_trial(data, 1, "ridge", {"alpha": 1.0}, metric="r2")
    return H.predict(trial, data.part("val"), ["o_orderkey"]).select("o_orderkey", F.round("pred", 3).alias("prediction"))


@query("f3_logreg_balanced")
def logreg_balanced(spark, folder):
    return one_fit(spark, folder, "logreg", {"C": 0.5, "class_weight": "balanced"})


@query("f4_linear_regressions")
def linear_regressions(spark, folder):
    data = H.prepare(order_table(spark, folder), ["o_orderkey"], "o_totalprice", ["c_acctbal", "c_nationkey", "o_orderpriority", "c_mktsegment"], fixed.REGRESSION)
    return trial_frame(spark, *[H.run_trial(data, i, m, p, metric="r2") for i, (m, p) in enumerate(
        [("linreg", {}), ("ridge", {"alpha": 2.0}), ("elasticnet", {"alpha": 0.5, "l1_ratio": 0.3})], 1)])


@query("f5_decision_tree")
def decision_tree(spark, folder):
    return one_fit(spark, folder, "decision_tree", {"max_depth": 5, "min_samples_leaf": 5})


@query("f6_random_forest")
def random_forest(spark, folder):
    return one_fit(spark, folder, "random_forest", {"n_estimators": 50, "max_depth": 6})


@query("f7_boosted_trees")
def boosted_trees(spark, folder):
    return one_fit(spark, folder, "hist_gbdt", {"max_iter": 15, "max_depth": 3}, [{"step": "impute", "strategy": "none"}])


@query("f8_neural_net")
def neural_net(spark, folder):
    return one_fit(spark, folder, "mlp", {"hidden_layer_sizes": [8], "max_iter": 50})


@query("f9_linear_svc")
def linear_svc(spark, folder):
    return one_fit(spark, folder, "svc", {"C": 1.0}, label="toxic")


# Names asked for per supplier, resolved per task.
@query("f11_model_names", """
WITH r AS (SELECT s_suppkey, CASE s_suppkey % 5 WHEN 0 THEN 'rf' WHEN 1 THEN 'lightgbm' WHEN 2 THEN 'OLS' WHEN 3 THEN 'xgb' ELSE 'extra_trees' END AS asked, CASE WHEN s_nationkey % 2 = 0 THEN 'regression' ELSE 'classification' END AS task FROM supplier)
SELECT s_suppkey, asked, task, CASE asked WHEN 'rf' THEN 'random_forest' WHEN 'lightgbm' THEN 'hist_gbdt' WHEN 'xgb' THEN 'xgboost' WHEN 'OLS' THEN CASE WHEN task = 'regression' THEN 'linreg' END END AS model FROM r""")
def model_names(spark, folder):
    def resolved(task):
        cases = []
        for name in ("rf", "lightgbm", "OLS", "xgb", "extra_trees"):
            try:
                cases.append(f"WHEN '{name}' THEN '{M.resolve_name(name, task)}'")
            except ValueError:
                continue
        return f"CASE asked {' '.join(cases)} END"

    rows = table(spark, folder, "supplier").selectExpr(
        "s_suppkey", "CASE s_suppkey % 5 WHEN 0 THEN 'rf' WHEN 1 THEN 'lightgbm' WHEN 2 THEN 'OLS' WHEN 3 THEN 'xgb' ELSE 'extra_trees' END AS asked",
        "CASE WHEN s_nationkey % 2 = 0 THEN 'regression' ELSE 'classification' END AS task")
    return rows.withColumn("model", F.expr(f"CASE task WHEN 'regression' THEN {resolved(fixed.REGRESSION)} ELSE {resolved(fixed.CLASSIFICATION)} END"))


@query("f12_class_weights", f"WITH d AS ({DOCS_SQL}), c AS (SELECT quality, count(*) AS nc FROM d GROUP BY quality) SELECT doc_id, quality, round((SELECT count(*) FROM d) / ((SELECT count(*) FROM c)::DOUBLE * nc), 9) AS weight FROM d JOIN c USING (quality)")
def class_weights(spark, folder):
    rows = scored_docs(spark, folder).select("doc_id", "quality")
    return rounded(M.class_weights(rows, "quality", "balanced"), ("weight",), 9)


@query("f13_early_stopping", "WITH rows_ AS (SELECT CAST(o_orderkey AS VARCHAR) AS key, CAST(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS VARCHAR) AS stratum FROM orders), " + SPLIT_SQL + " SELECT count(*) AS fit_rows, CAST(ceil(0.1 * count(*)) AS BIGINT) AS held_rows FROM split_ WHERE split = 'train'")
def early_stopping(spark, folder):
    rows = orders_customers(spark, folder).select("o_orderkey", "o_totalprice", "c_acctbal", F.col("y").alias("done"))
    data = H.prepare(rows, ["o_orderkey"], "done", ["o_totalprice", "c_acctbal"], fixed.CLASSIFICATION)
    trial = H.run_trial(data, 1, "hist_gbdt", {"max_iter": 5, "max_depth": 2, "early_stopping": True}, metric="f1")
    return data.part("train").agg(F.count(F.lit(1)).alias("fit_rows"), F.lit(trial.fit.held_rows).cast("bigint").alias("held_rows"))


def doc_search(spark, folder):
    data = doc_data(spark, folder)
    found = H.search(data, [("logreg", {}), ("decision_tree", {"max_depth": 4}), ("hist_gbdt", {"max_iter": 5, "max_depth": 2})], "roc_auc", 0.999, max_iterations=3)
    return data, found


@query("f15_search")
def search(spark, folder):
    _, found = doc_search(spark, folder)
    trials = H.trial_table(spark, found, "docs", "roc_auc").select("iteration", "model", "status", "score")
    return trials.withColumn("reason", F.lit(found.reason)).withColumn("chosen", F.col("iteration") == found.best.iteration).withColumn(
        "test", F.when(F.col("iteration") == found.best.iteration, F.lit(found.holdout.get("roc_auc"))))


@query("f15_search_diagnosis")
def search_diagnosis(spark, folder):
    """The rules of the ledger over a search's own attempts, one of which must fail."""
    data = doc_data(spark, folder)
    found = H.search(data, [("logreg", {}), ("knn", {}), ("logreg", {"C": 0.1})], "roc_auc", 0.9999, max_iterations=3)
    trials = T.ledger(H.trial_table(spark, found, "docs", "roc_auc", bar=0.9999, imbalance=5.0))
    return trials.select("iteration", "model", "status", "error_type", "rule", "failure_type", "prescription", "pipeline_move", F.round("score", 4).alias("score"))


@query("f15_closed_search")
def closed_search(spark, folder):
    """One given attempt; the rest comes from the written ledger, and each step is planned again from what came before it."""
    path = f"{shared_folder(spark)}/ledger-{uuid.uuid4().hex}"
    H.closed_search(doc_data(spark, folder), ("decision_tree", {"max_depth": 2}), "balanced_accuracy", 0.9999, path, "docs", max_iterations=4, stall_limit=4)
    written = H.read_ledger(spark, path)
    steps = policy.audited(written, M.PARAMS).select("iteration", "planned_model", "planned_origin", "follows")
    return written.join(steps, "iteration", "left").select(
        "iteration", "origin", "model", F.to_json("params").alias("params"), F.to_json("ran").alias("ran"), "status", F.round("score", 4).alias("score"), "planned_model", "planned_origin", "follows")


def saved_model(spark, folder):
    """A logistic model on the labelled documents, saved and loaded again."""
    data = doc_data(spark, folder)
    trial = H.run_trial(data, 1, "logreg", {}, metric="f1")
    path = f"{shared_folder(spark)}/model-{uuid.uuid4().hex}"
    P.save(spark, path, data.layout, trial, ["0", "1"], "f1")
    return P.load(spark, path)


@query("f16_batch_predict")
def batch_predict(spark, folder):
    return P.predict(doc_features(spark, folder), saved_model(spark, folder), "doc_id")


@query("f16_prediction_contract", "SELECT doc_id, true AS known, true AS adds_to_one, true AS likeliest FROM documents")
def prediction_contract(spark, folder):
    """What holds for every saved model: known classes, probabilities that add up to 1, the likelier class predicted."""
    out = P.predict(doc_features(spark, folder), saved_model(spark, folder), "doc_id")
    return out.select(
        "doc_id", F.col("prediction").isin("0", "1").alias("known"), (F.abs(F.col("proba_0") + F.col("proba_1") - 1) < 1e-9).alias("adds_to_one"),
        ((F.col("prediction") == "1") == (F.col("proba_1") > F.col("proba_0"))).alias("likeliest"))


@query("m17_batch_scoring", f"""WITH b AS (SELECT CASE WHEN doc_id % 9 = 0 THEN NULL WHEN doc_id % 7 = 0 THEN 'other' ELSE CAST(quality AS VARCHAR) END AS label, CASE WHEN proba >= 0.5 THEN '1' ELSE '0' END AS pred FROM ({DOCS_SQL}))
SELECT 'rows_missing' AS metric, CAST(count(*) AS DOUBLE) AS value FROM b WHERE label IS NULL UNION ALL SELECT 'rows_unknown', count(*) FROM b WHERE label = 'other' UNION ALL SELECT 'rows_scored', count(*) FROM b WHERE label IN ('0', '1')
UNION ALL SELECT 'accuracy', round(avg(CASE WHEN label = pred THEN 1.0::DOUBLE ELSE 0.0 END), 6) FROM b WHERE label IN ('0', '1')
UNION ALL SELECT 'recall', round(avg(CASE WHEN pred = '1' THEN 1.0::DOUBLE ELSE 0.0 END), 6) FROM b WHERE label = '1'""")
def batch_scoring(spark, folder):
    d = F.col("doc_id")
    rows = scored_docs(spark, folder).select(
        F.when(d % 9 == 0, F.lit(None)).when(d % 7 == 0, "other").otherwise(F.col("quality").cast("string")).alias("label"),
        F.when(F.col("proba") >= 0.5, "1").otherwise("0").alias("prediction"), (1 - F.col("proba")).alias("proba_0"), F.col("proba").alias("proba_1"))
    counts, scores = P.score_batch(rows, "label", ["0", "1"], resamples=100)
    both = counts.select(F.concat(F.lit("rows_"), F.col("label_state")).alias("metric"), F.col("rows").cast("double").alias("value"))
    return both.unionByName(scores.where("metric IN ('accuracy', 'recall')").select("metric", F.round("value", 6).alias("value")))


CARD_SQL = f"""WITH p AS ({DEFECT_PROFILE}), b AS ({DEFECTS_SQL}), s AS (SELECT round(count(*) / CAST((SELECT count(*) FROM b) AS DOUBLE), 4) AS share FROM b GROUP BY event_type)
SELECT 'events' AS name, 'multiclass_classification' AS task, max(n_rows) AS n_rows, CAST(count(*) FILTER (usable_by_executor) AS BIGINT) AS n_features, CAST(count(*) FILTER (NOT usable_by_executor) AS BIGINT) AS dropped,
 (SELECT CAST(count(*) AS INTEGER) FROM s) AS n_classes, (SELECT round(max(share) / min(share), 2) FROM s) AS imbalance_ratio, max(missing_rate) AS worst_rate, CAST(count(*) FILTER (missing_rate > 0) AS BIGINT) AS columns_with_missing,
 string_agg(name || ':' || kind, ',' ORDER BY name) AS kinds FROM p"""


def defect_card(spark, folder):
    rows = defects(spark, folder).select("event_id", "event_type", "amount", "kind_text", "user_text", "flag", "weekday", "fixed_value")
    return K.build_card(rows, "event_type", "events", ["event_id"], notes=["values from January", "values  from January"], with_baseline=False)


@query("a16_card", CARD_SQL)
def card(spark, folder):
    return defect_card(spark, folder).select(
        "name", "task", "n_rows", "n_features", F.col("n_features_dropped_non_numeric").alias("dropped"), "n_classes", "imbalance_ratio",
        F.col("missing.worst_rate").alias("worst_rate"), F.col("missing.columns_with_missing").cast("bigint").alias("columns_with_missing"),
        F.concat_ws(",", F.transform("features", lambda f: F.concat(f["name"], F.lit(":"), f["kind"]))).alias("kinds"))


@query("a16_card_with_baseline")
def card_with_baseline(spark, folder):
    rows = doc_table(spark, folder).drop("toxic")
    return K.build_card(rows, "quality", "quality", ["doc_id"]).select(F.to_json(F.struct("*")).alias("card"))


@query("s5_card_sink", f"SELECT name, task, n_rows, n_classes FROM ({CARD_SQL})")
def card_sink(spark, folder):
    path = f"{shared_folder(spark)}/card-{uuid.uuid4().hex}"
    sinks.write_card(defect_card(spark, folder), path)
    return spark.read.json(path).select("name", "task", "n_rows", F.col("n_classes").cast("int").alias("n_classes"))


WINDOW_SQL = f"""SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS rows, count(*) - count(amount) AS missing_amount, count(*) - count(kind_text) AS missing_kind_text,
 CAST(count(*) FILTER (amount IN (-9999, -999)) AS BIGINT) AS code_amount FROM ({DEFECTS_SQL}) GROUP BY 1"""


@query("x11_quality_windows", WINDOW_SQL)
def quality_windows(spark, folder):
    return B.quality_windows(defects(spark, folder), "ts", ["amount", "kind_text"], {"amount": [-9999.0, -999.0]})


@query("x11_quality_stream", WINDOW_SQL)
def quality_stream(spark, folder):
    events = table(spark, folder, "events")
    stream = B.file_stream(spark, f"{folder}/events*.parquet", events.schema)
    e = F.col("event_id")
    rows = stream.select(
        "ts", F.when(e % 17 == 0, F.lit(None)).when(e % 50 == 0, F.lit(-9999.0)).when(e % 70 == 0, F.lit(-999.0)).otherwise(F.col("value")).alias("amount"),
        F.when(e % 40 == 0, F.lit(" Unknown")).when(e % 90 == 0, F.lit(None)).otherwise(F.col("event_type")).alias("kind_text"))
    path = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    B.keyed_updates(B.quality_windows(rows, "ts", ["amount", "kind_text"], {"amount": [-9999.0, -999.0]}), f"{path}/out", f"{path}/checkpoint")
    return B.latest_rows(spark, f"{path}/out", ["start"])


# A stream scored by the saved model gives every document the answer that a batch gives it.
@query("x11_score_stream", "SELECT doc_id, true AS known, true AS agrees FROM documents")
def score_documents(spark, folder):
    saved = saved_model(spark, folder)
    docs = table(spark, folder, "documents")
    path = f"{shared_folder(spark)}/scores-{uuid.uuid4().hex}"
    stream = B.file_stream(spark, f"{folder}/documents*.parquet", docs.schema)
    B.score_stream(stream, lambda rows: P.predict(featured(rows), saved, "doc_id"), f"{path}/out", f"{path}/checkpoint")
    batch = P.predict(featured(docs), saved, "doc_id").select("doc_id", F.col("prediction").alias("own"), F.col("proba_1").alias("p"))
    both = spark.read.parquet(f"{path}/out").join(batch, "doc_id")
    return both.select("doc_id", F.col("prediction").isin("0", "1").alias("known"), ((F.col("prediction") == F.col("own")) & (F.abs(F.col("proba_1") - F.col("p")) < 1e-12)).alias("agrees"))


# Days of the later half against the statistics of the first one.
DRIFT_SQL = f"""WITH f AS (SELECT * FROM ({DEFECTS_SQL}) WHERE {HALF}), b AS (SELECT ts, CASE WHEN event_id % 9 = 0 THEN NULL ELSE amount END AS amount, kind_text FROM ({DEFECTS_SQL}) WHERE NOT ({HALF})),
fit_ AS (SELECT 'amount' AS "column", round(1 - count(amount) / CAST(count(*) AS DOUBLE), 4) AS fit FROM f UNION ALL SELECT 'kind_text', round(1 - count(kind_text) / CAST(count(*) AS DOUBLE), 4) FROM f),
d AS (SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS rows, 1 - count(amount) / CAST(count(*) AS DOUBLE) AS a, 1 - count(kind_text) / CAST(count(*) AS DOUBLE) AS k FROM b GROUP BY 1),
l AS (SELECT start, 'amount' AS "column", a AS now, rows FROM d UNION ALL SELECT start, 'kind_text', k, rows FROM d)
SELECT start, "column", fit, round(now, 4) AS now, rows, abs(now - fit) >= 0.05 AND abs(now - fit) >= 2 * sqrt(greatest(now, fit) * (1 - greatest(now, fit)) / rows) AS moved FROM l JOIN fit_ USING ("column")"""


def _later(rows):
    return rows.where(f"NOT ({HALF})").select("ts", F.when(F.col("event_id") % 9 == 0, F.lit(None)).otherwise(F.col("amount")).alias("amount"), "kind_text")


@query("x11_drift_windows", DRIFT_SQL)
def drift_windows(spark, folder):
    stats = D.stats_frame(spark, fitted_layout(spark, folder))
    return B.missing_shifts(_later(defects(spark, folder)), "ts", stats, ["amount", "kind_text"])


@query("x11_drift_stream", DRIFT_SQL)
def drift_stream(spark, folder):
    stats = D.stats_frame(spark, fitted_layout(spark, folder))
    events = table(spark, folder, "events")
    rows = _later(with_defects(B.file_stream(spark, f"{folder}/events*.parquet", events.schema)))
    path = f"{shared_folder(spark)}/drift-{uuid.uuid4().hex}"
    B.raise_shifts(B.missing_shifts(rows, "ts", stats, ["amount", "kind_text"]), path, f"{path}/checkpoint")
    return B.latest_rows(spark, f"{path}/windows", ["start", "column"])
