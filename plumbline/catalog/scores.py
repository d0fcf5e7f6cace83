"""Named queries: label metrics, errors, ranking, calibration, cuts."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline import fixed
from plumbline.catalog import query
from plumbline.catalog.base import DOCS_SQL, LINES_SQL, scored_docs, scored_lines, union_sql
from plumbline.operators import calibration as C
from plumbline.operators import cuts as D
from plumbline.operators import metrics as M
from plumbline.operators import ranking as K
from plumbline.session import table

WITH_LINES = f"WITH base AS ({LINES_SQL})"


@query("m1_confusion", f"{WITH_LINES} SELECT l_suppkey, flag AS label, flag_pred AS pred, count(*) AS n FROM base GROUP BY ALL")
def confusion(spark, folder):
    return M.confusion(scored_lines(spark, folder), "flag", "flag_pred", ["l_suppkey"])


@query("m1_confusion_rollup", f"""{WITH_LINES}, b AS (SELECT l_suppkey % 7 AS part, l_suppkey, flag AS label, flag_pred AS pred FROM base)
SELECT part, l_suppkey, label, pred, count(*) AS n, 0 AS level FROM b GROUP BY ALL UNION ALL
SELECT part, NULL, label, pred, count(*), 1 FROM b GROUP BY ALL UNION ALL SELECT NULL, NULL, label, pred, count(*), 2 FROM b GROUP BY ALL""")
def confusion_rollup(spark, folder):
    rows = scored_lines(spark, folder).withColumn("part", F.col("l_suppkey") % 7)
    return M.confusion_rollup(rows, "flag", "flag_pred", ["part", "l_suppkey"])


MULTI_SQL = f"""{WITH_LINES}, k AS (SELECT l_suppkey, flag AS label, flag_pred AS pred FROM base),
c AS (SELECT l_suppkey, class, sum(t) AS truth, sum(p) AS predicted, sum(h) AS tp FROM (
  SELECT l_suppkey, label AS class, 1 AS t, 0 AS p, CASE WHEN label = pred THEN 1 ELSE 0 END AS h FROM k UNION ALL
  SELECT l_suppkey, pred, 0, 1, 0 FROM k) GROUP BY ALL),
s AS (SELECT *, CASE WHEN predicted > 0 THEN tp / CAST(predicted AS DOUBLE) ELSE 0 END AS pr, CASE WHEN truth > 0 THEN tp / CAST(truth AS DOUBLE) ELSE 0 END AS re,
  2 * tp / CAST(truth + predicted AS DOUBLE) AS f FROM c)
SELECT l_suppkey, CAST(sum(truth) AS BIGINT) AS rows, round(CAST(sum(tp) AS DOUBLE) / CAST(sum(truth) AS DOUBLE), 6) AS accuracy, round(avg(f), 6) AS f1, round(avg(pr), 6) AS "precision",
  round(avg(re), 6) AS recall, round(avg(re) FILTER (truth > 0), 6) AS balanced_accuracy FROM s GROUP BY l_suppkey"""


def rounded(df, columns, digits=6):
    return df.select(*[F.round(c, digits).alias(c) if c in columns else F.col(c) for c in df.columns])


SCORES = ("accuracy", "f1", "precision", "recall", "balanced_accuracy", "specificity", "r2", "mae", "rmse",
          "roc_auc", "pr_auc", "ks", "value", "train", "val", "test", "score")


@query("m2_macro_scores", MULTI_SQL)
def macro_scores(spark, folder):
    cells = M.confusion(scored_lines(spark, folder), "flag", "flag_pred", ["l_suppkey"])
    return rounded(M.label_scores(cells, ["l_suppkey"], binary=False), SCORES)


BINARY_SQL = """{base}, k AS (SELECT {by} y, CASE WHEN proba >= 0.5 THEN 1 ELSE 0 END AS p FROM base {where}),
c AS (SELECT {by} sum(y * p) AS tp, sum((1 - y) * p) AS fp, sum(y * (1 - p)) AS fn, sum((1 - y) * (1 - p)) AS tn FROM k GROUP BY ALL)
SELECT {by} CAST(tp + fp + fn + tn AS BIGINT) AS rows, round((tp + tn) / CAST(tp + fp + fn + tn AS DOUBLE), 6) AS accuracy,
 round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / CAST(2 * tp + fp + fn AS DOUBLE) ELSE 0 END, 6) AS f1,
 round(CASE WHEN tp + fp > 0 THEN tp / CAST(tp + fp AS DOUBLE) ELSE 0 END, 6) AS "precision",
 round(CASE WHEN tp + fn > 0 THEN tp / CAST(tp + fn AS DOUBLE) ELSE 0 END, 6) AS recall,
 round(CASE WHEN tp + fn > 0 AND tn + fp > 0 THEN (tp / CAST(tp + fn AS DOUBLE) + tn / CAST(tn + fp AS DOUBLE)) / 2
   WHEN tp + fn > 0 THEN tp / CAST(tp + fn AS DOUBLE) ELSE tn / CAST(tn + fp AS DOUBLE) END, 6) AS balanced_accuracy,
 round(CASE WHEN tn + fp > 0 THEN tn / CAST(tn + fp AS DOUBLE) ELSE 0 END, 6) AS specificity FROM c"""


def binary_scores(rows, by):
    labelled = rows.withColumn("pred", (F.col("proba") >= 0.5).cast("int"))
    return rounded(M.label_scores(M.confusion(labelled, "y", "pred", by), by), SCORES)


@query("m2_binary_scores", BINARY_SQL.format(base=WITH_LINES, by="l_suppkey,", where=""))
def binary(spark, folder):
    return binary_scores(scored_lines(spark, folder), ["l_suppkey"])


@query("m3_balanced_accuracy", f"SELECT l_suppkey, balanced_accuracy FROM ({MULTI_SQL})")
def balanced_accuracy(spark, folder):
    return macro_scores(spark, folder).select("l_suppkey", "balanced_accuracy")


DOCS_Y = f"WITH base AS (SELECT source, quality AS y, proba FROM ({DOCS_SQL}))"


@query("m4_specificity", "SELECT source, specificity FROM (" + BINARY_SQL.format(base=DOCS_Y, by="source,", where="") + ")")
def specificity(spark, folder):
    rows = scored_docs(spark, folder).withColumnRenamed("quality", "y")
    return binary_scores(rows, ["source"]).select("source", "specificity")


@query("m5_regression_scores", f"""{WITH_LINES} SELECT l_suppkey, count(*) AS rows, round(1 - avg((amount - amount_pred) * (amount - amount_pred)) / var_pop(amount), 6) AS r2,
 round(avg(abs(amount - amount_pred)), 4) AS mae, round(sqrt(avg((amount - amount_pred) * (amount - amount_pred))), 4) AS rmse FROM base GROUP BY l_suppkey""")
def regression(spark, folder):
    out = M.regression_scores(scored_lines(spark, folder), "amount", "amount_pred", ["l_suppkey"])
    return rounded(rounded(out, ("r2",)), ("mae", "rmse"), 4)


RANK_SQL = """{base}, g AS (SELECT {by} proba, sum(y) AS pos, count(*) - sum(y) AS neg FROM base GROUP BY ALL),
c AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY {part}) AS np, sum(neg) OVER (PARTITION BY {part}) AS nn
  FROM g WINDOW w AS (PARTITION BY {part} ORDER BY proba DESC ROWS UNBOUNDED PRECEDING)),
r AS (SELECT {by} CAST(max(np) AS BIGINT) AS positives, CAST(max(nn) AS BIGINT) AS negatives,
  CAST(sum(neg * (tp - pos / 2.0::DOUBLE)) AS DOUBLE) / (CAST(max(np) AS DOUBLE) * CAST(max(nn) AS DOUBLE)) AS auc,
  sum(CASE WHEN pos > 0 THEN CAST(pos AS DOUBLE) * CAST(tp AS DOUBLE) / CAST(tp + fp AS DOUBLE) ELSE 0 END) / CAST(max(np) AS DOUBLE) AS ap,
  greatest(0, max(CAST(tp AS DOUBLE) / CAST(np AS DOUBLE) - CAST(fp AS DOUBLE) / CAST(nn AS DOUBLE))) AS ks FROM c GROUP BY ALL)
"""
LINES_RANK = RANK_SQL.format(base=WITH_LINES, by="l_suppkey,", part="l_suppkey")
ALL_RANK = RANK_SQL.format(base=WITH_LINES, by="", part="1")


@query("m6_roc_auc", f"{LINES_RANK} SELECT l_suppkey, positives, negatives, round(auc, 6) AS roc_auc FROM r")
def roc_auc(spark, folder):
    return rounded(K.ranking(scored_lines(spark, folder), "y", "proba", ["l_suppkey"]), SCORES).select("l_suppkey", "positives", "negatives", "roc_auc")


@query("m6_roc_auc_all", f"{ALL_RANK} SELECT positives, negatives, round(auc, 9) AS roc_auc, round(ap, 9) AS pr_auc, round(ks, 9) AS ks FROM r")
def roc_auc_all(spark, folder):
    return rounded(K.ranking(scored_lines(spark, folder), "y", "proba"), SCORES, 9).select("positives", "negatives", "roc_auc", "pr_auc", "ks")


@query("m7_pr_auc", f"{LINES_RANK} SELECT l_suppkey, round(ap, 6) AS pr_auc FROM r")
def pr_auc(spark, folder):
    return rounded(K.ranking(scored_lines(spark, folder), "y", "proba", ["l_suppkey"]), SCORES).select("l_suppkey", "pr_auc")


BA_SQL = "SELECT l_suppkey, balanced_accuracy FROM (" + BINARY_SQL.format(base=WITH_LINES, by="l_suppkey,", where="") + ")"


@query("m8_ks_headroom", f"{LINES_RANK}, b AS ({BA_SQL}) SELECT l_suppkey, round(ks, 6) AS ks, round((1 + ks) / 2, 4) AS ceiling, round(round((1 + ks) / 2, 4) - balanced_accuracy, 6) AS headroom FROM r JOIN b USING (l_suppkey)")
def ks_headroom(spark, folder):
    rows = scored_lines(spark, folder)
    r = K.ranking(rows, "y", "proba", ["l_suppkey"])
    b = binary_scores(rows, ["l_suppkey"]).select("l_suppkey", "balanced_accuracy")
    return r.join(b, "l_suppkey").select(
        "l_suppkey", F.round("ks", 6).alias("ks"), F.col("best_cut_ceiling").alias("ceiling"),
        K.cut_headroom(F.col("best_cut_ceiling"), F.col("balanced_accuracy")).alias("headroom"))


@query("m9_required_ks", f"""{LINES_RANK}, b AS ({BA_SQL}), x AS (SELECT l_suppkey, balanced_accuracy AS base_score, round((1 + ks) / 2, 4) AS ceiling FROM r JOIN b USING (l_suppkey))
SELECT l_suppkey, CASE WHEN 2.0 * ceiling - 1.0 BETWEEN 0 AND 1 THEN round(2.0 * ceiling - 1.0, 4) END AS required_ks,
 CASE WHEN (ceiling - base_score) / (1.0 - base_score) > 0 THEN floor(round((ceiling - base_score) / (1.0 - base_score) * 1000, 9)) / 1000.0::DOUBLE END AS passable_margin FROM x""")
def required_ks(spark, folder):
    rows = scored_lines(spark, folder)
    r = K.ranking(rows, "y", "proba", ["l_suppkey"]).select("l_suppkey", "best_cut_ceiling")
    b = binary_scores(rows, ["l_suppkey"]).select("l_suppkey", "balanced_accuracy")
    return r.join(b, "l_suppkey").select(
        "l_suppkey", K.required_ks(F.col("best_cut_ceiling")).alias("required_ks"),
        K.passable_margin(F.col("balanced_accuracy"), F.col("best_cut_ceiling")).alias("passable_margin"))


# Per nation: which metrics apply to its customers' predictions.
@query("m10_applicability", """
WITH m(metric, task, proba, bin) AS (VALUES ('f1','classification',false,false),('accuracy','classification',false,false),('balanced_accuracy','classification',false,false),
 ('precision','classification',false,false),('recall','classification',false,false),('roc_auc','classification',true,true),('pr_auc','classification',true,true),
 ('r2','regression',false,false),('mae','regression',false,false),('rmse','regression',false,false)),
c AS (SELECT c_custkey, CASE WHEN c_nationkey % 4 = 0 THEN 'regression' ELSE 'classification' END AS task, c_nationkey % 3 <> 0 AS is_binary, c_mktsegment <> 'BUILDING' AS has_proba FROM customer)
SELECT c_custkey, string_agg(metric, ',' ORDER BY metric) AS metrics FROM c JOIN m ON c.task = m.task AND (is_binary OR NOT m.bin) AND (has_proba OR NOT m.proba) GROUP BY c_custkey""")
def applicability(spark, folder):
    task = F.when(F.col("c_nationkey") % 4 == 0, fixed.REGRESSION).otherwise(fixed.CLASSIFICATION)
    rows = table(spark, folder, "customer").select(
        "c_custkey", task.alias("task"), (F.col("c_nationkey") % 3 != 0).alias("is_binary"),
        (F.col("c_mktsegment") != "BUILDING").alias("has_proba"), F.explode(F.array(*[F.lit(m) for m in fixed.METRICS])).alias("metric"))
    kept = rows.where(M.applicable(F.col("metric"), F.col("task"), F.col("is_binary"), F.col("has_proba")))
    return kept.groupBy("c_custkey").agg(F.concat_ws(",", F.array_sort(F.collect_list("metric"))).alias("metrics"))


PARTS = "CASE WHEN l_orderkey % 5 = 0 THEN 'test' WHEN l_orderkey % 5 = 1 THEN 'val' ELSE 'train' END"


def _parts(spark, folder):
    k = F.col("l_orderkey") % 5
    return scored_lines(spark, folder).withColumn("split", F.when(k == 0, "test").when(k == 1, "val").otherwise("train"))


@query("m11_train_val_gap", f"""{WITH_LINES}, s AS (SELECT l_suppkey % 20 AS part, {PARTS} AS split, avg(CASE WHEN flag = flag_pred THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS acc, avg(abs(amount - amount_pred)) AS mae FROM base GROUP BY ALL),
l AS (SELECT part, split, 'accuracy' AS metric, acc AS value FROM s UNION ALL SELECT part, split, 'mae', mae FROM s)
SELECT a.part, a.metric, round(a.value, 4) AS train, round(b.value, 4) AS val, round(CASE WHEN a.metric = 'mae' THEN b.value - a.value ELSE a.value - b.value END, 4) AS train_val_gap
FROM l a JOIN l b ON a.part = b.part AND a.metric = b.metric AND a.split = 'train' AND b.split = 'val'""")
def train_val_gap(spark, folder):
    rows = _parts(spark, folder).withColumn("part", F.col("l_suppkey") % 20)
    by = ["part", "split"]
    acc = M.long_scores(M.label_scores(M.confusion(rows, "flag", "flag_pred", by), by, binary=False), ["accuracy"], by)
    mae = M.long_scores(M.regression_scores(rows, "amount", "amount_pred", by), ["mae"], by)
    gaps = M.train_val_gap(acc.unionByName(mae), ["part"])
    return rounded(gaps, ("train", "val", "train_val_gap"), 4)


@query("m12_brier", f"{WITH_LINES} SELECT l_suppkey, round(avg((proba - y) * (proba - y)), 6) AS brier FROM base GROUP BY l_suppkey")
def brier(spark, folder):
    return C.brier(scored_lines(spark, folder), "y", "proba", ["l_suppkey"])


BIN = "CASE " + " ".join(f"WHEN proba <= {(i + 1) / 10} THEN {i}" for i in range(9)) + " ELSE 9 END"
RELIABILITY = f"""{WITH_LINES}, t AS (SELECT l_suppkey % 10 AS part, {BIN} AS bin, count(*) AS rows, round(avg(proba), 4) AS predicted, round(avg(y), 4) AS observed FROM base GROUP BY ALL)"""


def _reliability(spark, folder):
    return C.reliability(scored_lines(spark, folder).withColumn("part", F.col("l_suppkey") % 10), "y", "proba", ["part"])


@query("m13_reliability", f"{RELIABILITY} SELECT part, bin, round(bin / 10.0::DOUBLE, 4) AS low, round((bin + 1) / 10.0::DOUBLE, 4) AS high, rows, predicted, observed FROM t")
def reliability(spark, folder):
    return _reliability(spark, folder)


@query("m14_calibration_error", f"{RELIABILITY} SELECT part, CAST(sum(rows) AS BIGINT) AS rows, CASE WHEN sum(rows) >= 50 THEN round(CAST(sum(rows * abs(predicted - observed)) AS DOUBLE) / CAST(sum(rows) AS DOUBLE), 6) END AS calibration_error FROM t GROUP BY part")
def calibration_error(spark, folder):
    return C.calibration_error(_reliability(spark, folder), ["part"])


@query("m15_chance_scores", f"""WITH d AS ({DOCS_SQL}), b AS (SELECT lang, quality AS y, CASE WHEN doc_id % 5 = 1 THEN 'val' WHEN doc_id % 5 = 0 THEN 'test' ELSE 'train' END AS split FROM d),
m AS (SELECT lang, y AS p FROM (SELECT lang, y, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, y) AS r FROM b WHERE split = 'train' GROUP BY lang, y) WHERE r = 1),
v AS (SELECT lang, y, p FROM b JOIN m USING (lang) WHERE split = 'val')
SELECT lang, round(avg(CASE WHEN y = p THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS accuracy,
 round(coalesce(CASE WHEN max(p) = 1 THEN 2.0::DOUBLE * sum(y) / (count(*) + sum(y)) END, 0), 6) AS f1,
 round(CASE WHEN sum(y) > 0 AND sum(1 - y) > 0 THEN 0.5 ELSE max(CASE WHEN y = p THEN 1.0 ELSE 0.0 END) END::DOUBLE, 6) AS balanced_accuracy,
 0.5::DOUBLE AS roc_auc, round(avg(y), 6) AS pr_auc FROM v GROUP BY lang""")
def chance_scores(spark, folder):
    k = F.col("doc_id") % 5
    rows = scored_docs(spark, folder).select("lang", F.col("quality").alias("y"), k.alias("k"))
    out = M.chance_scores(rows.where("k NOT IN (0, 1)"), rows.where("k = 1"), "y", ["lang"])
    return rounded(out, SCORES).select("lang", "accuracy", "f1", "balanced_accuracy", "roc_auc", "pr_auc")


@query("m15_chance_scores_multi", f"""WITH d AS ({LINES_SQL}), b AS (SELECT l_suppkey % 10 AS part, flag AS y, l_orderkey % 5 AS k FROM d),
m AS (SELECT part, y AS p FROM (SELECT part, y, row_number() OVER (PARTITION BY part ORDER BY count(*) DESC, y) AS r FROM b WHERE k NOT IN (0, 1) GROUP BY part, y) WHERE r = 1),
v AS (SELECT part, y, p, count(*) AS n FROM b JOIN m USING (part) WHERE k = 1 GROUP BY ALL), t AS (SELECT part, any_value(p) AS p, sum(n) AS n, coalesce(sum(n) FILTER (y = p), 0) AS tp, count(*) AS classes, bool_or(y = p) AS seen FROM v GROUP BY part)
SELECT part, round(CAST(tp AS DOUBLE) / n, 6) AS accuracy, round(2.0::DOUBLE * tp / (n + tp) / (classes + CASE WHEN seen THEN 0 ELSE 1 END), 6) AS f1, round(CAST(tp AS DOUBLE) / n / (classes + CASE WHEN seen THEN 0 ELSE 1 END), 6) AS precision,
 round(CASE WHEN seen THEN 1.0::DOUBLE ELSE 0 END / classes, 6) AS balanced_accuracy FROM t""")
def chance_scores_multi(spark, folder):
    rows = scored_lines(spark, folder).select((F.col("l_suppkey") % 10).alias("part"), F.col("flag").alias("y"), (F.col("l_orderkey") % 5).alias("k"))
    out = M.chance_scores(rows.where("k NOT IN (0, 1)"), rows.where("k = 1"), "y", ["part"], binary=False)
    return out.select("part", *[F.round(c, 6).alias(c) for c in ("accuracy", "f1", "precision", "balanced_accuracy")])


@query("m16_selection_gap", f"""{WITH_LINES}, s AS (SELECT l_suppkey % 20 AS part, {PARTS} AS split, avg(CASE WHEN flag = flag_pred THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS acc, count(*) AS n FROM base GROUP BY ALL)
SELECT v.part, 'accuracy' AS metric, round(v.acc, 6) AS val, round(t.acc, 6) AS test, round(v.acc - t.acc, 6) AS selection_gap,
 v.acc BETWEEN t.acc - 2 * sqrt(t.acc * (1 - t.acc) / t.n) AND t.acc + 2 * sqrt(t.acc * (1 - t.acc) / t.n) AS val_inside_ci FROM s v JOIN s t ON v.part = t.part AND v.split = 'val' AND t.split = 'test'""")
def selection_gap(spark, folder):
    rows = _parts(spark, folder).withColumn("part", F.col("l_suppkey") % 20)
    by = ["part", "split"]
    scores = M.label_scores(M.confusion(rows, "flag", "flag_pred", by), by, binary=False).select(
        "part", "split", "rows", F.lit("accuracy").alias("metric"), F.col("accuracy").alias("value"))
    half = "2 * sqrt(value * (1 - value) / rows)"
    test = scores.where("split = 'test'").select("part", "metric", "value", F.expr(f"value - {half} AS low"), F.expr(f"value + {half} AS high"))
    val = scores.where("split = 'val'").select("part", "metric", "value")
    return rounded(M.selection_gap(val, test, ["part", "metric"]).drop("low", "high"), SCORES)


# --- cuts -------------------------------------------------------------------------

CUT_SQL = """{base}, q AS (SELECT {by} quantile_cont(proba, [{qs}]) AS v FROM base GROUP BY ALL),
c AS (SELECT DISTINCT {by} round(round(cut, 9), 6) AS cut FROM (SELECT {by} unnest(v) AS cut FROM q UNION ALL SELECT {by} unnest([{grid}, 0.5]) AS cut FROM q) WHERE cut > 0 AND cut < 1),
g AS (SELECT {by} proba, sum(y) AS pos, count(*) - sum(y) AS neg FROM base GROUP BY ALL),
x AS (SELECT {cby} cut, CAST(sum(CASE WHEN proba >= cut THEN pos ELSE 0 END) AS DOUBLE) AS tp, CAST(sum(CASE WHEN proba >= cut THEN neg ELSE 0 END) AS DOUBLE) AS fp, CAST(sum(pos) AS DOUBLE) AS p, CAST(sum(neg) AS DOUBLE) AS n
   FROM c JOIN g {on} GROUP BY ALL),
s AS (SELECT {by} cut, {score} AS s FROM x),
b AS (SELECT *, max(s) OVER (PARTITION BY {part}) AS best, count(*) OVER (PARTITION BY {part}) AS cuts FROM s),
t AS (SELECT {by} best, cuts, list(cut ORDER BY cut) AS plateau FROM b WHERE s = best GROUP BY ALL)
SELECT {by} plateau[len(plateau) // 2 + 1] AS cut, round(best, 6) AS score, cuts, CAST(len(plateau) AS INTEGER) AS plateau_cuts FROM t WHERE len(plateau) < cuts"""
QS = ", ".join(repr(round(i / 100, 2)) for i in range(1, 100))
GRID = ", ".join(repr(round(0.02 * (i + 1), 6)) for i in range(49))
DOC_BASE = f"WITH base AS (SELECT lang, quality AS y, proba FROM ({DOCS_SQL}))"


@query("d1_cut_sweep", CUT_SQL.format(base=DOC_BASE, by="", cby="", on="ON true", part="1", qs=QS, grid=GRID, score="2 * tp / (p + tp + fp)"))
def cut_sweep(spark, folder):
    rows = scored_docs(spark, folder).withColumnRenamed("quality", "y")
    return rounded(D.sweep_cuts(rows, "y", "proba", "f1"), SCORES)


@query("d1_cut_sweep_by_segment", CUT_SQL.format(base=DOC_BASE, by="lang,", cby="c.lang,", on="ON c.lang = g.lang", part="lang", qs=QS, grid=GRID, score="(tp / p + (n - fp) / n) / 2"))
def cut_sweep_by(spark, folder):
    rows = scored_docs(spark, folder).withColumnRenamed("quality", "y")
    return rounded(D.sweep_cuts(rows, "y", "proba", "balanced_accuracy", ["lang"]), SCORES)


@query("d2_cut_refusal", f"""WITH base AS ({DOCS_SQL}), n AS (SELECT source, count(*) AS rows, count(DISTINCT quality) AS k FROM base GROUP BY source)
SELECT source, rows, k < 2 OR rows < 200 AS refused FROM n""")
def cut_refusal(spark, folder):
    rows = scored_docs(spark, folder).groupBy("source").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("quality").alias("k"))
    return rows.select("source", "rows", D.refused("f1", fixed.CLASSIFICATION, F.col("k"), F.col("rows")).isNotNull().alias("refused"))


@query("d3_fixed_cut", f"{WITH_LINES} SELECT y, CASE WHEN proba >= 0.35 THEN 1 ELSE 0 END AS pred, count(*) AS n FROM base GROUP BY ALL")
def fixed_cut(spark, folder):
    from plumbline.functions.columns import label_at_cut

    rows = scored_lines(spark, folder)
    return rows.groupBy("y", label_at_cut(F.col("proba"), D.fixed_cut(0.35)).alias("pred")).agg(F.count(F.lit(1)).alias("n"))
