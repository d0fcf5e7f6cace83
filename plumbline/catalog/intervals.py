"""Named queries: bootstrap intervals, paired differences, goals."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline import fixed
from plumbline.catalog import query
from plumbline.catalog.base import DOCS_SQL, LINES_SQL, scored_docs, scored_lines
from plumbline.catalog.scores import ALL_RANK, BINARY_SQL, LINES_RANK, WITH_LINES, binary_scores, rounded
from plumbline.operators import bootstrap as B
from plumbline.operators import goals as G
from plumbline.operators import metrics as M
from plumbline.operators import ranking as K
from plumbline.operators.keys import join_on
from plumbline.session import table

STEPS = " ".join(f"WHEN mix < {s} THEN {k}" for k, s in enumerate(B.poisson_steps()))


def draws_sql(unit: str, resamples: int) -> str:
    """CTEs draws(r, a, b) and weights(u, r, w) over a unit table."""
    return f"""draws AS (SELECT r, CAST('0x' || substr(md5('a|42|' || r), 1, 7) AS BIGINT) + 1 AS a, CAST('0x' || substr(md5('b|42|' || r), 1, 7) AS BIGINT) AS b FROM range({resamples}) t(r)),
units AS (SELECT DISTINCT {unit} AS u, CAST('0x' || substr(md5('42|' || {unit}), 1, 7) AS BIGINT) AS h FROM base),
mixed AS (SELECT u, r, (h * a + b) % {B.PRIME} AS mix FROM units, draws),
weights AS (SELECT u, r, w FROM (SELECT u, r, CASE {STEPS} ELSE 10 END AS w FROM mixed) WHERE w > 0)"""


# Groups are suppliers, each with its whole block of rows.
GROUP_SQL = f"""{WITH_LINES}, {draws_sql('l_suppkey', 400)},
k AS (SELECT l_suppkey, y, CASE WHEN proba >= 0.5 THEN 1 ELSE 0 END AS p, count(*) AS n FROM base GROUP BY ALL),
c AS (SELECT r, CAST(sum(CASE WHEN y = 1 AND p = 1 THEN n * w ELSE 0 END) AS DOUBLE) AS tp, CAST(sum(CASE WHEN y = 0 AND p = 1 THEN n * w ELSE 0 END) AS DOUBLE) AS fp,
  CAST(sum(CASE WHEN y = 1 AND p = 0 THEN n * w ELSE 0 END) AS DOUBLE) AS fn, CAST(sum(CASE WHEN y = 0 AND p = 0 THEN n * w ELSE 0 END) AS DOUBLE) AS tn
  FROM k JOIN weights ON l_suppkey = u GROUP BY r),
s AS (SELECT 'accuracy' AS metric, (tp + tn) / (tp + fp + fn + tn) AS v FROM c UNION ALL SELECT 'f1', 2 * tp / (2 * tp + fp + fn) FROM c
  UNION ALL SELECT 'precision', tp / (tp + fp) FROM c UNION ALL SELECT 'recall', tp / (tp + fn) FROM c
  UNION ALL SELECT 'balanced_accuracy', (tp / (tp + fn) + tn / (tn + fp)) / 2 FROM c)
SELECT metric, round(quantile_cont(v, 0.025), 6) AS low, round(quantile_cont(v, 0.975), 6) AS high, count(v) AS resamples, (SELECT count(*) FROM units) AS units, 'group' AS unit FROM s GROUP BY metric HAVING (SELECT count(*) FROM units) >= 20"""


def _labelled(spark, folder):
    return scored_lines(spark, folder).withColumn("pred", (F.col("proba") >= 0.5).cast("int"))


@query("b1_group_bootstrap", GROUP_SQL)
def group_bootstrap(spark, folder):
    rows = _labelled(spark, folder)
    return B.bootstrap(B.label_draws(rows, "y", "pred", unit="l_suppkey"), rows, unit="l_suppkey")


@query("b1_row_bootstrap")
def row_bootstrap(spark, folder):
    rows = _labelled(spark, folder)
    return B.bootstrap(B.label_draws(rows, "y", "pred", by=["l_suppkey"]), rows, by=["l_suppkey"])


RANK_DRAWS = f"""{WITH_LINES}, {draws_sql('l_suppkey', 400)},
k AS (SELECT l_suppkey, proba AS b, y, count(*) AS n FROM base GROUP BY ALL),
t AS (SELECT r, b, CAST(sum(CASE WHEN y = 1 THEN n * w ELSE 0 END) AS DOUBLE) AS pos, CAST(sum(CASE WHEN y = 0 THEN n * w ELSE 0 END) AS DOUBLE) AS neg FROM k JOIN weights ON l_suppkey = u GROUP BY r, b),
x AS (SELECT *, sum(pos) OVER v AS tp, sum(neg) OVER v AS fp FROM t WINDOW v AS (PARTITION BY r ORDER BY b DESC ROWS UNBOUNDED PRECEDING)),
s AS (SELECT r, sum(neg * (tp - pos / 2)) / (sum(pos) * sum(neg)) AS auc, sum(CASE WHEN pos > 0 THEN pos * tp / (tp + fp) ELSE 0 END) / sum(pos) AS ap FROM x GROUP BY r),
l AS (SELECT 'roc_auc' AS metric, auc AS v FROM s UNION ALL SELECT 'pr_auc', ap FROM s)
SELECT metric, round(quantile_cont(v, 0.025), 6) AS low, round(quantile_cont(v, 0.975), 6) AS high, count(v) AS resamples, (SELECT count(*) FROM units) AS units, 'group' AS unit FROM l GROUP BY metric HAVING (SELECT count(*) FROM units) >= 20"""


@query("b1_ranking_bootstrap", RANK_DRAWS)
def ranking_bootstrap(spark, folder):
    rows = scored_lines(spark, folder)
    return B.bootstrap(B.ranking_draws(rows, "y", "proba", unit="l_suppkey"), rows, unit="l_suppkey")


@query("b1_error_bootstrap", f"""{WITH_LINES}, {draws_sql('l_suppkey', 400)},
k AS (SELECT l_suppkey, count(*) AS n, sum(amount) AS sy, sum(amount * amount) AS syy, sum((amount - amount_pred) * (amount - amount_pred)) AS sse, sum(abs(amount - amount_pred)) AS sae FROM base GROUP BY ALL),
c AS (SELECT r, CAST(sum(n * w) AS DOUBLE) AS n, sum(sy * w) AS sy, sum(syy * w) AS syy, sum(sse * w) AS sse, sum(sae * w) AS sae FROM k JOIN weights ON l_suppkey = u GROUP BY r),
s AS (SELECT 'r2' AS metric, 1 - sse / (syy - sy * sy / n) AS v FROM c UNION ALL SELECT 'mae', sae / n FROM c UNION ALL SELECT 'rmse', sqrt(sse / n) FROM c)
SELECT metric, round(quantile_cont(v, 0.025), 4) AS low, round(quantile_cont(v, 0.975), 4) AS high, count(v) AS resamples FROM s GROUP BY metric HAVING (SELECT count(*) FROM units) >= 20""")
def error_bootstrap(spark, folder):
    rows = scored_lines(spark, folder)
    out = B.bootstrap(B.error_draws(rows, "amount", "amount_pred", "l_suppkey"), rows, unit="l_suppkey")
    return out.select("metric", F.round("low", 4).alias("low"), F.round("high", 4).alias("high"), "resamples")


@query("b2_baseline_intervals", f"""WITH g AS ({GROUP_SQL}), r AS ({RANK_DRAWS}), a AS (SELECT metric, low, high FROM g UNION ALL SELECT metric, low, high FROM r)
SELECT metric, round(low, 4) AS low, round(high, 4) AS high FROM a UNION ALL SELECT 'average_precision', round(low, 4), round(high, 4) FROM a WHERE metric = 'pr_auc'""")
def baseline_intervals(spark, folder):
    rows = _labelled(spark, folder)
    draws = B.label_draws(rows, "y", "pred", unit="l_suppkey").unionByName(B.ranking_draws(rows, "y", "proba", unit="l_suppkey"))
    bounds = B.bootstrap(draws, rows, unit="l_suppkey").select("metric", F.round("low", 4).alias("low"), F.round("high", 4).alias("high"))
    copies = bounds.where("metric = 'pr_auc'").withColumn("metric", F.lit("average_precision"))
    return bounds.unionByName(copies)


PAIRED_SQL = f"""{WITH_LINES}, {draws_sql('l_suppkey', 400)},
k AS (SELECT l_suppkey, flag AS y, flag_pred AS a, flag_pred_b AS b, count(*) AS n FROM base GROUP BY ALL),
c AS (SELECT -1 AS r, y, a, b, CAST(sum(n) AS DOUBLE) AS n FROM k GROUP BY ALL UNION ALL SELECT r, y, a, b, CAST(sum(n * w) AS DOUBLE) FROM k JOIN weights ON l_suppkey = u GROUP BY r, y, a, b),
m AS (SELECT r, 'a' AS side, y, a AS p, sum(n) AS n FROM c GROUP BY ALL UNION ALL SELECT r, 'b', y, b, sum(n) FROM c GROUP BY ALL),
t AS (SELECT r, side, class, sum(t) AS t, sum(p) AS p, sum(h) AS h FROM (SELECT r, side, y AS class, n AS t, 0 AS p, CASE WHEN y = p THEN n ELSE 0 END AS h FROM m UNION ALL SELECT r, side, p, 0, n, 0 FROM m) GROUP BY ALL),
s AS (SELECT r, side, sum(h) / sum(t) AS accuracy, avg(2 * h / (t + p)) AS f1, avg(CASE WHEN t > 0 THEN h / t END) AS balanced_accuracy FROM t GROUP BY ALL),
d AS (SELECT x.r, x.accuracy - z.accuracy AS accuracy, x.f1 - z.f1 AS f1, x.balanced_accuracy - z.balanced_accuracy AS balanced_accuracy FROM s x JOIN s z ON x.r = z.r AND x.side = 'a' AND z.side = 'b'),
l AS (SELECT r, 'accuracy' AS metric, accuracy AS v FROM d UNION ALL SELECT r, 'f1', f1 FROM d UNION ALL SELECT r, 'balanced_accuracy', balanced_accuracy FROM d)
SELECT metric, 'measured' AS status, round(max(v) FILTER (r = -1), 6) AS delta, round(quantile_cont(v, 0.025) FILTER (r >= 0), 6) AS low, round(quantile_cont(v, 0.975) FILTER (r >= 0), 6) AS high,
 round(avg(CASE WHEN v > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) FILTER (r >= 0), 4) AS p_better, count(v) FILTER (r >= 0) AS resamples FROM l GROUP BY metric"""


def _pair(spark, folder):
    lines = scored_lines(spark, folder)
    return lines.select("l_suppkey", F.col("flag").alias("y"), F.col("flag_pred").alias("pa"), F.col("flag_pred_b").alias("pb"), F.lit(False).alias("unpaired"))


@query("b3_paired_delta_groups", PAIRED_SQL)
def paired_groups(spark, folder):
    out = B.paired_delta(_pair(spark, folder), unit="l_suppkey", binary=False)
    return out.where("metric IN ('accuracy', 'f1', 'balanced_accuracy')").drop("reason")


DOC_PAIR = f"WITH base AS ({DOCS_SQL}), k AS (SELECT quality AS y, CASE WHEN proba >= 0.5 THEN 1 ELSE 0 END AS a, CASE WHEN proba_b >= 0.5 THEN 1 ELSE 0 END AS b FROM base)"


@query("b3_paired_observed", f"""{DOC_PAIR} SELECT 'accuracy' AS metric, 'measured' AS status, round(avg(CASE WHEN y = a THEN 1.0::DOUBLE ELSE 0.0 END) - avg(CASE WHEN y = b THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS delta FROM k""")
def paired_observed(spark, folder):
    rows = scored_docs(spark, folder)
    candidate = rows.select("doc_id", "quality", (F.col("proba") >= 0.5).cast("int").alias("pred"))
    baseline = rows.select("doc_id", (F.col("proba_b") >= 0.5).cast("int").alias("pred"))
    paired = B.pair_predictions(candidate, baseline, ["doc_id"], "quality", "pred")
    return B.paired_delta(paired).where("metric = 'accuracy'").select("metric", "status", "delta")


# --- goals ------------------------------------------------------------------------

# Baseline scores per supplier: measured balanced accuracy, f1, roc_auc and mae with chance and bounds.
BASE_SQL = f"""{LINES_RANK}, b AS ({BINARY_SQL.format(base=WITH_LINES, by="l_suppkey,", where="")}), e AS (SELECT l_suppkey, avg(abs(amount - amount_pred)) AS mae, stddev_pop(amount) AS sd FROM base GROUP BY l_suppkey),
s AS (SELECT l_suppkey, 'balanced_accuracy' AS metric, balanced_accuracy AS baseline, 0.5 AS chance, round(ks, 6) AS ks, balanced_accuracy - 0.05 AS low, balanced_accuracy + 0.2 AS high FROM b JOIN r USING (l_suppkey) UNION ALL
SELECT l_suppkey, 'f1', f1, 0.66, NULL, f1 - 0.1, f1 + 0.1 FROM b UNION ALL SELECT l_suppkey, 'roc_auc', round(auc, 6), 0.5, NULL, NULL, NULL FROM r UNION ALL
SELECT l_suppkey, 'mae', round(mae, 4), round(mae * 0.7, 4), NULL, NULL, NULL FROM e)"""


def baseline_scores(spark, folder):
    rows, by = scored_lines(spark, folder), ["l_suppkey"]
    b = binary_scores(rows, by)
    r = K.ranking(rows, "y", "proba", by)
    e = M.regression_scores(rows, "amount", "amount_pred", by)
    none = "CAST(NULL AS DOUBLE)"
    ba = b.join(r, "l_suppkey").selectExpr("l_suppkey", "'balanced_accuracy' AS metric", "balanced_accuracy AS baseline", "0.5D AS chance", "round(ks, 6) AS ks", "balanced_accuracy - 0.05D AS low", "balanced_accuracy + 0.2D AS high")
    f1 = b.selectExpr("l_suppkey", "'f1' AS metric", "f1 AS baseline", "0.66D AS chance", f"{none} AS ks", "f1 - 0.1D AS low", "f1 + 0.1D AS high")
    auc = r.selectExpr("l_suppkey", "'roc_auc' AS metric", "round(roc_auc, 6) AS baseline", "0.5D AS chance", f"{none} AS ks", f"{none} AS low", f"{none} AS high")
    mae = e.selectExpr("l_suppkey", "'mae' AS metric", "round(mae, 4) AS baseline", "round(mae * 0.7D, 4) AS chance", f"{none} AS ks", f"{none} AS low", f"{none} AS high")
    return ba.unionByName(f1).unionByName(auc).unionByName(mae)


BAR_SQL = BASE_SQL + """, t AS (SELECT *, CASE WHEN metric = 'mae' THEN greatest(0, baseline * 0.75) ELSE least(baseline + (1.0 - baseline) * 0.25, 0.99) END AS t0 FROM s),
u AS (SELECT *, CASE WHEN metric = 'mae' THEN least(t0, chance * 0.98) ELSE greatest(t0, chance + 0.02) END AS t1, CASE WHEN metric = 'balanced_accuracy' THEN round((1 + ks) / 2, 4) END AS ceiling FROM t),
v AS (SELECT *, round(CASE WHEN ceiling > t1 THEN least(ceiling, 0.99) ELSE t1 END, 4) AS threshold FROM u)"""


@query("g1_auto_bars", BAR_SQL + " SELECT l_suppkey, metric, threshold, metric <> 'mae' AND t0 < chance + 0.02 AS raised, metric = 'mae' AND t0 > chance * 0.98 AS lowered FROM v WHERE metric <> 'balanced_accuracy'")
def auto_bars(spark, folder):
    out = G.derive_bars(baseline_scores(spark, folder).where("metric <> 'balanced_accuracy'"))
    return out.select("l_suppkey", "metric", "threshold", F.col("raised_to_clear_chance").alias("raised"), F.col("lowered_to_clear_chance").alias("lowered"))


@query("g2_ranking_floor", BAR_SQL + " SELECT l_suppkey, threshold, ceiling > t1 AS raised FROM v WHERE metric = 'balanced_accuracy'")
def ranking_floor(spark, folder):
    out = G.derive_bars(baseline_scores(spark, folder).where("metric = 'balanced_accuracy'"))
    return out.select("l_suppkey", "threshold", F.col("raised_to_ranking_floor").alias("raised"))


@query("g3_bar_notes", BAR_SQL + """ SELECT l_suppkey, metric, coalesce(threshold > ceiling, false) AS exceeds_ranking_ceiling, CASE WHEN threshold > ceiling THEN round(2.0 * threshold - 1.0, 4) END AS required_ks,
 CASE WHEN threshold > ceiling THEN round(round(2.0 * threshold - 1.0, 4) - round(ks, 4), 4) END AS ks_shortfall, metric <> 'mae' AND threshold > 0.99 AS exceeds_ceiling, coalesce(threshold BETWEEN low AND high, false) AS inside_baseline_ci FROM v""")
def bar_notes(spark, folder):
    out = G.derive_bars(baseline_scores(spark, folder))
    return out.select("l_suppkey", "metric", "exceeds_ranking_ceiling", "required_ks", "ks_shortfall", "exceeds_ceiling", "inside_baseline_ci")


# One request per supplier: asked metric, task, mode and sometimes a threshold, all from its key.
REQUEST_SQL = """q AS (SELECT s_suppkey, CASE WHEN s_nationkey % 2 = 0 THEN 'regression' ELSE 'classification' END AS task,
 CASE s_suppkey % 5 WHEN 0 THEN 'f1' WHEN 1 THEN 'rmse' WHEN 2 THEN 'balanced_accuracy' WHEN 3 THEN 'mae' ELSE 'custom' END AS asked,
 CASE WHEN s_suppkey % 3 = 0 THEN 0.9 END AS given, CASE WHEN s_suppkey % 4 = 1 THEN 'fixed' ELSE 'auto' END AS mode FROM supplier)"""


@query("g4_resolve_goals", f"WITH {REQUEST_SQL}, " + """
w AS (SELECT *, CASE WHEN asked IN ('f1', 'balanced_accuracy') THEN 'classification' WHEN asked IN ('rmse', 'mae') THEN 'regression' END AS own FROM q),
x AS (SELECT *, CASE WHEN own IS NULL OR own = task THEN asked WHEN task = 'regression' THEN 'r2' ELSE 'f1' END AS metric FROM w),
y AS (SELECT s_suppkey, metric, CASE WHEN metric <> asked THEN asked END AS substituted_from, CASE WHEN metric = asked THEN given END AS given, mode,
  CASE metric WHEN 'f1' THEN 0.85 WHEN 'balanced_accuracy' THEN 0.8 WHEN 'r2' THEN 0.8 WHEN 'custom' THEN 0.85 END AS bar FROM x)
SELECT s_suppkey, metric, CASE WHEN metric IN ('mae', 'rmse') THEN 'minimize' ELSE 'maximize' END AS direction, substituted_from,
 CASE WHEN given IS NOT NULL OR mode = 'fixed' THEN 'fixed' ELSE 'auto' END AS mode, CAST(coalesce(given, bar) AS DOUBLE) AS threshold,
 CASE WHEN given IS NOT NULL THEN 'fixed' WHEN mode = 'fixed' AND bar IS NOT NULL THEN 'fixed_default' WHEN mode = 'fixed' OR bar IS NULL THEN 'unset' ELSE 'fallback' END AS source FROM y""")
def resolve_goals(spark, folder):
    k = F.col("s_suppkey")
    asked = F.when(k % 5 == 0, "f1").when(k % 5 == 1, "rmse").when(k % 5 == 2, "balanced_accuracy").when(k % 5 == 3, "mae").otherwise("custom")
    requests = table(spark, folder, "supplier").select(
        "s_suppkey", F.when(F.col("s_nationkey") % 2 == 0, fixed.REGRESSION).otherwise(fixed.CLASSIFICATION).alias("task"), asked.alias("metric"),
        F.when(k % 3 == 0, F.lit(0.9)).alias("given"), F.when(k % 4 == 1, "fixed").otherwise("auto").alias("mode"))
    # No baseline was measured for these: every auto bar falls back.
    none = requests.where("false").select("s_suppkey", "metric", F.lit(None).cast("double").alias("baseline"))
    return G.resolve_goals(requests, none, ["s_suppkey"])


@query("g5_goal_met", BAR_SQL + """ SELECT l_suppkey, metric, coalesce(CASE WHEN l_suppkey % 10 = 0 THEN false WHEN metric = 'mae' THEN baseline <= threshold ELSE baseline + 0.2 >= threshold END, false) AS met FROM v""")
def goal_met(spark, folder):
    bars = G.derive_bars(baseline_scores(spark, folder))
    direction = F.when(F.col("metric") == "mae", fixed.MINIMIZE).otherwise(fixed.MAXIMIZE)
    score = F.when(F.col("metric") == "mae", F.col("baseline")).otherwise(F.col("baseline") + 0.2)
    status = F.when(F.col("l_suppkey") % 10 == 0, "error").otherwise("ok")
    return bars.select("l_suppkey", "metric", G.goal_met(score, F.col("threshold"), direction, status).alias("met"))
