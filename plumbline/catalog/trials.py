"""Named queries over a trial table derived from the line items: a run per order, an attempt per line number."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline import fixed
from plumbline.catalog import query
from plumbline.operators import bootstrap as B
from plumbline.operators import policy as P
from plumbline.operators import trials as T
from plumbline.plans import fits as M
from plumbline.session import table

# Lines of one order and line number become one attempt: at most seven attempts per run.
_TRIALS = """
SELECT run, iteration, CASE s % 4 WHEN 0 THEN 'logreg' WHEN 1 THEN 'hist_gbdt' WHEN 2 THEN 'random_forest' ELSE 'decision_tree' END AS model,
 CASE run % 3 WHEN 0 THEN 'rmse' WHEN 1 THEN 'balanced_accuracy' ELSE 'f1' END AS metric,
 CASE run % 3 WHEN 0 THEN 'minimize' ELSE 'maximize' END AS direction, CASE run % 3 WHEN 0 THEN 0.5{d} ELSE 0.8{d} END AS bar,
 CASE WHEN p % 11 = 0 THEN NULL ELSE (40 + (q * 7 + p * 3) % 50) / 100.0{d} END AS score,
 CASE WHEN p % 11 = 0 THEN 'error' ELSE 'ok' END AS status,
 CASE WHEN p % 11 = 0 THEN CASE p % 5 WHEN 0 THEN 'oom' WHEN 1 THEN 'too_slow' WHEN 2 THEN 'config_error' WHEN 3 THEN 'unsupported_model' ELSE 'crash' END END AS error_type,
 (30 + (p * 7) % 60) / 100.0{d} AS recall, (35 + (s * 11 + q) % 60) / 100.0{d} AS specificity, (55 + (s * 3 + q) % 40) / 100.0{d} AS roc_auc,
 CASE WHEN p % 13 = 0 THEN NULL ELSE ((p + q) % 20) / 1000.0{d} END AS headroom, (50 + (p * 5 + s) % 45) / 100.0{d} AS ceiling,
 CASE WHEN s % 9 = 0 THEN NULL ELSE (45 + (q * 7 + p * 5) % 50) / 100.0{d} END AS train_score, CAST(NULL AS DOUBLE) AS train_val_gap,
 1.0{d} + (p % 4) * 0.5{d} AS weight, 2.5{d} AS imbalance, CASE p % 3 WHEN 0 THEN 'median' WHEN 1 THEN 'mean' ELSE 'none' END AS pipeline,
 p % 2 AS depth, s % 5 = 0 AS tuned, 100.0{d} + (p % 9) * 150 AS wall_sec
FROM (SELECT l_orderkey AS run, l_linenumber AS iteration, CAST(sum(l_quantity) AS BIGINT) AS q, max(l_partkey) AS p, max(l_suppkey) AS s
      FROM {lines} GROUP BY l_orderkey, l_linenumber) AS g"""
TRIALS_SQL = _TRIALS.format(d="::DOUBLE", lines="lineitem")
W = f"WITH t AS ({TRIALS_SQL})"


def trials(spark, folder):
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_partkey", "l_suppkey")
    rows = spark.sql(_TRIALS.format(d="D", lines="{lines}"), lines=T.by_run(lines, "l_orderkey"))
    return rows.withColumn("params", F.expr("map('depth', CAST(depth AS STRING), 'weight', CAST(CAST(weight * 10 AS INT) AS STRING))"))


BEFORE = "OVER (PARTITION BY run ORDER BY iteration ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
BEST = f"""b AS (SELECT *, CASE WHEN score IS NULL THEN false WHEN previous_best IS NULL THEN true WHEN direction = 'minimize' THEN score < previous_best ELSE score > previous_best END AS improved,
 round(score - previous_best, 6) AS delta FROM (SELECT *, CASE WHEN direction = 'minimize' THEN min(score) {BEFORE} ELSE max(score) {BEFORE} END AS previous_best FROM t))"""
STALL = """i AS (SELECT *, sum(CASE WHEN improved THEN 1 ELSE 0 END) OVER (PARTITION BY run ORDER BY iteration) AS island FROM b),
st AS (SELECT *, CAST(CASE WHEN island = 0 THEN row_number() OVER w ELSE row_number() OVER w - 1 END AS INTEGER) AS stall_count FROM i WINDOW w AS (PARTITION BY run, island ORDER BY iteration))"""


@query("t1_best_so_far", f"{W}, {BEST} SELECT run, iteration, score, previous_best, improved, delta FROM b")
def best(spark, folder):
    return T.best_so_far(trials(spark, folder)).select("run", "iteration", "score", "previous_best", "improved", "delta")


@query("t2_stall_count", f"{W}, {BEST}, {STALL} SELECT run, iteration, improved, stall_count FROM st")
def stall(spark, folder):
    return T.stalls(trials(spark, folder)).select("run", "iteration", "improved", "stall_count")


@query("t3_stop_reason", f"""{W}, {BEST}, {STALL}, r AS (SELECT run, iteration, CASE WHEN score IS NOT NULL AND CASE WHEN direction = 'minimize' THEN score <= bar ELSE score >= bar END THEN 'goal_reached'
 WHEN iteration >= 5 THEN 'max_iterations' WHEN stall_count >= 2 THEN 'stalled' WHEN 1500 * 0.9 - sum(wall_sec) OVER (PARTITION BY run ORDER BY iteration) <= 0 THEN 'out_of_time' END AS reason FROM st)
SELECT run, min(iteration) FILTER (reason IS NOT NULL) AS stopped_at, min_by(reason, iteration) FILTER (reason IS NOT NULL) AS reason, count(*) AS attempts FROM r GROUP BY run""")
def stop_reason(spark, folder):
    return T.stop_reasons(trials(spark, folder), total_sec=1500.0)


DIAG = f"""s0 AS (SELECT *, coalesce(score, CASE WHEN direction = 'minimize' THEN bar ELSE 0 END) AS s, score IS NOT NULL AND CASE WHEN direction = 'minimize' THEN score <= bar ELSE score >= bar END AS cleared,
   (SELECT min(h.iteration) FROM t h WHERE h.run = t.run AND h.iteration < t.iteration AND h.score - coalesce(t.score, CASE WHEN t.direction = 'minimize' THEN t.bar ELSE 0 END) > {fixed.METRIC_DROP} AND t.roc_auc >= h.roc_auc - {fixed.RANKING_TOLERANCE}) AS collapse_of,
   (SELECT count(*) FROM t h WHERE h.run = t.run AND h.iteration < t.iteration AND h.model = t.model) AS same FROM t),
s1 AS (SELECT *, CASE WHEN direction = 'minimize' THEN s - train_score ELSE train_score - s END AS gap FROM s0),
dg AS (SELECT *, CASE WHEN status = 'error' THEN 'error' WHEN CASE WHEN metric = 'rmse' THEN train_score > 0 AND gap > train_score * 0.25 ELSE gap > 0.15 END THEN 'overfit'
  WHEN collapse_of IS NOT NULL THEN 'collapse' WHEN metric = 'balanced_accuracy' AND coalesce(headroom >= 0.005, true) AND abs(recall - specificity) >= 0.08 THEN 'skew'
  WHEN NOT cleared AND CASE WHEN direction = 'minimize' THEN train_score > bar * 1.05 ELSE train_score < bar - 0.05 END THEN 'underfit' WHEN same >= 2 THEN 'plateau'
  WHEN metric = 'balanced_accuracy' AND headroom < 0.005 AND ceiling < bar THEN 'ranking_limited' WHEN cleared THEN 'cleared' ELSE 'other' END AS rule FROM s1),
df AS (SELECT *, CASE rule WHEN 'error' THEN CASE error_type WHEN 'oom' THEN 'oom' WHEN 'too_slow' THEN 'too_slow' WHEN 'config_error' THEN 'data_issue' WHEN 'unsupported_model' THEN 'wrong_model_family' ELSE 'unknown' END
  WHEN 'overfit' THEN 'overfitting' WHEN 'collapse' THEN 'data_issue' WHEN 'underfit' THEN 'underfitting' WHEN 'plateau' THEN 'wrong_model_family' WHEN 'ranking_limited' THEN 'wrong_model_family' ELSE 'hyperparam' END AS failure_type FROM dg)"""


@query("t6_diagnosis", f"{W}, {DIAG} SELECT run, iteration, rule, failure_type, CASE WHEN rule <> 'none' THEN collapse_of END AS collapse_of FROM df")
def diagnosis(spark, folder):
    return T.diagnose(trials(spark, folder)).select("run", "iteration", "rule", "failure_type", "collapse_of")


LEDGER = f"""bl AS (SELECT b.*, failure_type FROM b JOIN df USING (run, iteration)), l0 AS (SELECT *, lag(failure_type) OVER (PARTITION BY run ORDER BY iteration) AS prescription FROM bl),
lb AS (SELECT l0.*, CASE WHEN prescription IS NOT NULL THEN improved END AS paid, (SELECT max(h.iteration) FROM t h WHERE h.run = l0.run AND h.iteration < l0.iteration AND h.status <> 'error') AS built FROM l0)"""


@query("t4_ledger", f"""{W}, {BEST}, {DIAG}, {LEDGER}
SELECT lb.run, lb.iteration, lb.model, lb.delta, lb.improved, lb.prescription, lb.paid, CASE WHEN lb.status <> 'error' AND h.pipeline <> lb.pipeline THEN CASE WHEN h.model <> lb.model THEN 'with_family'
  WHEN h.depth = lb.depth AND h.weight = lb.weight THEN 'alone' ELSE 'with_params' END END AS pipeline_move FROM lb LEFT JOIN t h ON h.run = lb.run AND h.iteration = lb.built""")
def ledger(spark, folder):
    t = trials(spark, folder).withColumn("params", F.expr("concat(depth, '/', CAST(weight * 10 AS INT))"))
    return T.ledger(t).select("run", "iteration", "model", "delta", "improved", "prescription", "paid", "pipeline_move")


@query("t4_family_spend", f"{W} SELECT run, model, count(*) AS attempts, CASE WHEN any_value(direction) = 'minimize' THEN min(score) ELSE max(score) END AS best FROM t GROUP BY run, model")
def family_spend(spark, folder):
    return T.family_spend(trials(spark, folder))


@query("t4_wasted_prescriptions", f"{W}, {BEST}, {DIAG}, {LEDGER} SELECT run, prescription, count(*) AS times FROM lb WHERE prescription IS NOT NULL GROUP BY ALL HAVING NOT bool_or(paid)")
def wasted(spark, folder):
    t = trials(spark, folder).withColumn("params", F.expr("concat(depth, '/', CAST(weight * 10 AS INT))"))
    return T.wasted_prescriptions(T.ledger(t))


@query("t5_cut_lever", f"{W} SELECT run, iteration, round(bar - score, 6) AS shortfall, round(headroom / (bar - score), 6) AS cut_share FROM t WHERE metric = 'balanced_accuracy' AND headroom IS NOT NULL AND bar - score > 0")
def cut_lever(spark, folder):
    return T.cut_lever(trials(spark, folder))


@query("t5_ceiling_spread", f"{W}, f AS (SELECT run, model, max(ceiling) AS c, max(bar) AS bar FROM t WHERE metric = 'balanced_accuracy' GROUP BY ALL), g AS (SELECT run, count(*) AS families, min(c) AS low, max(c) AS high, max(bar) AS bar FROM f GROUP BY run) SELECT run, families, low, high, round(high - low, 6) AS span, round(bar - high, 6) AS shortfall FROM g WHERE families >= 2 AND bar - high > 0")
def ceiling_spread(spark, folder):
    return T.ceiling_spread(trials(spark, folder))


CLAMP = "round(least(greatest({0}, 0.001), 1000), 3)"


# The points nearest to no skew, the earliest attempt on ties: compared in turn, since one packed number would lose digits of the skew.
WEIGHTS = f"""p AS (SELECT a.run, a.iteration, a.weight, a.recall - a.specificity AS skew, a.imbalance, h.weight AS hw, h.recall - h.specificity AS hs, h.iteration AS hi
  FROM df a JOIN t h ON h.run = a.run AND h.model = a.model AND h.iteration <= a.iteration WHERE a.rule = 'skew'),
x AS (SELECT run, iteration, weight, skew, imbalance, min_by(hw, {{'skew': hs, 'i': hi}}) FILTER (hs > 0) AS aw, min(hs) FILTER (hs > 0) AS ahs, max_by(hw, {{'skew': hs, 'i': -hi}}) FILTER (hs < 0) AS bw, max(hs) FILTER (hs < 0) AS bhs FROM p GROUP BY ALL),
y AS (SELECT run, iteration, weight, {CLAMP.format('bw + (aw - bw) * (-bhs) / (ahs - bhs)')} AS crossing, {CLAMP.format("CASE WHEN skew < 0 AND weight = 1 THEN greatest(1.5, imbalance) WHEN skew < 0 THEN weight * 1.5 ELSE weight / 1.5 END")} AS step, bw < aw AS bracket FROM x)
SELECT run, iteration, CASE WHEN bracket AND crossing <> {CLAMP.format('weight')} THEN crossing ELSE step END AS proposed_weight FROM y"""


@query("t7_weight_search", f"{W}, {DIAG}, {WEIGHTS}")
def weight_search(spark, folder):
    return T.propose_weight(trials(spark, folder)).where("rule = 'skew'").select("run", "iteration", "proposed_weight")


ORDER = T.candidate_order(fixed.CLASSIFICATION)


@query("t8_novelty", f"""{W}, m AS (SELECT run, max(iteration) AS last FROM t GROUP BY run), p AS (SELECT t.* FROM t JOIN m ON t.run = m.run AND t.iteration = m.last), h AS (SELECT t.* FROM t JOIN m ON t.run = m.run AND t.iteration < m.last),
c(model, pos) AS (VALUES {', '.join(f"('{m}', {i})" for i, m in enumerate(ORDER))}),
r AS (SELECT p.run, p.model, EXISTS (SELECT 1 FROM h WHERE h.run = p.run AND h.model = p.model AND h.depth = p.depth AND h.weight = p.weight AND h.pipeline = p.pipeline AND h.tuned = p.tuned) AS repeated FROM p)
SELECT run, repeated, CASE WHEN repeated THEN (SELECT min_by(c.model, pos) FROM c WHERE c.model NOT IN (SELECT h.model FROM h WHERE h.run = r.run)) ELSE model END AS next_model FROM r""")
def novelty(spark, folder):
    t = trials(spark, folder).withColumn("last", F.expr("max(iteration) OVER (PARTITION BY run)"))
    plans, history = t.where("iteration = last"), t.where("iteration < last")
    return T.novelty(plans, history).select("run", "repeated", "next_model")


@query("t8_next_family", f"""{W}, f AS (SELECT DISTINCT run, CASE model WHEN 'logreg' THEN 'linear' WHEN 'hist_gbdt' THEN 'gbdt' WHEN 'random_forest' THEN 'bagging' ELSE 'tree' END AS f FROM t),
c(f, pos) AS (VALUES {', '.join(f"('{f}', {i})" for i, f in enumerate(fixed.FAMILY_ROTATION))}), r AS (SELECT DISTINCT run FROM t)
SELECT run, coalesce((SELECT min_by(c.f, pos) FROM c WHERE c.f NOT IN (SELECT f.f FROM f WHERE f.run = r.run)), 'gbdt') AS family FROM r""")
def next_family(spark, folder):
    return T.next_family(trials(spark, folder))


@query("t9_budget", f"""{W}, s AS (SELECT run, iteration, coalesce(sum(wall_sec) {BEFORE}, 0) AS spent_before FROM t)
SELECT run, iteration, spent_before, 1500 * 0.9::DOUBLE - spent_before AS loop_remaining, round(CASE WHEN 1350 - spent_before <= 0 THEN (1350 - spent_before) / greatest(1, 5 - iteration + 1) ELSE greatest(1, (1350 - spent_before) / greatest(1, 5 - iteration + 1)) END, 6) AS fit_share FROM s""")
def budget(spark, folder):
    return T.budget(trials(spark, folder), total_sec=1500.0).select("run", "iteration", "spent_before", "loop_remaining", F.round("fit_share", 6).alias("fit_share"))


@query("t10_report_counts", f"""{W}, {DIAG}, c AS (SELECT run, failure_type, count(*) AS n, min(iteration) AS first FROM df GROUP BY ALL), d AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY n DESC, first) AS r FROM c)
SELECT run, string_agg(failure_type || '=' || n, ',' ORDER BY failure_type || '=' || n) AS diagnoses, max(failure_type) FILTER (r = 1) AS dominant, CAST(sum(n) AS BIGINT) AS attempts FROM d GROUP BY run""")
def report_counts(spark, folder):
    return T.report_counts(T.diagnose(trials(spark, folder)))


@query("b4_inside_interval", f"{W} SELECT a.run, a.iteration, a.score - 0.05 AS low, a.score + 0.05 AS high, h.iteration AS other, h.score AS other_score FROM t a JOIN t h ON a.run = h.run AND h.iteration < a.iteration AND h.score BETWEEN a.score - 0.05 AND a.score + 0.05")
def inside_interval(spark, folder):
    t = trials(spark, folder).withColumn("low", F.expr("score - 0.05D")).withColumn("high", F.expr("score + 0.05D"))
    return B.inside(t, t, "run")


# Available families per nation's customers: their segment plays the family asked for.
@query("f14_candidates", f"""
WITH k(family, model, pos) AS (VALUES {', '.join(f"('{c[2]}', '{c[1]}', {ORDER.index(c[1])})" for c in fixed.CANDIDATES if c[0] == fixed.CLASSIFICATION and c[1] in ORDER)}),
q AS (SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'gbdt' WHEN 'MACHINERY' THEN 'bagging' WHEN 'HOUSEHOLD' THEN 'linear' WHEN 'AUTOMOBILE' THEN 'tree' ELSE 'neural' END AS family FROM customer)
SELECT c_custkey, family, (SELECT min_by(model, pos) FROM k WHERE k.family = q.family) AS model FROM q""")
def candidates(spark, folder):
    pick = T.cheapest(["gbdt", "bagging", "linear", "tree", "neural"], fixed.CLASSIFICATION)
    cases = " ".join(f"WHEN '{f}' THEN '{m}'" for f, m in pick.items())
    rows = table(spark, folder, "customer").selectExpr(
        "c_custkey", "CASE c_mktsegment WHEN 'BUILDING' THEN 'gbdt' WHEN 'MACHINERY' THEN 'bagging' WHEN 'HOUSEHOLD' THEN 'linear' WHEN 'AUTOMOBILE' THEN 'tree' ELSE 'neural' END AS family")
    return rows.withColumn("model", F.expr(f"CASE family {cases} END"))


# The next attempt of every run after its last one. Parameters are columns in the twin, one per name that a rule can set.
NAMES = ("max_depth", "max_iter", "learning_rate", "n_estimators", "max_leaf_nodes", "l2_regularization", "train_subsample", "class_weight")
_SET = {
    "max_depth": "WHEN 'overfitting' THEN '4' WHEN 'hyperparam' THEN ['8', '5', '12'][(iteration - 1) % 3 + 1] WHEN 'unknown' THEN ['6', '8', '12'][(iteration + 1) % 3 + 1]",
    "max_iter": "WHEN 'oom' THEN CASE WHEN cost >= 3 THEN '300' ELSE '80' END WHEN 'too_slow' THEN '60' WHEN 'underfitting' THEN CAST(least(1200, greatest(200, 3 * rounds)) AS VARCHAR) "
                "WHEN 'hyperparam' THEN ['400', '800', '250'][(iteration - 1) % 3 + 1] WHEN 'unknown' THEN '400' WHEN 'wrong_model_family' THEN CASE WHEN new_family = 'linear' THEN '300' ELSE '' END",
    "learning_rate": "WHEN 'underfitting' THEN '0.08' WHEN 'overfitting' THEN '0.05' WHEN 'hyperparam' THEN ['0.05', '0.02', '0.12'][(iteration - 1) % 3 + 1] "
                     "WHEN 'unknown' THEN ['0.03', '0.05', '0.15'][(iteration + 1) % 3 + 1]",
    "n_estimators": "WHEN 'oom' THEN '50' WHEN 'wrong_model_family' THEN CASE WHEN new_family = 'linear' THEN '' ELSE '300' END",
    "max_leaf_nodes": "WHEN 'underfitting' THEN '63'", "l2_regularization": "WHEN 'overfitting' THEN '1.0'",
    "train_subsample": "WHEN 'oom' THEN '0.5' WHEN 'too_slow' THEN '0.4'", "class_weight": "WHEN 'data_issue' THEN 'balanced'",
}
_OWN = {"max_depth": "CAST(2 + depth AS VARCHAR)", "max_iter": "CAST(rounds AS VARCHAR)"}
_ROWS = "SELECT *, 100 + (CAST(weight * 2 AS INTEGER) % 3) * 50 AS rounds FROM t"


def _entry(name):
    """A parameter of the plan: what the rule sets, else what the last attempt had, else ''."""
    own = _OWN.get(name, "''")
    kept = f"CASE WHEN failure_type = 'wrong_model_family' AND proposed IS NULL THEN '' WHEN failure_type IN ('oom', 'too_slow') AND '{name}' = 'max_iter' THEN '' ELSE {own} END"
    ruled = f"coalesce(CASE failure_type {_SET[name]} END, {kept})"
    weighed = "'{\"0\": 1, \"1\": ' || CAST(proposed AS VARCHAR) || '}'" if name == "class_weight" else own
    return f"CASE WHEN proposed IS NOT NULL THEN {weighed} ELSE {ruled} END"


def _signature(model, entry):
    """The entries that the model's trainer takes, as text."""
    cases = " ".join(f"WHEN '{m}' THEN {' || chr(1) || '.join(entry(n) for n in NAMES if n in M.PARAMS[m] or n == 'train_subsample')}" for m in ORDER)
    return f"CASE {model} {cases} END"


NEXT_SQL = f"""{W}, {DIAG}, w AS ({{weights}}),
fam(model, family, cost, pos) AS (VALUES {', '.join(f"('{c[1]}', '{c[2]}', {c[3]}, {ORDER.index(c[1]) if c[1] in ORDER else 99})" for c in fixed.CANDIDATES if c[0] == fixed.CLASSIFICATION)}),
rot(family, pos) AS (VALUES {', '.join(f"('{f}', {i})" for i, f in enumerate(fixed.FAMILY_ROTATION) if f != 'kernel' or 'svc' in ORDER)}),
rw AS ({_ROWS}), lastrow AS (SELECT run, max(iteration) AS iteration FROM t GROUP BY run),
a AS (SELECT df.run, df.iteration, df.failure_type, df.model, df.pipeline, df.tuned, df.depth, rw.rounds, fam.family AS own_family, fam.cost, w.proposed_weight AS proposed,
  coalesce((SELECT min_by(rot.family, rot.pos) FROM rot WHERE rot.family IN (SELECT f.family FROM fam f WHERE f.pos < 99)
            AND rot.family NOT IN (SELECT f.family FROM t h JOIN fam f ON f.model = h.model WHERE h.run = df.run)), 'gbdt') AS new_family
  FROM lastrow JOIN df USING (run, iteration) JOIN rw USING (run, iteration) JOIN fam ON fam.model = df.model LEFT JOIN w USING (run, iteration)),
b AS (SELECT *, CASE WHEN failure_type IN ('oom', 'too_slow') THEN CASE WHEN cost >= 3 THEN 'linear' ELSE 'tree' END WHEN failure_type = 'wrong_model_family' THEN new_family ELSE own_family END AS family FROM a),
c AS (SELECT b.*, (SELECT min_by(f.model, f.pos) FROM fam f WHERE f.family = b.family AND f.pos < 99) AS plan_model, {', '.join(f'{_entry(n)} AS p_{n}' for n in NAMES)} FROM b),
e AS (SELECT c.*, EXISTS (SELECT 1 FROM rw h WHERE h.run = c.run AND h.model = c.plan_model AND h.pipeline = c.pipeline AND h.tuned = c.tuned
        AND {_signature('h.model', lambda n: {'max_depth': 'CAST(2 + h.depth AS VARCHAR)', 'max_iter': 'CAST(h.rounds AS VARCHAR)'}.get(n, "''"))} = {_signature('c.plan_model', lambda n: f'c.p_{n}')}) AS repeated FROM c),
g AS (SELECT e.*, (SELECT min_by(f.model, f.pos) FROM fam f WHERE f.pos < 99 AND f.model NOT IN (SELECT h.model FROM t h WHERE h.run = e.run)) AS untried FROM e)
SELECT run, iteration + 1 AS iteration, failure_type AS answers, CASE WHEN repeated AND untried IS NULL THEN 'new_rounds' WHEN repeated THEN 'new_model' WHEN proposed IS NOT NULL THEN 'weight' ELSE failure_type END AS origin,
 CASE WHEN repeated THEN coalesce(untried, plan_model) ELSE plan_model END AS model, repeated, {', '.join(f"nullif(p_{n}, '') AS {n}" for n in NAMES)} FROM g"""


@query("t6_next_attempt", NEXT_SQL.replace("{weights}", "WITH " + WEIGHTS))
def next_attempt(spark, folder):
    rows = trials(spark, folder).withColumn("params", F.expr(
        "map('max_depth', CAST(2 + depth AS STRING), 'max_iter', CAST(100 + (CAST(weight * 2 AS INT) % 3) * 50 AS STRING))"))
    plans = P.next_attempts(rows, M.PARAMS)
    return plans.select("run", "iteration", "answers", "origin", "model", "repeated", *[F.expr(f"try_element_at(params, '{n}')").alias(n) for n in NAMES])
