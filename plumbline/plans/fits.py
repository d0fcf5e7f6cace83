"""Model families as pyspark.ml estimators, with parameters that mean the same penalties."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    DecisionTreeClassifier, GBTClassifier, LinearSVC, LogisticRegression,
    MultilayerPerceptronClassifier, OneVsRest, RandomForestClassifier,
)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline import fixed
from plumbline.session import small_side

# The parameters each family takes here; anything else is dropped and listed.
TREE = {"max_depth": "maxDepth", "min_samples_leaf": "minInstancesPerNode"}
PARAMS = {
    "logreg": {"C", "max_iter", "class_weight"}, "ridge": {"alpha"}, "linreg": set(),
    "elasticnet": {"alpha", "l1_ratio", "max_iter"}, "decision_tree": {*TREE, "class_weight"},
    "random_forest": {*TREE, "n_estimators", "class_weight"},
    "hist_gbdt": {*TREE, "max_iter", "learning_rate", "class_weight", "early_stopping"},
    "gradient_boosting": {*TREE, "n_estimators", "learning_rate", "subsample"},
    "xgboost": {*TREE, "n_estimators", "learning_rate", "subsample", "scale_pos_weight", "early_stopping_rounds"},
    "mlp": {"max_iter", "hidden_layer_sizes"}, "svc": {"C", "class_weight"},
}
MAX_DEPTH = 30
# Limits that families have here where no parameter is given; they are part of what was applied.
DEFAULTS = {
    "decision_tree": {"max_depth": MAX_DEPTH}, "random_forest": {"max_depth": 12, "n_estimators": 300}, "svc": {"max_iter": 100},
    "hist_gbdt": {"max_depth": 5}, "gradient_boosting": {"max_depth": 5}, "xgboost": {"max_depth": 5},
}


class UnsupportedModel(ValueError):
    """A model name without an estimator here."""


@dataclass
class Fit:
    """A fitted family: the pipeline, what was applied and what was dropped."""

    model: PipelineModel
    name: str
    task: str
    features: list[str]
    applied: dict
    dropped: list[str] = field(default_factory=list)
    held_rows: int = 0

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds ``pred`` and, where the family has one, ``proba`` (binary) and ``probas``."""
        out = self.model.transform(df)
        cols = [c for c in out.columns if c not in ("features", "rawPrediction", "probability", "prediction")]
        pred = F.col("prediction") if self.task == fixed.REGRESSION else F.col("prediction").cast("bigint")
        extra = []
        if "probability" in out.columns:
            extra = [vector_to_array("probability").alias("probas"), vector_to_array("probability")[1].alias("proba")]
        return out.select(*cols, pred.alias("pred"), *extra)


def resolve_name(name: str, task: str) -> str:
    """Canonical model name; a name of the other task or without a counterpart here is refused."""
    asked = str(name).strip().lower().replace("-", "_")
    key = fixed.MODEL_ALIASES[task].get(str(name).strip().lower(), fixed.MODEL_ALIASES[task].get(asked, asked))
    if not any(c[0] == task and c[1] == key for c in fixed.CANDIDATES):
        raise UnsupportedModel(f"unsupported model {name!r} for {task}")
    if (task, key) in fixed.UNAVAILABLE or key == "knn":
        raise UnsupportedModel(f"model {name!r} has no estimator here")
    return key


def resolve_params(name: str, params: dict | None) -> tuple[dict, list[str]]:
    """Canonical parameters inside their limits, and the names that do not apply."""
    aliases = fixed.PARAM_ALIASES.get(name, {})
    kept, dropped = {}, []
    for key, value in (params or {}).items():
        key = aliases.get(key, key)
        if key not in PARAMS[name]:
            dropped.append(key)
            continue
        if isinstance(value, (int, float)) and not isinstance(value, bool):
            low, high = fixed.PARAM_LIMITS.get(key, fixed.PARAM_LIMIT_DEFAULT)
            clamped = min(max(value, low), high)
            value = int(clamped) if isinstance(value, int) and float(clamped).is_integer() else clamped
        if key == "max_depth":
            value = min(int(value), MAX_DEPTH)
        if key == "early_stopping_rounds":  # the number has no counterpart: it turns stopping on or off
            dropped.append(key)
            key, value = "early_stopping", value > 0
        kept[key] = value
    return kept, sorted(dropped)


def class_weights(df: DataFrame, label: str, spec) -> DataFrame:
    """Adds ``weight``: ``balanced`` gives n / (k * n_c), a map gives its own values."""
    if isinstance(spec, dict):
        weights = F.create_map(*[x for code, w in spec.items() for x in (F.lit(int(code)).cast("bigint"), F.lit(float(w)))])
        return df.withColumn("weight", F.coalesce(F.element_at(weights, F.col(label).cast("bigint")), F.lit(1.0)))
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("__nc"))
    total = counts.agg(F.sum("__nc").alias("n"), F.count(F.lit(1)).alias("k")).first()
    side = counts.select(F.col(label).alias("__c"), (F.lit(float(total["n"])) / (F.lit(float(total["k"])) * F.col("__nc"))).alias("weight"))
    return df.join(small_side(side), F.col(label) == F.col("__c")).drop("__c")


def _estimator(name: str, task: str, params: dict, facts: dict, weighted: bool, seed: int):
    label = {"featuresCol": "features", "labelCol": "y"}
    weight = {"weightCol": "weight"} if weighted else {}
    tree = {TREE[k]: min(int(v), MAX_DEPTH) if k == "max_depth" else int(v) for k, v in params.items() if k in TREE}
    regression = task == fixed.REGRESSION
    n = float(facts["weight"])
    if name == "logreg":
        return LogisticRegression(
            regParam=1.0 / (float(params.get("C", 1.0)) * n), elasticNetParam=0.0, standardization=False,
            maxIter=int(params.get("max_iter", 1000)), tol=1e-6, **label, **weight)
    if name == "linreg":
        return LinearRegression(solver="normal", standardization=False, regParam=0.0, **label)
    if name == "ridge":
        return LinearRegression(
            solver="normal", standardization=False, elasticNetParam=0.0,
            regParam=float(params.get("alpha", 1.0)) * facts["sd_pop"] / n, **label)
    if name == "elasticnet":
        a, r, s = float(params.get("alpha", 1.0)), float(params.get("l1_ratio", 0.5)), facts["sd_sample"]
        reg = a * (r + (1.0 - r) * s)
        return LinearRegression(
            solver="l-bfgs", standardization=False, regParam=reg, elasticNetParam=a * r / reg if reg else 0.0,
            maxIter=int(params.get("max_iter", 1000)), tol=1e-10, **label)
    if name == "decision_tree":
        kind = DecisionTreeRegressor if regression else DecisionTreeClassifier
        return kind(seed=seed, **{"maxDepth": MAX_DEPTH if "maxDepth" not in tree else tree["maxDepth"], **tree}, **label, **weight)
    if name == "random_forest":
        kind = RandomForestRegressor if regression else RandomForestClassifier
        return kind(seed=seed, numTrees=int(params.get("n_estimators", 300)), **{"maxDepth": 12, **tree}, **label, **weight)
    if name in ("hist_gbdt", "gradient_boosting", "xgboost"):
        rounds = int(params.get("n_estimators", params.get("max_iter", 100)))
        common = {"maxIter": rounds, "stepSize": float(params.get("learning_rate", 0.1)), "seed": seed,
                  "subsamplingRate": float(params.get("subsample", 1.0)), **{"maxDepth": 5, **tree}}
        if facts["held"]:
            common["validationIndicatorCol"] = "held"
        if regression:
            return GBTRegressor(**common, **label, **weight)
        gbt = GBTClassifier(**common, **label, **weight)
        return gbt if facts["classes"] == 2 else OneVsRest(classifier=gbt, **label, **weight)
    if name == "mlp":
        hidden = params.get("hidden_layer_sizes", [100])
        return MultilayerPerceptronClassifier(
            layers=[facts["features"], *[int(h) for h in hidden], facts["classes"]], maxIter=int(params.get("max_iter", 200)),
            seed=seed, **label)
    svc = LinearSVC(regParam=1.0 / (float(params.get("C", 1.0)) * n), maxIter=100, standardization=False, **label, **weight)
    return svc if facts["classes"] == 2 else OneVsRest(classifier=svc, **label, **weight)


def fit(train: DataFrame, name: str, task: str, features: Sequence[str], label: str = "y", params: dict | None = None, seed: int = 42) -> Fit:
    """Fit one family on prepared train rows (no missing values left).

    A boolean ``held`` column marks rows for early stopping of boosted trees.
    """
    name = resolve_name(name, task)
    applied, dropped = resolve_params(name, params)
    applied = {**DEFAULTS.get(name, {}), **applied}
    features = list(features)
    rows = train.withColumn("y", F.col(label).cast("double"))
    early = name in ("hist_gbdt", "xgboost") and "held" in train.columns
    if not early and "held" in train.columns:
        rows = rows.drop("held")
    spec = applied.get("class_weight")
    if spec is None and applied.get("scale_pos_weight") is not None:
        spec = {0: 1.0, 1: float(applied["scale_pos_weight"])}
    if task == fixed.REGRESSION:
        spec = None
    if spec is not None:
        rows = class_weights(rows, "y", spec)
    facts = rows.agg(
        F.sum("weight" if spec is not None else F.lit(1.0)).alias("weight"), F.stddev_pop("y").alias("sd_pop"),
        F.stddev_samp("y").alias("sd_sample"), (F.max("y") + 1).alias("classes"),
        (F.sum(F.col("held").cast("int")) if early else F.lit(0)).alias("held")).first().asDict()
    facts["classes"], facts["features"], facts["held"] = int(facts["classes"]), len(features), int(facts["held"] or 0)
    if facts["classes"] > 2 and applied.pop("scale_pos_weight", None) is not None:
        dropped.append("scale_pos_weight")
        return fit(train, name, task, features, label, applied, seed)
    safe = [f"f{i}" for i, _ in enumerate(features)]
    keep = [c for c in ("y", "weight", "held") if c in rows.columns]
    slim = rows.select(*keep, *[F.col(f"`{c}`").alias(s) for c, s in zip(features, safe)])
    stages = [VectorAssembler(inputCols=safe, outputCol="features", handleInvalid="error"),
              _estimator(name, task, applied, facts, spec is not None, seed)]
    model = Pipeline(stages=stages).fit(slim)
    return Fit(model, name, task, features, applied, dropped, facts["held"])


def predict_rows(fitted: Fit, rows: DataFrame, keep: Sequence[str]) -> DataFrame:
    """``keep`` columns plus the predictions, for prepared rows."""
    slim = rows.select(*[F.col(f"`{c}`") for c in keep], *[F.col(f"`{c}`").alias(f"f{i}") for i, c in enumerate(fitted.features)])
    out = fitted.transform(slim)
    return out.drop(*[f"f{i}" for i, _ in enumerate(fitted.features)])


def coefficients(fitted: Fit) -> tuple[list[float], float]:
    """Linear families only: coefficients in feature order, and the intercept."""
    last = fitted.model.stages[-1]
    return [float(v) for v in last.coefficients], float(last.intercept)
