"""The dataset card: aggregates about a labelled table, with a measured linear baseline."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline import fixed
from plumbline.operators import bootstrap, metrics, profile, targets
from plumbline.operators.encoding import fit_encoding
from plumbline.operators.keys import column_kinds
from plumbline.operators.splits import protocol
from plumbline.plans import search
from plumbline.session import stage

BASELINE = {fixed.CLASSIFICATION: "logreg", fixed.REGRESSION: "ridge"}


def _value(df: DataFrame, column: str):
    """The value of a one-row table as a literal."""
    kind = df.schema[column].dataType
    row = df.select(F.to_json(column)).first()
    return F.from_json(F.lit(None if row is None else row[0]).cast("string"), kind)


def baseline(df: DataFrame, keys: Sequence[str], target: str, features: Sequence[str], task: str, group: str | None = None, seed: int = 42) -> DataFrame:
    """Rows (metric, value, chance, low, high) of the fixed linear model on validation.

    Median impute and scaling come from the automatic steps; all rows are used.
    """
    data = search.prepare(df, keys, target, features, task, group, seed)
    trial = search.run_trial(data, 1, BASELINE[task], {})
    if trial.status != "ok":
        raise ValueError(f"baseline failed: {trial.error_type}")
    keep = [*keys, "y", *([group] if group and group not in keys else [])]
    val = stage(search.predict(trial, data.part("val"), keep), "baseline")
    scores = search.score_predictions(val, task, data.classes)
    if task == fixed.REGRESSION:
        mean = data.part("train").agg(F.avg("y").alias("m")).first()["m"]
        chance = metrics.long_scores(metrics.regression_scores(val.withColumn("pred", F.lit(mean)), "y", "pred"), ("r2", "mae", "rmse"))
        # Without a group, rows are drawn by their whole key.
        unit = group or "__unit"
        val = val if group else val.withColumn("__unit", F.xxhash64(*keys))
        draws = bootstrap.error_draws(val, "y", "pred", unit, seed=seed)
    else:
        binary = data.classes == 2
        rows = val.withColumn("y", F.col("y").cast("bigint"))
        plain = metrics.chance_scores(data.part("train").withColumn("y", F.col("y").cast("bigint")), rows, "y", binary=binary)
        names = ["accuracy", "f1", "precision", "recall", "balanced_accuracy", *(["roc_auc", "pr_auc"] if binary else [])]
        chance = metrics.long_scores(plain, names)
        draws = bootstrap.label_draws(rows, "y", "pred", unit=group, binary=binary, seed=seed)
        if binary:
            draws = draws.unionByName(bootstrap.ranking_draws(rows, "y", "proba", unit=group, seed=seed))
        unit = group
    bounds = bootstrap.bootstrap(draws, val, unit=unit)
    return scores.join(chance.withColumnRenamed("value", "chance"), "metric", "left").join(
        bounds.select("metric", "low", "high"), "metric", "left").select(
        "metric", *[F.round(c, 4).alias(c) for c in ("value", "chance", "low", "high")])


def build_card(
    df: DataFrame, target: str, name: str, keys: Sequence[str] = (), group: str | None = None,
    notes: Sequence[str] = (), policy: str = "reject", with_baseline: bool = True, seed: int = 42,
) -> DataFrame:
    """One row: rates, buckets and counts only. ``keys`` identify rows and are no features."""
    # A dozen scans read the table; what made it, a join or features of whole texts, runs once.
    df = stage(df, "card-rows")
    task = targets.detect_task(df, target)
    rows, gone = targets.apply_missing_policy(df, target, policy)
    coded = targets.encode_target(rows, target, task, "__y")
    left_out = {target, "__y", *keys, *([group] if group else [])}
    features = [c for c in coded.columns if c not in left_out]
    balance = None
    classes = None
    if task == fixed.CLASSIFICATION:
        balance = profile.class_balance(coded, "__y").first()
        classes = int(balance["n_classes"])
    numeric_target = "__y" if task == fixed.REGRESSION or classes == 2 else None
    subject = coded.select(*features, *(["__y"] if numeric_target else []))
    columns = stage(profile.profile_columns(subject, target=numeric_target), "features")
    layout = fit_encoding(coded, features)
    spark = df.sparkSession
    suspects = columns.where("sentinel_suspects IS NOT NULL").select(
        F.posexplode("sentinel_suspects").alias("at", "s"), "name").select(
        F.lit(0).alias("d"), F.col("at").alias("position"),
        F.expr("concat(name, ': suspected missing code ', s.value, ' in ', round(s.rate * 100, 1), '% of rows, counted as a value')").alias("text"))
    machine = suspects
    if group:
        counted = rows.agg(F.count_distinct(F.coalesce(F.col(group).cast("string"), F.lit(fixed.MISSING_LEVEL))).alias("n"))
        machine = machine.unionByName(counted.select(
            F.lit(0).alias("d"), F.lit(1000).alias("position"),
            F.expr(f"concat('split by {group} (', n, ' groups): no group crosses train, val and test')").alias("text")))
    human = spark.createDataFrame([(0, i, str(n)) for i, n in enumerate(notes)], "d int, position int, text string")
    findings = profile.merge_findings(machine, human, ["d"]).groupBy().agg(F.expr(
        "transform(array_sort(collect_list(struct(position, text))), x -> x.text) AS caveats"))
    one = columns.groupBy().agg(
        F.sum(F.col("usable_by_executor").cast("int")).alias("n_features"),
        F.sum((~F.col("usable_by_executor")).cast("int")).alias("n_features_dropped_non_numeric"),
        F.round(F.sum(F.round(F.col("missing_rate") * F.col("n_rows"))) / F.sum("n_rows"), 4).alias("overall_rate"),
        F.sum((F.col("missing_rate") > 0).cast("int")).alias("columns_with_missing"), F.max("missing_rate").alias("worst_rate"),
        F.max("n_rows").alias("n_rows"),
        F.sort_array(F.collect_list(F.struct(*[c for c in columns.columns if c not in ("n_rows", "distinct_count")]))).alias("features"))
    kind = "regression" if task == fixed.REGRESSION else "binary_classification" if classes == 2 else "multiclass_classification"
    report = layout.report()
    card = one.select(
        F.lit(name).alias("name"), F.lit(kind).alias("task"), F.lit(target).alias("target_column"), "n_rows", "n_features",
        "n_features_dropped_non_numeric",
        F.struct(*[(F.array(*[F.lit(x) for x in v]).cast("array<string>") if isinstance(v, list) else F.lit(v)).alias(k) for k, v in report.items()]).alias("encoding"),
        F.lit(classes).cast("int").alias("n_classes"),
        F.lit(None if balance is None else list(balance["class_balance"])).cast("array<double>").alias("class_balance"),
        F.lit(None if balance is None else balance["imbalance_ratio"]).cast("double").alias("imbalance_ratio"),
        F.struct("overall_rate", "columns_with_missing", "worst_rate").alias("missing"), "features",
        F.struct(F.lit(policy).alias("policy"), F.lit(gone).alias("n_dropped")).alias("target_missing"))
    card = card.withColumn("caveats", _value(findings, "caveats"))
    if task == fixed.REGRESSION:
        own = profile.profile_columns(coded.select("__y")).select(F.struct(
            "dtype", "missing_rate", "distinct", "kind", "magnitude", "skew", "outlier_rate").alias("target"))
        card = card.withColumn("target", _value(own, "target"))
    if with_baseline and keys:
        measured = baseline(coded.drop(target), keys, "__y", features, task, group, seed)
        block = measured.groupBy().agg(F.sort_array(F.collect_list(F.struct("metric", "value", "chance", "low", "high"))).alias("scores"))
        block = block.select(F.struct(
            F.lit(BASELINE[task]).alias("model"), F.to_json(F.create_map(*[
                x for k, v in protocol(seed, group, task == fixed.CLASSIFICATION).items() for x in (F.lit(k), F.lit(str(v)))])).alias("protocol"),
            "scores").alias("baseline"))
        card = card.withColumn("baseline", _value(block, "baseline"))
    return card
