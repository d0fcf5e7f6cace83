"""Deterministic splits by key hash: same rows in, same split out, however the data is partitioned."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline import fixed
from plumbline.functions.columns import group_id, unit_hash
from plumbline.operators.keys import beside, join_on
from plumbline.session import small_side, stage

# Hex digits of the hash that name a bucket: 65,536 buckets, so only 1/65,536 of a stratum is ranked.
PREFIX = 4


def row_counts(n: int) -> tuple[int, int, int]:
    """(train, val, test) sizes."""
    test = math.ceil(fixed.TEST_FRACTION * n)
    val = math.ceil(fixed.VAL_FRACTION_OF_POOL * (n - test))
    if n < 3 or n - test - val <= 0:
        raise ValueError(f"cannot split {n} rows into train, val and test")
    return n - test - val, val, test


def _largest_remainder(strata: DataFrame, total: int, quota: int, source: str, output: str, key: str) -> DataFrame:
    """Whole-number share of ``quota`` per stratum: floors, then the largest remainders."""
    exact = F.col(source) * F.lit(quota) / F.lit(total)
    left = F.lit(quota) - F.sum(F.floor("__x")).over(Window.partitionBy(F.lit(1)))
    rank = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.round(F.col("__x") - F.floor("__x"), 9).desc(), F.col(key)))
    return strata.withColumn("__x", exact).withColumn("__left", left).withColumn("__rank", rank).withColumn(
        output, (F.floor("__x") + (F.col("__rank") <= F.col("__left")).cast("int")).cast("bigint")
    ).drop("__x", "__left", "__rank")


def _by_stratum(df: DataFrame, facts: DataFrame) -> DataFrame:
    """Each row with its stratum's facts; a single stratum's facts become literals."""
    if len(facts.select("stratum").take(2)) == 1:
        return beside(df, facts.drop("stratum"), [])
    return join_on(df, small_side(facts), ["stratum"])


def hash_cut(units: DataFrame, quotas: DataFrame, seed: int | str, keys: Sequence[str], labels: Sequence[str], rest: str, output: str = "split") -> DataFrame:
    """Label units by hash order inside each ``stratum``.

    ``units`` has ``stratum``, ``weight`` and the ``keys``; ``quotas`` has ``stratum`` and ``q0``, ``q1``...
    for ``labels``. A unit takes the first label whose cumulative quota its midpoint lies under. Whole
    hash buckets are labelled from bucket sums; only rows of the buckets a boundary cuts are ranked.
    """
    hashed = units.withColumn("__h", unit_hash(seed, *[F.col(k) for k in keys])).withColumn("__b", F.substring("__h", 1, PREFIX))
    sums = hashed.groupBy("stratum", "__b").agg(F.sum("weight").alias("w"))
    # At most 65,536 bucket rows per stratum.
    run = Window.partitionBy("stratum").orderBy("__b")
    sums = sums.withColumn("end", F.sum("w").over(run)).withColumn("start", F.col("end") - F.col("w"))
    bounds = _by_stratum(sums, quotas)
    ends = [" + ".join(f"q{k}" for k in range(i + 1)) for i, _ in enumerate(labels)]
    # The bucket holding each boundary: the first whose end passes the cumulative quota.
    cuts = stage(bounds.groupBy("stratum").agg(*[
        F.expr(f"min_by(__b, IF(end > {e}, __b, NULL)) AS c{i}") for i, e in enumerate(ends)
    ], *[
        F.expr(f"CAST(min_by(start, IF(end > {e}, __b, NULL)) AS DOUBLE) AS s{i}") for i, e in enumerate(ends)
    ], *[F.expr(f"CAST(max({e}) AS DOUBLE) AS e{i}") for i, e in enumerate(ends)]), "cuts")
    joined = _by_stratum(hashed, cuts)
    on_edge = F.expr("coalesce(" + ", ".join(f"IF(__b = c{i}, true, NULL)" for i, _ in enumerate(labels)) + ", false)")
    start = F.expr("coalesce(" + ", ".join(f"IF(__b = c{i}, s{i}, NULL)" for i, _ in enumerate(labels)) + ")")
    order = Window.partitionBy("stratum", "__b").orderBy("__h", *keys)
    middle = start + F.sum("weight").over(order) - F.col("weight") / 2.0
    direct, ranked = F.lit(rest), F.lit(rest)
    for i in reversed(range(len(labels))):
        direct = F.when(F.expr(f"c{i} IS NULL OR __b < c{i}"), labels[i]).otherwise(direct)
        ranked = F.when(F.expr(f"__middle < e{i}"), labels[i]).otherwise(ranked)
    keep = [c for c in units.columns]
    whole = joined.where(~on_edge).select(*keep, direct.alias(output))
    edges = joined.where(on_edge).withColumn("__middle", middle).select(*keep, ranked.alias(output))
    return whole.unionByName(edges)


def row_split(df: DataFrame, keys: Sequence[str], label: str | None = None, seed: int = 42) -> DataFrame:
    """Adds ``split``: exact test and val sizes, stratified by ``label`` when given."""
    units = df.withColumn("stratum", F.col(label).cast("string") if label else F.lit("all")).withColumn("weight", F.lit(1))
    strata = stage(units.groupBy("stratum").agg(F.count(F.lit(1)).alias("n")), "strata")
    n = int(strata.agg(F.sum("n").alias("n")).first()["n"] or 0)
    _, val, test = row_counts(n)
    # One row per class.
    quotas = _largest_remainder(strata, n, test, "n", "q0", "stratum")
    quotas = _largest_remainder(quotas.withColumn("left", F.col("n") - F.col("q0")), n - test, val, "left", "q1", "stratum")
    out = hash_cut(units, quotas.select("stratum", "q0", "q1"), seed, keys, ["test", "val"], "train")
    return out.drop("stratum", "weight")


def group_table(df: DataFrame, group: str, label: str | None) -> DataFrame:
    """One row per group: size and, when stratified, its commonest class (smallest on ties)."""
    keyed = df.withColumn("__g", group_id(F.col(group)))
    if label is None:
        return keyed.groupBy("__g").agg(F.count(F.lit(1)).alias("weight")).withColumn("stratum", F.lit("all"))
    cells = keyed.groupBy("__g", F.col(label).cast("string").alias("c")).agg(F.count(F.lit(1)).alias("n"))
    most = F.max("n")
    return cells.groupBy("__g").agg(
        F.sum("n").alias("weight"), most.alias("__m"), F.collect_list(F.struct("n", "c")).alias("__cells")
    ).select("__g", "weight", F.array_min(F.transform(
        F.filter("__cells", lambda x: x["n"] == F.col("__m")), lambda x: x["c"])).alias("stratum"))


def group_split(df: DataFrame, group: str, label: str | None = None, seed: int = 42) -> DataFrame:
    """Adds ``split`` with every group on one side.

    Groups are ranked by hash inside the stratum of their commonest class, one fifth of the rows to
    test and one quarter of the rest to val. A group larger than the test quota stays in train.
    """
    groups = stage(group_table(df, group, label), "groups")
    n_groups = groups.count()
    if n_groups < fixed.TEST_FOLDS:
        raise ValueError(f"{n_groups} groups cannot fill {fixed.TEST_FOLDS} folds")
    strata = groups.groupBy("stratum").agg(F.sum("weight").alias("n"))
    quota = F.col("n") * fixed.TEST_FRACTION
    val = (F.col("n") - quota) * fixed.VAL_FRACTION_OF_POOL
    quotas = strata.select("stratum", quota.alias("q0"), val.alias("q1"))
    marked = join_on(groups, small_side(stage(quotas, "quotas")), ["stratum"])
    oversized = marked.where(F.col("weight") > F.col("q0")).select("__g", F.lit("train").alias("split"))
    normal = marked.where(F.col("weight") <= F.col("q0")).select("__g", "weight", "stratum")
    placed = hash_cut(normal, quotas, seed, ["__g"], ["test", "val"], "train").select("__g", "split")
    placed = stage(placed.unionByName(oversized), "placed")
    joined = df.withColumn("__g", group_id(F.col(group)))
    return joined.join(small_side(placed), "__g").drop("__g")


def assign_splits(df: DataFrame, keys: Sequence[str], label: str | None = None, group: str | None = None, seed: int = 42) -> DataFrame:
    if group:
        return group_split(df, group, label, seed)
    return row_split(df, keys, label, seed)


def hold_back(df: DataFrame, keys: Sequence[str], share: float, salt: str, group: str | None = None, seed: int = 42, label: str | None = None) -> DataFrame:
    """Adds ``held``: a hash-ordered share of the train rows, stratified by ``label`` (whole groups when grouped)."""
    train = df.where("split = 'train'")
    if group:
        units = train.withColumn("__g", group_id(F.col(group))).groupBy("__g").agg(F.count(F.lit(1)).alias("weight"))
        names = ["__g"]
    else:
        units, names = train.withColumn("weight", F.lit(1)), list(keys)
    units = units.withColumn("stratum", F.col(label).cast("string") if label and not group else F.lit("all"))
    strata = stage(units.groupBy("stratum").agg(F.sum("weight").alias("n")), "held-strata")
    total = strata.agg(F.sum("n").alias("n")).first()["n"] or 0
    quotas = _largest_remainder(strata, total, math.ceil(share * total), "n", "q0", "stratum").select("stratum", "q0")
    cut = hash_cut(units, quotas, f"{seed}|{salt}", names, ["held"], "fit", "held")
    if not group:
        return cut.drop("stratum", "weight").withColumn("held", F.col("held") == "held")
    side = small_side(stage(cut.select("__g", (F.col("held") == "held").alias("held")), "held"))
    return train.withColumn("__g", group_id(F.col(group))).join(side, "__g").drop("__g")


def train_subsample(df: DataFrame, keys: Sequence[str], fraction: float, seed: int = 42) -> DataFrame:
    """The hash-order prefix of the train rows: max(50, int(n * fraction)) of them."""
    train = df.where("split = 'train'").withColumn("stratum", F.lit("all")).withColumn("weight", F.lit(1))
    keep = max(fixed.SUBSAMPLE_MIN_ROWS, int(train.count() * fraction))
    quotas = df.sparkSession.sql(f"SELECT 'all' AS stratum, CAST({keep} AS BIGINT) AS q0")
    cut = hash_cut(train, quotas, f"{seed}|subsample", keys, ["keep"], "leave", "__keep")
    return cut.where("__keep = 'keep'").drop("__keep", "stratum", "weight")


def fingerprint(df: DataFrame, keys: Sequence[str], label: str, by: Sequence[str] = ()) -> DataFrame:
    """Order-free fingerprint of scored rows: row count, key hash xor, and a decimal sum of md5 prefixes."""
    digest = unit_hash("rows", *[F.col(k) for k in keys], F.col(label))
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"),
        F.bit_xor(F.xxhash64(*keys, label)).alias("xor"),
        F.sum(F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")).alias("digest"),
    )


def protocol(seed: int, group: str | None, stratified: bool) -> dict:
    return {"test_fraction": fixed.TEST_FRACTION, "val_fraction": 0.2, "train_fraction": 0.6,
            "stratified": stratified, "grouped_by": group, "seed": seed}


def protocol_differences(declared: dict[str, Column], own: dict[str, Column]) -> Column:
    """Names of the protocol keys that differ; a key not declared is accepted."""
    parts = [
        F.when(declared[k].isNotNull() & ~declared[k].eqNullSafe(own[k]), F.lit(k)) for k in fixed.PROTOCOL_KEYS if k in declared
    ]
    return F.filter(F.array(*parts), lambda x: x.isNotNull())
