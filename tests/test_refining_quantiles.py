"""Quantiles whose brackets miss, hold too many rows, or hold one value; class codes by ranges."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import profile, quantiles, steps, targets

PROBS = (0.0, 0.1, 0.25, 0.5, 0.9, 1.0)


def values(n=60_000):
    rng = np.random.default_rng(1)
    x = np.round(rng.normal(size=n) ** 3, 4)
    x[: n // 5] = 7.0  # a tie of a fifth of the rows
    return x


@pytest.fixture(scope="module")
def table(spark):
    x = values()
    rows = [(float(v), "a" if i % 3 else "b") for i, v in enumerate(x)]
    return x, spark.createDataFrame(rows, "x double, g string").repartition(4).cache()


def close(df, want, by=None):
    got = {((r["g"],) if by else ()) + (r["prob"],): r["value"] for r in df.collect()}
    assert set(got) == set(want)
    for k, v in want.items():
        assert got[k] == pytest.approx(v, abs=1e-12)


def wanted(x):
    return {(p,): np.quantile(x, p) for p in PROBS}


@pytest.mark.parametrize("case", ["as is", "miss below", "miss above", "wide", "wide and missed"])
def test_brackets_are_widened_and_refined(spark, table, monkeypatch, case):
    x, df = table
    scans = []
    counted = quantiles._counted
    monkeypatch.setattr(quantiles, "_counted", lambda *a: scans.append(a[-1]) or counted(*a))
    edges = quantiles._edges
    shifted = {"miss below": 0.3, "miss above": -0.3, "wide and missed": 0.2}.get(case)
    if shifted:
        monkeypatch.setattr(quantiles, "_edges", lambda probs: edges([min(1.0, max(0.0, p + shifted)) for p in probs]))
    if case.startswith("wide"):
        monkeypatch.setattr(quantiles, "FEW", 300)
        monkeypatch.setattr(quantiles, "MARGIN", 0.1)
        monkeypatch.setattr(quantiles, "SMALL", 40)
    close(quantiles.exact_quantiles(df, {"x": "x"}, {"x": PROBS}), wanted(x))
    assert len(scans) == 1 if case == "as is" else len(scans) > 1


def test_segments_refine_too(spark, table, monkeypatch):
    x, df = table
    monkeypatch.setattr(quantiles, "SMALL", 100)
    monkeypatch.setattr(quantiles, "FEW", 200)
    monkeypatch.setattr(quantiles, "MARGIN", 0.05)
    g = np.array(["a" if i % 3 else "b" for i in range(len(x))])
    want = {(k, p): np.quantile(x[g == k], p) for k in "ab" for p in PROBS}
    close(quantiles.exact_quantiles(df, {"x": "x"}, {"x": PROBS}, ["g"]), want, True)


def test_no_rank_table_is_larger_than_few(spark, table, monkeypatch):
    _, df = table
    monkeypatch.setattr(quantiles, "FEW", 100)
    monkeypatch.setattr(quantiles, "MARGIN", 0.05)
    monkeypatch.setattr(quantiles, "SMALL", 40)
    last = {}
    counted = quantiles._counted

    def watched(*a):
        last["rows"] = counted(*a)
        return last["rows"]
    monkeypatch.setattr(quantiles, "_counted", watched)
    quantiles.exact_quantiles(df, {"x": "x"}, {"x": PROBS}).collect()
    row = last["rows"].first()
    for j, _ in enumerate(PROBS):
        b, r = row["b0"], row[f"r0_{j}"]
        assert r["inside"] <= 100 or b["l"][j] == b["h"][j]


def test_a_profile_starts_from_sums_and_sketches(spark, table):
    x, df = table
    states = profile.profile_states(df, ["x", "g"], ["x", "g"], ["x"], None)
    sums, sketches = states.sums.first(), states.sketches.first()
    assert sums["__n"] == len(x) and sums["k0"]["present"] == len(x) and sketches["s0"]["n"] == len(x) and sketches["d1"] == 2
    got = profile.profile_columns(df, None, (), False).where("name = 'x'").first()
    q1, q3 = np.quantile(x, [0.25, 0.75])
    assert got["outlier_rate"] == round(float(np.mean((x < q1 - 1.5 * (q3 - q1)) | (x > q3 + 1.5 * (q3 - q1)))), 4)


def test_many_classes_are_numbered_by_ranges(spark, monkeypatch):
    df = spark.range(0, 500).select(F.concat(F.lit("c"), F.lpad(F.col("id").cast("string"), 4, "0")).alias("label"))
    monkeypatch.setattr(targets, "FEW_CLASSES", 50)
    codes = {r["label"]: r["code"] for r in targets.class_levels(df, "label").collect()}
    assert codes == {f"c{i:04d}": i for i in range(500)}


@pytest.mark.parametrize("by", [[], ["g"]])
def test_a_column_without_values_ends_beside_a_large_one(spark, table, monkeypatch, by):
    x, df = table
    scans = []
    counted = quantiles._counted

    def limited(*a):
        scans.append(a[-1])
        assert len(scans) < 5, "the scans do not end"
        return counted(*a)

    monkeypatch.setattr(quantiles, "_counted", limited)
    monkeypatch.setattr(quantiles, "SMALL", 100)
    rows = df.withColumn("empty", F.lit(None).cast("double")).withColumn("part", F.when(F.col("g") == "a", F.col("x")))
    names = ("empty", "x", "part")
    found = quantiles.exact_quantiles(rows, {c: c for c in names}, {c: (0.5,) for c in names}, by).collect()
    g = np.array(["a" if i % 3 else "b" for i in range(len(x))])
    if by:
        want = {("a", "x"): np.median(x[g == "a"]), ("b", "x"): np.median(x[g == "b"]), ("a", "part"): np.median(x[g == "a"])}
        assert {(r["g"], r["measure"]): r["value"] for r in found} == pytest.approx(want)
    else:
        assert {r["measure"]: r["value"] for r in found} == pytest.approx({"x": np.median(x), "part": np.median(x[g == "a"])})


def test_steps_drop_an_empty_column_of_many_rows(spark, table, monkeypatch):
    x, df = table
    scans = []
    counted = quantiles._counted

    def limited(*a):
        scans.append(a[-1])
        assert len(scans) < 5, "the scans do not end"
        return counted(*a)

    monkeypatch.setattr(quantiles, "_counted", limited)
    rows = df.select("x", F.lit(None).cast("double").alias("empty"))
    fitted = steps.fit_steps(rows, [{"step": "impute"}, {"step": "scale"}], ["x", "empty"])
    assert fitted.log == ["impute: no present value in ['empty'], dropped"]
    assert fitted.columns == ["x"] and fitted.steps[0].values == {"x": pytest.approx(np.median(x))}


@pytest.mark.parametrize("by", [[], ["g"]])
@pytest.mark.parametrize("share", [3, 5, 6, 10])
def test_nans_count_as_the_greatest_values_and_end(spark, monkeypatch, share, by):
    scans = []
    counted = quantiles._counted

    def limited(*a):
        scans.append(a[-1])
        assert len(scans) < 5, "the scans do not end"
        return counted(*a)

    monkeypatch.setattr(quantiles, "_counted", limited)
    rows = spark.range(5_000).selectExpr(f"IF(id % 10 < {share}, CAST('NaN' AS DOUBLE), id * 1.0D) AS x", "id % 11 AS y", "id % 3 AS g")

    def found(small):
        monkeypatch.setattr(quantiles, "SMALL", small)
        out = quantiles.exact_quantiles(rows, {"x": "x", "y": "y"}, {"x": (0.0, 0.25, 0.5, 1.0), "y": (0.5,)}, by)
        return {(*[r[c] for c in by], r["measure"], r["prob"]): (r["n"], repr(r["value"])) for r in out.collect()}

    want = found(100_000)
    assert not scans and len(want) == (15 if by else 5)
    assert found(100) == want and scans
    monkeypatch.setattr(quantiles, "FEW", 50)
    scans.clear()
    assert found(100) == want
