import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions import columns as C
from plumbline.functions import text as X
from plumbline.operators import profile, quantiles, sentinels, targets


def test_quantiles_match_numpy_on_both_paths(spark):
    rng = np.random.default_rng(1)
    for values in (rng.normal(size=101), np.round(rng.exponential(size=60_000), 2), np.r_[np.zeros(50_000), rng.normal(size=20_000)]):
        df = spark.createDataFrame([(float(v),) for v in values], "x double").repartition(5)
        out = quantiles.exact_quantiles(df, {"x": "x"}, {"x": (0.0, 0.25, 0.5, 0.75, 1.0)})
        got = {r["prob"]: r["value"] for r in out.collect()}
        for p, v in got.items():
            assert v == pytest.approx(np.percentile(values, p * 100), abs=1e-12)


def test_quantiles_by_segment_keep_null_segments(spark):
    rows = [(g, float(i)) for g in ("a", None) for i in range(10)] + [("b", None)]
    out = quantiles.exact_quantiles(spark.createDataFrame(rows, "g string, x double"), {"x": "x"}, {"x": (0.5,)}, ["g"])
    assert {r["g"]: r["value"] for r in out.collect()} == {"a": 4.5, None: 4.5}


def test_stacked_numeric_codes_are_found_in_report_order(spark):
    values = [float(v) for v in range(1, 101)] + [-9999.0] * 3 + [-999.0] * 4 + [99.0]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)] * 5, "x double")
    found = sentinels.numeric_codes(df, ["x"]).orderBy("position").collect()
    assert [(r["value"], r["hits"]) for r in found] == [("-9999", 3), ("-999", 4)]
    assert found[0]["rate"] == round(3 / len(values + [0] * 5), 4)


def test_codes_need_repeats_distance_and_rows(spark):
    near = spark.createDataFrame([(float(v),) for v in range(-1, 60)] * 2, "x double")
    once = spark.createDataFrame([(float(v),) for v in range(1, 60)] + [(-999.0,)], "x double")
    few = spark.createDataFrame([(float(v),) for v in range(1, 10)] + [(-999.0,)] * 2, "x double")
    for df in (near, once, few):
        assert sentinels.numeric_codes(df, ["x"]).count() == 0


def test_high_codes_and_one_sided_sign(spark):
    rng = np.random.default_rng(2)
    values = [float(v) for v in rng.uniform(1, 20, 200)] + [9999.0] * 5 + [-1.0] * 4
    df = spark.createDataFrame([(v,) for v in values], "x double")
    found = {r["value"] for r in sentinels.numeric_codes(df, ["x"]).collect()}
    assert "9999" in found and "-1" not in found


def test_markers_trim_and_fold_case(spark):
    df = spark.createDataFrame([("\tN/A ",), ("n/a",), ("Unknown",)] + [("x",)] * 20, "t string")
    assert [(r["value"], r["hits"]) for r in sentinels.text_markers(df, ["t"]).collect()] == [("n/a", 2)]


def test_profile_kinds_and_empty_columns(spark):
    rows = [(i, i % 2, float(i) / 7, None, "c" if i % 3 else "d", i % 5) for i in range(40)]
    df = spark.createDataFrame(rows, "a long, b int, c double, n double, t string, k int")
    out = {r["name"]: r for r in profile.profile_columns(df).collect()}
    assert {c: out[c]["kind"] for c in out} == {
        "a": "continuous", "b": "binary", "c": "continuous", "n": "constant", "t": "binary", "k": "discrete"}
    assert out["n"]["missing_rate"] == 1.0 and out["n"]["magnitude"] is None
    assert out["c"]["outlier_rate"] == 0.0 and out["c"]["skew"] == "low"


def test_nan_counts_as_missing(spark):
    df = spark.createDataFrame([(float("nan"),), (1.0,), (None,)], "x double")
    assert profile.missing_rates(df, ["x"]).first()["n_missing"] == 2


def test_task_rules(spark):
    rows = [("a" if i % 2 else "b", float(i), i / 2, i % 3, 1, i % 2 == 0) for i in range(30)]
    df = spark.createDataFrame(rows, "t string, whole double, half double, few int, one int, b boolean")
    tasks = {r["name"]: r["task"] for r in targets.target_tasks(df, df.columns).collect()}
    assert tasks == {"t": "classification", "whole": "regression", "half": "regression", "few": "classification",
                     "one": "unusable", "b": "classification"}
    with pytest.raises(ValueError):
        targets.detect_task(df, "one")


def test_missing_target_policy(spark):
    df = spark.createDataFrame([(1,), (None,), (2,)], "y int")
    with pytest.raises(ValueError):
        targets.apply_missing_policy(df, "y")
    kept, gone = targets.apply_missing_policy(df, "y", "drop")
    assert (kept.count(), gone) == (2, 1)


def test_findings_order_dedupe_and_cap(spark):
    machine = spark.createDataFrame([("d", 1, "b  b"), ("d", 0, "a")], "d string, position int, text string")
    notes = spark.createDataFrame([("d", i, f"n{i}") for i in range(30)] + [("d", 30, "a "), ("d", 31, "  ")], "d string, position int, text string")
    out = [r["text"] for r in profile.merge_findings(machine, notes, ["d"]).orderBy("position").collect()]
    assert out[:3] == ["a", "b b", "n0"] and len(out) == 20


def test_weights_are_all_or_nothing(spark):
    df = spark.createDataFrame([({0: 1.0, 1: 5000.0},), ({0: 1.0},), ({0: 1.0, 1: 0.0},), ({0: 1.0, 1: float("nan")},)], "w map<int,double>")
    out = [r[0] for r in df.select(C.checked_weights(F.col("w"), F.array(F.lit(0), F.lit(1)))).collect()]
    assert out == [{0: 1.0, 1: 1000.0}, None, None, None]


def test_binary_switch_tree_equals_counting(spark):
    cuts = [0.1, 0.2, 0.35, 0.9]
    df = spark.createDataFrame([(v / 100,) for v in range(101)], "p double")
    for row in df.select("p", C.switch(F.col("p"), cuts).alias("k")).collect():
        assert row["k"] == sum(c <= row["p"] for c in cuts)


def test_redaction_and_scrubbing(spark):
    log = "Traceback\n  File x\nValueError: bad 'secret value' in C:\\a\\b.csv\nbye"
    df = spark.createDataFrame([(log,), ("open /tmp/x/y.parquet or été.csv now",), ("",), (None,)], "t string")
    out = df.select(X.redact_paths(F.col("t")).alias("r"), X.scrub_log(F.col("t")).alias("s")).collect()
    assert out[0]["s"] == "ValueError: bad '<redacted>' in <path>"
    assert out[1]["r"] == "open <path> or <path> now"
    assert out[2]["s"] == ""


@pytest.mark.parametrize("text,expected", [
    ("we use smote here", ["resampling"]), ("we go without smote", []), ("without care. smote it", ["resampling"]),
    ("smote is not available", []), ("smote, which is not available", ["resampling"]),
    ("no smote; then stacking", ["model_averaging"]), ("not " + "x" * 60 + " smote", ["resampling"]),
    ("not " + "x" * 55 + " smote", []), ("no smote, yes smote", ["resampling"]),
])
def test_claims(spark, text, expected):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(X.claims(F.col("t"))).first()[0] == expected


def test_private_terms_take_their_file_name(spark):
    df = spark.createDataFrame([("see b.csv",), ("nothing",)], "t string")
    assert [r[0] for r in df.select(X.holds_private(F.col("t"), ["C:\\a\\b.csv", "abc"])).collect()] == [True, False]


def test_many_strings_are_found_like_one_by_one(spark):
    terms = [f"{a}{b}{c}x" for a in "abc" for b in "abc" for c in "abc"] + ["abax and", "bax a", "C:\\d\\secret.csv", "abc", "größe", "😀😀😀😀"]
    texts = ["abax and more", "no hits", "", None, "in C:/d/secret.csv and secret.csv", "aaax" * 3, "die größe", "x" * 20000 + "cccx", "😀😀😀😀😀"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(X.term_hits(F.col("t"), terms).alias("hits"), X.holds_private(F.col("t"), terms).alias("held"))
    forms = X.private_forms(terms)
    want = [None if t is None else [f for f in forms if f in t] for t in texts]
    assert [(r["hits"], r["held"]) for r in df.collect()] == [(w, None if w is None else bool(w)) for w in want]
    assert [r[0] for r in spark.createDataFrame([("a",)], "t string").select(X.term_hits(F.col("t"), [])).collect()] == [[]]
