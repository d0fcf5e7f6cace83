"""Values that stand for "missing": text markers and numeric codes. Reported, never converted."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline import fixed
from plumbline.functions.columns import distinct_estimate
from plumbline.operators.keys import beside, clean, column_kinds, join_on, number_literal, quoted, rows_from, rows_of, text_literal
from plumbline.operators.quantiles import exact_quantiles
from plumbline.session import stage

FINDING = "name string, kind string, value string, hits bigint, rate double, position int"


def text_markers(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Rows (by..., name, kind, value, hits, rate, position) for markers seen at least twice."""
    kinds = column_kinds(df)
    columns = [c for c in columns if kinds[c] == "text"]
    rows = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"))
    if not columns:
        return df.sparkSession.createDataFrame([], _schema(df, by))
    markers = ", ".join(text_literal(m) for m in fixed.TEXT_MARKERS)
    forms = df.selectExpr(*map(quoted, by), *[
        f"lower(regexp_replace({quoted(c)}, r'^\\s+|\\s+$', '')) AS f{i}" for i, c in enumerate(columns)
    ])
    found = forms.select(*by, rows_of([
        f"CASE WHEN f{i} IN ({markers}) THEN struct({text_literal(c)} AS name, f{i} AS value) END"
        for i, c in enumerate(columns)
    ])).groupBy(*by, "name", "value").agg(F.count(F.lit(1)).alias("hits"))
    found = found.where(F.col("hits") >= fixed.SENTINEL_MIN_COUNT)
    found = beside(found, rows, by)
    return found.where(F.col("n_rows") >= fixed.SENTINEL_MIN_ROWS).select(
        *by, "name", F.lit("text_marker").alias("kind"), "value", "hits",
        F.round(F.try_divide("hits", "n_rows"), 4).alias("rate"),
        (F.array_position(F.array(*[F.lit(m) for m in fixed.TEXT_MARKERS]), F.col("value")) - 1)
        .cast("int").alias("position"),
    )


def _schema(df: DataFrame, by: Sequence[str]):
    from pyspark.sql import types as T

    own = T._parse_datatype_string(FINDING)
    return T.StructType([df.schema[c] for c in by] + own.fields)


def code_profile(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Rows (by..., name, code, hits, low, high, est): one per code met, and one with ``code`` NULL
    for all other values, whose ``low``/``high`` bound them."""
    codes = ", ".join(f"{c!r}D" for c in fixed.NUMERIC_CODES)
    values = clean(df, [*by, *columns]).selectExpr(
        *map(quoted, by), *[f"CAST({quoted(c)} AS DOUBLE) AS x{i}" for i, c in enumerate(columns)])
    return values.select(*by, rows_from([
        f"struct({text_literal(c)} AS name, x{i} AS x, CASE WHEN x{i} IN ({codes}) THEN x{i} END AS code)"
        for i, c in enumerate(columns)
    ])).groupBy(*by, "name", "code").agg(
        F.count(F.lit(1)).alias("n"), F.count("x").alias("hits"), F.min("x").alias("low"),
        F.max("x").alias("high"), distinct_estimate(F.col("x")).alias("est"),
    )


def numeric_codes(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Rows (by..., name, kind, value, hits, rate, position) for codes far outside the other values.

    One pass bounds the ordinary values of every column. Only columns with a repeated code beyond
    those bounds go on; their quartiles are taken for each set of codes that can be left out.
    """
    kinds = column_kinds(df)
    columns = [c for c in columns if kinds[c] == "numeric"]
    empty = df.sparkSession.createDataFrame([], _schema(df, by))
    if not columns:
        return empty
    profile = stage(code_profile(df, columns, by), "codes")
    ordinary = profile.where("code is null").select(*by, "name", F.col("low").alias("low0"), F.col("high").alias("high0"))
    met = profile.where("code is not null")
    edge = join_on(met, ordinary, [*by, "name"], "left")
    edge = edge.withColumn("is_low", F.col("low0").isNull() | (F.col("code") < F.col("low0")))
    edge = edge.withColumn("is_high", F.col("high0").isNull() | (F.col("code") > F.col("high0")))
    edge = edge.where("is_low or is_high").groupBy("name").agg(
        F.array_sort(F.collect_set(F.when(F.col("is_low"), F.col("code")))).alias("lows"),
        F.array_sort(F.collect_set(F.when(F.col("is_high"), F.col("code")))).alias("highs"),
        F.max("hits").alias("most"),
    ).where(F.col("most") >= fixed.SENTINEL_MIN_COUNT)
    # At most one row per column, at most fourteen codes each.
    flagged = {r["name"]: (list(r["lows"]), list(r["highs"])) for r in edge.collect()}
    if not flagged:
        return empty
    values = clean(df, [*by, *flagged])
    measures, probs = {}, {}
    for name, (lows, highs) in flagged.items():
        for low in [None, *lows]:
            for high in [None, *highs]:
                if low is not None and high is not None and low >= high:
                    continue
                x = quoted(name)
                keep = [f"{x} > {number_literal(low)}"] if low is not None else []
                keep += [f"{x} < {number_literal(high)}"] if high is not None else []
                key = f"{name}\t{low}\t{high}"
                measures[key] = f"CASE WHEN {' AND '.join(keep)} THEN {x} END" if keep else x
                probs[key] = (0.25, 0.75)
    quartiles = exact_quantiles(values, measures, probs, by)
    part = F.split("measure", "\t")
    quartiles = quartiles.groupBy(*by, part[0].alias("name"), part[1].alias("lo"), part[2].alias("hi")).agg(
        F.max(F.when(F.col("prob") == 0.25, F.col("value"))).alias("q1"),
        F.max(F.when(F.col("prob") == 0.75, F.col("value"))).alias("q3"),
    ).groupBy(*by, "name").agg(
        F.collect_list(F.struct("lo", "hi", "q1", "q3")).alias("states")
    )
    distinct = _few_distinct(values, profile.where(F.col("name").isin(*flagged)), list(flagged), by)
    columns_of = profile.where(F.col("name").isin(*flagged)).groupBy(*by, "name").agg(
        F.sum("n").alias("n_rows"),
        F.max(F.when(F.col("code").isNull(), F.col("low"))).alias("low0"),
        F.max(F.when(F.col("code").isNull(), F.col("high"))).alias("high0"),
        F.sum("hits").alias("present"),
        F.collect_list(F.when(F.col("code").isNotNull(), F.struct("code", "hits"))).alias("met"),
    )
    ready = join_on(join_on(columns_of, quartiles, [*by, "name"]), distinct, [*by, "name"])
    return ready.mapInPandas(_search(list(by)), _schema(df, by))


def _few_distinct(values: DataFrame, profile: DataFrame, columns: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Distinct non-missing values per flagged column: counted where few, else the estimate."""
    estimate = profile.groupBy(*by, "name").agg(F.sum("est").alias("est"))
    few = [r["name"] for r in estimate.groupBy("name").agg(F.min("est").alias("e")).where("e < 200").collect()]
    if not few:
        return estimate.select(*by, "name", F.col("est").alias("distinct"))
    counted = values.select(*by, rows_of([
        f"CASE WHEN {quoted(c)} IS NOT NULL THEN struct({text_literal(c)} AS name, CAST({quoted(c)} AS DOUBLE) AS x) END"
        for c in few
    ])).distinct().groupBy(*by, "name").agg(F.count(F.lit(1)).alias("exact"))
    return join_on(estimate, counted, [*by, "name"], "left").select(
        *by, "name", F.coalesce("exact", "est").alias("distinct")
    )


def _search(by: list[str]):
    """Task-side helper over one row per column: take codes off the ends while they qualify."""
    codes = list(fixed.NUMERIC_CODES)

    def accepted(code, values, hits, gone, present, quartile):
        rest = [v for v in values if v != code]
        n_rest = present - sum(hits[c] for c in [*gone, code])
        if hits.get(code, 0) < fixed.SENTINEL_MIN_COUNT or n_rest < fixed.SENTINEL_MIN_ROWS:
            return False
        out = [*gone, code]
        low = max((c for c in out if c < rest[0]), default=None)
        high = min((c for c in out if c > rest[-1]), default=None)
        q1, q3 = quartile[(str(low), str(high))]
        scale = (q3 - q1) or (rest[-1] - rest[0])
        if scale <= 0:
            return False
        gap = abs((rest[0] if code < rest[0] else rest[-1]) - code)
        alone = (code < 0 <= rest[0]) or (code > 0 >= rest[-1])
        return gap >= fixed.SENTINEL_GAP * scale or (alone and gap >= fixed.SENTINEL_SIGN_GAP * scale)

    def search(batches: Iterator) -> Iterator:
        import pandas as pd

        for batch in batches:
            out = []
            for row in batch.to_dict("records"):
                n_rows, present = int(row["n_rows"]), int(row["present"])
                if n_rows < fixed.SENTINEL_MIN_ROWS or present < fixed.SENTINEL_MIN_ROWS:
                    continue
                hits = {float(m["code"]): int(m["hits"]) for m in row["met"] if m is not None}
                quartile = {(s["lo"], s["hi"]): (s["q1"], s["q3"]) for s in row["states"]}
                bounds = [v for v in (row["low0"], row["high0"]) if v is not None and not math.isnan(v)]
                values, gone = sorted({*hits, *bounds}), []
                while int(row["distinct"]) - len(gone) >= fixed.SENTINEL_MIN_DISTINCT:
                    ends = [v for v in (values[0], values[-1]) if v in codes]
                    code = next((c for c in ends if accepted(c, values, hits, gone, present, quartile)), None)
                    if code is None:
                        break
                    gone.append(code)
                    values.remove(code)
                for code in sorted(gone, key=codes.index):
                    out.append({
                        **{k: row[k] for k in by}, "name": row["name"], "kind": "numeric_code",
                        "value": str(int(code)), "hits": hits[code],
                        "rate": round(hits[code] / n_rows, 4), "position": codes.index(code),
                    })
            yield pd.DataFrame(out, columns=[*by, "name", "kind", "value", "hits", "rate", "position"])

    return search


def detect_sentinels(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Both kinds of findings for the named columns."""
    return text_markers(df, columns, by).unionByName(numeric_codes(df, columns, by))
