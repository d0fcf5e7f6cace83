"""Declared preprocessing: an ordered list of steps, fitted on train rows, applied as projections."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline import fixed
from plumbline.operators.keys import quoted, rows_of
from plumbline.operators.quantiles import exact_quantiles


def select_columns(columns: Sequence[str], names: Sequence[str] | None) -> tuple[list[str], list[str]]:
    """Encoded columns for plan names (a text column's name takes all its levels), and the unknown ones."""
    if names is None:
        return list(columns), []
    chosen, unknown = set(), []
    for name in names:
        hits = [c for c in columns if c == name] or [
            c for c in columns if c.startswith(f"{name}{fixed.LEVEL_SEPARATOR}")
        ]
        chosen.update(hits)
        if not hits:
            unknown.append(name)
    return [c for c in columns if c in chosen], unknown


def _c(name: str):
    return F.col(f"`{name}`")


@dataclass
class Fitted:
    """One fitted step; everything in it is a scalar per column."""

    name: str
    kind: str
    columns: list[str]
    values: dict = field(default_factory=dict)
    drop: list[str] = field(default_factory=list)
    label: str = "all"

    def apply(self, df: DataFrame) -> DataFrame:
        if self.kind == "impute":
            fills = {c: F.coalesce(_c(c), F.lit(float(v))) for c, v in self.values.items()}
            return df.select(*[fills.get(c, _c(c)).alias(c) for c in df.columns if c not in self.drop])
        if self.kind == "scale":
            return df.select(*[
                ((_c(c) - self.values[c][0]) / (self.values[c][1] or 1.0)).alias(c) if c in self.values else _c(c)
                for c in df.columns
            ])
        if self.kind == "interactions":
            return df.select("*", *[
                (_c(a) * _c(b)).alias(f"{a}{fixed.INTERACTION_JOIN}{b}") for a, b in combinations(self.columns, 2)
            ])
        if self.kind == "missing_indicator":
            return df.select("*", *[_c(c).isNull().cast("double").alias(f"{c}{fixed.INDICATOR_SUFFIX}") for c in self.columns])
        total = F.lit(0.0)
        for c in self.columns:
            total = total + _c(c).isNull().cast("double")
        return df.withColumn(fixed.MISSING_COUNT_COLUMN, total)


@dataclass
class FittedSteps:
    steps: list[Fitted]
    columns: list[str]
    applied: list[str]
    log: list[str]

    def apply(self, df: DataFrame) -> DataFrame:
        for step in self.steps:
            df = step.apply(df)
        return df


def most_frequent(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows (name, value): the commonest present value, the smallest on ties. Counts come before the choice."""
    long = df.select(rows_of([
        f"CASE WHEN {quoted(c)} IS NOT NULL THEN struct('{c}' AS name, CAST({quoted(c)} AS DOUBLE) AS value) END" for c in columns
    ]))
    counts = long.groupBy("name", "value").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("name").agg(F.max_by("value", F.struct(F.col("n"), -F.col("value"))).alias("value"))


def fill_values(df: DataFrame, columns: Sequence[str], strategy: str, constant: float = 0.0) -> dict[str, float | None]:
    """Fill value per column from the train rows; None where a column has no present value."""
    columns = list(columns)
    if not columns:
        return {}
    if strategy == "constant":
        return {c: float(constant) for c in columns}
    if strategy == "mean":
        row = df.agg(*[F.avg(_c(c)).alias(f"v{i}") for i, c in enumerate(columns)]).first()
        return {c: row[f"v{i}"] for i, c in enumerate(columns)}
    if strategy == "none":
        row = df.agg(*[F.min(_c(c)).alias(f"v{i}") for i, c in enumerate(columns)]).first()
        return {c: None if row[f"v{i}"] is None else row[f"v{i}"] - 1.0 for i, c in enumerate(columns)}
    if strategy == "most_frequent":
        found = {r["name"]: r["value"] for r in most_frequent(df, columns).collect()}
    else:
        found = {r["measure"]: r["value"] for r in exact_quantiles(
            df, {c: quoted(c) for c in columns}, {c: (0.5,) for c in columns}).collect()}
    return {c: found.get(c) for c in columns}


def _fit_impute(df: DataFrame, name: str, entry: dict, columns: list[str], native: bool, log: list[str]) -> list[Fitted]:
    def strategy_of(source: dict, default: str) -> str:
        wanted = source.get("strategy") or default
        if wanted not in fixed.IMPUTE_STRATEGIES:
            log.append(f"impute: unknown strategy {wanted!r}, using {default}")
            wanted = default
        if wanted == "none" and not native:
            log.append("impute: 'none' needs a family that splits on missing values, using median")
            wanted = "median"
        return wanted

    rest, plan, labels = strategy_of(entry, "median"), [], []
    taken: set[str] = set()
    for group in entry.get("groups") or []:
        chosen, unknown = select_columns(columns, group.get("columns"))
        if unknown:
            log.append(f"impute: no such column(s) {sorted(unknown)}")
        chosen = [c for c in chosen if c not in taken]
        taken.update(chosen)
        if chosen:
            plan.append((strategy_of(group, rest), float(group.get("fill_value", 0.0)), chosen))
            labels.append(f"{plan[-1][0]}: {', '.join(chosen)}")
    plan.append((rest, 0.0, [c for c in columns if c not in taken]))
    values: dict[str, float | None] = {}
    kept_missing: list[str] = []
    for strategy, constant, chosen in plan:
        values.update(fill_values(df, chosen, strategy, constant))
        if strategy == "none":
            kept_missing += chosen
    empty = [c for c, v in values.items() if v is None]
    if empty:
        log.append(f"impute: no present value in {empty}, dropped")
    label = rest + (f" ({'; '.join(labels)})" if labels else "")
    fitted = [Fitted(name, "impute", columns, {c: v for c, v in values.items() if v is not None}, empty, label)]
    if kept_missing:
        # Trees here cannot hold a missing value: a fill below the minimum plus an indicator keeps the branch.
        flags = [c for c in kept_missing if c not in empty]
        log.append("impute: 'none' realised as fill below the minimum plus indicator")
        fitted.insert(0, Fitted(f"{name}_indicator", "missing_indicator", flags, label="none"))
    return fitted


def flag_steps(flags: dict, model: str) -> list[dict]:
    """The step list of the four preprocessing flags (other spellings allowed) for a model family."""
    named = {fixed.PREPROCESSING_ALIASES.get(str(k), str(k)): v for k, v in flags.items()}
    strategy = str(named.get("impute") or "median")
    if strategy not in ("median", "mean", "most_frequent", "none") or (strategy == "none" and model not in fixed.NATIVE_MISSING):
        strategy = "median"
    spec = [{"step": s} for s in ("missing_indicator", "missing_count") if named.get(s)]
    spec.append({"step": "impute", "strategy": strategy})
    scale = named.get("scale")
    if scale if isinstance(scale, bool) else model in fixed.SCALE_SENSITIVE:
        spec.append({"step": "scale"})
    return spec


def _leaves_missing(entry: dict, native: bool) -> bool:
    parts = [entry, *(g for g in entry.get("groups") or [] if isinstance(g, dict))]
    return native and any(p.get("strategy") == "none" for p in parts)


def fit_steps(df: DataFrame, spec: Sequence[dict], columns: Sequence[str], native_missing: bool = False, scale_sensitive: bool = False) -> FittedSteps:
    """Fit the declared steps in order on train rows; unusable steps are dropped with a reason.

    A median impute follows the last appending step if none was declared, and scaling is added for a
    family that needs it; both are marked ``(auto)``.
    """
    entries = [dict(e) for e in spec if isinstance(e, dict)]
    names = [str(e.get("step", "")).strip().lower() for e in entries]
    auto: set[int] = set()
    if "impute" not in names:
        at = max((i + 1 for i, n in enumerate(names) if n in ("missing_indicator", "missing_count")), default=0)
        entries.insert(at, {"step": "impute", "strategy": "none" if native_missing and names else "median"})
        auto.add(at)
    if scale_sensitive and "scale" not in names:
        entries.append({"step": "scale"})
        auto.add(len(entries) - 1)
    current, names_now = df.select(*[_c(c) for c in columns]), list(columns)
    out: list[Fitted] = []
    applied: list[str] = []
    log: list[str] = []
    seen: dict[str, int] = {}
    imputed = False
    for position, entry in enumerate(entries):
        kind = str(entry.get("step", "")).strip().lower()
        if kind not in fixed.STEP_NAMES:
            log.append(f"unknown step {entry.get('step')!r}, dropped")
            continue
        chosen, unknown = select_columns(names_now, entry.get("columns"))
        if unknown:
            log.append(f"{kind}: no such column(s) {sorted(unknown)}")
        label = "all" if entry.get("columns") is None else ", ".join(chosen) or "none"
        seen[kind] = seen.get(kind, 0) + 1
        name = kind if seen[kind] == 1 else f"{kind}_{seen[kind]}"
        if kind == "impute":
            fitted = _fit_impute(current, name, entry, names_now, native_missing, log)
            label, imputed = fitted[-1].label, imputed or not _leaves_missing(entry, native_missing)
        elif kind == "interactions":
            if not imputed:
                log.append("interactions: a missing value may remain, skipped")
            elif not 2 <= len(chosen) <= fixed.INTERACTION_MAX_COLUMNS or entry.get("degree", 2) != 2:
                log.append(f"interactions: {len(chosen)} columns, degree {entry.get('degree', 2)}: skipped")
            if not imputed or not 2 <= len(chosen) <= fixed.INTERACTION_MAX_COLUMNS or entry.get("degree", 2) != 2:
                seen[kind] -= 1
                continue
            fitted = [Fitted(name, kind, chosen, label=label)]
        elif kind == "scale":
            row = current.agg(*[
                F.struct(F.avg(_c(c)).alias("mean"), F.stddev_pop(_c(c)).alias("sd")).alias(f"s{i}")
                for i, c in enumerate(chosen)
            ]).first() if chosen else None
            if row is None:
                seen[kind] -= 1
                continue
            fitted = [Fitted(name, kind, chosen, {
                c: (row[f"s{i}"]["mean"] or 0.0, row[f"s{i}"]["sd"] or 0.0) for i, c in enumerate(chosen)
            }, label=label)]
        else:
            if not chosen:
                seen[kind] -= 1
                continue
            fitted = [Fitted(name, kind, names_now if kind == "missing_count" else chosen, label=label)]
        for step in fitted:
            current = step.apply(current)
        names_now = current.columns
        out += fitted
        applied.append(f"{kind}(auto)" if position in auto else f"{kind}({label})")
    return FittedSteps(out, names_now, applied, log)
