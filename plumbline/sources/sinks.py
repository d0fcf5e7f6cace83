"""Writers: dataset cards and predictions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Keys that could carry rows.
ROW_KEYS = frozenset({"sample", "samples", "sample_rows", "head", "rows", "examples", "preview", "raw", "raw_rows"})


def check_card(df: DataFrame) -> None:
    """Refuse a card with a field that could carry original rows."""
    bad = [c for c in df.columns if c.lower() in ROW_KEYS]
    if bad:
        raise ValueError(f"a card holds aggregates only; not allowed: {bad}")


def write_card(df: DataFrame, path: str) -> None:
    """One JSON line per dataset. A card is one row, so one file."""
    check_card(df)
    df.coalesce(1).write.mode("overwrite").json(path)


def predictions(df: DataFrame, key: str, labels: Sequence[str] = ()) -> DataFrame:
    """The columns a prediction file may hold: key, prediction and one probability per label."""
    return df.select(key, "prediction", *[F.col(f"`proba_{label}`") for label in labels])


def write_predictions(df: DataFrame, path: str, key: str, labels: Sequence[str] = (), form: str = "parquet") -> None:
    out = predictions(df, key, labels)
    writer = out.write.mode("overwrite")
    writer.option("header", True).csv(path) if form == "csv" else writer.parquet(path)
