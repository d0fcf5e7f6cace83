"""Small helpers of the operators: the columns they read, and the fixed folds of the labelled rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def id_and_text(docs: DataFrame) -> DataFrame:
    """Only ``doc_id`` (long) and ``text``, null text as empty; other columns never enter a plan, so no name can clash."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def remainder(doc_id: Column | str, k: int) -> Column:
    """crc32 of the id written as text, modulo ``k``; null ids give -1."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(col.cast("string").cast("binary")) % k, F.lit(-1))
