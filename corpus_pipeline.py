"""The corpus pipeline: quality, toxicity, exact duplicates, near duplicates, packing, one stage after another.

Each stage takes (spark, docs, sf_dir) and works on all documents that its predecessor kept. All but the last return the
columns of documents. ``run`` writes each stage's rows to the shared folder and reads them again for the next.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import exact, minhash, packing, quality, toxicity
from plumbline.session import stage, table

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches 0.3."""
    stats = stage(quality.document_statistics(docs), "pipeline-statistics")
    score = quality.scorer(quality.fit(stats, table(spark, sf_dir, "labels")))
    return docs.where(score(F.coalesce("text", F.lit(""))) >= quality.LEAST_SCORE)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays below 0.7."""
    score = toxicity.scorer(toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return docs.where(score(F.coalesce("text", F.lit("")))["score"] < toxicity.LEAST_SCORE)


def without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """``docs`` without the ids in ``dropped``; rows without an id stay."""
    return docs.join(dropped.select("doc_id").distinct(), "doc_id", "left_anti").select(docs.columns)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return without(docs, exact.exact_groups(docs).where("not kept"))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates: five-word shingles, similarity of 0.8 or more."""
    return without(docs, minhash.near_duplicates(docs, k=5, percent=80).where("not kept"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the kept documents and their places in sequences of at most 2048 tokens."""
    return packing.packed(docs, TOKENIZER)


STAGES = [("quality", quality_stage), ("toxicity", toxicity_stage), ("exact", exact_stage), ("near", near_stage), ("packing", packing_stage)]

# Trained classifiers and MinHash have no SQL form; tests hold each stage against a plain version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
