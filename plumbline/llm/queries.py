"""Named queries of the operators and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import (
    exact, html_text, licenses, merkle, minhash, packing, pitman_yor, quality, quality_rules, sentencepiece_codec, sql_text, toxicity, turn_trie,
    vector_lists,
)
from plumbline.session import table


def op1_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    return sentencepiece_codec.encoded(table(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op2_vector_lists(spark: SparkSession, folder: str) -> DataFrame:
    return vector_lists.nearest_neighbours(table(spark, folder, "embeddings"))


def op3_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.toxicity_scores(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op4_html(spark: SparkSession, folder: str) -> DataFrame:
    return html_text.extracted(table(spark, folder, "pages"))


def op5_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.quality_scores(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op6_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.packed(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op7_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact.exact_groups(table(spark, folder, "documents"))


def op8_licenses(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.license_scan(table(spark, folder, "documents"))


def op9_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, folder, "documents"), k=3, percent=85)


def op10_language_model(spark: SparkSession, folder: str) -> DataFrame:
    return pitman_yor.model_scores(table(spark, folder, "documents"))


def op11_merkle(spark: SparkSession, folder: str) -> DataFrame:
    return merkle.manifest(table(spark, folder, "documents"))


def op12_turn_trie(spark: SparkSession, folder: str) -> DataFrame:
    return turn_trie.prefix_trie(table(spark, folder, "conversations"))


def op13_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules.judged(table(spark, folder, "documents"), table(spark, folder, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_vector_lists": op2_vector_lists,
    "op3_toxicity": op3_toxicity,
    "op4_html": op4_html,
    "op5_quality": op5_quality,
    "op6_packing": op6_packing,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_licenses": op8_licenses,
    "op9_minhash": op9_minhash,
    "op10_language_model": op10_language_model,
    "op11_merkle": op11_merkle,
    "op12_turn_trie": op12_turn_trie,
    "op13_quality_rules": op13_quality_rules,
}

SQL: dict[str, str] = {
    "op7_exact_dedup": r"""
WITH plain AS (SELECT doc_id, coalesce(text, '') AS whole, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS bare FROM documents),
     digest AS (SELECT doc_id, length(whole) AS points, sha256(bare) AS text_sha256 FROM plain),
     best AS (SELECT doc_id, text_sha256, count(*) OVER (PARTITION BY text_sha256) AS group_size,
                     first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY points DESC, doc_id) AS keep_id FROM digest)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM best""",
    "op11_merkle": sql_text.MERKLE,
    "op12_turn_trie": sql_text.PREFIX_TRIE,
    "op13_quality_rules": sql_text.QUALITY_RULES,
}
