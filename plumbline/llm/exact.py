"""Exact duplicates by content-defined chunk recipes, in DataFrame operations only.

Each text, without white space, is cut into chunks at places that its own content names: after the first sentence mark
beyond ``least`` characters, or at ``most`` characters. A chunk gets a 64-bit hash. Distinct chunk texts are gathered once
(combined before the shuffle, so a chunk that thousands of copies share moves once per task); they show whether a hash
stands for one text only. Where it doesn't, the texts of that hash are numbered, so (hash, number) names one chunk text
for certain. A document is then its ordered list of identifiers, and equal lists mean equal texts. Only lists, lengths and
digests move after that, never a document.

Defined results: null text counts as empty, and all texts without visible characters are equal. A row without ``doc_id``
can be dropped for another, and stays only where its whole group has no id. Repeated rows (same id, same text) count each
and get the same answer. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import id_and_text
from plumbline.session import stage

SPACE = r"[\x20\x09-\x0D]+"
LEAST, MOST = 512, 4096


def chunk_pattern(least: int = LEAST, most: int = MOST) -> str:
    return rf"(?s).{{{least},{most - 1}}}?[.!?;。！？]|.{{1,{most}}}"


def chunked(docs: DataFrame, least: int = LEAST, most: int = MOST, slots: int | None = None) -> DataFrame:
    """doc_id, n_points, text_sha256, chunks (texts) and marks (their hashes; ``slots`` narrows them, for tests)."""
    mark = lambda c: F.pmod(F.xxhash64(c), F.lit(slots)) if slots else F.xxhash64(c)
    plain = id_and_text(docs).select("doc_id", F.length("text").cast("long").alias("n_points"), F.regexp_replace("text", SPACE, "").alias("plain"))
    cut = plain.select("doc_id", "n_points", F.sha2("plain", 256).alias("text_sha256"),
                       F.regexp_extract_all("plain", F.lit(chunk_pattern(least, most)), F.lit(0)).alias("chunks"))
    return cut.withColumn("marks", F.transform("chunks", mark))


def recipes(docs: DataFrame, least: int = LEAST, most: int = MOST, slots: int | None = None) -> DataFrame:
    """doc_id, n_points, text_sha256 and ``recipe``: the ordered verified identifiers of the document's chunks."""
    cut = chunked(docs, least, most, slots)
    lists = stage(cut.select("doc_id", "n_points", "text_sha256", "marks"), "exact-lists")
    texts = cut.select(F.explode(F.arrays_zip("marks", "chunks")).alias("x")).select(F.col("x.marks").alias("mark"), F.col("x.chunks").alias("chunk")).distinct()
    shared = stage(texts.groupBy("mark").count().where("count > 1").select("mark"), "exact-shared-hashes")
    if shared.isEmpty():
        return lists.withColumnRenamed("marks", "recipe")
    numbers = texts.join(shared, "mark").withColumn("number", F.row_number().over(Window.partitionBy("mark").orderBy("chunk")))
    # Lists with such a hash are put together again, one per digest and list of hashes.
    touched = cut.select("text_sha256", "marks", F.posexplode(F.arrays_zip("marks", "chunks")).alias("pos", "x"))
    touched = touched.select("text_sha256", "marks", "pos", F.col("x.marks").alias("mark"), F.col("x.chunks").alias("chunk"))
    named = touched.join(numbers, ["mark", "chunk"]).groupBy("text_sha256", "marks", "pos").agg(F.first("number").alias("number"))
    lists_of = named.groupBy("text_sha256", "marks").agg(F.sort_array(F.collect_list(F.struct("pos", "number"))).alias("numbers"))
    return lists.join(lists_of, ["text_sha256", "marks"], "left").select(
        "doc_id", "n_points", "text_sha256",
        F.concat("marks", F.coalesce(F.flatten(F.transform("numbers", lambda x: F.array(x["pos"].cast("long"), x["number"].cast("long")))), F.array().cast("array<bigint>"))).alias("recipe"))


def exact_groups(docs: DataFrame, least: int = LEAST, most: int = MOST, slots: int | None = None) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the one with most code points stays, then the smallest id. The group table is written, then joined back on
    the list: both sides are plain shuffles, one of them unique, so Spark splits a list that a third of the rows share.
    """
    rows = recipes(docs, least, most, slots)
    best = F.min(F.struct((-F.col("n_points")).alias("less"), F.col("doc_id").isNull().alias("no_id"), "doc_id")).alias("best")
    groups = stage(rows.groupBy("recipe").agg(F.count("*").alias("group_size"), best).select("recipe", "group_size", F.col("best.doc_id").alias("keep_id")), "exact-groups")
    joined = rows.join(groups, "recipe")
    return joined.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
