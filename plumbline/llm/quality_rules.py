"""Quality rules and a hashed n-gram likelihood ratio, in DataFrame operations only.

A word becomes a number (its crc32), a unigram or a pair of neighbouring words one of ``BUCKETS`` buckets. Two multinomials over the buckets are counted: one of the whole corpus, one of the trusted documents (labelled
quality 1, never 0; at most ``TRUSTED_ROWS`` of them, taken by the md5 of their id). The trusted one leans on the corpus by
``PRIOR`` pseudo-words, so few trusted texts give small ratios instead of wild ones. A text's score is the mean of the
log ratios of its n-grams; every text below ``LEAST_SCORE`` is rejected, without any draw.

The log ratios are whole millionths, so sums don't depend on the order of rows and two engines agree on every verdict.

What a task holds is one text's words. The counts have ``BUCKETS`` rows at any size of the corpus and are summed before the
shuffle, so common words don't meet in one task; the ratios reach the tasks as one constant of ``BUCKETS`` numbers.

Defined results: null text counts as empty: no words, score 0, ``base_failed``. A text without an n-gram has score 0. Without
trusted words every score is 0 and only the base rules reject. Ids with contradicting labels are not trusted. Rows without
``doc_id`` are judged and never trusted. Repeated rows count each and get equal answers. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import id_and_text
from plumbline.session import stage

BUCKETS = 10_000
PRIOR = 100_000
TRUSTED_ROWS = 100_000
LEAST_SCORE = -0.1
WINDOW = 5
LEAST_WORDS = 10
MOST_REPEATED_PERCENT = 20

BLANKS = "[\\x20\\x09-\\x0D]+"
BLANK_SIGNS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"


def _without(text: Column, signs: str) -> Column:
    return F.translate(text, signs, "")


def _worded(docs: DataFrame) -> DataFrame:
    """doc_id, text and ``words`` in order."""
    return id_and_text(docs).select("doc_id", "text", F.filter(F.split("text", BLANKS), lambda w: w != "").alias("words"))


def _numbers(words: Column) -> Column:
    return F.transform(words, F.crc32)


def _grams(h: Column) -> Column:
    """The buckets of all unigrams and pairs. ``h`` must be a column of the row, not an expression."""
    small = lambda x: x % 1_000_003
    pairs = F.transform(F.slice(h, 2, F.greatest(F.size(h) - 1, F.lit(0))), lambda w, i: ((small(F.get(h, i)) * 31 + small(w)) % BUCKETS).cast("int"))
    return F.concat(F.transform(h, lambda w: (w % BUCKETS).cast("int")), pairs)


def trusted_ids(labels: DataFrame, rows: int = TRUSTED_ROWS) -> DataFrame:
    """Ids labelled 1 and never 0; ``rows`` of them at most, the smallest md5 first."""
    agreed = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("least"), F.max("quality").alias("most"))
    ids = agreed.where("least = 1 AND most = 1")
    return ids.orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(rows).select("doc_id")


def bucket_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """bucket, n (in all texts) and trusted (in trusted texts)."""
    # At most TRUSTED_ROWS ids of eight bytes.
    known = trusted_ids(labels).select("doc_id", F.lit(1).alias("one"))
    marked = _worded(docs).select("doc_id", _numbers(F.col("words")).alias("h")).join(F.broadcast(known), "doc_id", "left")
    grams = marked.select("one", F.explode(_grams(F.col("h"))).alias("bucket"))
    return grams.groupBy("bucket").agg(F.count("*").alias("n"), F.count("one").alias("trusted"))


def log_ratios(counts: DataFrame) -> list[int]:
    """ln of trusted over corpus probability per bucket, in millionths; 0 where the corpus has no such n-gram."""
    staged = stage(counts, "quality-rule-counts")
    total, trusted = staged.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("trusted"), F.lit(0))).first()
    share = (F.col("trusted").cast("double") * float(total) / F.col("n") + float(PRIOR)) / (float(trusted) + float(PRIOR))
    out = [0] * BUCKETS
    for bucket, ratio in staged.select("bucket", F.round(F.log(share) * 1e6).cast("long")).collect():  # BUCKETS rows
        out[bucket] = ratio
    return out


def _constant(numbers: list[int]) -> Column:
    """An array constant, folded once by the optimizer."""
    return F.split(F.lit(",".join(map(str, numbers))), ",").cast("array<bigint>")


def _repeated_words(keys: Column) -> Column:
    """Words inside windows whose key occurs twice or more. ``keys`` must be a column of the row."""
    marked = F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("i")))
    twice = F.transform(F.array(F.sort_array(marked)), lambda s: F.filter(
        F.transform(s, lambda x, j: F.when((x["k"] == F.get(s, j - 1)["k"]) | (x["k"] == F.get(s, j + 1)["k"]), x["i"])), lambda i: i.isNotNull()))
    covered = F.aggregate(
        F.sort_array(F.flatten(twice)), F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("n")),
        lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n")), lambda a: a["n"])
    return F.when(F.size(F.array_distinct(keys)) == F.size(keys), F.lit(0).cast("long")).otherwise(covered)


def rule_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, h (word numbers), n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text, h = F.col("text"), F.col("h")
    lines = F.filter(F.split(text, "\n", -1), lambda line: _without(line, BLANK_SIGNS) != "")
    # Windows are told apart by 64-bit hashes of their words' 64-bit hashes.
    seen = _worded(docs).select("doc_id", "text", _numbers(F.col("words")).alias("h"), F.transform("words", lambda w: F.xxhash64(w)).alias("x"), lines.alias("lines"))
    x = F.col("x")
    windows = F.transform(F.slice(x, WINDOW, F.greatest(F.size(x) - (WINDOW - 1), F.lit(0))),
                          lambda w, i: F.xxhash64(*[F.get(x, i + k) for k in range(WINDOW - 1)], w))
    seen = seen.select("doc_id", "text", "h", "lines", windows.alias("windows"))
    long = lambda c: c.cast("long")
    return seen.select(
        "doc_id", "h", long(F.size("h")).alias("n_words"), long(F.length(_without(text, BLANK_SIGNS))).alias("word_chars"),
        long(F.length(text) - F.length(_without(text, SYMBOLS))).alias("n_symbols"),
        long(F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        _repeated_words(F.col("windows")).alias("n_repeat_words"))


def judged(docs: DataFrame, labels: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """One row per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, ratio.

    ``ratio`` is the summed log ratio in millionths; divided by the number of n-grams it is the score that ``least`` bounds.
    """
    ratios = _constant(log_ratios(bucket_counts(docs, labels)))
    told = rule_statistics(docs).withColumn("grams", _grams(F.col("h")))
    ratio = F.aggregate("grams", F.lit(0).cast("long"), lambda a, g: a + F.get(ratios, g))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))
    bound = F.lit(round(least * 1e6)).cast("long") * F.size("grams")
    scored = told.select(*[c for c in told.columns if c not in ("h", "grams")], failed.alias("base_failed"), ratio.alias("ratio"), bound.alias("bound"))
    return scored.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.col("ratio") >= F.col("bound"))).alias("kept"), "ratio")
