"""License scan by ordered signature rules, in DataFrame operations only.

Texts are turned into words; the keywords among them pick the rules worth trying, and only those patterns run. Detections of a document are then put in order (start, longer first, higher priority first, earlier
rule first), and one that lies inside an earlier one of at least its priority is suppressed: four running maxima of ends,
one per priority, tell so in one pass, whatever the number of detections. Texts never move; detections do.

Beside the rules, base phrases are counted in full: every place where their words stand one after another.

Defined results: null and empty texts have no words, no labels and score 0. Rows without ``doc_id`` and repeated rows are
scanned like others, each for itself. The score is the confidence of the best detection that stays. Other columns are
ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import id_and_text
from plumbline.llm.license_rules import KINDS, rules
from plumbline.session import stage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
FOUND = "array<struct<rule: int, label: string, priority: int, confidence: double, start: int, end: int>>"


def _blanks(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def _spans(words: Column, rule: Column) -> Column:
    """Every match of one rule as (rule, label, priority, confidence, start, end), in characters of the words."""
    hits = F.regexp_extract_all(words, rule["pattern"], F.lit(0))
    gaps = F.split(words, rule["pattern"], -1)
    ends = F.reduce(
        F.arrays_zip(gaps.alias("gap"), hits.alias("hit")), F.array().cast("array<int>"),
        lambda seen, x: F.concat(seen, F.array((F.coalesce(F.try_element_at(seen, F.lit(-1)), F.lit(0)) + F.length(x["gap"]) + F.length(F.coalesce(x["hit"], F.lit("")))).cast("int"))))
    return F.transform(F.arrays_zip(F.slice(ends, F.lit(1), F.size(hits)).alias("to"), hits.alias("hit")), lambda x: F.struct(
        rule["rule"].alias("rule"), rule["label"].alias("label"), rule["priority"].alias("priority"), rule["confidence"].alias("confidence"),
        (x["to"] - F.length(x["hit"])).alias("start"), x["to"].alias("end")))


def _rules_column() -> tuple[Column, Column]:
    """All rules and their distinct keywords as constants."""
    made = F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(label).alias("label"), F.lit(priority).alias("priority"), F.lit(confidence).alias("confidence"),
                              F.lit(keyword).alias("keyword"), F.lit(pattern).alias("pattern")) for n, label, priority, confidence, keyword, pattern in rules()])
    return made, F.array(*[F.lit(k) for k in sorted({r[4] for r in rules()})])


def scanned(docs: DataFrame) -> DataFrame:
    """One written row per document: key, doc_id, n_words, base figures and all detections before suppression."""
    made, keywords = _rules_column()
    rows = id_and_text(docs).select("doc_id", F.regexp_count("text", F.lit(WORD)).cast("long").alias("n_words"),
                                    F.concat(F.lit(" "), F.trim(F.regexp_replace(F.translate("text", UPPER, LOWER), GAP, " ")), F.lit(" ")).alias("words"))
    out = rows.select(
        "*",
        *[F.split("words", rf"(?<= ){phrase}(?= )", -1).alias(f"cut_{label}") for phrase, label in BASE.items()],
        F.array_intersect(F.split(F.trim("words"), " "), keywords).alias("keywords"))
    places = {label: F.coalesce(F.array_size(f"cut_{label}") - 1, F.lit(0)) for label in BASE.values()}
    firsts = [F.when(places[label] > 0, _blanks(F.element_at(f"cut_{label}", 1)) - 1) for label in BASE.values()]
    lasts = [F.when(places[label] > 0, _blanks(F.col("words")) - _blanks(F.element_at(f"cut_{label}", -1)) - phrase.count(" ") - 1) for phrase, label in BASE.items()]
    # Rules without a keyword among the words are left aside; the rest run in order.
    tried = F.filter(made, lambda r: F.array_contains("keywords", r["keyword"]))
    found = F.flatten(F.transform(tried, lambda r: _spans(F.col("words"), r)))
    return stage(out.select(
        F.monotonically_increasing_id().alias("key"), "doc_id", "n_words", reduce(lambda a, b: a + b, places.values()).cast("long").alias("n_base"),
        F.least(*firsts).cast("long").alias("first_word"), F.greatest(*lasts).cast("long").alias("last_word"),
        F.filter(F.array(*[F.when(n > 0, F.lit(label)) for label, n in places.items()]), lambda x: x.isNotNull()).alias("base"),
        F.coalesce(found.cast(FOUND), F.array().cast(FOUND)).alias("found")), "licenses-scanned")


def surviving(rows: DataFrame) -> DataFrame:
    """key, doc_id and detections that no other one contains, of ``scanned`` rows."""
    each = rows.select("key", "doc_id", F.explode("found").alias("d")).select("key", "doc_id", "d.*")
    before = Window.partitionBy("key").orderBy("start", F.desc("end"), F.desc("priority"), "rule").rowsBetween(Window.unboundedPreceding, -1)
    levels = sorted({p for p, _ in KINDS.values()})
    reach = {p: F.max(F.when(F.col("priority") >= p, F.col("end"))).over(before) for p in levels}
    inside = reduce(lambda a, b: a | b, [(F.col("priority") == p) & (F.coalesce(F.col(f"reach_{p}"), F.lit(-1)) >= F.col("end")) for p in levels])
    return each.select("*", *[c.alias(f"reach_{p}") for p, c in reach.items()]).where(~inside).drop(*[f"reach_{p}" for p in levels])


def detections(docs: DataFrame) -> DataFrame:
    """doc_id, label, rule, priority, confidence, start and end (characters of the text's words) of each detection that stays."""
    return surviving(scanned(docs)).drop("key")


def license_scan(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    rows = scanned(docs)
    kept = surviving(rows).groupBy("key").agg(F.collect_set("label").alias("more"), F.max("confidence").alias("confidence"))
    joined = rows.drop("found").join(kept, "key", "left")
    names = F.array_sort(F.array_distinct(F.concat("base", F.coalesce("more", F.array().cast("array<string>")))))
    return joined.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.concat_ws(",", F.array_sort("base")).alias("base_labels"),
                         F.concat_ws(",", names).alias("labels"), F.coalesce("confidence", F.lit(0.0)).alias("score"))
