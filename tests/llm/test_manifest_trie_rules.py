"""Merkle manifest, conversation trie and quality rules on small fixtures, against SQL and plain versions."""

import hashlib
import random
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from check import normal
from plumbline.llm import merkle, quality_rules, sql_text, turn_trie

CLASH = "tree int, pos long, node string, h long, words string, lines long, step int, ids long, shard int, row long, bucket int"
EXTRA = (1, 2, "n", 3, "w", 4, 5, 6, 7, 8, 9)


def same(df, sql, **tables):
    con = duckdb.connect()
    for name, frame in tables.items():
        con.register(name, frame.toArrow())
    want = con.execute(sql)
    columns = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(columns)
    got = normal([tuple(r) for r in df.collect()], df.columns)
    assert got == normal(want.fetchall(), columns)
    return got


# ---- Merkle manifest ----

MANIFEST = "doc_id long, source string, lang string, n_chars long, text string, " + CLASH


def manifest_docs(spark):
    rows = [(i, f"s{i % 3}", "en", i, f"Text {i} É") for i in range(150)]
    rows += [(1000 + i, None, f"l{i:02d}", None, "ABC") for i in range(11)]  # more than eight languages: two levels over them
    rows += [(2000, "s", None, 1, None), (None, None, None, None, None), (3, "s0", "en", 3, "Text 3 É"), (3, "s0", "en", 3, "Text 3 É"), (4, "x", "é", 0, ""),
             (2001, "a" * 50, "en", 7, "long WORD " * 20_000)]
    return spark.createDataFrame([(*r, *EXTRA) for r in rows], MANIFEST).repartition(5)


@pytest.mark.parametrize("crown", [4, 512])
def test_manifest_equals_sql(spark, crown):
    docs = manifest_docs(spark)
    same(merkle.manifest(docs, crown), sql_text.MERKLE, documents=docs.select("doc_id", "source", "lang", "n_chars", "text"))


def test_manifest_of_one_and_of_none(spark):
    one = spark.createDataFrame([(5, None, None, None, "AB", *EXTRA)], MANIFEST)
    row = merkle.manifest(one).first()
    leaf = hashlib.sha256(b"1:5---2:AB").hexdigest()
    assert row["leaf"] == row["subroot"] == row["root"] == leaf and row["proof_sha256"] == hashlib.sha256(b"").hexdigest()
    assert row["verified"] == (zlib.crc32(b"5") % 3 != 0)
    assert merkle.manifest(one.limit(0)).collect() == []


def test_manifest_tells_tampered_rows(spark):
    docs = manifest_docs(spark).where("lang = 'en'").dropDuplicates(["doc_id"])
    rows = merkle.manifest(docs, 4).collect()
    for r in rows:
        assert r["verified"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 != 0)
    assert len({r["root"] for r in rows}) == 1


# ---- conversation trie ----

TURNS = "conv_id long, turn long, role string, text string, " + CLASH


def conversation_rows(spark):
    rows = []
    for c in (0, 1, 2, 3, 19, 20, 21, 25, 39, 41, 45, 46, 47, -3, -20, 100):
        for t in range(c % 5 + 1):
            rows.append((c, t, ("user", "assistant")[t % 2], f"turn {t} of {c // 30}"))
    rows += [(60, None, None, None), (60, 1, None, ""), (60, 1, "", None), (60, 1, "user", "x y z"), (61, None, "u", "ab c"), (62, 5, "ua", "b c")]
    rows += [(c, t, "user", f"same {t} words here") for c in range(200, 320) for t in range(3)]  # a third of all rows in one path
    rows += [(400, t, "user", f"step {t % 7}") for t in range(300)] + [(401, 0, "user", "long " * 30_000), (None, 1, "user", "nobody")]
    return spark.createDataFrame([(*r, *EXTRA) for r in rows], TURNS).repartition(4)


@pytest.mark.parametrize("shard_turns", [5, 20_000])
def test_trie_equals_sql(spark, shard_turns):
    rows = conversation_rows(spark)
    same(turn_trie.prefix_trie(rows, shard_turns), sql_text.PREFIX_TRIE, conversations=rows.select("conv_id", "turn", "role", "text"))


def test_trie_of_nothing_and_of_one(spark):
    rows = conversation_rows(spark)
    assert turn_trie.prefix_trie(rows.limit(0)).collect() == []
    one = turn_trie.prefix_trie(rows.where("conv_id = 61")).collect()
    # The host has no rows, so its turns are missing; what is left is this conversation from its own later turns.
    assert len(one) == 1 + (0 if zlib.crc32(b"61") % 4 else 1)
    assert one[0]["depth"] == 0 and one[0]["parent_conv_id"] is None and one[0]["n_convs"] == 1


def test_medians_come_first():
    assert sorted(turn_trie.medians(100)) == list(range(100)) and next(turn_trie.medians(100)) == 50
    trie = turn_trie.TernaryTrie()
    for i in turn_trie.medians(1023):
        trie.insert([i], [1], i)

    def height(node):
        return 0 if node < 0 else 1 + max(height(trie.low[node]), height(trie.high[node]))

    assert height(trie.down[0]) == 10


# ---- quality rules ----

DOCS = "doc_id long, text string, " + CLASH


def rule_docs(spark):
    good = "The quick brown fox jumps over the lazy dog and rests near the old stone bridge in the evening light"
    texts = [None, "", " \t\n ", "one", "one two", good, good + " again", good.upper(), (good + "\n") * 4, "a b c d e " * 30, "x# $y %z &| <> *",
             "a\n\na\n \nb\nb\t", "漢字 Ünï " * 9 + good, "buy | now | cheap | pills | here | click | this | link | today | only | " * 5, "\n".join(good.split()),
             good + " " + " ".join(f"n{i}" for i in range(30_000))]
    rows = list(enumerate(texts)) + [(None, good), (5, good), (5, "another text of this id")]
    rows += [(100 + i, f"{good} number {i}") for i in range(30)]
    return spark.createDataFrame([(*r, *EXTRA) for r in rows], DOCS).repartition(3)


@pytest.mark.parametrize("labelled", [True, False])
def test_rules_equal_sql(spark, labelled):
    docs = rule_docs(spark)
    rows = [(i, 1, 0) for i in range(100, 130)] + [(5, 1, 0), (5, 0, 0), (6, 1, None), (6, 1, 0), (13, 0, 1), (None, 1, 0), (7, None, 0), (9999, 1, 0)]
    labels = spark.createDataFrame(rows if labelled else [], "doc_id long, quality int, toxic int")
    same(quality_rules.judged(docs, labels), sql_text.QUALITY_RULES, documents=docs.select("doc_id", "text"), labels=labels)
    assert quality_rules.judged(docs.limit(0), labels).collect() == []


def test_rules_reject_what_trusted_texts_never_hold(spark):
    rng = random.Random(5)
    clean = [(i, " ".join(f"w{rng.randrange(400)}" for _ in range(300))) for i in range(600)]
    junk = [(1000 + i, " | ".join(f"j{rng.randrange(50)}" for _ in range(60))) for i in range(40)]
    docs = spark.createDataFrame(clean + junk, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(0, 600, 2)] + [(1000 + i, 0) for i in range(0, 40, 2)], "doc_id long, quality int")
    kept = {r["doc_id"]: r["kept"] for r in quality_rules.judged(docs, labels).where("not base_failed").collect()}
    assert all(kept[i] for i, _ in clean if i in kept) and not any(kept[i] for i, _ in junk if i in kept)
    assert sum(i < 1000 for i in kept) > 500 and sum(i >= 1000 for i in kept) > 30


def test_rules_run_without_python(spark):
    docs = rule_docs(spark)
    plan = quality_rules.judged(docs, spark.createDataFrame([(100, 1)], "doc_id long, quality int"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_positions_by_ranges(spark):
    from plumbline.operators.ranges import positions

    df = spark.range(0, 3000, 1, 7).select((F.col("id") % 13).alias("v"), F.when(F.col("id") % 3 > 0, F.col("id") % 2).alias("g"))
    rows = positions(df, [F.col("v").desc()], ["g"]).collect()
    for g in (None, 0, 1):
        mine = sorted(((r["position"], r["v"]) for r in rows if r["g"] == g))
        assert [p for p, _ in mine] == list(range(len(mine))) and [v for _, v in mine] == sorted((v for _, v in mine), reverse=True)
