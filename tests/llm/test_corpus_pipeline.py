"""The pipeline's stages on a small corpus, each against a plain version of what it must leave."""

import collections
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from plumbline.llm import packing, queries
from test_corpus_operators import BPE, corpus, plain_components

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A corpus with labels, exact copies (one with more white space), near copies, nulls and a row without id."""
    docs, labels, truth = corpus(spark, 600)
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    clean = [i for i in rows if truth[i][1] == 1 and truth[i][2] == 0]
    more = [(1000 + n, rows[i]) for n, i in enumerate(clean[:20])] + [(1100 + n, rows[i].replace(" ", "  ")) for n, i in enumerate(clean[:10])]
    more += [(1200 + n, rows[i] + " addedword") for n, i in enumerate(clean[20:40])] + [(None, rows[clean[50]] + " other"), (1300, None), (1301, "")]
    path = tmp_path_factory.mktemp("corpus")
    table = spark.createDataFrame([*rows.items(), *more], "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.length("text").cast("long")})
    table.repartition(3).write.parquet(f"{path}/documents.parquet")
    labels.write.parquet(f"{path}/labels.parquet")
    return str(path), truth


def test_stages(spark, folder, tmp_path):
    path, truth = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    seen = [docs.collect()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, path).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.columns == COLUMNS
        seen.append(docs.collect())
        assert not collections.Counter(seen[-1]) - collections.Counter(seen[-2])
    start, good, calm, single, apart = seen
    kept = lambda rows: {r["doc_id"] for r in rows}
    known = [i for i in truth]
    assert sum((i in kept(good)) == (truth[i][1] == 1) for i in known) / len(known) > 0.98
    inside = [i for i in known if i in kept(good)]
    assert sum((i in kept(calm)) == (truth[i][2] == 0) for i in inside) / len(inside) > 0.98
    bare = lambda r: re.sub(r"[\x20\x09-\x0D]", "", r["text"] or "")
    assert len({bare(r) for r in single}) == len(single) and {bare(r) for r in single} == {bare(r) for r in calm}
    for r in single:
        assert len(r["text"] or "") == max(len(x["text"] or "") for x in calm if bare(x) == bare(r))
    want = plain_components([(r["doc_id"], r["text"]) for r in single], 5, 80)
    assert kept(apart) - {None} == {i for i, (_, root) in want.items() if i == root}
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, path).collect()
    encode = packing.tokenizer(BPE)
    total = collections.Counter()
    for r in pieces:
        total[r["doc_id"]] += r["length"]
    assert total == collections.Counter({r["doc_id"]: len(encode(r["text"] or "")) // 4 + 1 for r in apart})
    placed = ("doc_id", "piece", "start", "length", "ids_crc32")
    again = corpus_pipeline.run(spark, path).collect()
    assert collections.Counter(tuple(r[c] for c in placed) for r in again) == collections.Counter(tuple(r[c] for c in placed) for r in pieces)


def test_pipeline_of_an_empty_table(spark, folder, tmp_path):
    path, _ = folder
    spark.read.parquet(f"{path}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{path}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_queries_and_twins():
    import __spark_entry__ as entry

    named = entry.queries()
    assert {f"op{n}" for n in range(1, 14)} == {q.split("_")[0] for q in queries.QUERIES} and "pipeline" in named
    assert set(queries.QUERIES) <= set(named) and set(queries.SQL) <= set(entry.oracle_sql())
