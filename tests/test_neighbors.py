"""Nearest neighbours by blocks and by projection hashing."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plumbline.operators import neighbors


def rows(spark, n=400, d=6, seed=0):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, d)), 2)
    x[10:20] = x[0]  # ties at distance 0
    return x, spark.createDataFrame([(i, v.tolist(), i % 3) for i, v in enumerate(x)], "id long, v array<double>, c int").repartition(3)


def plain(x, q, k):
    gaps = ((x - x[q]) ** 2).sum(1)
    return [int(i) for i in np.argsort(gaps, kind="stable")[:k]]


@pytest.mark.parametrize("block", [10_000, 37])
def test_blocks_equal_a_plain_search(spark, monkeypatch, block):
    monkeypatch.setattr(neighbors, "BLOCK_ROWS", block)
    monkeypatch.setattr(neighbors, "QUERIES_AT_ONCE", 11)
    x, df = rows(spark)
    found = {}
    for r in neighbors.nearest(df, df.where("id % 7 = 0 OR id = 12"), "id", "v", "c", 5).orderBy("id", "rank").collect():
        found.setdefault(r["id"], []).append(r["neighbor"])
        assert r["label"] == r["neighbor"] % 3
        assert r["distance"] == pytest.approx(float(np.sqrt(((x[r["id"]] - x[r["neighbor"]]) ** 2).sum())), abs=1e-12)
    assert found == {q: plain(x, q, 5) for q in [*range(0, 400, 7), 12]}


def test_small_tables_are_searched_on_every_core(spark, monkeypatch):
    x, df = rows(spark)
    dealt, met = [], neighbors._met
    monkeypatch.setattr(neighbors, "_met", lambda stored, asked, *a: dealt.extend(
        [asked.select("__q").distinct().count(), stored.select("__q").distinct().count()]) or met(stored, asked, *a))
    cores = spark.sparkContext.defaultParallelism
    found = {}
    for r in neighbors.nearest(df, df.crossJoin(spark.range(cores).select(F.lit(400).alias("__n"), F.col("id").alias("__k"))).selectExpr(
            "id + __n * (__k + 1) AS id", "v"), "id", "v", "c", 5).collect():
        found.setdefault(r["id"], []).append((r["rank"], r["neighbor"]))
    assert dealt == [cores, cores] and cores > 1
    assert {q: [n for _, n in sorted(f)] for q, f in found.items()} == {q: plain(x, q % 400, 5) for q in range(400, 400 * (cores + 1))}


def test_fewer_rows_than_neighbours_and_none(spark):
    _, df = rows(spark, 30)
    assert neighbors.nearest(df.where("id < 3"), df.where("id = 5"), "id", "v", "c", 5).count() == 3
    assert neighbors.nearest(df.limit(0), df, "id", "v", "c").count() == 0
    assert neighbors.nearest_hashed(df.limit(0), df, "id", "v", "c").count() == 0


@pytest.mark.parametrize("block", [10_000, 50])
def test_hashed_search_finds_most_and_spreads_hot_buckets(spark, monkeypatch, block):
    monkeypatch.setattr(neighbors, "BLOCK_ROWS", block)
    _, df = rows(spark, 600, 8, 4)
    queries = df.where("id % 10 = 0")
    exact, found = neighbors.nearest(df, queries, "id", "v", "c"), neighbors.nearest_hashed(df, queries, "id", "v", "c", bits=3, tables=12)
    told = neighbors.recall(found, exact, "id").first()
    assert told["neighbors"] == 300 and told["recall"] > 0.9
    assert found.groupBy("id").count().where("count > 5").count() == 0


def test_a_pair_of_blocks_takes_little_memory():
    rng = np.random.default_rng(2)
    block = lambda n: pa.table({"id": np.arange(n), "v": pa.array(list(rng.normal(size=(n, 64)).astype("float32"))), "c": np.arange(n) % 3})
    stored, asked = block(neighbors.BLOCK_ROWS), block(600)
    tracemalloc.start()
    found = neighbors._searched("id", "v", "c", 5)(stored, asked)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found.num_rows == 3000
    assert peak < 48 << 20


@pytest.mark.parametrize("vectors", [[[1.0], None], [[1.0], [1.0, 2.0]], [[1.0], [None]]])
def test_vectors_that_cannot_be_compared_are_refused(vectors):
    with pytest.raises(ValueError):
        neighbors._matrix(pa.chunked_array([pa.array(vectors, pa.list_(pa.float64()))]))


def test_names_and_labels_keep_their_types(spark):
    df = spark.createDataFrame([("b", [0.0, 1.0], None), ("a", [0.0, 1.0], "x"), ("c", [5.0, 5.0], "y")], "id string, v array<float>, c string")
    found = [(r["neighbor"], r["label"]) for r in neighbors.nearest(df, df.where("id = 'c'"), "id", "v", "c", 3).orderBy("rank").collect()]
    assert found == [("c", "y"), ("a", "x"), ("b", None)]
