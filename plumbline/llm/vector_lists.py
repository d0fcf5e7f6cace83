"""Approximate nearest neighbours by balanced posting lists under an in-memory graph of centroids.

1. A bounded sample is split again and again into balanced halves until parts are small; their means are the centroids.
   Inner products become distances by one more component (what each vector lacks to the longest one).
2. The centroids form a neighbour graph that tasks hold in memory; a best-first walk over it finds the few nearest centroids
   of many stored vectors at once. Queries, which need many, are held against all centroids.
3. Every vector goes to the list of its nearest centroid. Near a border it is copied to further lists, as long as they are
   within ``BORDER`` of the nearest distance and not all but equal to a list it is in (``SPREAD``).
4. A query searches the lists within ``PROBE`` of its nearest centroid's distance, at least ``LEAST_LISTS``.

Lists are dealt in blocks of ``BLOCK_ROWS`` rows, so a list that one frequent vector fills is not one task, and blocks into
buckets that grow in number with the data. Queries are dealt in parts of about ``QUERY_ROWS`` by hash. Each bucket meets each
part in a group of its own, where a query's vector is held once with the blocks it searches there, so both sides are bounded;
a bucket's rows are sent once for each part. Scores are inner products of the original vectors in double precision. Each group
returns a query's best, and a window takes the best of all.

Defined results: vectors that are null, zero, of another length than most, or hold null or non-finite components take no
part. Rows without ``vec_id`` take no part. Rows that repeat an id count once. A query never finds its own id. Ties go to
the smaller id. Fewer candidates than asked give fewer rows. Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.session import stage

FIT_ROWS = 20_000
LIST_ROWS = 200
MOST_LISTS = 2_048
COPIES = 4
BORDER, SPREAD, PROBE = 1.03, 0.1, 1.13
LEAST_LISTS = 16
NEIGHBOURS, ENTRIES = 24, 16
BLOCK_ROWS, BUCKET_ROWS, QUERY_ROWS = 2_048, 12_000, 20_000
SENT_ROWS = 8_192


def balanced_centroids(x: np.ndarray, size: int, seed: int = 7) -> np.ndarray:
    """Means of balanced parts of at most ``size`` rows; equal rows are one part."""
    rng, todo, out = np.random.default_rng(seed), [np.arange(len(x))], []
    while todo:
        part = todo.pop()
        rows = x[part]
        if len(part) <= size or np.all(rows == rows[0]):
            out.append(rows.mean(0))
            continue
        a = rows[rng.integers(len(rows))]
        b = rows[np.argmax(((rows - a) ** 2).sum(1))]
        for _ in range(8):
            side = ((rows - a) ** 2).sum(1) - ((rows - b) ** 2).sum(1)
            order = np.argsort(side, kind="stable")
            half = len(order) // 2
            a, b = rows[order[:half]].mean(0), rows[order[half:]].mean(0)
        todo += [part[order[:half]], part[order[half:]]]
    return np.unique(np.array(out, np.float32), axis=0)


@dataclass(frozen=True)
class CentroidGraph:
    """Centroids, each with links to its nearest ones and a few far ones, and entry points."""
    centroids: np.ndarray
    links: np.ndarray
    entries: np.ndarray

    @classmethod
    def build(cls, centroids: np.ndarray) -> CentroidGraph:
        n, rng = len(centroids), np.random.default_rng(11)
        near = []
        norms = (centroids ** 2).sum(1)
        for lo in range(0, n, 512):
            d = norms[None] - 2 * centroids[lo:lo + 512] @ centroids.T
            d[np.arange(len(d)), np.arange(lo, lo + len(d))] = np.inf
            near.append(np.argsort(d, axis=1)[:, :min(NEIGHBOURS, n - 1)])
        near = np.concatenate(near) if n > 1 else np.zeros((n, 0), np.int64)
        far = rng.integers(0, n, (n, 4))
        return cls(centroids, np.concatenate([near, far], axis=1), rng.permutation(n)[:ENTRIES])

    def nearest(self, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(centroid, squared distance), nearest first, of up to ``k`` centroids for each row, by walks side by side."""
        n, k = len(self.centroids), min(k, len(self.centroids))
        norms = (self.centroids ** 2).sum(1)
        rows = np.arange(len(x))[:, None]
        own = (x ** 2).sum(1)[:, None]
        seen = np.zeros((len(x), n), bool)
        ids = np.tile(self.entries, (len(x), 1))
        seen[:, self.entries] = True
        d = own + norms[ids] - 2 * np.einsum("ij,ikj->ik", x, self.centroids[ids])
        width = max(k, 32)
        opened = np.zeros(ids.shape, bool)
        for _ in range(4 * n):
            waiting = np.where(opened, np.inf, d)
            pick = np.argsort(waiting, axis=1)[:, :4]
            if not np.isfinite(waiting[rows, pick]).any():
                break
            opened[rows, pick] |= True
            more = np.where(np.isfinite(waiting[rows, pick])[:, :, None], self.links[ids[rows, pick]], self.entries[0]).reshape(len(x), -1)
            fresh = ~seen[rows, more]
            more_sorted = np.sort(np.where(fresh, more, n), axis=1)
            more_sorted[:, 1:][more_sorted[:, 1:] == more_sorted[:, :-1]] = n
            real = more_sorted < n
            new = np.where(real, more_sorted, 0)
            seen[np.broadcast_to(rows, new.shape)[real], new[real]] = True
            dist = np.where(real, own + norms[new] - 2 * np.einsum("ij,ikj->ik", x, self.centroids[new]), np.inf)
            ids, d, opened = np.concatenate([ids, new], 1), np.concatenate([d, dist], 1), np.concatenate([opened, ~real], 1)
            if ids.shape[1] > width:
                keep = np.argpartition(d, width - 1, axis=1)[:, :width]
                ids, d, opened = ids[rows, keep], d[rows, keep], opened[rows, keep]
        order = np.argsort(d, axis=1)[:, :k]
        return ids[rows, order], np.maximum(d[rows, order], 0)


def border_lists(graph: CentroidGraph, x: np.ndarray) -> list[np.ndarray]:
    """Lists of each vector: the nearest, and those that its place near a border calls for."""
    ids, d = graph.nearest(x, 4 * COPIES)
    out = []
    for i in range(len(x)):
        chosen = [0]
        for j in range(1, ids.shape[1]):
            if len(chosen) == COPIES or d[i, j] > BORDER ** 2 * d[i, 0] + 1e-12 or not np.isfinite(d[i, j]):
                break
            gaps = ((graph.centroids[ids[i, chosen]] - graph.centroids[ids[i, j]]) ** 2).sum(1)
            if (gaps >= SPREAD * d[i, j]).all():
                chosen.append(j)
        out.append(ids[i, chosen])
    return out


def probed_lists(graph: CentroidGraph, x: np.ndarray, ratio: float = PROBE) -> list[np.ndarray]:
    """Lists that each query searches, nearest first: all that the ratio selects, by the distances to all centroids."""
    d = np.maximum((x ** 2).sum(1)[:, None] + (graph.centroids ** 2).sum(1) - 2 * x @ graph.centroids.T, 0)
    order = np.argsort(d, axis=1, kind="stable")
    d = np.take_along_axis(d, order, 1)
    return [row[(dist <= ratio ** 2 * dist[0]) | (np.arange(len(dist)) < LEAST_LISTS)] for row, dist in zip(order, d)]


def valid_vectors(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id and vec (array<double>) of the rows that take part."""
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vec")).where("vec_id is not null and vec is not null and size(vec) > 0")
    sound = rows.where(F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))) & F.exists("vec", lambda v: v != 0))
    usual = sound.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return sound.where(F.size("vec") == (usual[0]["n"] if usual else 0)).dropDuplicates(["vec_id"])


def _matrix(column) -> np.ndarray:
    chunk = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return chunk.flatten().to_numpy(zero_copy_only=False).reshape(len(chunk), -1)


def _wide(x: np.ndarray, longest: float | None) -> np.ndarray:
    """Stored vectors get what they lack to the longest one as one more component, queries (None) get zero."""
    lack = np.zeros((len(x), 1)) if longest is None else np.sqrt(np.maximum(longest ** 2 - (x ** 2).sum(1, keepdims=True), 0))
    return np.concatenate([x, lack], 1).astype(np.float32)


def _listed(graph: CentroidGraph, longest: float):
    """(list, vec_id, vec) rows: the lists of stored vectors."""
    def assign(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                lists = border_lists(graph, _wide(_matrix(part.column(1)), longest))
                of = np.repeat(np.arange(part.num_rows), [len(i) for i in lists])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(lists).astype(np.int32)), part.column(0).take(pa.array(of)), part.column(1).take(pa.array(of))], names=["list", "vec_id", "vec"])
    return assign


def _asking(graph: CentroidGraph, first: np.ndarray, buckets: int):
    """(bucket, vec_id, vec, places) rows: each query once in every bucket that holds blocks it searches."""
    def ask(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                row, bucket, places = [], [], []
                for i, lists in enumerate(probed_lists(graph, _wide(_matrix(part.column(1)), None))):
                    mine = np.concatenate([np.arange(first[j], first[j + 1]) for j in lists])
                    mine = mine[np.argsort(mine % buckets, kind="stable")]
                    each, at = np.unique(mine % buckets, return_index=True)
                    row += [i] * len(each)
                    bucket += each.tolist()
                    places += np.split(mine, at[1:])
                for at in range(0, len(row), SENT_ROWS):
                    cut = slice(at, at + SENT_ROWS)
                    of, held = pa.array(row[cut], pa.int64()), places[cut]
                    ends = pa.array(np.concatenate([[0], np.cumsum([len(p) for p in held])]).astype(np.int32))
                    yield pa.RecordBatch.from_arrays([pa.array(bucket[cut], pa.int64()), part.column(0).take(of), part.column(1).take(of), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(held), pa.int64()))], names=["bucket", "vec_id", "vec", "places"])
    return ask


def _best(query: np.ndarray, vec: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Indices of the best ``k`` of each query, ties to the smaller id, each id once."""
    order = np.lexsort((vec, -score, query))
    q, v = query[order], vec[order]
    again = np.zeros(len(order), bool)
    again[1:] = (q[1:] == q[:-1]) & (v[1:] == v[:-1])
    order, q = order[~again], q[~again]
    place = np.arange(len(q)) - np.searchsorted(q, q)
    return order[place < k]


def _searched(k: int):
    def search(stored: pa.Table, asked: pa.Table) -> pa.Table:
        nothing = np.zeros(0, np.int64)
        found = [(nothing, nothing, np.zeros(0))]
        if stored.num_rows and asked.num_rows:
            block_x, held = stored.column("place").to_numpy(), asked.column("places").combine_chunks()
            block_q, of = held.flatten().to_numpy(), np.repeat(np.arange(asked.num_rows), held.value_lengths().to_numpy())
            x, xid, q, qid = _matrix(stored.column("vec")), stored.column("vec_id").to_numpy(), _matrix(asked.column("vec")), asked.column("vec_id").to_numpy()
            order_x, order_q = np.argsort(block_x, kind="stable"), np.argsort(block_q, kind="stable")
            for b in np.unique(block_x):
                mine = order_x[np.searchsorted(block_x[order_x], b):np.searchsorted(block_x[order_x], b, "right")]
                theirs = order_q[np.searchsorted(block_q[order_q], b):np.searchsorted(block_q[order_q], b, "right")]
                for lo in range(0, len(theirs), 1024):
                    some = of[theirs[lo:lo + 1024]]
                    score = q[some] @ x[mine].T
                    score[qid[some][:, None] == xid[mine][None, :]] = -np.inf
                    edge = np.partition(score, -k, axis=1)[:, -k][:, None] if len(mine) > k else np.full((len(some), 1), -np.inf)
                    i, j = np.nonzero((score >= edge) & np.isfinite(score))
                    found.append((qid[some][i], xid[mine][j], score[i, j]))
                    if sum(len(f[0]) for f in found[1:]) > 2_000_000:
                        one = [np.concatenate(f) for f in zip(*found)]
                        found = [tuple(f[_best(*one, k)] for f in one)]
        one = [np.concatenate(f) for f in zip(*found)]
        query, vec, score = (f[_best(*one, k)] for f in one)
        return pa.table({"query_id": pa.array(query, pa.int64()), "vec_id": pa.array(vec, pa.int64()), "score": pa.array(score, pa.float64())})
    return search


def nearest_neighbours(table: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` largest inner products found for every row whose id ``every`` divides."""
    rows = stage(valid_vectors(table, id_col, vector_col), "vectors")
    n, longest = rows.agg(F.count("*"), F.max(F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, v: a + v * v)))).first()
    if not n:
        return rows.select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0.0).alias("score")).limit(0)
    chosen = rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(1_000_003)) <= int(1_000_003 * min(1.0, FIT_ROWS / n)))
    x = _matrix(chosen.select("vec").toArrow().column(0))
    wide = np.concatenate([x, np.sqrt(np.maximum(longest ** 2 - (x ** 2).sum(1, keepdims=True), 0))], 1)
    lists = int(np.clip(n // LIST_ROWS, 1, MOST_LISTS)) if n >= 8 * LIST_ROWS else 1
    graph = CentroidGraph.build(balanced_centroids(wide.astype(np.float32), max(1, -(-len(x) // lists))))
    kind = "list int, vec_id long, vec array<double>"
    stored = stage(rows.mapInArrow(_listed(graph, longest), kind), "vector-lists")
    # Blocks of bounded rows within a list, and buckets of blocks.
    sizes = stored.groupBy("list").agg(F.count("*").alias("rows")).withColumn("blocks", F.ceil(F.col("rows") / BLOCK_ROWS).cast("int")).collect()
    blocks = np.ones(len(graph.centroids), np.int64)
    for r in sizes:
        blocks[r["list"]] = r["blocks"]
    first = np.concatenate([[0], np.cumsum(blocks)])
    buckets = max(1, -(-sum(r["rows"] for r in sizes) // BUCKET_ROWS))

    @F.arrow_udf("long")
    def block_of(lists: pa.Array, ids: pa.Array) -> pa.Array:
        i = lists.to_numpy()
        return pa.array(first[i] + ids.to_numpy() % blocks[i])

    queries = rows.where(f"vec_id % {every} = 0")
    parts = max(1, -(-queries.count() // QUERY_ROWS))
    left = stored.withColumn("place", block_of("list", F.abs(F.xxhash64("vec_id") % 1_000_000_007))).select((F.col("place") % buckets).alias("bucket"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), "place", "vec_id", "vec")
    right = queries.mapInArrow(_asking(graph, first, buckets), "bucket long, vec_id long, vec array<double>, places array<long>").withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int"))
    found = left.groupBy("bucket", "part").cogroup(right.groupBy("bucket", "part")).applyInArrow(_searched(k), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.distinct().withColumn("rank", F.row_number().over(order)).where(f"rank <= {k}").select("query_id", "rank", "vec_id", "score")
