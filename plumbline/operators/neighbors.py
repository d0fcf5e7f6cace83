"""Nearest neighbours: exact by blocks of both sides, or among rows that share a projection hash.

Both sides are dealt into blocks of bounded size by a hash of their key. Each pair of blocks meets in one group, where one
matrix product ranks the pairs and keeps k a query; a window over the blocks' bests ends it. Nothing goes through the driver.
The approximate path compares a query only with rows that agree with it in one of several sets of random projections;
``recall`` tells what that lost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Rows of a block, and queries whose distances to a block are held at a time (8 MB of them). A task holds two blocks, at any size of the tables.
BLOCK_ROWS = 10_000
QUERIES_AT_ONCE = 100
# Sets of projections, and the rows that a bucket of a set should hold; it has 2 to 2**16 buckets.
TABLES, BUCKET_ROWS, MOST_BITS = 8, 500, 16


def _blocks(df: DataFrame, least: int = 1) -> int:
    """Blocks of a table; ``least``, if each of them gets ``QUERIES_AT_ONCE`` rows."""
    rows = df.count()
    return max(1, -(-rows // BLOCK_ROWS), min(least, rows // QUERIES_AT_ONCE))


def _dealt(df: DataFrame, key: str, blocks: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key)), F.lit(blocks)).cast("int")


def _best(names, rows, points, k: int):
    """The k nearest rows of each point: numbers of the points, numbers of the rows, distances; ties to the smaller name.

    The product only chooses candidates, with room for its rounding; their distances are taken again term by term.
    """
    import numpy as np

    order = np.argsort(names, kind="stable")
    rows = rows[order]
    sizes = (rows ** 2).sum(1)
    kept = min(k, len(rows))
    asked, found, distance = (np.empty((len(points), kept), kind) for kind in (np.int64, np.int64, np.float64))
    for lo in range(0, len(points), QUERIES_AT_ONCE):
        part = points[lo:lo + QUERIES_AT_ONCE]
        own = (part ** 2).sum(1)
        near = part @ rows.T
        near *= -2
        near += sizes
        near += own[:, None]
        for i, point in enumerate(part):
            limit = np.partition(near[i], kept - 1)[kept - 1] + 1e-9 * (own[i] + sizes.max() + 1)
            at = np.flatnonzero(near[i] <= limit)
            gaps = ((rows[at] - point) ** 2).sum(1)
            take = np.argsort(gaps, kind="stable")[:kept]
            asked[lo + i], found[lo + i], distance[lo + i] = lo + i, order[at[take]], np.sqrt(gaps[take])
    return asked.ravel(), found.ravel(), distance.ravel()


def _matrix(vectors):
    """An Arrow column of lists as one matrix; vectors must be as long as each other and hold no null."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    flat = pc.list_flatten(vectors)
    if vectors.null_count or flat.null_count or len(set(pc.list_value_length(vectors).unique().to_pylist())) != 1:
        raise ValueError("vectors must be present, without nulls, and of one length")
    return flat.to_numpy(zero_copy_only=False).reshape(len(vectors), -1).astype(np.float64)


def _searched(key: str, vector: str, label: str, k: int):
    def search(stored, asked):
        import pyarrow as pa

        names = stored.column(key)
        if not stored.num_rows or not asked.num_rows:
            none = names.slice(0, 0)
            return pa.table({key: none, "neighbor": none, "label": stored.column(label).slice(0, 0), "distance": pa.array([], pa.float64())})
        points, rows, distance = _best(names.to_numpy(), _matrix(stored.column(vector)), _matrix(asked.column(vector)), k)
        return pa.table({key: asked.column(key).take(pa.array(points)), "neighbor": names.take(pa.array(rows)),
                         "label": stored.column(label).take(pa.array(rows)), "distance": pa.array(distance)})

    return search


def _met(stored: DataFrame, asked: DataFrame, groups: list[str], reference: DataFrame, key: str, vector: str, label: str, k: int) -> DataFrame:
    schema = T.StructType([
        T.StructField(key, reference.schema[key].dataType), T.StructField("neighbor", reference.schema[key].dataType),
        T.StructField("label", reference.schema[label].dataType), T.StructField("distance", T.DoubleType())])
    apart = asked.select(*[F.col(c).alias(c) for c in asked.columns])  # both sides may come from one table
    near = stored.groupBy(*groups).cogroup(apart.groupBy(*groups)).applyInArrow(_searched(key, vector, label, k), schema)
    order = Window.partitionBy(key).orderBy("distance", "neighbor")
    return near.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def nearest(reference: DataFrame, queries: DataFrame, key: str, vector: str, label: str, k: int = 5) -> DataFrame:
    """Rows (key, neighbor, label, distance, rank) of the k nearest reference rows per query.

    Each pair of blocks keeps k rows a query, so the last shuffle carries k rows per query and block of the reference.
    Few queries are dealt into smaller blocks, so that every core has a pair.
    """
    rows = _blocks(reference)
    asks = _blocks(queries, -(-reference.sparkSession.sparkContext.defaultParallelism // rows))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    stored = reference.select(key, vector, label, _dealt(reference, key, rows).alias("__r"), every(asks).alias("__q"))
    asked = queries.select(key, vector, _dealt(queries, key, asks).alias("__q"), every(rows).alias("__r"))
    return _met(stored, asked, ["__r", "__q"], reference, key, vector, label, k)


def projection_buckets(df: DataFrame, vector: str, width: int, bits: int, tables: int = TABLES, seed: int = 42) -> Column:
    """Array of bucket numbers, one per set: the signs of ``bits`` random projections of the vector."""
    import numpy as np

    normals = np.round(np.random.default_rng(seed).normal(size=(tables, bits, width)), 6)
    dot = lambda normal: F.aggregate(
        F.zip_with(F.col(vector).cast("array<double>"), F.lit([float(v) for v in normal]), lambda a, b: a * b), F.lit(0.0), lambda acc, x: acc + x)
    return F.array(*[sum((F.when(dot(n) >= 0, F.lit(1 << b)).otherwise(F.lit(0)) for b, n in enumerate(table)), F.lit(0)) for table in normals])


def nearest_hashed(
    reference: DataFrame, queries: DataFrame, key: str, vector: str, label: str, k: int = 5, bits: int | None = None, tables: int = TABLES, seed: int = 42,
) -> DataFrame:
    """As ``nearest``, among reference rows that share a bucket with the query; other neighbours are missed.

    A bucket with more than ``BLOCK_ROWS`` rows is dealt into blocks, so a hot bucket spreads.
    """
    first = reference.select(F.size(vector).alias("w")).first()
    if first is None:
        return nearest(reference, queries, key, vector, label, k)
    bits = bits or max(1, min(MOST_BITS, (reference.count() // BUCKET_ROWS).bit_length()))

    def bucketed(df: DataFrame, *columns: str) -> DataFrame:
        return df.select(*columns, F.posexplode(projection_buckets(df, vector, first["w"], bits, tables, seed)).alias("__t", "__b"))

    stored, asked = bucketed(reference, key, vector, label), bucketed(queries, key, vector)
    sizes = stored.groupBy("__t", "__b").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("__n"))
    # At most tables * 2**bits rows.
    sizes = F.broadcast(sizes)
    stored = stored.join(sizes, ["__t", "__b"]).withColumn("__r", F.pmod(F.xxhash64(F.col(key)), F.col("__n")).cast("int")).drop("__n")
    asks = _blocks(queries)
    asked = asked.join(sizes, ["__t", "__b"]).select(key, vector, "__t", "__b", _dealt(queries, key, asks).alias("__q"), F.explode(F.sequence(F.lit(0), F.col("__n") - 1)).alias("__r"))
    stored = stored.withColumn("__q", F.explode(F.sequence(F.lit(0), F.lit(asks - 1))))
    return _met(stored, asked, ["__t", "__b", "__r", "__q"], reference, key, vector, label, k)


def recall(found: DataFrame, exact: DataFrame, key: str) -> DataFrame:
    """One row: queries' true neighbours, how many were found, and the share."""
    hit = found.select(key, "neighbor", F.lit(1).alias("__hit"))
    both = exact.select(key, "neighbor").join(hit, [key, "neighbor"], "left")
    return both.agg(F.count("*").alias("neighbors"), F.count("__hit").alias("found"), F.try_divide(F.count("__hit"), F.count("*")).alias("recall"))


def vote(neighbors: DataFrame, key: str, by_distance: bool = False) -> DataFrame:
    """Predicted label per query: most votes, smallest label on ties."""
    weight = F.expr("1 / greatest(distance, 1e-12)") if by_distance else F.lit(1.0)
    votes = neighbors.groupBy(key, "label").agg(F.sum(weight).alias("votes"))
    return votes.groupBy(key).agg(F.expr("min_by(label, struct(-votes, label)) AS prediction"))


def average(neighbors: DataFrame, key: str, value: str = "label") -> DataFrame:
    """Regression: mean target of the neighbours."""
    return neighbors.groupBy(key).agg(F.avg(F.col(value).cast("double")).alias("prediction"))
