"""Near duplicates by MinHash: many universal minima, banding, signature check, exact check, connected components.

A document is the set of its distinct ``k``-word shingles. Documents with equal sets form one class, which is named by its
smallest ``doc_id`` and takes part once. Of each class, ``bands * rows`` minima of universal hashes are kept; classes that
agree on all minima of a band meet in a bucket. At the named similarity a pair misses all bands with probability
(1 - s**rows)**bands, below 3e-7 with the defaults.

No bucket is paired off at once. First every member meets the bucket's smallest and largest member only. Pairs pass three
checks: set sizes, agreement of the minima (nine standard deviations of slack), and then both full shingle sets, made
again from the whole texts. The confirmed links give components; buckets that lie in one component are done. Members of
buckets that still span components meet in the second step, in blocks, so that no link that could join two components
goes unseen, and no pair becomes a row before it is one.

Defined results: null, empty and blank texts have the empty set and stay alone. Texts of fewer than ``k`` words have their
whole sequence as one shingle. Rows without ``doc_id`` take part in nothing: component_id is null and they are kept.
Repeated rows (same id and text) all get the same answer. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import words as W
from plumbline.llm.common import id_and_text
from plumbline.llm.components import components
from plumbline.session import small_side, stage

MINIMA = 192
SLACK = 9.0
BLOCK_BYTES, BLOCK_ROWS = 4 << 20, 512


def banding(percent: int) -> tuple[int, int]:
    """Bands and rows within about ``MINIMA`` minima: the widest bands that miss a pair at the threshold below 3e-7."""
    s = percent / 100
    rows = max((r for r in range(1, 13) if (1 - s ** r) ** (MINIMA // r) < 3e-7), default=1)
    return MINIMA // rows, rows


def _family(n: int) -> tuple[np.ndarray, np.ndarray]:
    x = W.mix(np.arange(1, 2 * n + 1, dtype=np.uint64))
    return (x[:n] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (x[n:] >> np.uint64(32)).astype(np.uint32)


def minima(sets: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Minima of ``n`` universal hashes of each non-empty set; ``at`` are the sets' offsets."""
    a, b = _family(n)
    x = (sets ^ (sets >> np.uint64(32))).astype(np.uint32)
    full = np.flatnonzero(at[1:] > at[:-1])
    out = np.empty((len(full), n), np.uint32)
    starts = at[full]
    for i in range(n if len(full) else 0):
        out[:, i] = np.minimum.reduceat(x * a[i] + b[i], starts)
    return out


def _signer(k: int, bands: int, rows: int):
    n = bands * rows
    weights = W.mix(np.arange(100, 100 + n, dtype=np.uint64)).reshape(bands, rows) | np.uint64(1)
    numbers = np.arange(bands, dtype=np.uint64) << np.uint64(40)

    def sign(batches):
        for batch in batches:
            ids = batch.column(0)
            for w in W.words(batch.column(1)):
                sets, at = W.shingles(w, k)
                sizes = np.diff(at)
                full = np.flatnonzero(sizes)
                low = minima(sets, at, n)
                keys = W.mix((low.reshape(len(full), bands, rows) * weights[None]).sum(axis=2, dtype=np.uint64) + numbers[None])
                short = (low & np.uint32(0xFFFF)).astype(np.uint16)
                digest, mine, bits = [None] * w.rows, [None] * w.rows, [None] * w.rows
                for j, r in enumerate(full):
                    digest[r] = xxhash.xxh3_128_digest(sets[at[r]:at[r + 1]].tobytes())
                    mine[r], bits[r] = keys[j].view(np.int64), short[j].tobytes()
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(w.first, w.rows), pa.array(sizes, pa.int64()), pa.array(digest, pa.binary()), pa.array(mine, pa.list_(pa.int64())), pa.array(bits, pa.binary())],
                    names=["doc_id", "n_shingles", "set_key", "bands", "minima"])

    return sign


def signatures(docs: DataFrame, k: int, bands: int, rows: int) -> DataFrame:
    """doc_id, n_shingles, set_key (128-bit digest of the set), bands (one key each), minima (low 16 bits of each)."""
    return id_and_text(docs).mapInArrow(_signer(k, bands, rows), "doc_id long, n_shingles long, set_key binary, bands array<long>, minima binary")


def _agreeing(least: float):
    """Pairs whose minima agree often enough for the similarity sought."""
    def check(batches):
        for batch in batches:
            a, b = batch.column("minima_a"), batch.column("minima_b")
            same = [np.count_nonzero(np.frombuffer(x, np.uint16) == np.frombuffer(y, np.uint16)) for x, y in zip(a.to_pylist(), b.to_pylist())]
            keep = np.array(same, dtype=float) >= least
            yield batch.select(["a", "b"]).filter(pa.array(keep))
    return check


def _confirming(k: int, percent: int):
    """Pairs whose full shingle sets are as similar as asked."""
    def sets(texts):
        for w in W.words(texts):
            at, one = W.shingles(w, k)[::-1]
            yield from (one[at[r]:at[r + 1]] for r in range(w.rows))

    def check(batches):
        for batch in batches:
            keep = []
            for x, y in zip(sets(batch.column("text_a")), sets(batch.column("text_b"))):
                shared = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(bool(100 * shared >= percent * (len(x) + len(y) - shared)))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
    return check


def confirmed(pairs: DataFrame, signed: DataFrame, docs: DataFrame, k: int, percent: int, n_minima: int) -> DataFrame:
    """The pairs (a, b) of ``pairs`` that are linked, staged. Pairs are dealt out by both ids, so no document is a hot spot."""
    s = percent / 100
    least = n_minima * s - SLACK * (n_minima * s * (1 - s)) ** 0.5
    side = lambda x: signed.select(F.col("doc_id").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("minima").alias(f"minima_{x}"))
    sized = pairs.join(side("a"), "a").join(side("b"), "b").where(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)")
    likely = stage(sized.select("a", "b", "minima_a", "minima_b").mapInArrow(_agreeing(least), "a long, b long"), "near-likely")
    needed = stage(likely.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "near-needed")
    texts = stage(id_and_text(docs).join(small_side(needed), "doc_id"), "near-texts")
    text = lambda x: texts.select(F.col("doc_id").alias(x), F.col("text").alias(f"text_{x}"))
    both = likely.join(text("a"), "a").join(text("b"), "b").select("a", "b", "text_a", "text_b")
    return stage(both.mapInArrow(_confirming(k, percent), "a long, b long").distinct(), "near-links")


def _set_rows(k: int):
    """(family, doc_id, root, set) with the shingle set of each text as sorted uint64 bytes."""
    def make(batches):
        for batch in batches:
            for w in W.words(batch.column("text")):
                sets, at = W.shingles(w, k)
                part = batch.select(["family", "doc_id", "root"]).slice(w.first, w.rows)
                blobs = [sets[at[r]:at[r + 1]].tobytes() for r in range(w.rows)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.diff(at), pa.int64()), pa.array(blobs, pa.binary())], names=["family", "doc_id", "root", "n", "shingles"])
    return make


def _one_block(rows: pa.Table) -> pa.Table:
    first = lambda c: rows.column(c)[0].as_py()
    numbers = lambda c: pa.array([rows.column(c).to_numpy().astype(np.int64).tobytes()], pa.binary())
    return pa.table({"family": pa.array([first("family")], pa.int64()), "size_class": pa.array([first("size_class")], pa.int32()), "block": pa.array([first("block")], pa.int64()),
                     "ids": numbers("doc_id"), "roots": numbers("root"), "sizes": numbers("n"), "shingles": pa.array([b"".join(x.as_py() for x in rows.column("shingles"))], pa.binary())})


def _linking(percent: int):
    """Links between members of two blocks that lie in different components; enough of them to join what they join."""
    def block(row, x):
        ids, roots, sizes = (np.frombuffer(row[f"{c}_{x}"], np.int64) for c in ("ids", "roots", "sizes"))
        return ids, roots, sizes, np.frombuffer(row[f"shingles_{x}"], np.uint64)

    def check(batches):
        for batch in batches:
            for row in batch.to_pylist():
                (ids_x, roots_x, n_x, sets_x), (ids_y, roots_y, n_y, sets_y) = block(row, "x"), block(row, "y")
                shared, both = np.unique(np.concatenate([np.unique(sets_x), np.unique(sets_y)]), return_counts=True)
                shared = shared[both > 1]
                common = np.zeros((len(ids_x), len(ids_y)), np.float32)
                of_x, of_y = np.repeat(np.arange(len(ids_x)), n_x), np.repeat(np.arange(len(ids_y)), n_y)
                at_x, at_y = np.searchsorted(shared, sets_x), np.searchsorted(shared, sets_y)
                in_x = (at_x < len(shared)) & (shared[np.minimum(at_x, max(len(shared) - 1, 0))] == sets_x) if len(shared) else np.zeros(len(sets_x), bool)
                in_y = (at_y < len(shared)) & (shared[np.minimum(at_y, max(len(shared) - 1, 0))] == sets_y) if len(shared) else np.zeros(len(sets_y), bool)
                for lo in range(0, len(shared), 4096):
                    left, right = np.zeros((len(ids_x), 4096), np.float32), np.zeros((len(ids_y), 4096), np.float32)
                    mine_x, mine_y = in_x & (at_x >= lo) & (at_x < lo + 4096), in_y & (at_y >= lo) & (at_y < lo + 4096)
                    left[of_x[mine_x], at_x[mine_x] - lo] = 1
                    right[of_y[mine_y], at_y[mine_y] - lo] = 1
                    common += left @ right.T
                linked = (100 * common >= percent * (n_x[:, None] + n_y[None, :] - common)) & (roots_x[:, None] != roots_y[None, :])
                found, seen = [], set()
                for i, j in np.argwhere(linked):
                    pair = roots_x[i], roots_y[j]
                    if pair not in seen:
                        seen.add(pair)
                        found.append((ids_x[i], ids_y[j]))
                if found:
                    a, b = np.array(found, np.int64).T
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])
    return check


def leftover_links(shared: DataFrame, roots: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Links between components that the first step left apart though members share a bucket.

    Members of such buckets form families (buckets with a common member). Within a family, sets can only be linked in the
    same or the next class of sizes, a class being a factor of the similarity. Members of a class are dealt into blocks of
    bounded bytes, and pairs of blocks are compared whole: intersections of all their sets come from one product of 0/1
    matrices over the shingles that both hold. No pair of documents becomes a row unless it is a link.
    """
    placed = stage(shared.join(roots.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("root", F.coalesce("root", "doc_id")), "near-placed")
    mixed = placed.groupBy("bucket").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 < r1").select("bucket")
    left = stage(placed.join(mixed, "bucket").select("low", "doc_id", "root").distinct(), "near-mixed")
    families = components(left.select(F.col("low").alias("a"), F.col("doc_id").alias("b")))
    members = left.select("doc_id", "root").distinct().join(families.select(F.col("node").alias("doc_id"), F.col("root").alias("family")), "doc_id", "left")
    members = stage(members.withColumn("family", F.coalesce("family", "doc_id")), "near-members")
    texts = id_and_text(docs).join(small_side(members), "doc_id").dropDuplicates(["doc_id"])
    sets = texts.select("family", "doc_id", "root", "text").mapInArrow(_set_rows(k), "family long, doc_id long, root long, n long, shingles binary")
    sets = stage(sets.withColumn("size_class", F.floor(F.log("n") / F.lit(-np.log(percent / 100))).cast("int")), "near-sets")
    room = stage(sets.groupBy("family", "size_class").agg(F.ceil(F.sum("n") * 8 / BLOCK_BYTES).alias("b"), F.ceil(F.count("*") / BLOCK_ROWS).alias("c")), "near-blocks-per-class")
    dealt = sets.join(room, ["family", "size_class"]).withColumn("block", F.pmod(F.xxhash64("doc_id"), F.greatest("b", "c", F.lit(1))))
    blocks = stage(dealt.select("family", "size_class", "block", "doc_id", "root", "n", "shingles").groupBy("family", "size_class", "block").applyInArrow(
        _one_block, "family long, size_class int, block long, ids binary, roots binary, sizes binary, shingles binary"), "near-blocks")
    parts = ("ids", "roots", "sizes", "shingles")
    x = blocks.select("family", "size_class", F.col("block").alias("block_x"), *[F.col(c).alias(f"{c}_x") for c in parts])
    y = blocks.select("family", F.explode(F.array("size_class", F.col("size_class") - 1)).alias("size_class"), F.col("size_class").alias("class_y"), F.col("block").alias("block_y"), *[F.col(c).alias(f"{c}_y") for c in parts])
    meet = x.join(y, ["family", "size_class"]).where("class_y > size_class or block_x <= block_y")
    return stage(meet.select(*[f"{c}_{s}" for s in "xy" for c in parts]).mapInArrow(_linking(percent), "a long, b long").distinct(), "near-links")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Linked: 100 * shared shingles >= ``percent`` * all shingles of both. component_id is the smallest id reachable.
    """
    bands, rows = banding(percent)
    rows_of = stage(signatures(docs, k, bands, rows), "near-signatures")
    classes = rows_of.where("set_key is not null and doc_id is not null").groupBy("set_key").agg(F.min("doc_id").alias("lead"))
    named = rows_of.join(classes.withColumnRenamed("lead", "doc_id"), ["set_key", "doc_id"])
    signed = stage(named.select("doc_id", "n_shingles", "bands", "minima").dropDuplicates(["doc_id"]), "near-classes")
    entries = signed.select("doc_id", "n_shingles", F.explode("bands").alias("bucket"))
    ends = entries.groupBy("bucket").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high")
    shared = stage(entries.join(ends, "bucket"), "near-buckets")
    ordered = lambda x, y: F.array(F.struct(F.col(x).alias("a"), F.col(y).alias("b")))
    first = shared.select(F.explode(F.concat(ordered("low", "doc_id"), ordered("doc_id", "high"))).alias("p")).select("p.a", "p.b").where("a < b").distinct()
    links = confirmed(first, signed, docs, k, percent, bands * rows)
    roots = components(links)
    more = leftover_links(shared, roots, docs, k, percent)
    if not more.isEmpty():
        roots = components(links.unionByName(more))
    ids = stage(classes.join(roots.withColumnRenamed("node", "lead"), "lead", "left").select("set_key", F.coalesce("root", "lead").alias("component")), "near-components")
    out = rows_of.select("doc_id", "n_shingles", "set_key").join(ids, "set_key", "left")
    out = out.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
