"""Quality scores: random Fourier features of document statistics, ridge by normal equations, isotonic calibration.

Every whole text gives some twenty statistics (shares of kinds of characters, word lengths, repetition, lines). Random
Fourier features of the standardised statistics approximate a Gaussian kernel. Ridge scores come from normal equations
that partitions sum, once per inner fold; sums are subtracted, so out-of-fold scores of the training rows cost one more
pass and no more fits on data. Those scores, counted in a fixed grid, give the isotonic map from score to probability.

Labels are learned from at most ``FIT_ROWS`` labelled rows, taken by hash; everything else sees all rows. What reaches
the driver is a table of means, ``PARTS * INNER`` matrices and the grid, at any size of input.

Defined results: null and empty texts have statistics of 0 and get a score like any other. Without usable labels every
score is 0.5, or the only label. Rows without ``doc_id`` are scored and never learned from. Repeated rows get equal
scores; repeated labels count each. Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import words as W
from plumbline.llm.common import id_and_text, remainder
from plumbline.session import stage

FIT_ROWS = 100_000
FEATURES = 256
RIDGE = 1e-3
INNER = 4
PARTS = 16
GRID = 1_000
FOLDS = 5
LEAST_SCORE = 0.3
CLIP = 5.0

# Kinds of bytes: blank, line end, lower, upper, digit, sentence mark, comma-like, bar, other ASCII sign, lead byte, rest of a character.
_KIND = np.full(256, 8, np.int64)
for _bytes, _k in (((0x20, 0x09, 0x0B, 0x0C, 0x0D), 0), ((0x0A,), 1), (range(0x61, 0x7B), 2), (range(0x41, 0x5B), 3), (range(0x30, 0x3A), 4),
                   ((0x2E, 0x3F), 5), ((0x2C, 0x3B, 0x3A, 0x27, 0x22, 0x28, 0x29, 0x2D), 6), ((0x7C,), 7), (range(0xC0, 0x100), 9), (range(0x80, 0xC0), 10)):
    _KIND[list(_bytes)] = _k
KINDS = 11
STATISTICS = ("log_chars", "blank", "line", "lower", "upper", "digit", "mark", "comma", "bar", "sign", "accented", "shout", "log_words", "word_length",
              "word_spread", "longest", "distinct", "distinct_pairs", "distinct_triples", "repeats", "top_word", "sentence_words", "line_words", "shout_words")


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of ``STATISTICS`` per text."""
    at, data = W.column_bytes(texts)
    out = []
    for w in W.words(texts):
        rows, lo = w.rows, int(at[w.first])
        b = data[lo:int(at[w.first + rows])]
        sizes = np.diff(at[w.first:w.first + rows + 1])
        of = np.repeat(np.arange(rows), sizes)
        kinds = np.bincount(of * KINDS + _KIND[b], minlength=rows * KINDS).reshape(rows, KINDS).astype(float)
        shouts = np.bincount(of[b == 0x21], minlength=rows)
        chars = np.maximum(kinds.sum(1) - kinds[:, 10], 1)
        n = np.bincount(w.row, minlength=rows)
        words = np.maximum(n, 1)
        length = (w.end - w.start).astype(float)
        mean = np.bincount(w.row, length, rows) / words
        spread = np.sqrt(np.maximum(np.bincount(w.row, length ** 2, rows) / words - mean ** 2, 0))
        bounds = np.concatenate([[0], np.cumsum(n)])
        longest, distinct, pairs, triples, top, sentences = (np.zeros(rows) for _ in range(6))
        two = W.mix(w.hash[:-1] * np.uint64(3) + w.hash[1:]) if len(w.hash) > 1 else w.hash[:0]
        three = W.mix(two[:-1] * np.uint64(5) + w.hash[2:]) if len(w.hash) > 2 else w.hash[:0]
        for r in np.flatnonzero(n):
            i, j = bounds[r], bounds[r + 1]
            _, often = np.unique(w.hash[i:j], return_counts=True)
            distinct[r], top[r], longest[r] = len(often) / (j - i), often.max() / (j - i), np.log1p(length[i:j].max())
            pairs[r] = len(np.unique(two[i:j - 1])) / max(j - i - 1, 1)
            triples[r] = len(np.unique(three[i:j - 2])) / max(j - i - 2, 1)
            sentences[r] = w.sentence[j - 1] - w.sentence[i] + 1
        again = np.zeros(len(w.hash))
        again[1:] = (w.hash[1:] == w.hash[:-1]) & (w.row[1:] == w.row[:-1])
        starts = w.start + (at[w.first:w.first + rows] - lo)[w.row]
        capital = ((b[starts] >= 0x41) & (b[starts] <= 0x5A)).astype(float)
        second = b[np.minimum(starts + 1, len(b) - 1)] if len(b) else b
        capital *= (second >= 0x41) & (second <= 0x5A)
        share = lambda k: kinds[:, k] / chars
        out.append(np.column_stack([
            np.log1p(chars - 1), share(0), share(1), share(2), share(3), share(4), share(5), share(6), share(7), share(8), share(9), shouts / chars,
            np.log1p(n), mean, spread, longest, distinct, pairs, triples, np.bincount(w.row, again, rows) / words, top,
            np.log1p(n / np.maximum(sentences, 1)), np.log1p(n / (kinds[:, 1] + 1)), np.bincount(w.row, capital, rows) / words]))
    return np.concatenate(out) if out else np.zeros((0, len(STATISTICS)))


@dataclass(frozen=True)
class QualityModel:
    """Everything a task needs to score: fixed sizes only."""
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    grid: np.ndarray
    prob: np.ndarray

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.interp(features(stats, self.mean, self.scale) @ self.weights, self.grid, self.prob)


def _directions(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20_240_501)
    return rng.normal(0.0, 1.0 / np.sqrt(n), (n, FEATURES)), rng.uniform(0, 2 * np.pi, FEATURES)


def features(stats: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Random Fourier features of standardised statistics, and a constant."""
    w, b = _directions(len(mean))
    z = np.clip((stats - mean) / scale, -CLIP, CLIP)
    return np.column_stack([np.sqrt(2.0 / FEATURES) * np.cos(z @ w + b), np.ones(len(z))])


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, len(STATISTICS)))


def document_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and stats of every document; texts are read once and don't move."""
    def make(batches):
        for batch in batches:
            stats = statistics(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.FixedSizeListArray.from_arrays(pa.array(stats.ravel()), len(STATISTICS)).cast(pa.list_(pa.float64()))], names=["doc_id", "stats"])

    return id_and_text(docs).mapInArrow(make, "doc_id long, stats array<double>")


def _sums(mean: np.ndarray, scale: np.ndarray):
    def add(batches):
        n = FEATURES + 1
        gram, right = np.zeros((INNER, n, n)), np.zeros((INNER, n))
        for batch in batches:
            x, y, fold = features(_matrix(batch.column("stats")), mean, scale), batch.column("y").to_numpy(), batch.column("inner_fold").to_numpy()
            for k in range(INNER):
                part = x[fold == k]
                gram[k] += part.T @ part
                right[k] += part.T @ y[fold == k]
        yield pa.RecordBatch.from_arrays([pa.array([gram.tobytes()]), pa.array([right.tobytes()])], names=["gram", "right"])
    return add


def _solve(gram: np.ndarray, right: np.ndarray) -> np.ndarray:
    n = len(right)
    return np.linalg.solve(gram + RIDGE * max(gram[-1, -1], 1.0) * np.diag([1.0] * (n - 1) + [1e-6]) / FEATURES + 1e-9 * np.eye(n), right)


def pool_adjacent(count: np.ndarray, hits: np.ndarray) -> np.ndarray:
    """Isotonic least squares: the non-decreasing rates of groups in order."""
    blocks: list[list[float]] = []
    for n, h in zip(count, hits):
        blocks.append([float(h), float(n), 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            h2, n2, k2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + h2, blocks[-1][1] + n2, blocks[-1][2] + k2]
    return np.concatenate([np.full(int(k), h / n) for h, n, k in blocks]) if blocks else np.zeros(0)


def fit(stats: DataFrame, labels: DataFrame, label: str = "quality", folds: int = FOLDS, held: int = 0, fit_rows: int = FIT_ROWS) -> QualityModel:
    """Learn from labelled rows outside the held-out fold."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("double").alias("y")).where("doc_id is not null and y in (0, 1)")
    known = known.where(remainder("doc_id", folds) != held)
    total = known.count()
    mixed = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003))
    if total > fit_rows:
        known = known.where(mixed < int(1_000_003 * fit_rows / total))
    rows = stage(stats.where("doc_id is not null").join(known, "doc_id").withColumn("inner_fold", F.pmod(F.shiftright(F.xxhash64("doc_id"), 20), F.lit(INNER)).cast("int")), "quality-fit")
    n = len(STATISTICS)
    means = rows.agg(F.count("*"), F.avg("y"), *[F.avg(F.col("stats")[i]) for i in range(n)], *[F.coalesce(F.stddev_pop(F.col("stats")[i]), F.lit(0.0)) for i in range(n)]).first()
    if not means[0] or means[1] in (0.0, 1.0):
        flat = 0.5 if not means[0] else means[1]
        return QualityModel(np.zeros(n), np.ones(n), np.zeros(FEATURES + 1), np.array([0.0, 1.0]), np.array([flat, flat]))
    mean, scale = np.array(means[2:2 + n]), np.maximum(np.array(means[2 + n:]), 1e-6)
    # As many sums as parts, whatever the number of files.
    parts = rows.coalesce(PARTS).mapInArrow(_sums(mean, scale), "gram binary, right binary").collect()
    gram = sum(np.frombuffer(r["gram"]).reshape(INNER, FEATURES + 1, FEATURES + 1) for r in parts)
    right = sum(np.frombuffer(r["right"]).reshape(INNER, FEATURES + 1) for r in parts)
    weights = _solve(gram.sum(0), right.sum(0))
    inner = np.stack([_solve(gram.sum(0) - gram[k], right.sum(0) - right[k]) for k in range(INNER)])

    def outside(batches):
        for batch in batches:
            x, fold = features(_matrix(batch.column("stats")), mean, scale), batch.column("inner_fold").to_numpy()
            raw = np.einsum("ij,ij->i", x, inner[fold]) if len(x) else np.zeros(0)
            cell = np.clip(np.floor((raw + 0.5) / 2 * GRID), 0, GRID - 1).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(cell), batch.column("y")], names=["cell", "y"])

    cells = rows.mapInArrow(outside, "cell long, y double").groupBy("cell").agg(F.count("*").alias("n"), F.sum("y").alias("hits")).orderBy("cell").collect()
    grid = np.array([(r["cell"] + 0.5) / GRID * 2 - 0.5 for r in cells])
    return QualityModel(mean, scale, weights, grid, pool_adjacent(np.array([r["n"] for r in cells]), np.array([r["hits"] for r in cells])))


def scorer(model: QualityModel):
    """Arrow function text -> score, for tables whose other columns should stay where they are."""
    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array(model.score(statistics(texts)))
    return score


def quality_scores(docs: DataFrame, labels: DataFrame, folds: int = FOLDS, held: int = 0, least: float = LEAST_SCORE) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    stats = stage(document_statistics(docs), "quality-statistics")
    model = fit(stats, labels, "quality", folds, held)

    @F.arrow_udf("double")
    def score(column: pa.Array) -> pa.Array:
        return pa.array(model.score(_matrix(column)))

    out = stats.select("doc_id", (remainder("doc_id", folds) == held).alias("held_out"), score("stats").alias("score"))
    return out.withColumn("predicted", (F.col("score") >= least).cast("int"))
