"""Toxicity by multiple-instance learning: sentences are scored, a noisy-or combines them, document labels train them.

A sentence has a probability from the words it holds (whole words and their first four and five bytes, so that compounds
of a stem are seen too); a document is toxic if any sentence is: p = 1 - prod(1 - p_s). Only documents carry labels; the
likelihood of the noisy-or is maximised, and the sentences that caused a score can then be shown.

1. ``CANDIDATES`` features that most toxic training documents share are gathered (counts combined before the shuffle).
2. They are counted in all training documents; of those bound to the label beyond chance (log-likelihood ratio of
   ``LEAST_BOUND``, or ``LEAST_SHARE`` of the strongest ratio if that is less, as with few labels), the ``FEATURES`` strongest stay.
3. Training documents become short lists (sentence, feature), and the driver fits the weights on at most ``FIT_ROWS``
   documents, taken by hash. Corpus-wide work is scoring alone, which reads each whole text once and moves nothing.

Defined results: texts without words score 0. Without usable labels (none, or one kind) every score is 0, or 1 if all
labels are 1. An id whose labels contradict each other is not learned from. Rows without ``doc_id`` are scored and never learned from. Repeated rows get equal scores. Other columns
are ignored.
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

FIT_ROWS = 30_000
CANDIDATES = 50_000
FEATURES = 1_024
LEAST_DOCS = 3
# A feature must reach this log-likelihood ratio, or this share of the strongest one where labels are few.
LEAST_BOUND, LEAST_SHARE = 30.0, 0.25
PREFIXES = (4, 5)
FOLDS, HELD = 3, 1
LEAST_SCORE = 0.7
STEPS = 400
WEIGHT_COST = 1e-6


def _features(texts: pa.Array):
    """Runs of (Words, feature hashes: one row per kind of feature, one column per word)."""
    for w in W.words(texts, W.LETTERS, PREFIXES):
        yield w, np.stack([w.hash, *w.prefix]) ^ np.arange(1, 2 + len(PREFIXES), dtype=np.uint64)[:, None]


def _distinct_per_row(w: W.Words, hashes: np.ndarray):
    """(row, feature) pairs, each once."""
    bounds = np.concatenate([[0], np.cumsum(np.bincount(w.row, minlength=w.rows))])
    for r in np.flatnonzero(np.diff(bounds)):
        yield r, np.unique(hashes[:, bounds[r]:bounds[r + 1]])


def _candidates(batches):
    """Documents of this task per feature, toxic documents only."""
    seen = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for batch in batches:
        for w, hashes in _features(batch.column("text")):
            found = [seen[0]] + [x for _, x in _distinct_per_row(w, hashes)]
            many = np.concatenate(found)
            weight = np.concatenate([seen[1], np.ones(len(many) - len(seen[0]), np.int64)])
            keys, back = np.unique(many, return_inverse=True)
            seen = keys, np.bincount(back, weight, len(keys)).astype(np.int64)
            if len(keys) > 500_000:
                yield pa.RecordBatch.from_arrays([pa.array(seen[0].view(np.int64)), pa.array(seen[1])], names=["feature", "n"])
                seen = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(seen[0].view(np.int64)), pa.array(seen[1])], names=["feature", "n"])


def _find(sorted_keys: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Index of each hash among the keys, -1 if absent."""
    if not len(sorted_keys):
        return np.full(hashes.shape, -1, np.int64)
    i = np.minimum(np.searchsorted(sorted_keys, hashes), len(sorted_keys) - 1)
    return np.where(sorted_keys[i] == hashes, i, -1)


def _counter(keys: np.ndarray):
    def count(batches):
        n = np.zeros((2, len(keys)), np.int64)
        for batch in batches:
            y = batch.column("y").to_numpy()
            for w, hashes in _features(batch.column("text")):
                for r, x in _distinct_per_row(w, hashes):
                    i = _find(keys, x)
                    n[int(y[w.first + r]), i[i >= 0]] += 1
        at = np.flatnonzero(n.sum(0))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[0, at]), pa.array(n[1, at])], names=["i", "clean", "toxic"])
    return count


def _association(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> np.ndarray:
    """Log-likelihood ratio of feature and label (0 where the feature is commoner in clean documents)."""
    def part(seen, expected):
        return np.where(seen > 0, seen * np.log(np.maximum(seen, 1e-12) / np.maximum(expected, 1e-12)), 0.0)

    both, n = toxic + clean, n_toxic + n_clean
    ratio = 2 * (part(toxic, both * n_toxic / n) + part(clean, both * n_clean / n) + part(n_toxic - toxic, n_toxic - both * n_toxic / n) + part(n_clean - clean, n_clean - both * n_clean / n))
    return np.where(toxic * n_clean > clean * n_toxic, ratio, 0.0)


def _lists(keys: np.ndarray):
    def make(batches):
        for batch in batches:
            y = batch.column("y").to_numpy()
            for w, hashes in _features(batch.column("text")):
                i = _find(keys, hashes)
                bounds = np.concatenate([[0], np.cumsum(np.bincount(w.row, minlength=w.rows))])
                rows = ([], [], [], [])
                for r in range(w.rows):
                    lo, hi = bounds[r], bounds[r + 1]
                    mine = i[:, lo:hi]
                    hit = np.argwhere(mine >= 0)
                    first = w.sentence[lo] if hi > lo else 0
                    pair = np.unique((w.sentence[lo:hi][hit[:, 1]] - first) * len(keys) + mine[hit[:, 0], hit[:, 1]]) if len(hit) else np.zeros(0, np.int64)
                    rows[0].append(float(y[w.first + r]))
                    rows[1].append(int(w.sentence[hi - 1] - first + 1) if hi > lo else 0)
                    rows[2].append(pair // max(len(keys), 1))
                    rows[3].append(pair % max(len(keys), 1))
                yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.float64()), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.list_(pa.int64())), pa.array(rows[3], pa.list_(pa.int64()))],
                                                 names=["y", "sentences", "at", "feature"])
    return make


@dataclass(frozen=True)
class ToxicityModel:
    """Feature hashes (sorted) with weights, and the bias of a sentence."""
    keys: np.ndarray
    weights: np.ndarray
    bias: float

    def sentences(self, texts: pa.Array):
        """Runs of (Words, first word of each sentence, probability of each sentence)."""
        for w, hashes in _features(texts):
            i = _find(self.keys, hashes)
            n = int(w.sentence[-1]) + 1 if len(w.sentence) else 0
            z = np.full(n, self.bias)
            hit = np.argwhere(i >= 0)
            if len(hit):
                pair = np.unique(w.sentence[hit[:, 1]] * len(self.keys) + i[hit[:, 0], hit[:, 1]])
                np.add.at(z, pair // len(self.keys), self.weights[pair % len(self.keys)])
            first = np.searchsorted(w.sentence, np.arange(n))
            yield w, first, 1 / (1 + np.exp(-np.clip(z, -60, 60)))

    def score(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Noisy-or of each text, and how many of its sentences are toxic by themselves."""
        scores, counts = [], []
        for w, first, p in self.sentences(texts):
            row = w.row[first] if len(first) else np.zeros(0, np.int64)
            scores.append(1 - np.exp(np.bincount(row, np.log1p(-np.minimum(p, 1 - 1e-15)), w.rows)))
            counts.append(np.bincount(row, p >= 0.5, w.rows).astype(np.int64))
        return (np.concatenate(scores), np.concatenate(counts)) if scores else (np.zeros(0), np.zeros(0, np.int64))


def train_noisy_or(y: np.ndarray, sentences: np.ndarray, doc: np.ndarray, at: np.ndarray, feature: np.ndarray, n_features: int) -> tuple[np.ndarray, float]:
    """Weights and bias that maximise the noisy-or likelihood (Adam, full passes). Hits: (doc, sentence, feature)."""
    key, sentence_of = np.unique(doc * (int(sentences.max(initial=0)) + 1) + at, return_inverse=True)
    doc_of = key // (int(sentences.max(initial=0)) + 1)
    plain = sentences - np.bincount(doc_of, minlength=len(y))
    theta, bias = np.zeros(n_features), -4.0
    m, v, mb, vb = np.zeros(n_features), np.zeros(n_features), 0.0, 0.0
    n = max(len(y), 1)
    for step in range(1, STEPS + 1):
        z = bias + np.bincount(sentence_of, theta[feature], len(key))
        clean = np.logaddexp(0, z)
        total = np.bincount(doc_of, clean, len(y)) + plain * np.logaddexp(0, bias)
        total = np.maximum(total, 1e-12)
        # d(-log likelihood)/d(total): 1 for clean documents, -1/(e^total - 1) for toxic ones.
        slope = np.where(y > 0.5, -1 / np.expm1(np.minimum(total, 50)), 1.0) / n
        g_sentence = slope[doc_of] / (1 + np.exp(-z))
        grad = np.bincount(feature, g_sentence[sentence_of], n_features) + 2 * WEIGHT_COST * theta
        g_bias = g_sentence.sum() + (slope * plain).sum() / (1 + np.exp(-bias))
        rate = 0.3 / (1 + 3 * step / STEPS)
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad ** 2
        mb, vb = 0.9 * mb + 0.1 * g_bias, 0.99 * vb + 0.01 * g_bias ** 2
        theta -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-9)
        bias -= rate * (mb / (1 - 0.9 ** step)) / (np.sqrt(vb / (1 - 0.99 ** step)) + 1e-9)
    return theta, float(bias)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = FOLDS, held: int = HELD, fit_rows: int = FIT_ROWS) -> ToxicityModel:
    """Learn from labelled documents outside the held-out fold. The sample is bounded, so its labels may be broadcast."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
    known = known.where(remainder("doc_id", folds) != held)
    total = known.count()
    if total > fit_rows:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < int(1_000_003 * fit_rows / total))
    agreed = known.groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("most")).where("y = most").select("doc_id", "y")
    known = stage(agreed, "toxicity-labels")
    rows = stage(id_and_text(docs).where("doc_id is not null").join(F.broadcast(known), "doc_id").select("text", "y"), "toxicity-fit")
    kinds = {r["y"] for r in rows.select("y").distinct().collect()}
    if kinds != {0, 1}:
        return ToxicityModel(np.zeros(0, np.uint64), np.zeros(0), 50.0 if kinds == {1} else -50.0)
    common = rows.where("y = 1").mapInArrow(_candidates, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n"))
    top = common.where(f"n >= {LEAST_DOCS}").orderBy(F.desc("n"), "feature").limit(CANDIDATES).collect()
    keys = np.sort(np.array([r["feature"] for r in top], np.int64).view(np.uint64))
    counts = rows.mapInArrow(_counter(keys), "i long, clean long, toxic long").groupBy("i").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).collect()
    size = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    clean, toxic, i = (np.array([r[c] for r in counts], np.int64) for c in ("clean", "toxic", "i"))
    bound = _association(toxic, clean, size[1], size[0])
    best = np.argsort(-bound, kind="stable")[:FEATURES]
    least = min(LEAST_BOUND, LEAST_SHARE * bound.max(initial=0))
    keys = np.sort(keys[i[best[(bound[best] >= least) & (bound[best] > 0)]]])
    lists = rows.mapInArrow(_lists(keys), "y double, sentences long, at array<long>, feature array<long>").toArrow()
    at, feature = lists.column("at").combine_chunks(), lists.column("feature").combine_chunks()
    doc = np.repeat(np.arange(len(at)), np.diff(at.offsets.to_numpy()))
    theta, bias = train_noisy_or(lists.column("y").to_numpy(), lists.column("sentences").to_numpy(), doc, at.flatten().to_numpy(), feature.flatten().to_numpy(), len(keys))
    return ToxicityModel(keys, theta, bias)


def scorer(model: ToxicityModel):
    """Arrow function text -> (score, toxic_sentences)."""
    @F.arrow_udf("struct<score: double, toxic_sentences: long>")
    def score(texts: pa.Array) -> pa.Array:
        p, n = model.score(texts)
        return pa.StructArray.from_arrays([pa.array(p), pa.array(n)], names=["score", "toxic_sentences"])
    return score


def offending(docs: DataFrame, model: ToxicityModel, least: float = 0.5) -> DataFrame:
    """doc_id, sentence (number among those with words), span of its words in bytes of the UTF-8 text, score, words."""
    def find(batches):
        for batch in batches:
            ids, texts, rows = batch.column(0), batch.column(1), []
            for w, first, p in model.sentences(texts):
                ends = np.append(first[1:], len(w.row))
                for s in np.flatnonzero(p >= least):
                    r = int(w.row[first[s]])
                    lo, hi = int(w.start[first[s]]), int(w.end[ends[s] - 1])
                    number = int(s - w.sentence[np.searchsorted(w.row, r)])
                    rows.append((ids[w.first + r].as_py(), number, lo, hi, float(p[s]), texts[w.first + r].as_py().encode()[lo:hi].decode("utf-8", "replace")))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)], names=["doc_id", "sentence", "start", "end", "score", "words"])

    return id_and_text(docs).mapInArrow(find, "doc_id long, sentence long, start long, end long, score double, words string")


def toxicity_scores(docs: DataFrame, labels: DataFrame, folds: int = FOLDS, held: int = HELD, least: float = LEAST_SCORE) -> DataFrame:
    """doc_id, held_out, score, predicted, toxic_sentences for every document."""
    score = scorer(fit(docs, labels, "toxic", folds, held))
    out = id_and_text(docs).select("doc_id", (remainder("doc_id", folds) == held).alias("held_out"), score("text").alias("s"))
    return out.select("doc_id", "held_out", "s.score", (F.col("s.score") >= least).cast("int").alias("predicted"), "s.toxic_sentences")
