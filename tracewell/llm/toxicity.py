"""Toxicity by subword bags: a text's character n-grams have vectors, which are
averaged over a passage and go into a linear softmax, all trained jointly. An
unseen misspelling shares n-grams, and so vectors, with the words it resembles.

A long text may be toxic in one place only, so the averages are of passages of
``PASSAGE`` bytes, and a text's score is that of its most toxic passage; in
training the gradient goes to that passage.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, labelled_sample
from .words import WORD_BYTES, hashed, joined, slices

GRAMS = (3, 4, 5, 6)
BUCKET_BITS = 20
DIMS = 8
PASSAGE = 24
#: a passage of fewer n-grams than this is averaged as if blanks filled it up
LEAST = 40
#: n-grams of fewer sample texts are not learned
MIN_TEXTS = 3
#: the strength of the pull of vectors to zero
DECAY = 0.1
#: the bound of the sample that fits the model: texts of each label, and characters of a text
PER_CLASS = 2500
MAX_CHARS = 12_000


def grams(data: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length n, the buckets of the n-grams that start at each byte, and which of them count: those
    within a word, where its first or last byte may be the blank before or after it. A word that only repeats
    the one before counts once."""
    word = WORD_BYTES[data]
    starts, ends, hashes = hashed(data)
    again = np.flatnonzero(hashes[1:] == hashes[:-1]) + 1
    repeated = np.zeros(len(data) + 1, np.int8)
    repeated[starts[again]] = 1
    repeated[ends[again]] = -1
    fresh = word & (np.cumsum(repeated[:-1]) == 0)
    text = np.where(word, data, 32).astype(np.uint32)
    n = len(data)
    h = text.copy()
    for length in range(2, GRAMS[-1] + 1):
        if n < length:
            return
        h = h[: n - length + 1] * np.uint32(0x01000193) ^ (text[length - 1 :] * np.uint32(0x9E3779B1))
        if length in GRAMS:
            inner = np.ones(n - length + 1, bool)
            for j in range(1, length - 1):
                inner &= fresh[j : j + n - length + 1]
            scrambled = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B + 2 * length)
            yield (scrambled >> np.uint32(32 - BUCKET_BITS)).astype(np.int64), inner


def passages(zeros: np.ndarray, size: int = PASSAGE) -> tuple[np.ndarray, np.ndarray]:
    """Where passages begin, in bytes, and where each text's passages begin among them; every text has one at least."""
    starts = np.concatenate([[0], zeros[:-1] + 1])
    counts = np.maximum(1, -(-(zeros - starts) // size))
    first = np.cumsum(counts) - counts
    return np.repeat(starts - first * size, counts) + np.arange(counts.sum()) * size, first


@dataclass
class Model:
    value: np.ndarray  # of each bucket: its vector's share of the softmax's logit
    bias: float

    def logits(self, texts: list[str | None]) -> np.ndarray:
        out = []
        for a, b in slices(texts):
            data, zeros = joined(texts[a:b])
            at, first = passages(zeros)
            total, count = np.zeros(len(data)), np.zeros(len(data))
            for bucket, inner in grams(data):
                total[: len(bucket)] += np.where(inner, self.value[bucket], 0)
                count[: len(bucket)] += inner
            each = np.add.reduceat(total, at) / np.maximum(np.add.reduceat(count, at), LEAST)
            out.append(np.maximum.reduceat(each, first))
        return (np.concatenate(out) if out else np.zeros(0)) + self.bias

    def scores(self, texts: list[str | None]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(texts), -60, 60)))


def fit(texts: list[str], labels: list[int], epochs: int | None = None, batch: int = 64, seed: int = 7) -> Model:
    """Vectors and softmax by AdaGrad, over ten epochs, or as many as make 600 steps. Without both labels, the model gives every text the share of ones, or one half."""
    buckets = 1 << BUCKET_BITS
    y = np.asarray(labels, float)
    if len(y) == 0 or y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2)
        return Model(np.zeros(buckets), float(np.log(share / (1 - share))))
    prepared = []
    for t in texts:
        data, zeros = joined([t])
        at, _ = passages(zeros)
        pairs = [(b[i], np.searchsorted(at, np.flatnonzero(i), "right") - 1) for b, i in grams(data)]
        ids = np.concatenate([p[0] for p in pairs]) if pairs else np.zeros(0, np.int64)
        who = np.concatenate([p[1] for p in pairs]) if pairs else np.zeros(0, np.int64)
        order = np.argsort(who, kind="stable")
        prepared.append((ids[order].astype(np.int32), np.searchsorted(who[order], np.arange(len(at) + 1))))
    # n-grams of few training texts would only learn those texts by heart
    held = np.zeros(buckets, np.int64)
    for own, _ in prepared:
        held[np.unique(own)] += 1
    common = held >= MIN_TEXTS
    known, number = np.flatnonzero(common), np.cumsum(common) - 1
    prepared = [(number[own[common[own]]].astype(np.int32), np.concatenate([[0], np.cumsum(common[own])])[edges]) for own, edges in prepared]
    n = len(known)
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1, 1, (n, DIMS)) / DIMS
    weights, bias = rng.normal(0, 0.1, (2, DIMS)), np.zeros(2)
    seen, seen_w, seen_b = np.full((n, DIMS), 1e-6), np.full((2, DIMS), 1e-6), np.full(2, 1e-6)
    rate, epochs = 0.3, epochs or max(10, -(-600 * batch // len(y)))
    for epoch in range(epochs):
        order = rng.permutation(len(y))
        for k in range(0, len(order), batch):
            ids, sizes, spans, ys = [], [], [], []
            slope = weights[1] - weights[0]
            value = vectors @ slope
            for d in order[k : k + batch]:
                own, edges = prepared[d]
                if not len(own) or (epoch and not np.diff(edges).any()):
                    continue
                counts = np.diff(edges)
                if epoch == 0:
                    chosen = slice(None)  # at first the whole text: no passage is known to be the worst
                else:
                    sums = np.concatenate([[0.0], np.cumsum(value[own])])
                    p = int(np.argmax(np.where(counts > 0, (sums[edges[1:]] - sums[edges[:-1]]) / np.maximum(counts, LEAST), -np.inf)))
                    chosen = slice(edges[p], edges[p + 1])
                ids.append(own[chosen])
                sizes.append(len(ids[-1]))
                spans.append(max(sizes[-1], LEAST))
                ys.append(y[d])
            if not ids:
                continue
            flat, sizes_, spans_, ys_ = np.concatenate(ids), np.array(sizes), np.array(spans), np.array(ys)
            means = np.add.reduceat(vectors[flat], np.cumsum(sizes_) - sizes_) / spans_[:, None]
            logits = means @ weights.T + bias
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            g = (p - np.stack([1 - ys_, ys_], 1)) / len(ys_)
            share = np.repeat(g[:, 1] / spans_, sizes_)
            grad = np.bincount(flat, share, n)[:, None] * slope + DECAY / n * vectors  # the softmax's two slopes are opposite
            seen += grad**2
            vectors -= rate * grad / np.sqrt(seen)
            grad_w, grad_b = g.T @ means, g.sum(0)
            seen_w += grad_w**2
            seen_b += grad_b**2
            weights -= rate * grad_w / np.sqrt(seen_w)
            bias -= rate * grad_b / np.sqrt(seen_b)
    values = np.zeros(buckets)  # an n-gram that the training texts lack says nothing
    values[known] = vectors @ (weights[1] - weights[0])
    return Model(values, float(bias[1] - bias[0]))


def score(docs: DataFrame, model: Model, threshold: float = 0.3, mod: int = 4, rem: int = 2) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs``.

    A null or empty text, or one without words, gets the score that the bias
    alone gives. Rows that repeat a doc_id are scored alike; a null doc_id is
    not held out. An empty table gives no rows. Other columns play no part.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((model.value.astype(np.float32), model.bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        for batch in batches:
            for k in range(0, len(batch), 512):
                part = batch.slice(k, 512)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(own.scores(part.column("text").to_pylist()))], ["doc_id", "held_out", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(mod, rem).alias("held_out"), "text")
    scored = rows.mapInArrow(run, "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))


def toxicity(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, max_chars: int = MAX_CHARS) -> DataFrame:
    """score() of every row of ``docs`` by a model fitted on a bounded sample of the labelled rows that are not held out.

    Labels other than 0 and 1, null ones, and those of a null doc_id or of no row
    teach nothing; a doc_id labelled twice counts as toxic if it is so once. With labels
    of one kind, or none, all rows get one score. Null and empty texts and repeated
    rows are as score() says; an empty table gives no rows.
    """
    texts, y = labelled_sample(docs, labels, "toxic", 4, 2, per_class, max_chars)
    return score(docs, fit(texts, y))
