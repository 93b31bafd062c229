"""A quality classifier by attention over passages (multiple-instance learning):
every passage is encoded, gated attention weighs the passages of a text, and the
weighted representation is scored. Encoder, attention and score are learned
together from the labels of whole documents, in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, labelled_sample
from .toxicity import passages
from .words import hashed, joined, slices

PASSAGE = 512
DIMS, GATE = 16, 8
#: the bound of the sample that fits the model: texts of each label, and characters of a text
PER_CLASS = 2500
MAX_CHARS = 20_000

_CLASSES = 12
_class_of = np.full(256, 11)
_class_of[128:] = 0
_class_of[[*range(97, 123)]] = 1
_class_of[[*range(65, 91)]] = 2
_class_of[[*range(48, 58)]] = 3
for _k, _marks in enumerate((b" \t", b"\n\r", b".,;:?", b"!", b"|", b"#$%&*", b"'\"()-"), 4):
    _class_of[list(_marks)] = _k
FEATURES = _CLASSES + 5


def encode(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """A row of features for each passage, and where each text's passages begin; an empty text has one passage of zeros."""
    raw = "\x00".join([(t.replace("\x00", " ") if "\x00" in t else t) if t else "" for t in texts] + [""])
    data = np.frombuffer(raw.encode("utf-8", "surrogatepass"), np.uint8)
    zeros = np.flatnonzero(data == 0)
    at, first = passages(zeros, PASSAGE)
    n = len(at)
    of = np.repeat(np.arange(n), np.diff(np.append(at, len(data))))
    kinds = np.bincount(of * _CLASSES + _class_of[data], minlength=n * _CLASSES)[: n * _CLASSES].reshape(n, _CLASSES).astype(float)
    kinds[np.searchsorted(at, zeros, "right") - 1, 11] -= 1  # the zero bytes
    size = np.maximum(kinds.sum(1), 1)
    lowered = np.where((data >= 65) & (data <= 90), data + 32, data)
    starts, ends, hashes = hashed(lowered)
    where = np.searchsorted(at, starts, "right") - 1
    text = np.searchsorted(zeros, starts)
    keys = hashes ^ (text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    fresh = np.zeros(len(keys), bool)
    fresh[np.unique(keys, return_index=True)[1]] = True
    again = np.zeros(len(keys), bool)
    again[1:] = keys[1:] == keys[:-1]
    length = (ends - starts).astype(float)
    words = np.bincount(where, minlength=n)
    mean = lambda x: np.bincount(where, x, n) / np.maximum(words, 1)
    extra = np.stack([np.log1p(words), mean(length) / 8, np.sqrt(np.maximum(mean(length**2) - mean(length) ** 2, 0)) / 8, mean(fresh), mean(again)], 1)
    return np.hstack([kinds / size[:, None], extra]), first


class Model:
    """Weights by name, and what standardises the features."""

    def __init__(self, weights: dict[str, np.ndarray], mean: np.ndarray, spread: np.ndarray):
        self.weights, self.mean, self.spread = weights, mean, spread

    def forward(self, x: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
        w = self.weights
        counts = np.diff(np.append(first, len(x)))
        h = np.tanh((x - self.mean) / self.spread @ w["encode"] + w["encode0"])
        t, s = np.tanh(h @ w["tanh"]), 1 / (1 + np.exp(-np.clip(h @ w["gate"], -30, 30)))
        e = (t * s) @ w["attend"]
        a = np.exp(e - np.repeat(np.maximum.reduceat(e, first), counts))
        a /= np.repeat(np.add.reduceat(a, first), counts)
        z = np.add.reduceat(a[:, None] * h, first)
        return {"h": h, "t": t, "s": s, "a": a, "z": z, "counts": counts, "p": 1 / (1 + np.exp(-np.clip(z @ w["score"] + w["score0"], -30, 30)))}

    def scores(self, texts: list[str | None]) -> np.ndarray:
        out = [self.forward(*encode(texts[a:b]))["p"] for a, b in slices(texts)]
        return np.concatenate(out) if out else np.zeros(0)


def fit(texts: list[str], labels: list[int], steps: int = 250, rate: float = 0.02, seed: int = 11) -> Model:
    """Adam on the whole sample. Without both labels, the model gives every text the share of ones, or one half."""
    y = np.asarray(labels, float)
    rng = np.random.default_rng(seed)
    shapes = {"encode": (FEATURES, DIMS), "tanh": (DIMS, GATE), "gate": (DIMS, GATE), "attend": (GATE,), "score": (DIMS,)}
    weights = {k: rng.normal(0, 1 / np.sqrt(s[0]), s) for k, s in shapes.items()} | {"encode0": np.zeros(DIMS), "score0": np.zeros(())}
    if len(y) == 0 or y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2)
        weights["score"], weights["score0"] = np.zeros(DIMS), np.log(share / (1 - share))
        return Model(weights, np.zeros(FEATURES), np.ones(FEATURES))
    parts = [encode(texts[a:b]) for a, b in slices(texts)]
    x = np.concatenate([p for p, _ in parts])
    before = np.cumsum([0, *(len(p) for p, _ in parts)])
    first = np.concatenate([f + b for (_, f), b in zip(parts, before, strict=False)])
    model = Model(weights, x.mean(0), x.std(0) + 1e-3)
    standard = (x - model.mean) / model.spread
    m1, m2 = ({k: np.zeros_like(v) for k, v in weights.items()} for _ in range(2))
    for step in range(1, steps + 1):
        f = model.forward(x, first)
        h, t, s, a, counts, w = f["h"], f["t"], f["s"], f["a"], f["counts"], model.weights
        g = (f["p"] - y) / len(y)
        dz = np.repeat(g, counts)[:, None] * w["score"]
        da = (h * dz).sum(1)
        de = a * (da - np.repeat(np.add.reduceat(a * da, first), counts))
        dt, ds = de[:, None] * w["attend"] * s * (1 - t**2), de[:, None] * w["attend"] * t * s * (1 - s)
        dh = (a[:, None] * dz + dt @ w["tanh"].T + ds @ w["gate"].T) * (1 - h**2)
        grads = {"score": g @ f["z"], "score0": g.sum(), "attend": de @ (t * s), "tanh": h.T @ dt, "gate": h.T @ ds, "encode": standard.T @ dh, "encode0": dh.sum(0)}
        for k, d in grads.items():
            d = d + 1e-4 * w[k]
            m1[k] = 0.9 * m1[k] + 0.1 * d
            m2[k] = 0.99 * m2[k] + 0.01 * d**2
            w[k] = w[k] - rate * m1[k] / (1 - 0.9**step) / (np.sqrt(m2[k] / (1 - 0.99**step)) + 1e-8)
    return model


def score(docs: DataFrame, model: Model, threshold: float = 0.3, mod: int = 5, rem: int = 0) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs``; its other columns play no part.

    A null or empty text is scored as one passage without characters. Rows that
    repeat a doc_id are scored alike; a null doc_id is not held out. An empty
    table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.mean, model.spread))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        for batch in batches:
            for k in range(0, len(batch), 512):
                part = batch.slice(k, 512)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(own.scores(part.column("text").to_pylist()))], ["doc_id", "held_out", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(mod, rem).alias("held_out"), "text")
    scored = rows.mapInArrow(run, "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))


def kept(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs``, with their columns, that the model doesn't reject: those that score ``threshold`` or more.

    Null and empty texts are judged as one passage without characters, rows that
    repeat stay or go together, and an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.mean, model.spread))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        for batch in batches:
            for k in range(0, len(batch), 512):
                part = batch.slice(k, 512)
                yield part.filter(pa.array(own.scores(part.column(at).to_pylist()) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def fitted(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, max_chars: int = MAX_CHARS) -> Model:
    """Fit on a bounded sample of the labelled rows that are not held out."""
    return fit(*labelled_sample(docs, labels, "quality", 5, 0, per_class, max_chars))


def quality(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, max_chars: int = MAX_CHARS) -> DataFrame:
    """score() of every row of ``docs`` by a model fitted on a bounded sample of the labelled rows that are not held out.

    Labels other than 0 and 1, null ones, and those of a null doc_id or of no row
    teach nothing; a doc_id labelled twice takes the higher. With labels of one
    kind, or none, all rows get one score. Null and empty texts and repeated rows
    are as score() says; an empty table gives no rows.
    """
    return score(docs, fitted(docs, labels, per_class, max_chars))
