"""Benchmark decontamination: a BM25 inverted index of the test items, queried
with every training passage by block-max WAND.

An item's score is its BM25 sum over the terms it shares with the passage,
divided by the sum over all its terms, so one threshold serves all items. The
passages of a batch go through WAND's bounds together: terms' maxima over all
items discard passages, terms' maxima over blocks of items discard blocks, and
only the items of the blocks that remain are scored. All items at or above the
threshold are retrieved; a pair counts as a leak if the item then aligns with
some run of the passage's words, and enough of its question and of its answer do.

An item's answer is its last sentence and its question the rest; an item of one
sentence is both.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved
from .words import slices, word_hashes

K1, B = 1.2, 0.75
THRESHOLD = 0.6
#: least edit similarities to the best run of the passage: of the whole item, and of question and answer each
WHOLE, PART = 0.8, 0.5
BLOCK_ITEMS = 8
STRIDE = 64
#: bytes of item texts that one index holds; more items make more indexes, each a pass of its own
INDEX_BYTES = 16 << 20


def share_within(part: np.ndarray, window: np.ndarray) -> float:
    """1 - (the edits that turn the part into the best run of the window) / words of the part; 1 for an empty part."""
    if not len(part):
        return 1.0
    ramp = np.arange(len(window) + 1)
    cost = np.zeros(len(window) + 1, np.int64)  # a run may begin anywhere
    for word in part:
        step = cost + 1  # the word is left out
        step[1:] = np.minimum(step[1:], cost[:-1] + (window != word))
        cost = np.minimum.accumulate(step - ramp) + ramp
    return 1 - int(cost.min()) / len(part)


def parts(text: str) -> tuple[str, str]:
    """Question and answer."""
    ends = [m.end() for m in re.finditer(r"[.!?]+(?=\s)", text.rstrip())]
    return (text[: ends[-1]], text[ends[-1] :]) if ends else (text, text)


@dataclass
class Statistics:
    """Of all items with words: their number, words and longest length, and in how many of them each of some terms is (terms in order)."""

    items: int
    words: int
    longest: int
    terms: np.ndarray
    df: np.ndarray


class Index:
    """The items with words; ``ids`` are their item_ids. ``statistics`` are those of all items, where these are a part of them."""

    def __init__(self, items: list[tuple[int, str | None]], statistics: Statistics | None = None):
        found = [(i, t, word_hashes([t])[0]) for i, t in sorted(items, key=lambda x: (x[0] is None, x[0] or 0, x[1] or ""))]
        found = [x for x in found if len(x[2])]
        self.ids = [i for i, _, _ in found]
        self.pieces = [tuple(word_hashes([p])[0] for p in parts(t)) for _, t, _ in found]
        self.whole = [w for _, _, w in found]
        self.lengths = np.array([len(w) for _, _, w in found], np.int64)
        counted = [np.unique(w, return_counts=True) for _, _, w in found]
        self.terms = np.unique(np.concatenate([t for t, _ in counted])) if found else np.zeros(0, np.uint64)
        item = np.repeat(np.arange(len(found)), [len(t) for t, _ in counted])
        term = np.searchsorted(self.terms, np.concatenate([t for t, _ in counted])) if found else np.zeros(0, np.int64)
        tf = np.concatenate([c for _, c in counted]).astype(float) if found else np.zeros(0)
        if statistics is None:
            statistics = Statistics(len(found), int(self.lengths.sum()), int(self.lengths.max(initial=0)), self.terms, np.bincount(term, minlength=len(self.terms)))
        self.stride = max(STRIDE, statistics.longest)
        df = statistics.df[np.searchsorted(statistics.terms, self.terms)]
        idf = np.log1p((statistics.items - df + 0.5) / (df + 0.5))
        norm = K1 * (1 - B + B * self.lengths / max(statistics.words / max(statistics.items, 1), 1))
        weight = idf[term] * tf * (K1 + 1) / (tf + norm[item])
        weight /= np.bincount(item, weight, len(found))[item]
        order = np.lexsort((item, term))
        self.item, self.weight = item[order], weight[order]
        self.post = np.searchsorted(term[order], np.arange(len(self.terms) + 1))
        # maxima of each term over all items and over each block of items
        self.most = np.maximum.reduceat(self.weight, self.post[:-1]) if len(self.terms) else np.zeros(0)
        block = self.item // BLOCK_ITEMS
        key = term[order] * (len(found) // BLOCK_ITEMS + 1) + block
        at = np.flatnonzero(np.diff(key, prepend=-1))
        self.block = block[at]
        self.block_most = np.maximum.reduceat(self.weight, at) if len(at) else np.zeros(0)
        self.block_post = np.searchsorted(term[order][at], np.arange(len(self.terms) + 1))
        self.n_blocks = len(found) // BLOCK_ITEMS + 1
        self.sieve = np.zeros(1 << 20, bool)
        self.sieve[(self.terms >> np.uint64(44)).astype(np.int64)] = True

    def _spread(self, post: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the terms' postings, and the number of the term that each belongs to."""
        n = post[terms + 1] - post[terms]
        ends = np.cumsum(n)
        return np.arange(ends[-1] if len(ends) else 0) + np.repeat(post[terms] - (ends - n), n), np.repeat(np.arange(len(terms)), n)

    def retrieve(self, words: np.ndarray, offsets: np.ndarray, threshold: float) -> list[tuple[int, int, int, int, float]]:
        """text, first word, last word (exclusive), item and score of every pair of a passage and an item at or above the threshold.

        Passages are windows of two strides, one stride apart; any run of up to a stride's words lies within one.
        """
        if not len(self.ids) or not len(words):
            return []
        counts = np.diff(offsets)
        halves = np.maximum(1, -(-counts // self.stride))
        half0 = np.cumsum(halves) - halves
        maybe = np.flatnonzero(self.sieve[(words >> np.uint64(44)).astype(np.int64)])
        term = np.searchsorted(self.terms, words[maybe])
        known = self.terms[np.minimum(term, len(self.terms) - 1)] == words[maybe]
        at, term = maybe[known], term[known]
        text = np.searchsorted(offsets, at, "right") - 1
        half = half0[text] + (at - offsets[text]) // self.stride
        key = np.unique(half * len(self.terms) + term)
        half, term = key // len(self.terms), key % len(self.terms)
        bound = np.bincount(half, self.most[term], halves.sum() + 1)
        last = np.zeros(len(bound), bool)
        last[half0 + halves - 1] = True
        # a window is a half and the next one of its text; a text of one half is one window
        bound[:-1] += np.where(last[:-1], 0, bound[1:])
        alone = np.repeat(halves == 1, halves)
        live = (bound[:-1] >= threshold - 1e-9) & (~last[:-1] | alone)
        if not live.any():
            return []
        number = np.cumsum(live) - 1
        live = np.append(live, False)
        first = live[half]
        second = (half > 0) & live[half - 1]
        w = np.concatenate([number[half[first]], number[half[second] - 1]])
        key = np.unique(w * len(self.terms) + np.concatenate([term[first], term[second]]))
        w, term = key // len(self.terms), key % len(self.terms)
        out, step = [], max(1, 4_000_000 // self.n_blocks)
        windows = np.flatnonzero(live)
        for k in range(0, len(windows), step):
            a, b = np.searchsorted(w, [k, k + step])
            own, own_terms, n = w[a:b] - k, term[a:b], min(step, len(windows) - k)
            place, who = self._spread(self.block_post, own_terms)
            bounds = np.bincount(own[who] * self.n_blocks + self.block[place], self.block_most[place], n * self.n_blocks)
            open_ = bounds >= threshold - 1e-9
            still = open_.reshape(n, -1).any(1)[own]
            place, who = self._spread(self.post, own_terms[still])
            pair = own[still][who] * self.n_blocks + self.item[place] // BLOCK_ITEMS
            place, who = place[open_[pair]], who[open_[pair]]
            keys, inverse = np.unique(own[still][who] * len(self.ids) + self.item[place], return_inverse=True)
            sums = np.bincount(inverse, self.weight[place], len(keys))
            for q in np.flatnonzero(sums >= threshold - 1e-9):
                h = int(windows[k + keys[q] // len(self.ids)])
                t = int(np.searchsorted(half0, h, "right") - 1)
                begin = int(offsets[t] + (h - half0[t]) * self.stride)
                out.append((t, begin, int(min(offsets[t + 1], begin + 2 * self.stride)), int(keys[q] % len(self.ids)), float(sums[q])))
        return out

    def leaks(self, texts: list[str | None], threshold: float = THRESHOLD) -> list[tuple[int, int, float, float, float]]:
        """text, item, score, and how much of the question and of the answer aligns; the best passage of each pair, in order."""
        out: dict[tuple[int, int], tuple[float, float, float]] = {}
        for a, b in slices(texts):
            words, offsets = word_hashes(texts[a:b])
            for t, begin, end, item, score in sorted(self.retrieve(words, offsets, threshold), key=lambda x: x[1:4]):
                window = words[begin:end]
                if share_within(self.whole[item], window) < WHOLE - 1e-9:
                    continue
                question, answer = (share_within(p, window) for p in self.pieces[item])
                if min(question, answer) >= PART - 1e-9:
                    out[a + t, item] = max(out.get((a + t, item), (0.0, 0.0, 0.0)), (score, question, answer))
        return [(*k, *v) for k, v in sorted(out.items())]


def indexes(items: DataFrame) -> Iterator[Index]:
    """Indexes of the items, each of a part whose texts fit INDEX_BYTES or so, whatever their number. Scores follow from
    statistics of all items, so the cut into parts changes none."""
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), "text")
    n = (rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // INDEX_BYTES + 1
    if n == 1:
        yield Index([(r.item_id, r.text) for r in rows.collect()])
        return
    rows = rows.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(n)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, offsets = word_hashes(batch.column("text").to_pylist())
            own = [np.unique(words[a:b]).view(np.int64) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("part"), pa.array(np.diff(offsets)), pa.array(own, pa.list_(pa.int64()))], ["part", "words", "terms"])

    held = saved(rows.select("part", "text").mapInArrow(run, "part long, words long, terms array<long>").where("words > 0"), "item-terms")
    total = held.agg(F.count("*"), F.coalesce(F.sum("words"), F.lit(0)), F.coalesce(F.max("words"), F.lit(0))).first()
    in_parts = held.select("part", F.explode("terms").alias("term"))
    df = saved(in_parts.groupBy("term").agg(F.count("*").alias("df")), "item-df")
    for k in range(n):
        own = in_parts.where(F.col("part") == k).select("term").distinct().join(df, "term").select("term", "df").toPandas()
        terms = own["term"].to_numpy(np.int64).view(np.uint64)
        order = np.argsort(terms)
        statistics = Statistics(*map(int, total), terms[order], own["df"].to_numpy(np.int64)[order])
        yield Index([(r.item_id, r.text) for r in rows.where(F.col("part") == k).collect()], statistics)


def leaks(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, item_id, score, question_share, answer_share of every leak in every whole text of ``docs``.

    Null texts, and texts or items without words, leak nothing. Rows that repeat
    a doc_id, or an item_id, give rows of their own. Empty tables give no rows.
    Other columns play no part.
    """
    spark, schema = docs.sparkSession, "doc_id long, item_id long, score double, question_share double, answer_share double"
    rows, out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), spark.createDataFrame([], schema)
    for index in indexes(items):
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                for k in range(0, len(batch), 512):
                    part = batch.slice(k, 512)
                    ids = part.column(0).to_pylist()
                    found = index.leaks(part.column(1).to_pylist(), threshold)
                    columns = list(zip(*((ids[t], index.ids[i], s, q, a) for t, i, s, q, a in found), strict=True)) or [()] * 5
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if j < 2 else pa.float64()) for j, c in enumerate(columns)], ["doc_id", "item_id", "score", "question_share", "answer_share"])

        out = out.unionByName(rows.mapInArrow(run, schema))
    return out


def clean(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, with their columns, that leak no item. Null texts and texts without words stay, as do all
    rows if there are no items; rows that repeat stay or go together; an empty table gives no rows."""
    at = docs.columns.index("text")
    for index in indexes(items):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(0, len(batch), 512):
                    part = batch.slice(k, 512)
                    keep = np.ones(len(part), bool)
                    keep[[t for t, *_ in shared.value.leaks(part.column(at).to_pylist(), threshold)]] = False
                    yield part.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
