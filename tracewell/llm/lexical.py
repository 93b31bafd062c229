"""Ranked lexical search by MaxScore: documents ranked by whole-number BM25 for every item.

Texts are read once. A task cuts its documents into shards, inverted indexes of
the items' terms in files of the shared folder; statistics are sums over all
shards. Then tasks take shards one after another, and keep each item's best
documents so far. In a shard an item's terms stand in order of their upper
bounds. The lists of the first ones, the essential terms, are added up until
documents in none of them can't reach the score to beat. From there on only
documents whose score and the bounds still to come reach that score are probed
in the lists of the others.

Terms are told apart by 64-bit hashes.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import files
from .common import new_path, saved
from .words import slices, word_hashes

TOP = 10
#: per cent of the length norm that goes with a document's length
B = 75
#: documents and postings of a shard; shards that a task takes, which share the score to beat
SHARD_DOCS, SHARD_POSTINGS, TASK_SHARDS = 4096, 1 << 19, 8
#: bytes of item texts that are searched for at once; more items make more passes
ITEM_BYTES = 16 << 20
#: groups that partial lists of an item are merged in before the last merge
MERGES = 64


@dataclass
class Items:
    """Items with terms: their ids, and of item k the terms ``term[post[k]:post[k + 1]]``, places in ``hashes``, with their repeats."""

    ids: list[int | None]
    hashes: np.ndarray
    post: np.ndarray
    term: np.ndarray
    repeats: np.ndarray

    @classmethod
    def of(cls, rows: list[tuple[int | None, str | None]]) -> Items:
        rows = sorted(rows, key=lambda x: (x[0] is None, x[0] or 0, x[1] or ""))
        words, offsets = word_hashes([t for _, t in rows], ascii_only=True)
        counted = [np.unique(words[a:b], return_counts=True) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        hashes = np.unique(words)
        sizes = [len(t) for t, _ in counted]
        return cls([i for i, _ in rows], hashes, np.append(0, np.cumsum(sizes)), np.searchsorted(hashes, np.concatenate([t for t, _ in counted])) if rows else np.zeros(0, np.int64), np.concatenate([c for _, c in counted]) if rows else np.zeros(0, np.int64))

    def sieve(self) -> np.ndarray:
        out = np.zeros(1 << 20, bool)
        out[(self.hashes >> np.uint64(44)).astype(np.int64)] = True
        return out


class Shard:
    """Documents (ids, whether they have one, numbers of terms) and, of every term that they hold, documents and occurrences."""

    def __init__(self, arrays: list[np.ndarray]):
        self.ids, self.known, self.n, self.terms, self.ends, self.doc, self.tf = arrays

    @classmethod
    def of(cls, ids: list[int | None], n: np.ndarray, doc: np.ndarray, term: np.ndarray, tf: np.ndarray) -> Shard:
        order = np.lexsort((doc, term))
        term = term[order]
        begins = np.flatnonzero(np.diff(term, prepend=-1))
        ends = np.append(begins[1:], len(term)) if len(term) else begins
        return cls([np.array([i or 0 for i in ids], np.int64), np.array([i is not None for i in ids], np.int8), n.astype(np.int64), term[begins].astype(np.int32), ends.astype(np.int32), doc[order].astype(np.int32), tf[order].astype(np.int32)])

    KINDS = (np.int64, np.int8, np.int64, np.int32, np.int32, np.int32, np.int32)

    def write(self, path: str) -> None:
        arrays = [self.ids, self.known, self.n, self.terms, self.ends, self.doc, self.tf]
        files.write(path, [np.array([len(x) for x in arrays], np.int64).tobytes(), *(x.tobytes() for x in arrays)])

    @classmethod
    def read(cls, path: str) -> Shard:
        data, at, arrays = files.read(path), 8 * len(cls.KINDS), []
        for n, kind in zip(np.frombuffer(data, np.int64, len(cls.KINDS)), cls.KINDS, strict=True):
            arrays.append(np.frombuffer(data, kind, n, at))
            at += arrays[-1].nbytes
        return cls(arrays)


def length_norm(n: np.ndarray, docs: int, words: int) -> np.ndarray:
    """100 - B + (B * n * docs) div words."""
    if B * int(n.max(initial=0)) * docs < 2**63:
        return 100 - B + (B * n * docs) // words
    return np.array([100 - B + (B * int(x) * docs) // words for x in n], np.int64)


class Ranking:
    """The best documents of each item over the shards that ``add`` gets."""

    def __init__(self, items: Items, weights: np.ndarray, docs: int, words: int, top: int):
        self.items, self.weights, self.docs, self.words, self.top = items, weights, docs, words, top
        empty = np.zeros(0, np.int64)
        self.best = [(empty, empty, empty)] * len(items.ids)  # scores, 0 for an id or 1 for none, ids

    def add(self, shard: Shard) -> None:
        begins = np.append(0, shard.ends[:-1]).astype(np.int64)
        if not len(shard.terms):
            return
        tf = shard.tf.astype(np.int64)
        part = np.repeat(self.weights[shard.terms], shard.ends - begins) * (1_000_000_000 * tf // (1000 * tf + 8 * length_norm(shard.n, self.docs, self.words)[shard.doc]))
        most = np.maximum.reduceat(part, begins)
        place = np.full(len(self.items.hashes), -1)
        place[shard.terms] = np.arange(len(shard.terms))
        lists = [(shard.doc[a:b], part[a:b]) for a, b in zip(begins, shard.ends, strict=True)]
        for item, best in enumerate(self.best):
            own = slice(self.items.post[item], self.items.post[item + 1])
            at, repeats = place[self.items.term[own]], self.items.repeats[own]
            at, repeats = at[at >= 0], repeats[at >= 0]
            bound = most[at] * repeats
            order = np.argsort(-bound, kind="stable")
            found, scores = self._shard(lists, at[order], repeats[order], bound[order], int(best[0][-1]) if len(best[0]) == self.top else 1, len(shard.ids))
            if len(found):
                own_best = np.concatenate([best[0], scores]), np.concatenate([best[1], 1 - shard.known[found]]), np.concatenate([best[2], shard.ids[found]])
                kept = np.lexsort((own_best[2], own_best[1], -own_best[0]))[: self.top]
                self.best[item] = tuple(x[kept] for x in own_best)

    def _shard(self, lists: list, at: np.ndarray, repeats: np.ndarray, bound: np.ndarray, beat: int, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents that score ``beat`` or more and aren't below the best ``top`` of the shard, and their scores."""
        rest = np.append(np.cumsum(bound[::-1])[::-1], 0)
        score, j = np.zeros(size, np.int64), 0
        while j < len(at) and rest[j] >= beat:  # the essential terms
            docs, part = lists[at[j]]
            score[docs] += part * repeats[j]
            j += 1
            if size > self.top:
                beat = max(beat, int(np.partition(score, size - self.top)[size - self.top]))
        open_ = np.flatnonzero((score > 0) & (score + rest[j] >= beat))
        while j < len(at) and len(open_):
            docs, part = lists[at[j]]
            where = np.minimum(np.searchsorted(docs, open_), len(docs) - 1)
            hit = docs[where] == open_
            score[open_[hit]] += part[where[hit]] * repeats[j]
            j += 1
            own = score[open_]
            if len(own) > self.top:
                beat = max(beat, int(np.partition(own, len(own) - self.top)[len(own) - self.top]))
            open_ = open_[own + rest[j] >= beat]
        return open_, score[open_]


def indexed(docs: DataFrame, items: Items) -> DataFrame:
    """path, docs, words, terms, counts of every shard: its documents with terms, all their terms, and documents by the items' terms."""
    folder, schema = new_path(docs.sparkSession, "search-shards"), "path string, docs long, words long, terms array<int>, counts array<int>"
    shared = docs.sparkSession.sparkContext.broadcast(items.hashes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = shared.value
        sieve = Items([], hashes, *[np.zeros(0, np.int64)] * 3).sieve()
        ids: list[int | None] = []
        n, found, held = [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal ids, n, found, held
            doc, term, tf = (np.concatenate(x) for x in zip(*found, strict=True)) if found else [np.zeros(0, np.int64)] * 3
            shard = Shard.of(ids, np.array(n, np.int64), doc, term, tf)
            path = f"{folder}/{uuid.uuid4().hex}.shard"
            shard.write(path)
            counts = np.diff(shard.ends, prepend=0)
            ids, out = [], [pa.array([path]), pa.array([len(n)], pa.int64()), pa.array([sum(n)], pa.int64()), pa.array([shard.terms], pa.list_(pa.int32())), pa.array([counts.astype(np.int32)], pa.list_(pa.int32()))]
            n, found, held = [], [], 0
            return pa.RecordBatch.from_arrays(out, ["path", "docs", "words", "terms", "counts"])

        for batch in batches:
            for k in range(0, len(batch), 512):
                part = batch.slice(k, 512)
                own_ids, texts = part.column(0).to_pylist(), part.column(1).to_pylist()
                for a, b in slices(texts):
                    words, offsets = word_hashes(texts[a:b], ascii_only=True)
                    counts = np.diff(offsets)
                    maybe = np.flatnonzero(sieve[(words >> np.uint64(44)).astype(np.int64)])
                    term = np.searchsorted(hashes, words[maybe])
                    known = hashes[np.minimum(term, len(hashes) - 1)] == words[maybe] if len(hashes) else np.zeros(len(maybe), bool)
                    doc = np.searchsorted(offsets, maybe[known], "right") - 1
                    number = np.cumsum(counts > 0) - 1 + len(ids)  # of the documents with terms
                    key, tf = np.unique(number[doc] * len(hashes) + term[known], return_counts=True)
                    if len(key):
                        found.append((key // len(hashes), key % len(hashes), tf))
                    ids += [i for i, c in zip(own_ids[a:b], counts, strict=True) if c]
                    n += counts[counts > 0].tolist()
                    held += len(key)
                    if len(ids) >= SHARD_DOCS or held >= SHARD_POSTINGS:
                        yield flush()
        if ids:
            yield flush()

    return saved(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema), "search-names")


def _parts(items: DataFrame) -> Iterator[Items]:
    """The items, in parts whose texts fit ITEM_BYTES or so."""
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), "text")
    n = (rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // ITEM_BYTES + 1
    for k in range(n):
        own = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) if n > 1 else rows
        yield Items.of([(r.item_id, r.text) for r in own.collect()])


def _ranked(docs: DataFrame, items: Items, top: int) -> DataFrame:
    """item (its number), no_id, doc_id, score: each item's best."""
    shards = indexed(docs, items)
    total = shards.agg(F.count("*"), F.coalesce(F.sum("docs"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0))).first()
    zipped = shards.select(F.explode(F.arrays_zip("terms", "counts")).alias("x")).groupBy("x.terms").agg(F.sum("x.counts").alias("df"))
    weights = np.zeros(len(items.hashes), np.int64)
    for term, df in zipped.collect():  # one row for each of the items' terms
        weights[term] = math.floor(1000 * math.log((2 * total[1] + 2) / (2 * df + 1)))
    shared = docs.sparkSession.sparkContext.broadcast((items, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Ranking(*shared.value, total[1], total[2], top)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                own.add(Shard.read(path))
        number = np.repeat(np.arange(len(own.best)), [len(s) for s, _, _ in own.best])
        scores, no_id, ids = (np.concatenate([x[k] for x in own.best]) if own.best else np.zeros(0, np.int64) for k in range(3))
        yield pa.RecordBatch.from_arrays([pa.array(number), pa.array(no_id, pa.int64()), pa.array(ids, mask=no_id > 0), pa.array(scores)], ["item", "no_id", "doc_id", "score"])

    parts = shards.select("path").repartition(total[0] // TASK_SHARDS + 1).mapInArrow(run, "item long, no_id long, doc_id long, score long")
    order = [F.desc("score"), "no_id", "doc_id"]
    best = parts.withColumn("part", F.pmod(F.xxhash64("doc_id", "score"), F.lit(MERGES)))
    for keys in (["item", "part"], ["item"]):
        best = best.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= top)
    return best.select("item", "rank", "doc_id", "score")


def ranked(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: each item's ``top`` documents of highest score above 0.

    Scores are sums over the item's terms, repeats included, of whole-number BM25
    parts, by statistics of all documents with terms. Equal scores go by ascending
    doc_id, rows without doc_id last. Null texts, and texts or items without
    terms, have no rows. Rows that repeat a doc_id are documents of their own, rows
    that repeat an item_id items of their own. Empty tables give no rows. Other
    columns play no part.
    """
    out = docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for part in _parts(items):
        names = docs.sparkSession.createDataFrame(list(enumerate(part.ids)), "item long, item_id long")
        out = out.unionByName(_ranked(docs, part, top).join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))
    return out
