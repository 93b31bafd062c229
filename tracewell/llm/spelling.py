"""Spelling variants: words at edit distance one, found by walking a compact trie.

The corpus' words are counted in whole texts. The sorted words are cut into
shards of bounded size, each written as a trie to the shared folder. A task holds
a block of words and takes every shard in turn: the distance-one Levenshtein
automata of the block's words walk the trie together, depth first, a frontier of
(word, node, letters read, edits) at a time; a frontier that grows too large is
cut in two. Edits are taken in one form only (a letter is inserted or deleted at
the end of a run of equal letters), so an accepting path speaks for one neighbour
and none is met twice. What a task keeps of a word is the number of its
neighbours and the best of them, so no pair is ever written.

A shard whose words share a prefix that no word of the block comes within one
edit of is skipped unread.
"""

from __future__ import annotations

import io
import re
import uuid
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import files
from .common import discard, new_path, saved

LEAST_LETTERS, LEAST_COUNT = 5, 3
DROP = 97
#: words of a shard, words of a task's block, and letters (words times longest) of either at once
SHARD_WORDS, BLOCK_WORDS, CELLS = 1 << 17, 1 << 14, 1 << 24
FRONTIER = 1 << 18
PIECE = 1 << 20
#: distinct words that a task holds while it counts
HELD = 1 << 18

RUN = re.compile(rb"[a-z\xc0-\xff]{%d,}" % LEAST_LETTERS)
LETTERS = re.compile(rb"[a-z\xc0-\xff]*")


def runs(text: str | None) -> Iterator[dict[bytes, int]]:
    """How often each run of at least LEAST_LETTERS letters stands in a piece of the text, pieces one after another.

    Runs are Latin-1, one byte a letter; a piece ends where a run does.
    """
    data = (text or "").encode("latin-1", "replace").lower()  # of bytes, only A-Z change
    begin = 0
    while begin < len(data):
        end = LETTERS.match(data, begin + PIECE).end() if begin + PIECE < len(data) else len(data)
        yield Counter(RUN.findall(data, begin, end))
        begin = end


def dropped(run: bytes, base: int | None) -> bytes:
    """The run, less a letter where the checksum of document and run says so; ``base`` is the checksum of ``<doc_id>:``."""
    if base is not None:
        h = crc32(run if run.isascii() else run.decode("latin-1").encode(), base)
        if h % DROP == 0:
            k = h % len(run)
            return run[:k] + run[k + 1 :]
    return run


def counted(docs: DataFrame) -> DataFrame:
    """word, n: the words of all whole texts and their occurrences."""

    def table(counts: dict[bytes, int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[bytes, int] = {}
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                base = None if doc_id is None else crc32(f"{doc_id}:".encode())
                for piece in runs(text.as_py()):
                    for word, n in piece.items():
                        word = dropped(word, base)
                        if len(word) >= LEAST_LETTERS:
                            counts[word] = counts.get(word, 0) + n
                    if len(counts) >= HELD:
                        yield table(counts)
                        counts = {}
        if counts:
            yield table(counts)

    parts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def matrix(words: list[bytes]) -> np.ndarray:
    """A row of letters for each word, zeros after its end and at least one."""
    width = max(map(len, words)) + 1
    return np.array(words, f"S{width}").view(np.uint8).reshape(len(words), width)


class Trie:
    """Sorted distinct words as a trie in flat arrays, level after level.

    ``keys`` has 256 * parent + letter of every node but the root, in order; the
    node of ``keys[k]`` is k + 1. ``first`` has the place in ``keys`` of each
    node's first child, ``word`` the number of the word that ends at a node, or -1.
    """

    def __init__(self, words: list[bytes], n: np.ndarray):
        letters = matrix(words)
        lengths = np.array(list(map(len, words)))
        same = letters[1:] == letters[:-1]
        shared = np.append(0, np.where(same.all(1), letters.shape[1], same.argmin(1))) if len(words) > 1 else np.zeros(1, np.int64)
        self.letters, self.n = letters, n
        keys, word, level, base = [], [np.full(1, -1)], np.zeros(1, np.int64), 0
        alive = np.arange(len(words))
        for depth in range(int(lengths.max())):
            alive = alive[lengths[alive] > depth]
            new = alive[shared[alive] <= depth]  # the first words of their prefixes of one letter more
            parent = base + np.searchsorted(level, new, "right") - 1
            keys.append(parent * 256 + letters[new, depth])
            word.append(np.where(lengths[new] == depth + 1, new, -1))
            base, level = base + len(level), new
        self.keys = np.concatenate(keys)
        self.word = np.concatenate(word)
        self.first = np.searchsorted(self.keys, np.arange(len(self.word) + 1) * 256)

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, letters=self.letters, n=self.n, keys=self.keys, word=self.word.astype(np.int32), first=self.first.astype(np.int32))
        return out.getvalue()

    @classmethod
    def load(cls, path: str) -> Trie:
        held, out = np.load(io.BytesIO(files.read(path))), cls.__new__(cls)
        out.letters, out.n, out.keys, out.word, out.first = (held[x] for x in ("letters", "n", "keys", "word", "first"))
        return out

    def near(self, letters: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rows of ``letters`` and numbers of the trie's words one edit away from them, each pair once."""
        start = np.arange(len(letters))
        stack = [(start, np.zeros(len(start), np.int64), np.zeros(len(start), np.int64), np.zeros(len(start), bool))]
        while stack:
            who, node, at, edited = stack.pop()
            if len(who) > FRONTIER:
                half = len(who) // 2
                stack += [(who[half:], node[half:], at[half:], edited[half:]), (who[:half], node[:half], at[:half], edited[:half])]
                continue
            # with the edit spent, the rest of the word has to follow
            w, v, p = who[edited], node[edited], at[edited]
            letter = letters[w, p]
            ended = letter == 0
            hit = self.word[v[ended]]
            if (hit >= 0).any():
                yield w[ended][hit >= 0], hit[hit >= 0]
            w, v, p, letter = w[~ended], v[~ended], p[~ended], letter[~ended]
            child = np.searchsorted(self.keys, v * 256 + letter)
            ok = self.keys[np.minimum(child, len(self.keys) - 1)] == v * 256 + letter
            out = [(w[ok], child[ok] + 1, p[ok] + 1, np.ones(ok.sum(), bool))]
            # with the edit at hand
            w, v, p = who[~edited], node[~edited], at[~edited]
            letter = letters[w, p]
            if len(w):
                last = (letter != 0) & (letter != letters[w, np.minimum(p + 1, letters.shape[1] - 1)])
                out.append((w[last], v[last], p[last] + 1, np.ones(last.sum(), bool)))  # a deletion
                fan = self.first[v + 1] - self.first[v]
                ends = np.cumsum(fan)
                key = np.arange(ends[-1]) + np.repeat(self.first[v] - (ends - fan), fan)
                w, p, letter = np.repeat(w, fan), np.repeat(p, fan), np.repeat(letter, fan)
                same = (self.keys[key] & 255) == letter
                key = key + 1
                other = ~same & (letter != 0)
                out.append((w[~same], key[~same], p[~same], np.ones((~same).sum(), bool)))  # an insertion
                out.append((w[other], key[other], p[other] + 1, np.ones(other.sum(), bool)))  # a replacement
                out.append((w[same], key[same], p[same] + 1, np.zeros(same.sum(), bool)))
            step = tuple(np.concatenate(x) for x in zip(*out, strict=True))
            if len(step[0]):
                stack.append(step)


def reachable(letters: np.ndarray, prefix: bytes) -> bool:
    """Whether one edit at most brings some row to begin with the prefix."""
    q = len(prefix)
    if not q:
        return True
    rows = np.zeros((len(letters), q + 1), np.uint8)
    rows[:, : min(q + 1, letters.shape[1])] = letters[:, : q + 1]
    p = np.frombuffer(prefix, np.uint8)
    differ = rows[:, :q] != p
    at = np.where(differ.any(1), differ.argmax(1), q)
    if (at == q).any():
        return True
    after = np.arange(q)[None, :] > at[:, None]
    replaced = ~(differ & after).any(1)
    inserted = ~((np.pad(rows[:, : q - 1], ((0, 0), (1, 0))) != p) & after).any(1)
    deleted = ~((rows[:, 1:] != p) & (after | (np.arange(q)[None, :] == at[:, None]))).any(1)
    return bool((replaced | inserted | deleted).any())


def _cuts(words: list[bytes], most: int) -> Iterator[tuple[int, int]]:
    """(first, last) of runs of at most ``most`` words and CELLS letters."""
    first, longest = 0, 0
    for k, w in enumerate(words):
        longest = max(longest, len(w))
        if k > first and (k - first >= most or (k - first + 1) * (longest + 1) > CELLS):
            yield first, k
            first, longest = k, len(w)
    if len(words) > first:
        yield first, len(words)


def _columns(batches: Iterator[pa.RecordBatch]) -> tuple[list[bytes], np.ndarray]:
    words, n = [], [np.zeros(0, np.int64)]
    for batch in batches:
        words += [w.encode("latin-1") for w in batch.column(0).to_pylist()]
        n.append(batch.column(1).to_numpy())
    return words, np.concatenate(n)


def shards(vocabulary: DataFrame, rows: int) -> list[tuple[str, bytes]]:
    """Path and common prefix of each shard; a name for each SHARD_WORDS words or so comes to the driver."""
    folder = new_path(vocabulary.sparkSession, "tries")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, n = _columns(batches)
        for a, b in _cuts(words, SHARD_WORDS):
            path, lo, hi = f"{folder}/{uuid.uuid4().hex}.trie", words[a], words[b - 1]
            files.write(path, [Trie(words[a:b], n[a:b]).dump()])
            k = next((k for k, (x, y) in enumerate(zip(lo, hi)) if x != y), min(len(lo), len(hi)))
            yield pa.RecordBatch.from_pydict({"path": [path], "prefix": [lo[:k]]}, pa.schema([("path", pa.string()), ("prefix", pa.binary())]))

    ordered = vocabulary.repartitionByRange(rows // SHARD_WORDS + 1, "word").sortWithinPartitions("word")
    return [(r.path, bytes(r.prefix)) for r in saved(ordered.mapInArrow(run, "path string, prefix binary"), "trie-names").orderBy("path").collect()]


def neighbours(vocabulary: DataFrame) -> DataFrame:
    """word, n, n_near, best, best_n: how many words of ``vocabulary`` (word, n) are one edit away, and the one of them
    of largest n, the first in code-point order of equals; null if there is none."""
    rows = vocabulary.count()
    tries = shards(vocabulary, rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, n = _columns(batches)
        parts = [(a, matrix(words[a:b])) for a, b in _cuts(words, BLOCK_WORDS)]
        near, best_n, best = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), np.full(len(words), b"", object)
        for path, prefix in tries:
            wanted = [(a, letters) for a, letters in parts if reachable(letters, prefix)]
            if not wanted:
                continue
            trie = Trie.load(path)
            for a, letters in wanted:
                top_n, top = np.zeros(len(letters), np.int64), np.full(len(letters), len(trie.n))
                for w, x in trie.near(letters):
                    near[a : a + len(letters)] += np.bincount(w, minlength=len(letters))
                    order = np.lexsort((x, -trie.n[x], w))
                    w, x = w[order], x[order]
                    first = np.flatnonzero(np.diff(w, prepend=-1))
                    w, x = w[first], x[first]
                    better = (trie.n[x] > top_n[w]) | ((trie.n[x] == top_n[w]) & (x < top[w]))
                    top_n[w[better]], top[w[better]] = trie.n[x[better]], x[better]
                for w in np.flatnonzero(top_n):
                    word = trie.letters[top[w]].tobytes().rstrip(b"\x00")
                    if top_n[w] > best_n[a + w] or top_n[w] == best_n[a + w] and word < best[a + w]:
                        best_n[a + w], best[a + w] = top_n[w], word
        found = best_n > 0
        if len(words):
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([w.decode("latin-1") for w in words], pa.string()),
                    pa.array(n),
                    pa.array(near),
                    pa.array([w.decode("latin-1") if ok else None for w, ok in zip(best, found, strict=True)], pa.string()),
                    pa.array(best_n, mask=~found),
                ],
                ["word", "n", "n_near", "best", "best_n"],
            )

    blocks = vocabulary.repartitionByRange(rows // BLOCK_WORDS + 1, "word").sortWithinPartitions("word")
    return blocks.mapInArrow(run, "word string, n long, n_near long, best string, best_n long")


def rooted(links: DataFrame) -> DataFrame:
    """word and root of every row of ``links`` (word, form): the end of the chain of forms.

    Pointers double in a round, and n doubles at least with each form of a chain, so
    seven rounds follow any chain.
    """
    tops = saved(links.select("word", F.col("form").alias("root")), "spell-roots")
    while True:
        hop = tops.select(F.col("word").alias("root"), F.col("root").alias("far"))
        moved = saved(tops.join(hop, "root", "left").select("word", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved")), "spell-roots")
        discard(tops)
        tops = moved
        if not tops.where("moved").take(1):
            return tops.select("word", "root")


def variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of ``docs``.

    Words are the lower-cased (A-Z only) maximal runs of A-Z, a-z and U+00C0 to
    U+00FF of the whole texts, where one run in DROP of a document loses a letter,
    with at least LEAST_LETTERS letters and LEAST_COUNT occurrences. ``form`` is the
    near word of largest n, ties to the first in code-point order, if its n is twice
    the word's or more; ``root`` ends the chain of forms and is the word itself if
    it has none. Null and empty texts have no words. Runs of a row without doc_id
    lose no letter. Repeated rows count as often as they stand. An empty table
    gives no rows. Other columns play no part.
    """
    vocabulary = saved(counted(docs), "spell-words")
    formed = F.col("best_n") >= 2 * F.col("n")
    near = neighbours(vocabulary).withColumn("form", F.when(formed, F.col("best"))).withColumn("form_n", F.when(formed, F.col("best_n")))
    near = saved(near.select("word", "form", "n", "n_near", "form_n"), "spell-near")
    roots = rooted(near.where("form is not null"))
    return near.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
