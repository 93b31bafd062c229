"""Near-duplicates by order MinHash: a component of a text's sketch takes the few
occurrence-labelled word shingles of least hash and keeps them in text order, so
that equal components speak for a small edit distance, not only for shared sets.
Pairs that share a component are aligned, and are linked if their edit
similarity, 1 - distance / words of the longer text, reaches the threshold.

Texts with the same words form a class at once, and one representative stands
for them from there on. Texts that share a component form a bucket, whose leader
is its least id. First every text is aligned with the one leader that it meets in
most buckets. Then the texts of all buckets of one class of leaders, and of the
leaders that meet those, are one group, which a text enters once however many
buckets a common passage puts it in. A group that still holds several classes is
cut by length and then into blocks of bounded size, and where two blocks meet,
the task that holds them aligns what a bound on shared words leaves, until the
classes stand: it gives a forest of links, so no group emits its pairs, no large
group meets in one task, and no link between classes is lost.
"""

from __future__ import annotations

import hashlib
from collections.abc import Generator, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, saved
from .words import mix64, slices, word_hashes

#: Five-word shingles and, for edits spread so evenly that they leave none whole, as many components of three-word ones.
SHINGLE, SHORTER = 5, 3
COMPONENTS = 40
KEPT = 2
#: Texts of up to SHORT words have so few shingles that an edit may leave too few; they take components of two single words besides.
SHORT = 64
SHORT_COMPONENTS = 16
SHORT_KEPT = 2
SIMILARITY = 0.8
#: texts and words of a block, texts that are bounded at once, and texts that meet a copy of their leader
BLOCK, BLOCK_WORDS = 4096, 1 << 21
TILE = 512
STAR = 1024
BINS = 1024
_SEEDS = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def shingle_hashes(words: np.ndarray, shingle: int = SHINGLE) -> np.ndarray:
    """Hashes of the shingles, each with the number of its earlier occurrences."""
    n = min(shingle, len(words))
    h = np.full(len(words) - n + 1, n, np.uint64)
    for j in range(n):
        h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + words[j : len(words) - n + 1 + j])
    order = np.argsort(h, kind="stable")
    run = h[order]
    begins = np.flatnonzero(np.diff(run, prepend=~run[:1]) != 0)
    occurrence = np.empty(len(h), np.uint64)
    occurrence[order] = np.arange(len(h)) - np.repeat(begins, np.diff(np.append(begins, len(h))))
    return mix64(h + occurrence * np.uint64(0xD1B54A32D192ED03))


def sketch(words: np.ndarray, components: int = COMPONENTS, kept: int = KEPT, shingle: int = SHINGLE, first: int = 0) -> np.ndarray:
    """A hash for each component, the seeds taken from ``first`` on; texts of fewer shingles than ``kept`` take all of theirs."""
    h = shingle_hashes(words, shingle)
    value = _SEEDS[first : first + components].copy()
    if len(h) <= kept:
        for one in h:
            value = mix64(value * np.uint64(3) + one)
        return value
    high, flip = (h >> np.uint64(32)).astype(np.uint32), (value >> np.uint64(32)).astype(np.uint32)
    factor = value.astype(np.uint32) | np.uint32(1)
    places = np.empty((components, kept), np.int64)
    at_once = max(1, 131_072 // len(h))
    for k in range(0, components, at_once):
        part = slice(k, k + at_once)
        order = high[None, :] ^ flip[part, None]
        order *= factor[part, None]
        rows = np.arange(len(order))
        for j in range(kept):
            places[part, j] = least = order.argmin(1)
            order[rows, least] = np.uint32(0xFFFFFFFF)
    places.sort(axis=1)  # text order
    for column in h[places].T:
        value = mix64(value * np.uint64(3) + column)
    return value


def full_sketch(words: np.ndarray, components: int = COMPONENTS, kept: int = KEPT) -> np.ndarray:
    """Components of five-word shingles, of three-word ones, and for short texts those of single words."""
    out = [sketch(words, components, kept), sketch(words, components, kept, SHORTER, components)]
    if len(words) <= SHORT:
        out.append(sketch(words, SHORT_COMPONENTS, SHORT_KEPT, 1, 2 * components))
    return np.concatenate(out)


def distance(a: np.ndarray, b: np.ndarray, most: int) -> int:
    """Edit distance of two arrays by alignment within a band; ``most`` + 1 if it is more than ``most``."""
    return int(distances([(a, b)], [most])[0])


def _trimmed(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    k = int(differ[0]) if len(differ) else n
    a, b = a[k:], b[k:]
    n = min(len(a), len(b))
    if n:
        differ = np.flatnonzero(a[::-1][:n] != b[::-1][:n])
        k = int(differ[0]) if len(differ) else n
        a, b = a[: len(a) - k], b[: len(b) - k]
    return a, b


def _banded(pairs: list[tuple[np.ndarray, np.ndarray]], band: int, limits: np.ndarray) -> np.ndarray:
    """Least cost of an alignment that stays within ``band`` of the diagonal, for many pairs at once; the true distance if
    that is at most ``band``. A pair is given up, as very far, once every alignment of its first words costs more than its limit."""
    rows, width = max(len(a) for a, _ in pairs), 2 * band + 1
    n = len(pairs)
    columns = max(rows, *(len(b) for _, b in pairs)) + width + 1
    left, right = np.zeros((n, rows), pairs[0][0].dtype), np.zeros((n, columns), pairs[0][0].dtype)
    a_len, b_len = np.array([len(a) for a, _ in pairs]), np.array([len(b) for _, b in pairs])
    used = np.zeros((n, columns), bool)
    for k, (a, b) in enumerate(pairs):
        left[k, : len(a)] = a
        right[k, band : band + len(b)] = b
        used[k, band : band + len(b)] = True
    far = np.int32(1 << 28)
    ramp = np.arange(width, dtype=np.int32)
    at = ramp - band
    cost = np.where(at >= 0, at, far).astype(np.int32)[None, :].repeat(n, 0)  # row 0: column j costs j
    cost[at[None, :] > b_len[:, None]] = far
    out = np.full(n, far, np.int32)
    done = a_len == 0
    out[done] = cost[done, np.clip(b_len[done] + band, 0, width - 1)]
    who = np.arange(n)
    for i in range(1, rows + 1):
        if i % 16 == 0:
            alive = (a_len >= i) & (cost.min(1) <= limits)
            if not alive.any():
                break
            if alive.mean() < 0.7:
                left, right, used, cost, a_len, b_len, who, limits = (v[alive] for v in (left, right, used, cost, a_len, b_len, who, limits))
        # column j = i + d - band of b; d is the place in the band
        same = (right[:, i - 1 : i - 1 + width] == left[:, i - 1 : i]) & used[:, i - 1 : i - 1 + width]
        step = cost + np.where(same, np.int32(0), np.int32(1))
        step[~used[:, i - 1 : i - 1 + width]] = far
        up = np.full_like(cost, far)
        up[:, :-1] = cost[:, 1:] + np.int32(1)
        cost = np.minimum(step, up)
        column = i + at
        if i <= band:
            cost[:, band - i] = i  # column 0
            cost[:, : band - i] = far
        cost[column[None, :] > b_len[:, None]] = far
        cost = np.minimum.accumulate(cost - ramp, axis=1) + ramp
        cost[column[None, :] > b_len[:, None]] = far
        ended = a_len == i
        if ended.any():
            place = b_len[ended] - i + band
            ok = (place >= 0) & (place < width)
            out[who[np.flatnonzero(ended)[ok]]] = cost[ended][np.flatnonzero(ok), place[ok]]
    return out


def distances(pairs: list[tuple[np.ndarray, np.ndarray]], most: list[int]) -> np.ndarray:
    """distance() of many pairs. Bands widen from 8 until they hold the distance or reach ``most``."""
    out = np.array([m + 1 for m in most], np.int64)
    open_: list[tuple[int, np.ndarray, np.ndarray]] = []
    for k, (a, b) in enumerate(pairs):
        if abs(len(a) - len(b)) > most[k]:
            continue
        a, b = _trimmed(a, b)
        if not len(a) or not len(b):
            out[k] = min(len(a) + len(b), most[k] + 1)
        elif common_words(a, b) >= max(len(a), len(b)) - most[k]:
            open_.append((k, a, b))
    band = 8
    while open_:
        open_.sort(key=lambda x: len(x[1]))
        rest = []
        first = 0
        while first < len(open_):
            last, cells = first + 1, 0
            while last < len(open_) and (last + 1 - first) * (len(open_[last][1]) + 4 * band) <= 1_500_000 and last - first < 512:
                last += 1
            group = open_[first:last]
            # a band that holds every cell needs no widening
            own = min(band, max(max(len(a), len(b)) for _, a, b in group), max(most[k] for k, _, _ in group))
            limits = np.array([min(own, most[k]) if own < max(len(a), len(b)) else most[k] for k, a, b in group])
            found = _banded([(a, b) for _, a, b in group], own, limits)
            for (k, a, b), d in zip(group, found, strict=True):
                if d <= own or own >= most[k] or own >= max(len(a), len(b)):
                    out[k] = min(int(d), most[k] + 1)
                else:
                    rest.append((k, a, b))
            first = last
        open_, band = rest, band * 4
    return out


def common_words(a: np.ndarray, b: np.ndarray) -> int:
    """How many words, with repeats, two texts share in any order: an alignment matches no more."""
    x, n = np.unique(a, return_counts=True)
    y, m = np.unique(b, return_counts=True)
    at = np.searchsorted(x, y)
    hit = x[np.minimum(at, len(x) - 1)] == y
    return int(np.minimum(n[at[hit]], m[hit]).sum())


def histogram(words: np.ndarray) -> np.ndarray:
    """How many words fall in each bin, up to 255: the sum of two texts' lesser counts, and the lesser number of words that full bins
    left out, bound the words they share."""
    return np.minimum(np.bincount(words >> np.uint32(22), minlength=BINS), 255).astype(np.uint8)


def may_be_alike(a: np.ndarray, a_sizes: np.ndarray, b: np.ndarray, b_sizes: np.ndarray, similarity: float, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in a and b of the pairs ``asked`` for (a matrix of booleans) whose texts, given by histograms and numbers of words, can be
    alike; full bins bound nothing.

    A text shares at most the words that fall in bins which the other has too, a
    matrix product for all pairs at once; for the pairs that this leaves, the
    lesser counts of all bins are added up.
    """
    most = np.maximum(a_sizes[:, None], b_sizes[None, :])
    need = similarity * most - 1e-6 * most
    ok = asked & (np.minimum(a_sizes[:, None], b_sizes[None, :]) >= need)
    if not ok.any():
        return np.nonzero(ok)
    af, bf = a.astype(np.float32), b.astype(np.float32)
    a_over, b_over = a_sizes - a.sum(1, dtype=np.int64), b_sizes - b.sum(1, dtype=np.int64)  # words that full bins don't count
    need -= np.minimum(a_over[:, None], b_over[None, :])
    ok &= af @ (bf > 0).astype(np.float32).T >= need
    ok &= (af > 0).astype(np.float32) @ bf.T >= need
    i, j = np.nonzero(ok)
    kept = np.empty(len(i), bool)
    for k in range(0, len(i), 4096):
        x, y = i[k : k + 4096], j[k : k + 4096]
        kept[k : k + 4096] = np.minimum(a[x], b[y]).sum(1, dtype=np.int64) >= need[x, y]
    return i[kept], j[kept]


def allowed(a: int, b: int, similarity: float) -> int:
    """The most edits that two texts of a and b words may differ by."""
    return int(np.floor((1 - similarity) * max(a, b) + 1e-9))


def alike(pairs: list[tuple[np.ndarray, np.ndarray]], similarity: float) -> np.ndarray:
    most = [allowed(len(a), len(b), similarity) for a, b in pairs]
    return distances(pairs, most) <= np.array(most) if pairs else np.zeros(0, bool)


def sketched(docs: DataFrame, components: int, kept: int) -> DataFrame:
    """doc_id, tie (a hash of the text), same (a hash of all words, or of a wordless text), key (its first eight bytes), n words, sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, len(batch), 512):
                part = batch.slice(k, 512)
                texts = [t or "" for t in part.column(2).to_pylist()]
                same, counts, sketches = [], [], []
                for a, b in slices(texts):
                    words, offsets = word_hashes(texts[a:b])
                    for t in range(b - a):
                        own = words[offsets[t] : offsets[t + 1]]
                        data = own.tobytes() if len(own) else b"-" + texts[a + t].encode("utf-8", "surrogatepass")
                        same.append(hashlib.blake2b(data, digest_size=16).digest())
                        counts.append(len(own))
                        sketches.append(full_sketch(own, components, kept).view(np.int64) if len(own) else None)
                keys = np.array([int.from_bytes(x[:8], "little", signed=True) for x in same], np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(same, pa.binary()), pa.array(keys), pa.array(counts, pa.int64()), pa.array(sketches, pa.list_(pa.int64()))], ["doc_id", "tie", "same", "key", "n", "sketch"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tie"), "text")
    return rows.mapInArrow(run, "doc_id long, tie long, same binary, key long, n long, sketch array<long>")


Pairs = list[tuple[np.ndarray, np.ndarray]]


def forest(roots: np.ndarray, words: list[np.ndarray], x: np.ndarray, y: np.ndarray, asked, similarity: float) -> Generator[Pairs, np.ndarray, list[tuple[int, int]]]:
    """Links between the texts x and y (places) that join their classes, a forest over the classes given by ``roots``.

    A generator: it gives pairs of texts and is sent which of them are alike, so
    that pairs of many cells are aligned at once; the links are what it returns. ``asked`` says of a matrix of places in x and y which pairs are to be looked
    at. Of two classes one pair is aligned, then two more, then four, until one is
    alike or all are through; pairs whose classes have met meanwhile are left out.
    """
    sizes = np.array([len(w) for w in words])
    bins = np.stack([histogram(w) for w in words])
    names, top = np.unique(roots, return_inverse=True)
    parent = np.arange(len(names))

    def found(k: np.ndarray) -> np.ndarray:
        while True:
            up = parent[k]
            if (up == k).all():
                return k
            k = up

    out = []
    for k in range(0, len(x), TILE):
        for m in range(0, len(y), TILE):
            u, v = x[k : k + TILE], y[m : m + TILE]
            apart = found(top[u])[:, None] != found(top[v])[None, :]
            i, j = may_be_alike(bins[u], sizes[u], bins[v], sizes[v], similarity, apart & asked(u, v))
            i, j, most = u[i], v[j], 1
            while len(i):
                p, q = found(top[i]), found(top[j])
                lo, hi = np.minimum(p, q), np.maximum(p, q)
                open_ = lo != hi
                i, j, lo, hi = i[open_], j[open_], lo[open_], hi[open_]
                if not len(i):
                    break
                order = np.lexsort((hi, lo))
                key = lo[order] * len(names) + hi[order]
                first = np.flatnonzero(np.diff(key, prepend=-1))
                place = np.empty(len(key), np.int64)
                place[order] = np.arange(len(key)) - np.repeat(first, np.diff(np.append(first, len(key))))
                now = place < most
                ok = yield [(words[a], words[b]) for a, b in zip(i[now], j[now], strict=True)]
                for a, b in zip(i[now][ok].tolist(), j[now][ok].tolist(), strict=True):
                    p, q = (int(found(top[[c]])[0]) for c in (a, b))
                    if p != q:
                        parent[max(p, q)] = min(p, q)
                        out.append((a, b))
                i, j, most = i[~now], j[~now], 2 * most
    return out


def side_by_side(forests: list[Generator[Pairs, np.ndarray, list[tuple[int, int]]]], similarity: float) -> list[list[tuple[int, int]]]:
    """What each of the forests returns: in a round the pairs that all of them ask for are aligned together."""
    out: list[list[tuple[int, int]]] = [[] for _ in forests]
    open_: list[tuple[int, np.ndarray | None]] = [(k, None) for k in range(len(forests))]
    while open_:
        asked = []
        for k, ok in open_:
            try:
                asked.append((k, forests[k].send(ok)))
            except StopIteration as e:
                out[k] = e.value
        answers = np.split(alike([p for _, pairs in asked for p in pairs], similarity), np.cumsum([len(pairs) for _, pairs in asked])[:-1]) if asked else []
        open_ = [(k, ok) for (k, _), ok in zip(asked, answers, strict=True)]
    return out


#: of a row of a cell: g, win, a, b name the cell; side 0 meets side 1, side 2 its own kind
CELL = ["g", "win", "a", "b"]


def met_in_cells(rows: DataFrame, tokens: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) that join the classes of the rows (CELL, side, cut, id, root) of each cell; rows longer than the
    cell's ``win`` by a cut or more don't meet each other, as they do in the next window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, begins in _by_cell(batches, CELL):
            table = table.combine_chunks()
            win, side, cut, ids, roots = (table.column(c).to_numpy() for c in ("win", "side", "cut", "id", "root"))
            words = [np.frombuffer(w, np.uint32) for w in table.column("words").to_pylist()]
            forests, starts = [], []
            for start, end in zip(begins, np.append(begins[1:], len(ids)), strict=True):
                if (roots[start:end] == roots[start]).all():
                    continue
                whole, later = side[start:end], cut[start:end] > win[start]
                alone = bool((whole == 2).all())

                def asked(u: np.ndarray, v: np.ndarray, later=later, alone=alone) -> np.ndarray:
                    ok = ~(later[u][:, None] & later[v][None, :])
                    return ok & (u[:, None] < v[None, :]) if alone else ok

                forests.append(forest(roots[start:end], words[start:end], np.flatnonzero(whole != 1), np.flatnonzero(whole != 0), asked, similarity))
                starts.append(start)
            out = [(ids[start + a], ids[start + b]) for start, links in zip(starts, side_by_side(forests, similarity), strict=True) for a, b in links]
            if out:
                a, b = np.array(out, np.int64).T
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    rows = saved(rows, "dup-cells")
    dealt = rows.join(tokens, "id").repartition(rows.count() // 512 + 1, *CELL).sortWithinPartitions(*CELL)  # small rows, but much work for each
    links = saved(dealt.mapInArrow(run, "a long, b long").distinct(), "dup-links")
    discard(rows)
    return links


def components(links: DataFrame) -> DataFrame:
    """id and root (the least id of its component) of every id in ``links`` (a, b).

    In a round every id points to its least neighbour if that is less, pointers
    are followed to their ends, and only the edges between ends go on: at least
    half of the ids that have edges go with each round.
    """
    both = lambda e: e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = saved(both(links.select("a", "b")).where("a <> b").distinct(), "dup-edges")
    labels = None
    while True:
        tops = saved(edges.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("root")).withColumnRenamed("a", "id"), "dup-labels")
        while True:
            hop = tops.select(F.col("id").alias("root"), F.col("root").alias("far"))
            moved = saved(tops.join(hop, "root").select("id", F.col("far").alias("root"), (F.col("far") < F.col("root")).alias("moved")), "dup-labels")
            discard(tops)
            tops = moved
            if not moved.where("moved").take(1):
                break
        if labels is None:
            labels = tops
        else:
            above = tops.select(F.col("id").alias("root"), F.col("root").alias("top"))
            older, labels = labels, saved(labels.join(above, "root", "left").select("id", F.coalesce("top", "root").alias("root")), "dup-labels")
            discard(older)
        ends = tops.select(F.col("id").alias("a"), F.col("root").alias("a_top")), tops.select(F.col("id").alias("b"), F.col("root").alias("b_top"))
        rest = edges.where("a < b").join(ends[0], "a").join(ends[1], "b").where("a_top <> b_top").select(F.col("a_top").alias("a"), F.col("b_top").alias("b"))
        older, edges = edges, saved(both(rest).distinct(), "dup-edges")
        discard(older)
        if not edges.take(1):
            discard(edges)
            return labels.select("id", "root")


def _extended(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (id, root) after more links: only the edges between roots are worked on."""
    ends = [labels.select(F.col("id").alias(x), F.col("root").alias(f"{x}_root")) for x in "ab"]
    rooted = links.join(ends[0], "a", "left").join(ends[1], "b", "left")
    edges = saved(rooted.select(F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b")).where("a <> b").distinct(), "dup-edges")
    if not edges.take(1):
        return labels
    tops = components(edges)
    above = tops.select(F.col("id").alias("root"), F.col("root").alias("top"))
    moved = labels.join(above, "root", "left").select("id", F.coalesce("top", "root").alias("root"))
    return saved(moved.unionByName(tops.join(labels, "id", "left_anti").select("id", "root")), "dup-labels")


def classes(docs: DataFrame, similarity: float = SIMILARITY, components_: int = COMPONENTS, kept: int = KEPT) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, tie, same) and classes of their words (same, root, class_id, class_size, n_links)."""
    if 2 * components_ + SHORT_COMPONENTS > len(_SEEDS):
        raise ValueError(f"a sketch has at most {len(_SEEDS)} components")
    rows = saved(sketched(docs, components_, kept), "dup-sketches")
    # one representative for the documents of the same words
    reps = rows.groupBy("same").agg(F.first("key").alias("id"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    reps = saved(reps, "dup-classes")
    if reps.groupBy("id").count().where("count > 1").take(1):  # two hashes that begin alike: numbers of their own, fixed as they are written
        reps = saved(reps.withColumn("id", F.monotonically_increasing_id()), "dup-classes")
    spread = reps.where("n > 0").select("id", F.col("n").cast("int").alias("n"), F.posexplode("sketch").alias("j", "value")).select("id", "n", F.xxhash64("j", "value").alias("bucket"))
    buckets = saved(spread.groupBy("bucket").agg(F.count("*").alias("size"), F.min("id").alias("leader")).where("size > 1").drop("size"), "dup-buckets")
    led = buckets.join(reps.select(F.col("id").alias("leader"), F.col("n").cast("int").alias("leader_n")), "leader")
    # the leaders that a text meets
    met = saved(spread.join(led, "bucket").where(F.col("id") != F.col("leader")).groupBy("leader", "id", "n", "leader_n").agg(F.count("*").alias("shared")), "dup-met")
    tokens = _tokens(docs, rows, reps, met.select("id").unionByName(met.select(F.col("leader").alias("id"))).distinct())
    links = _stars(met, tokens, similarity)
    labels = components(links)
    more = _apart(met, labels, reps.select("id", F.col("n").cast("int").alias("n")), tokens, similarity)
    labels = _extended(labels, more)
    links = links.unionByName(more)
    degree = links.select("a").unionByName(links.select(F.col("b").alias("a"))).groupBy("a").agg(F.count("*").alias("n_links")).withColumnRenamed("a", "id")
    classed = saved(reps.join(labels, "id", "left").join(degree, "id", "left").select("same", F.coalesce("root", "id").alias("root"), "copies", F.coalesce("n_links", F.lit(0)).alias("n_links")), "dup-roots")
    least = rows.groupBy("same").agg(F.min("doc_id").alias("least"))
    by_root = saved(classed.join(least, "same").groupBy("root").agg(F.min("least").alias("class_id"), F.sum("copies").alias("class_size")), "dup-by-root")
    named = saved(classed.join(by_root, "root").select("same", "root", "class_id", "class_size", "n_links"), "dup-named")
    own = saved(rows.select("doc_id", "tie", "same"), "dup-rows")
    discard(rows, reps, buckets, met, tokens, classed, by_root)
    return own, named


def _stars(met: DataFrame, tokens: DataFrame, similarity: float) -> DataFrame:
    """Links of texts with the leader that they meet in most buckets, if their lengths allow one; a leader goes once to each STAR texts or so."""
    close = F.abs(F.col("n") - F.col("leader_n")) <= (1 - similarity) * F.greatest("n", "leader_n") + 1e-9
    best = met.where(close).groupBy("id").agg(F.min_by("leader", F.struct(-F.col("shared"), F.col("leader"))).alias("g"))
    best = saved(best, "dup-best")
    chunks = best.groupBy("g").agg(F.expr(f"count(*) div {STAR} + 1").alias("chunks"))
    texts = best.join(chunks, "g").select("g", F.expr("pmod(xxhash64(id, 7), chunks)").alias("a"), F.lit(1).cast("byte").alias("side"), "id")
    leaders = chunks.select("g", F.explode(F.expr("sequence(0L, chunks - 1)")).alias("a"), F.lit(0).cast("byte").alias("side"), F.col("g").alias("id"))
    rows = texts.unionByName(leaders).select("g", F.lit(0).cast("long").alias("win"), "a", F.lit(0).cast("long").alias("b"), "side", F.lit(0).cast("long").alias("cut"), "id", F.col("id").alias("root"))
    links = met_in_cells(rows, tokens, similarity)
    discard(best)
    return links


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, components_: int = COMPONENTS, kept: int = KEPT) -> DataFrame:
    """doc_id, class_id, class_size, n_links of every row of ``docs``.

    class_id is the least doc_id of the row's class: documents joined by links,
    directly or through others; it is null where the whole class has no doc_id.
    n_links counts the links that alignment found for the row's words with other
    words on the way to the classes: each task gives no more than join the classes that it holds. Null texts count as empty; texts without
    words are alike only if they are equal. Rows that repeat a doc_id, or have
    none, fall in the classes of their texts. An empty table gives no rows.
    Other columns play no part.
    """
    rows, named = classes(docs, similarity, components_, kept)
    return rows.select("doc_id", "same").join(named, "same").select("doc_id", "class_id", "class_size", "n_links")


def _tokens(docs: DataFrame, rows: DataFrame, reps: DataFrame, wanted: DataFrame) -> DataFrame:
    """id and words (32 bits of each word's hash) of the wanted representatives, from one document of each."""
    keys = rows.join(reps.select("same", "id").join(wanted, "id"), "same").groupBy("id").agg(F.min(F.struct("doc_id", "tie")).alias("key"))
    keys = keys.select("id", F.col("key.doc_id").alias("k_id"), F.col("key.tie").alias("k_tie"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, len(batch), 256):
                part = batch.slice(k, 256)
                texts, data = part.column("text").to_pylist(), []
                for a, b in slices(texts):
                    words, offsets = word_hashes(texts[a:b])
                    data += [(words[offsets[t] : offsets[t + 1]] >> np.uint64(32)).astype(np.uint32).tobytes() for t in range(b - a)]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(data, pa.binary())], ["id", "words"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tie"), "text")
    texts = texts.join(keys, F.col("doc_id").eqNullSafe(F.col("k_id")) & (F.col("tie") == F.col("k_tie"))).select("id", "text")
    return saved(texts.mapInArrow(run, "id long, words binary").dropDuplicates(["id"]), "dup-words")


def _by_cell(batches: Iterator[pa.RecordBatch], cell: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows sorted by ``cell`` in tables that hold its groups whole, each with the places where a group begins."""
    begins_of = lambda rows: np.flatnonzero((np.diff(np.stack([rows.column(c).to_numpy() for c in cell]), axis=1) != 0).any(0)) + 1
    held = None
    for batch in batches:
        if not len(batch):
            continue
        rows = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        begins = np.append(0, begins_of(rows))
        held = rows.slice(begins[-1])
        if len(begins) > 1:
            yield rows.slice(0, begins[-1]), begins[:-1]
    if held is not None:
        yield held, np.zeros(1, np.int64)


def _apart(met: DataFrame, labels: DataFrame, sizes: DataFrame, tokens: DataFrame, similarity: float) -> DataFrame:
    """Links between texts that share a component and are in different classes, enough to join these.

    The texts that meet a leader of a class are one group, with those that meet
    the leaders which that class's own leaders meet. In a group, texts of cut c by
    length meet those of cuts c and c + 1, the window c, as alike texts are at
    most a cut apart. Most texts of a group may be of one class already: those
    are at home and meet only the others, which also meet each other. Either
    kind is dealt to blocks by hash, and blocks meet two at a time.
    """
    root_of = lambda x, name: labels.select(F.col("id").alias(x), F.col("root").alias(name))
    rooted = met.select("leader", "id").join(root_of("id", "root"), "id", "left").join(root_of("leader", "leader_root"), "leader", "left")
    rooted = saved(rooted.select("leader", "id", F.coalesce("root", "id").alias("root"), F.coalesce("leader_root", "leader").alias("top")), "dup-rooted")
    leaders = rooted.select(F.col("leader").alias("id"), F.col("top").alias("own")).distinct()
    above = rooted.join(leaders, "id").groupBy("own").agg(F.min("top").alias("above")).withColumnRenamed("own", "top")
    groups = leaders.select("id", F.col("own").alias("root"), F.col("own").alias("top")).unionByName(rooted.select("id", "root", "top")).distinct()
    groups = groups.join(above, "top", "left").select(F.least("top", F.coalesce("above", "top")).alias("g"), "id", "root").distinct()
    held = groups.groupBy("g", "root").agg(F.count("*").alias("texts"))
    mixed = held.groupBy("g").agg(F.count("*").alias("classes"), F.max_by("root", F.struct("texts", "root")).alias("home")).where("classes > 1").drop("classes")
    # a cut's ratio of lengths is that of alike texts, and a little more
    cut = F.floor(F.log(F.col("n").cast("double")) / float(np.log(1.01 / similarity))).cast("long")
    own = groups.join(mixed, "g").join(sizes, "id").select("g", "id", "root", "n", cut.alias("cut"), (F.col("root") == F.col("home")).alias("at_home"))
    own = saved(own, "dup-apart")
    of = lambda home, what: F.coalesce(F.sum(F.when(F.col("at_home") == home, what)), F.lit(0))
    cuts = own.groupBy("g", "cut").agg(*[of(h, w).alias(name) for h, w, name in ((True, F.lit(1), "homes"), (False, F.lit(1), "aways"), (True, F.col("n"), "home_words"), (False, F.col("n"), "away_words"))], F.min("root").alias("lo"), F.max("root").alias("hi"))
    # a window holds its cut and the next
    after = cuts.select("g", (F.col("cut") - 1).alias("cut"), *[F.col(c).alias(f"next_{c}") for c in cuts.columns[2:]])
    both = lambda c: F.col(c) + F.coalesce(f"next_{c}", F.lit(0))
    blocks = lambda texts, words: F.greatest(F.ceil(both(texts) / BLOCK), F.ceil(both(words) / BLOCK_WORDS)).cast("long")
    windows = cuts.join(after, ["g", "cut"], "left").where((both("aways") > 0) & (F.least("lo", F.coalesce("next_lo", "lo")) != F.greatest("hi", F.coalesce("next_hi", "hi"))))
    windows = saved(windows.select("g", F.col("cut").alias("win"), blocks("aways", "away_words").alias("na"), blocks("homes", "home_words").alias("nh")), "dup-windows")
    entered = own.withColumn("win", F.explode(F.array(F.col("cut") - 1, F.col("cut")))).join(windows, ["g", "win"]).withColumn("k", F.expr("pmod(xxhash64(id, 7), if(at_home, nh, na))"))
    aways = "transform(sequence(0L, na - 1), m -> struct(least(k, m) as a, greatest(k, m) as b, cast(if(k = m, 2, if(k < m, 0, 1)) as byte) as side))"
    to_homes = "if(nh > 0, transform(sequence(0L, greatest(nh, 1L) - 1), m -> struct(k as a, na + m as b, cast(0 as byte) as side)), array())"
    homes = "transform(sequence(0L, na - 1), m -> struct(m as a, na + k as b, cast(1 as byte) as side))"
    cells = entered.withColumn("to", F.explode(F.expr(f"if(at_home, {homes}, concat({aways}, {to_homes}))")))
    links = met_in_cells(cells.select("g", "win", "to.a", "to.b", "to.side", "cut", "id", "root"), tokens, similarity)
    discard(rooted, own, windows)
    return links


def deduplicated(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row of each class of near_duplicates(), with the columns of ``docs``: that of the least doc_id, or if the
    class has none, any of one text. Null and empty texts are one class, and rows that repeat a row are one. An
    empty table gives no rows."""
    rows, named = classes(docs, similarity)
    keys = rows.join(named.select("same", "root"), "same")
    chosen = keys.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tie")).alias("key")).select(F.col("key.doc_id").alias("k_id"), F.col("key.tie").alias("k_tie"))
    copies = rows.groupBy(F.col("doc_id").alias("c_id"), F.col("tie").alias("c_tie")).agg(F.count("*").alias("copies"))
    chosen = saved(chosen.join(copies, F.col("k_id").eqNullSafe(F.col("c_id")) & (F.col("k_tie") == F.col("c_tie"))).select("k_id", "k_tie", "copies"), "dup-chosen")
    own = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("tie"))
    on = F.col("id").eqNullSafe(F.col("k_id")) & (F.col("tie") == F.col("k_tie"))
    single = own.join(chosen.where("copies = 1"), on, "left_semi").select("row")
    repeated = own.join(chosen.where("copies > 1"), on, "left_semi").dropDuplicates(["id", "tie"]).select("row")
    return single.unionByName(repeated).select(*[F.col("row")[c].alias(c) for c in docs.columns])
