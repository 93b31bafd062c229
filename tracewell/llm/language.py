"""Language identification by interpolated Kneser-Ney models of characters.

Texts are lower-cased; a letter (or mark) is a symbol, and everything between
letters one boundary symbol. The four-symbol runs of every document to learn
from are counted, and the counts of shorter runs are those of the different
symbols that come before them. A run's probability is its discounted share of
its context's count, and what discounting leaves goes to the run without its
first symbol, down to all symbols alike.

Where no language and order has more than GRAMS runs, workers hold them all: they
stand in one sorted array of hashes for each order, with a logarithm for each
language, so a symbol takes one search. Where there are more, all of them stay in
tables. Workers hold the logarithms of the most frequent runs of ORDER symbols, as
the tables give them, in such an array; a document's other runs are told apart,
counted, joined with the tables and added to what the array gave. Which runs the
array has decides nothing but the work: logarithms are added as whole numbers. The
language of the lowest cross-entropy a symbol is chosen. A second model, that
leaves a sixteenth of the documents out, is compared with texts of that part: so
the steepness of the score and the cross-entropies to reject are calibrated.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .common import discard, held_out, saved
from .words import mix64, slices

ORDER = 4
#: runs of symbols of a language and order that a worker holds, and numbers (for each of them one of each language) it holds
#: of an order at most: bounds what is broadcast; the others are joined
GRAMS, CELLS = 1 << 17, 1 << 23
#: logarithms from tables are whole multiples of 1 / UNITS
UNITS = 1 << 20
#: one document in SLICE is left out of the model that calibrates, by at most CALIBRATE of them with MAX_CHARS characters at most
SLICE, CALIBRATE, MAX_CHARS = 16, 2000, 20_000
#: share of a language's own texts that rejection costs; languages of fewer than FEW texts to calibrate by take the figures of all
REJECTED, FEW = 0.005, 20
#: distinct runs that a task holds while it counts
HELD = 1 << 20
#: symbols looked up at once
STEP = 1 << 18
UNDETERMINED = "und"

BOUNDARY = 1
_kinds: list[np.ndarray] = []


def kinds() -> np.ndarray:
    """Of every code point: 2 for a letter, 1 for a mark, 0 for others."""
    if not _kinds:
        _kinds.append(np.array([{"L": 2, "M": 1}.get(unicodedata.category(chr(k))[0], 0) for k in range(0x110000)], np.int8))
    return _kinds[0]


def symbols(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of ORDER symbols that end at each symbol, where each text's begin (with the end), and which texts have letters.

    A symbol is a code point of 16 bits; those beyond are folded into the range of surrogates. Three boundaries come before a text.
    """
    whole = "\x00".join([(t.replace("\x00", " ") if "\x00" in t else t).lower() if t else "" for t in texts] + [""])
    codes = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = kinds()[codes]
    letter = kind > 0
    ends = np.flatnonzero(codes == 0)
    real = np.append(0, np.cumsum(kind == 2))[ends]
    kept = letter.copy()
    kept[1:] |= letter[:-1]  # what follows a letter
    place = np.flatnonzero(kept)
    own = np.where(letter[place], np.where(codes[place] < 0x10000, codes[place], 0xD800 + codes[place] % 2048), BOUNDARY).astype(np.uint64)
    offsets = np.append(0, np.searchsorted(place, ends, "right"))
    at = np.arange(len(own)) + (ORDER - 1) * np.repeat(np.arange(1, len(ends) + 1), np.diff(offsets))
    padded = np.full(len(own) + (ORDER - 1) * len(ends), BOUNDARY, np.uint64)
    padded[at] = own
    runs = padded[at]
    for k in range(1, ORDER):
        runs |= padded[at - k] << np.uint64(16 * k)
    return runs, offsets, np.diff(real, prepend=0) > 0


def counted(docs: DataFrame) -> DataFrame:
    """lang, part, gram, n: runs of ORDER symbols in the whole texts of ``docs`` (lang, part, text)."""

    def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        grams, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(grams, kind="stable")
        grams, n = grams[order], n[order]
        first = np.flatnonzero(np.append(True, grams[1:] != grams[:-1])) if len(grams) else np.zeros(0, np.int64)
        return grams[first], np.add.reduceat(n, first) if len(first) else n

    def rows(held: dict) -> Iterator[pa.RecordBatch]:
        for (lang, part), parts in held.items():
            grams, n = merged(parts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array([part] * len(grams), pa.bool_()), pa.array(grams.view(np.int64)), pa.array(n, pa.int64())], ["lang", "part", "gram", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, bool], list[tuple[np.ndarray, np.ndarray]]] = {}
        size = 0
        for batch in batches:
            for k in range(0, len(batch), 512):
                part = batch.slice(k, 512)
                keys, texts = list(zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)), part.column(2).to_pylist()
                for a, b in slices(texts):
                    runs, offsets, _ = symbols(texts[a:b])
                    names = sorted(set(keys[a:b]))
                    of = np.repeat(np.array([names.index(x) for x in keys[a:b]], np.int64), np.diff(offsets))
                    for j, name in enumerate(names):
                        found = np.unique(runs[of == j], return_counts=True)
                        held.setdefault(name, []).append(found)
                        size += len(found[0])
                if size >= 2 * HELD:
                    held = {name: [merged(parts)] for name, parts in held.items()}
                    size = sum(len(parts[0][0]) for parts in held.values())
                    if size >= HELD:
                        yield from rows(held)
                        held, size = {}, 0
        yield from rows(held)

    return docs.mapInArrow(run, "lang string, part boolean, gram long, n long").groupBy("lang", "part", "gram").agg(F.sum("n").alias("n"))


def levels(counts: DataFrame) -> DataFrame:
    """model, lang, level, gram, ctx, c: counts of runs of ORDER symbols, and for shorter runs how many different symbols come before them.

    Model 1 has all counts, model 0 those out of the part.
    """
    both = counts.withColumn("model", F.lit(1)).unionByName(counts.where("not part").withColumn("model", F.lit(0)))
    level = both.groupBy("model", "lang", "gram").agg(F.sum("n").alias("c"))
    out = None
    for k in range(ORDER, 0, -1):
        if k < ORDER:
            shorter = F.col("gram").bitwiseAND(F.lit((1 << 16 * k) - 1))
            level = level.select("model", "lang", shorter.alias("gram")).groupBy("model", "lang", "gram").agg(F.count("*").alias("c"))
        level = saved(level, f"lang-level-{k}")
        own = level.select("model", "lang", F.lit(k).alias("level"), "gram", F.shiftrightunsigned("gram", 16).alias("ctx"), "c")
        out = own if out is None else out.unionByName(own)
    return out


KEYS = ["model", "lang", "level"]


def discount(ones: float, twos: float) -> float:
    return ones / (ones + 2 * twos) if ones and twos else 0.5


def grade():
    """Eight grades for each doubling of a count."""
    return F.floor(F.log2("c") * 8)


def cuts(every: DataFrame) -> tuple[list[str], pd.DataFrame, bool]:
    """The languages; by model, language (and its place, ``code``) and level the ``least`` grade that a worker holds and the discount ``d``; whether it holds all."""
    grades = every.groupBy(*KEYS, grade().alias("grade")).agg(F.count("*").alias("n"), F.sum((F.col("c") == 1).cast("long")).alias("ones"), F.sum((F.col("c") == 2).cast("long")).alias("twos")).toPandas()
    names, rows, whole = sorted(grades["lang"].unique()), [], True
    most = min(GRAMS, CELLS // max(len(names), 1) ** 2)
    for (model, lang, level), own in grades.sort_values("grade", ascending=False).groupby(KEYS):
        fits = own["n"].cumsum() <= most
        whole &= bool(fits.all())
        least = own["grade"][fits].min() if fits.any() else own["grade"].max() + 1
        rows.append((int(model), lang, int(level), names.index(lang), float(least), float(discount(own["ones"].sum(), own["twos"].sum()))))
    return names, pd.DataFrame(rows, columns=["model", "lang", "level", "code", "least", "d"]), whole


def cut_table(every: DataFrame, cut: pd.DataFrame) -> DataFrame:
    rows = [tuple(r) for r in cut.astype(object).itertuples(index=False)]
    return F.broadcast(every.sparkSession.createDataFrame(rows, "model int, lang string, level int, code int, least double, d double"))


def totals(every: DataFrame) -> DataFrame:
    return every.groupBy(*KEYS, "ctx").agg(F.sum("c").alias("total"), F.count("*").alias("different"))


def share():
    return (F.col("c") - F.col("d")) / F.col("total")


def held(every: DataFrame, names: list[str], cut: pd.DataFrame) -> pd.DataFrame:
    """model, lang, level, gram, ctx, share of the runs that a worker holds: at most GRAMS of each model, language and level."""
    own = every.join(cut_table(every, cut), KEYS).where(grade() >= F.col("least"))
    # numbers in Arrow batches: the driver holds 28 bytes for each run kept
    kept = own.join(totals(every), [*KEYS, "ctx"]).select("model", "code", "level", "gram", share().alias("share")).toArrow().to_pandas()
    kept["lang"] = pd.Categorical.from_codes(kept.pop("code"), names)
    return kept


def gathered(counts: DataFrame) -> pd.DataFrame:
    """held() of ``counts``: all runs if none has more than GRAMS (fitted() takes tables else), or the most frequent."""
    every = levels(counts)
    names, cut, _ = cuts(every)
    return held(every, names, cut)


class Sorted:
    """Rows of logarithms by the hashes of their keys; a key that is not there gives the row ``len(hashes)``."""

    def __init__(self, keys: np.ndarray, logs: np.ndarray, dtype: type = np.float32):
        hashes = mix64(keys)
        order = np.argsort(hashes)
        self.hashes, self.logs = hashes[order], logs[order].astype(dtype)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the keys, and which of them are there."""
        if not len(self.hashes):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        hashes = mix64(keys)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return at, self.hashes[at] == hashes


def _suffix(runs: np.ndarray, level: int) -> np.ndarray:
    return runs & np.uint64((1 << 16 * level) - 1)


def _summed(runs: np.ndarray, offsets: np.ndarray, logs: Callable[[np.ndarray], np.ndarray], out: np.ndarray) -> np.ndarray:
    """``out`` (a row for each text, a column for each language) with the logarithms of each text's runs added, STEP runs at once (fewer for many languages)."""
    full = np.flatnonzero(np.diff(offsets))
    step = max(1, min(STEP, CELLS // max(out.shape[1], 1)))
    for k in range(0, len(runs), step):  # a text's pieces are added up
        here = full[(offsets[full] < k + step) & (offsets[full + 1] > k)]
        out[here] += np.add.reduceat(logs(runs[k : k + step]), np.maximum(offsets[here] - k, 0), axis=0, dtype=out.dtype)
    return out


class Model:
    """Logarithms (to base 2) of the probabilities of runs, for every language at once."""

    def __init__(self, languages: list[str], base: np.ndarray, runs: list[Sorted], left: list[Sorted]):
        self.languages, self.base, self.runs, self.left = languages, base, runs, left

    @classmethod
    def of(cls, kept: pd.DataFrame) -> Model:
        kinds_of = kept["lang"].cat.remove_unused_categories().cat
        languages = sorted(kinds_of.categories)
        n, distinct = len(languages), kept.loc[kept["level"] == 1, "gram"].nunique() + 1
        out = cls(languages, np.full(n, -np.log2(distinct)), [], [])
        which = np.searchsorted(languages, kinds_of.categories)[kinds_of.codes] if n else np.zeros(0, np.int64)
        grams, level, share = kept["gram"].to_numpy(np.int64).view(np.uint64), kept["level"].to_numpy(), kept["share"].to_numpy()
        for k in range(1, ORDER + 1):
            rows = level == k
            keys, at = np.unique(grams[rows], return_inverse=True)
            own = np.zeros((len(keys), n))
            own[at, which[rows]] = share[rows]
            contexts, ctx = np.unique(keys >> np.uint64(16), return_inverse=True)
            left = np.zeros((len(contexts), n))
            np.add.at(left, ctx, own)
            left = np.maximum(1 - left, 1e-9)  # 1 where a language has nothing after the context
            lower = out.logs(_suffix(keys, k - 1), k - 1)
            out.runs.append(Sorted(keys, np.log2(own + left[ctx] * 2**lower)))
            out.left.append(Sorted(contexts, np.log2(left)))
        return out

    def logs(self, runs: np.ndarray, level: int = ORDER) -> np.ndarray:
        """A row for each run of ``level`` symbols, a column for each language."""
        if not level:
            return np.repeat(self.base[None, :], len(runs), 0).astype(np.float32)
        at, there = self.runs[level - 1].find(runs)
        if there.all() and len(runs):
            return self.runs[level - 1].logs[at]
        out = np.empty((len(runs), len(self.languages)), np.float32)
        out[there] = self.runs[level - 1].logs[at[there]]
        rest = runs[~there]
        ctx, known = self.left[level - 1].find(rest >> np.uint64(16))
        lower = self.logs(_suffix(rest, level - 1), level - 1)
        lower[known] += self.left[level - 1].logs[ctx[known]]
        out[~there] = lower
        return out

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cross-entropies a symbol (a row for each text, a column for each language), numbers of symbols, and which texts have letters."""
        sums, sizes, lettered = [], [], []
        for a, b in slices(texts):
            runs, offsets, letters = symbols(texts[a:b])
            sums.append(-_summed(runs, offsets, self.logs, np.zeros((b - a, len(self.languages)))))
            sizes.append(np.diff(offsets))
            lettered.append(letters)
        if not sums:
            return np.zeros((0, len(self.languages))), np.zeros(0, np.int64), np.zeros(0, bool)
        n = np.concatenate(sizes)
        return np.concatenate(sums) / np.maximum(n, 1)[:, None], n, np.concatenate(lettered)


class Tables:
    """A model whose runs are too many for a worker: ``shares`` (level, gram, of) and ``lefts`` (level, ctx, of) hold them all.

    ``of`` has the share, or what discounting leaves, by the language's code. ``often`` has the logarithms of frequent
    runs, in whole UNITS, for every language at once.
    """

    def __init__(self, languages: list[str], codes: list[int], distinct: int, shares: DataFrame, lefts: DataFrame):
        self.languages, self.codes, self.distinct, self.shares, self.lefts = languages, codes, distinct, shares, lefts
        self.often = Sorted(np.zeros(0, np.uint64), np.zeros((0, len(codes))), np.int32)

    @classmethod
    def of(cls, every: DataFrame, names: list[str], cut: pd.DataFrame) -> list[Tables]:
        """The models 0 and 1."""
        cut_rows, total = cut_table(every, cut), totals(every)
        by_code = lambda value: F.map_from_entries(F.collect_list(F.struct("code", value))).alias("of")
        shares = saved(every.join(cut_rows, KEYS).join(total, [*KEYS, "ctx"]).groupBy("model", "level", "gram").agg(by_code(share().alias("share"))), "lang-shares")
        left = F.greatest(F.col("d") * F.col("different") / F.col("total"), F.lit(1e-9))
        lefts = saved(total.join(cut_rows, KEYS).groupBy("model", "level", "ctx").agg(by_code(left.alias("left"))), "lang-lefts")
        out = []
        for m in (0, 1):
            codes = sorted(cut.loc[cut["model"] == m, "code"].unique().tolist())
            own = shares.where(F.col("model") == m)
            model = cls([names[k] for k in codes], codes, own.where("level = 1").count() + 1, own.drop("model"), lefts.where(F.col("model") == m).drop("model"))
            out.append(model)
            if not codes:
                continue
            runs = every.where((F.col("model") == m) & (F.col("level") == ORDER)).join(cut_rows, KEYS).where(grade() >= F.col("least")).select(F.col("gram").alias("run")).distinct()
            got = model.logs(runs).toArrow()
            logs = np.concatenate([x.flatten().to_numpy() for x in got["logs"].chunks] or [np.zeros(0, np.int32)]).reshape(-1, len(codes))
            model.often = Sorted(got["run"].to_numpy().view(np.uint64), logs, np.int32)
        return out

    def logs(self, runs: DataFrame) -> DataFrame:
        """run, logs: logarithms (to base 2, in UNITS) of the probabilities of the different ``runs`` of ORDER symbols, by language."""
        suffixes = [F.struct(F.lit(k).alias("level"), (F.col("run").bitwiseAND(F.lit((1 << 16 * k) - 1)) if k < ORDER else F.col("run")).alias("gram")) for k in range(1, ORDER + 1)]
        asked = runs.select("run", F.explode(F.array(*suffixes)).alias("at")).select("run", "at.*").withColumn("ctx", F.shiftrightunsigned("gram", 16))
        found = asked.join(self.shares.withColumnRenamed("of", "share"), ["level", "gram"], "left").join(self.lefts.withColumnRenamed("of", "left"), ["level", "ctx"], "left")
        at = lambda name, k: F.first(F.when(F.col("level") == k, F.col(name)), ignorenulls=True).alias(f"{name}{k}")
        wide = found.groupBy("run").agg(*[at(name, k) for name in ("share", "left") for k in range(1, ORDER + 1)])

        def log(code):
            p = F.lit(1 / self.distinct)
            for k in range(1, ORDER + 1):  # 0 where a language lacks the run, 1 where it has nothing after the context
                p = F.coalesce(F.try_element_at(f"share{k}", code), F.lit(0.0)) + F.coalesce(F.try_element_at(f"left{k}", code), F.lit(1.0)) * p
            return F.round(F.log2(p) * UNITS).cast("int")

        return wide.select("run", F.transform(F.array(*[F.lit(c) for c in self.codes]), log).alias("logs"))

    def entropies(self, docs: DataFrame) -> DataFrame:
        """The columns of ``docs`` but its text, with ``sums`` and ``more`` (of frequent and other runs' logarithms, by language), ``size`` and ``lettered``."""
        others, count = [c for c in docs.columns if c != "text"], len(self.codes)
        shared = docs.sparkSession.sparkContext.broadcast(self.often)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            often = shared.value
            logs = np.append(often.logs, np.zeros((1, count), np.int32), 0)
            names, begin = [*others, "sums", "size", "lettered", "row", "run", "times"], TaskContext.get().partitionId() << 40
            for batch in batches:
                for k in range(0, len(batch), 512):
                    part = batch.slice(k, 512)
                    texts = part.column("text").to_pylist()
                    for a, b in slices(texts):
                        runs, offsets, lettered = symbols(texts[a:b])
                        at, there = often.find(runs)
                        rest = np.flatnonzero(~there)
                        at[rest] = len(logs) - 1
                        sums = _summed(at, offsets, logs.__getitem__, np.zeros((b - a, count), np.int64))
                        row, own = np.searchsorted(offsets, rest, "right") - 1, runs[rest]
                        order = np.lexsort((own, row))
                        row, own = row[order], own[order]
                        first = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (own[1:] != own[:-1]))) if len(own) else np.zeros(0, np.int64)
                        times = np.diff(np.append(first, len(own)))
                        of = pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1, dtype=np.int32) * count), pa.array(sums.ravel()))
                        columns = [*[part.column(c).slice(a, b - a) for c in others], of, pa.array(np.diff(offsets)), pa.array(lettered)]
                        none = [pa.nulls(b - a, pa.int64())] * 2
                        yield pa.RecordBatch.from_arrays([*columns, pa.array(np.arange(begin, begin + b - a)), *none], names)
                        for j in range(0, len(first), STEP):
                            here = first[j : j + STEP]
                            none = [pa.nulls(len(here), c.type) for c in columns]
                            yield pa.RecordBatch.from_arrays([*none, pa.array(begin + row[here]), pa.array(own[here].view(np.int64)), pa.array(times[j : j + STEP])], names)
                        begin += b - a

        made = StructType.fromDDL("sums array<long>, size long, lettered boolean, row long, run long, times long")
        nullable = [StructField(c, docs.schema[c].dataType) for c in others]
        # a row for each text, and one for each of its other runs
        every = saved(docs.mapInArrow(run, StructType([*nullable, *made.fields])), "lang-sums")
        rows, rest = every.where("run is null"), every.where("run is not null").select("row", "run", "times")
        added = rest.join(self.logs(rest.select("run").distinct()), "run").groupBy("row").agg(F.array(*[F.sum(F.col("logs")[k] * F.col("times")) for k in range(count)]).alias("more"))
        return rows.join(added, "row", "left").select(*others, "sums", F.coalesce("more", F.array_repeat(F.lit(0).cast("long"), count)).alias("more"), "size", "lettered")


def bits_of(rows: pa.RecordBatch | pa.Table, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What Model.entropies() gives, from the columns that Tables.entropies() makes."""
    flat = lambda name: np.array(rows.column(name).to_pylist(), np.int64).reshape(-1, count)
    n = rows.column("size").to_numpy()
    return -(flat("sums") + flat("more")) / UNITS / np.maximum(n, 1)[:, None], n, np.array(rows.column("lettered").to_pylist(), bool)


@dataclass
class Calibration:
    """steep: how fast the score falls with the distance in bits between languages. usual, most: by language the usual
    cross-entropy of its texts, and how far (times the root of a text's symbols) above it a text may lie."""

    steep: float
    usual: np.ndarray
    most: np.ndarray

    def confidence(self, bits: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Of the language of the fewest bits among all."""
        if not bits.shape[1]:
            return np.zeros(len(bits))
        apart = (bits - bits.min(1, keepdims=True)) * np.sqrt(n)[:, None] * self.steep
        return 1 / np.exp2(-np.minimum(apart, 1000)).sum(1)

    def excess(self, bits: np.ndarray, best: np.ndarray, n: np.ndarray) -> np.ndarray:
        return (bits[np.arange(len(bits)), best] - self.usual[best]) * np.sqrt(n)


def calibrated(languages: list[str], bits: np.ndarray, n: np.ndarray, lettered: np.ndarray, langs: list[str]) -> Calibration:
    count = len(languages)
    out = Calibration(1.0, np.zeros(count), np.full(count, np.inf))
    known = lettered & np.isin(langs, languages) if count else np.zeros(0, bool)
    if not known.any():
        return out
    bits, n = bits[known], n[known]
    truth = np.searchsorted(languages, np.array(langs)[known])
    right = bits.argmin(1) == truth
    losses = []
    for steep in (grid := 2.0 ** np.arange(-6, 6)):
        p = np.clip(Calibration(steep, out.usual, out.most).confidence(bits, n), 1e-6, 1 - 1e-6)
        losses.append(-np.where(right, np.log(p), np.log(1 - p)).mean())
    out.steep = float(grid[int(np.argmin(losses))])
    own = bits[np.arange(len(bits)), truth]
    for k in [-1, *range(count)]:  # all languages together first, for those with few texts
        mine = right if k < 0 else (truth == k) & right
        if mine.sum() >= FEW:
            at = slice(None) if k < 0 else k
            usual = np.average(own[mine], weights=n[mine])
            out.usual[at], out.most[at] = usual, np.quantile((own[mine] - usual) * np.sqrt(n[mine]), 1 - REJECTED)
    return out


def fitted(docs: DataFrame, mod: int = 4, rem: int = 2) -> tuple[Model | Tables, Calibration]:
    """Learn from text and lang of the documents that are not held out and have a lang."""
    # a null doc_id is not held out
    rows = docs.where(F.col("lang").isNotNull() & ~held_out(mod, rem)).select("doc_id", F.col("lang").cast("string").alias("lang"), "text", F.xxhash64("doc_id", F.lit(SLICE)).alias("h"))
    part = F.pmod("h", F.lit(SLICE)) == 0
    counts = saved(counted(rows.select("lang", part.alias("part"), "text")), "lang-counts")
    every = levels(counts)
    names, cut, whole = cuts(every)
    if whole:
        kept = held(every, names, cut)
        less, model = (Model.of(kept[kept["model"] == m]) for m in (0, 1))
    else:
        less, model = Tables.of(every, names, cut)
    discard(counts)
    texts = rows.where(part & F.col("doc_id").isNotNull() & (F.length("text") <= MAX_CHARS))
    ids = texts.select("doc_id", "h").orderBy("h", "doc_id").limit(CALIBRATE)
    sample = texts.join(F.broadcast(ids.select("doc_id").distinct()), "doc_id").orderBy("h", "doc_id", "text").limit(CALIBRATE)
    if not less.languages:
        tests = Calibration(1.0, np.zeros(0), np.zeros(0))
    elif whole:
        found = sample.select("text", "lang").collect()
        tests = calibrated(less.languages, *less.entropies([r.text for r in found]), [r.lang for r in found])
    else:
        table = less.entropies(sample.select("h", "doc_id", "lang", "text")).orderBy("h", "doc_id", "lang", "sums", "more").toArrow()
        tests = calibrated(less.languages, *bits_of(table, len(less.languages)), table["lang"].to_pylist())
    # the model of all documents may know languages that the other doesn't
    usual, most = np.full(len(model.languages), tests.usual.mean() if less.languages else 0.0), np.full(len(model.languages), tests.most.max(initial=0) if less.languages else np.inf)
    at = np.searchsorted(model.languages, less.languages) if less.languages else np.zeros(0, np.int64)
    usual[at], most[at] = tests.usual, tests.most
    return model, Calibration(tests.steep, usual, most)


def identified(docs: DataFrame, model: Model | Tables, calibration: Calibration, mod: int = 4, rem: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred, score, bits, rejected of every row of ``docs``; its other columns play no part.

    ``lang_pred`` is the learned language of the lowest cross-entropy ``bits`` a
    symbol, ties to the first by code point; ``score`` tells from 0 to 1 how sure
    that is. ``rejected`` is whether the text is less like that language than all
    but a two-hundredth of its own texts: a caller who wants an open set takes such
    rows for undetermined. Null texts, texts without letters, and all texts if
    nothing was learned, are ``und`` with score 0, no bits, and rejected. Rows
    that repeat a doc_id are judged alike; a null doc_id is not held out. An empty
    table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(mod, rem).alias("held_out"), "text")
    held_by = model if isinstance(model, Model) else None
    if held_by is None:
        rows = model.entropies(rows)
    learned = model.languages
    shared = docs.sparkSession.sparkContext.broadcast((held_by, calibration))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_by, calibration = shared.value
        names = np.array([*learned, UNDETERMINED], object)
        for batch in batches:
            for k in range(0, len(batch), 512):
                part = batch.slice(k, 512)
                bits, n, lettered = held_by.entropies(part.column("text").to_pylist()) if held_by else bits_of(part, len(learned))
                known = lettered & (len(learned) > 0)
                best = bits.argmin(1) if len(learned) else np.zeros(len(n), np.int64)
                own = bits[np.arange(len(n)), best] if len(learned) else np.zeros(len(n))
                far = calibration.excess(bits, best, n) > calibration.most[best] if len(learned) else ~known
                score = np.where(known, calibration.confidence(bits, n), 0.0)
                columns = [part.column("doc_id"), part.column("held_out"), pa.array(names[np.where(known, best, -1)], pa.string()), pa.array(score), pa.array(own, mask=~known), pa.array(far | ~known)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "lang_pred", "score", "bits", "rejected"])

    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, bits double, rejected boolean")


def languages(docs: DataFrame, mod: int = 4, rem: int = 2) -> DataFrame:
    """identified() for ``docs``, learned from those of them that are not held out."""
    return identified(docs, *fitted(docs, mod, rem), mod, rem)
