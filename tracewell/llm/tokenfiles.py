"""Token-ID output in files of directly addressable codes.

An id is split into chunks of 8 bits, lowest first. Level 0 holds the first
chunk of every id; a bitmap marks ids that go on, and the rank of an id's mark
among its level's marks is its place in the next level. Rank directories (a
count before each 512 marks, and before each 64 within them) make any token
readable by itself, without decoding a block.

File: b"TWDAC001", then little-endian 64-bit counts (documents, tokens,
levels), doc_ids (int64), a byte for each that is 1 where the doc_id is null,
token counts (int64); then for each level its number of chunks, the chunks,
and, each from an 8-byte boundary on, marks (64-bit words), directory of 512s
(int64) and directory of 64s (uint16).
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import files
from .common import carried, discard, new_path, saved
from .encoding import BATCH_CHARS, batches, encoder

MAGIC = b"TWDAC001"
FILE_TOKENS = 1 << 21
#: of texts
PARTITION_BYTES = 24 << 20
#: so that the bounds of parts stay small; larger parts are sorted with spilling, and cut into files as others are
MOST_PARTS = 65_536


def _pad(n: int) -> bytes:
    return bytes(-n % 8)


def pack(ids: np.ndarray) -> Iterator[bytes]:
    """The levels of ids (non-negative integers)."""
    rest, levels = np.asarray(ids), []
    rest = rest if rest.dtype.kind == "u" else rest.astype(np.uint64)
    while True:
        more = rest >= 256
        levels.append((rest.astype(np.uint8), more))  # the lowest 8 bits
        if not more.any():
            break
        rest = rest[more] >> 8
    yield np.int64(len(levels)).tobytes()
    for chunks, more in levels:
        n = len(chunks)
        yield np.int64(n).tobytes()
        yield chunks.tobytes() + _pad(n)
        words = np.zeros(-(-n // 512) * 8, np.uint64)
        words.view(np.uint8)[: -(-n // 8)] = np.packbits(more, bitorder="little")
        ones = np.bitwise_count(words).astype(np.int64).reshape(-1, 8)
        yield words.tobytes()
        yield (np.cumsum(ones.sum(1)) - ones.sum(1)).astype(np.int64).tobytes()
        yield (np.cumsum(ones, 1) - ones).astype(np.uint16).tobytes()


class Codes:
    """Random access to packed ids."""

    def __init__(self, data, at: int = 0):
        self.levels = []
        (n_levels,) = np.frombuffer(data, np.int64, 1, at)
        at += 8
        for _ in range(n_levels):
            n = int(np.frombuffer(data, np.int64, 1, at)[0])
            at += 8
            chunks = np.frombuffer(data, np.uint8, n, at)
            at += n + (-n % 8)
            blocks = -(-n // 512)
            words = np.frombuffer(data, np.uint64, blocks * 8, at)
            at += blocks * 64
            coarse = np.frombuffer(data, np.int64, blocks, at)
            at += blocks * 8
            fine = np.frombuffer(data, np.uint16, blocks * 8, at)
            at += blocks * 16
            self.levels.append((chunks, words, coarse, fine))

    def __getitem__(self, positions) -> np.ndarray:
        """The ids at an array of positions, in any order."""
        at = np.asarray(positions, np.int64)
        out = np.zeros(len(at), np.uint64)
        who = np.arange(len(at))
        for level, (chunks, words, coarse, fine) in enumerate(self.levels):
            out[who] |= chunks[at].astype(np.uint64) << np.uint64(8 * level)
            word, bit = words[at >> 6], (at & 63).astype(np.uint64)
            on = (word >> bit) & np.uint64(1) == 1
            if not on.any():
                break
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            at = (coarse[at >> 9] + fine[at >> 6] + below)[on]
            who = who[on]
        return out


def file_parts(doc_ids: list, counts: np.ndarray, ids: np.ndarray) -> Iterator[bytes]:
    yield MAGIC + np.array([len(doc_ids), len(ids)], np.int64).tobytes()
    yield np.array([0 if d is None else d for d in doc_ids], np.int64).tobytes()
    nulls = np.array([d is None for d in doc_ids], np.uint8).tobytes()
    yield nulls + _pad(len(nulls)) + np.asarray(counts, np.int64).tobytes()
    yield from pack(ids)


def opened(data) -> tuple[np.ndarray, np.ndarray, np.ndarray, Codes]:
    """doc_ids, null marks, token counts and codes of a file."""
    assert bytes(data[:8]) == MAGIC, "not a file of this format"
    docs, _ = (int(x) for x in np.frombuffer(data, np.int64, 2, 8))
    ids = np.frombuffer(data, np.int64, docs, 24)
    nulls = np.frombuffer(data, np.uint8, docs, 24 + 8 * docs)
    at = 24 + 8 * docs + docs + (-docs % 8)
    return ids, nulls, np.frombuffer(data, np.int64, docs, at), Codes(data, at + 8 * docs)


def encoded(batch: pa.RecordBatch, path: str, end: int, most: int = BATCH_CHARS) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of a batch that has a column ``text``, with counts and ids of their texts, each text's ids with ``end`` after them."""
    for first, n in batches(batch.column("text"), most):
        part = batch.slice(first, n)
        ids, counts = encoder(path).encode(part.column("text"))
        yield part, counts + 1, np.insert(ids, np.cumsum(counts), end)


def part_bounds(keys: DataFrame, partition_bytes: int = PARTITION_BYTES) -> list[tuple]:
    """The least (has doc_id, doc_id, tie) of every part but the first, where rows of ``keys`` (doc_id, tie, size of the text)
    are cut in that order into parts of about so many bytes; at most MOST_PARTS - 1 of them, whatever the input's size."""
    total = keys.agg(F.sum("size")).first()[0] or 0
    parts = min(total // partition_bytes + 1, MOST_PARTS)
    if parts == 1:
        return []
    key = F.struct(F.col("doc_id").isNotNull().alias("known"), F.coalesce("doc_id", F.lit(0)).alias("doc_id"), "tie")
    ranged = keys.repartitionByRange(parts, "doc_id", "tie").groupBy(F.spark_partition_id()).agg(F.min(key).alias("least"))
    return sorted(tuple(r.least) for r in ranged.collect())[1:]


def encoded_documents(docs: DataFrame, tokenizer: str, end: int, partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """part, doc_id, n (number of ids) and ids (as bytes: 16-bit, or 32-bit where a slice has ids over that) of every row, one
    partition for each part, parts and the rows in them in ascending doc_id order (nulls first, equal ones by the hash of their text).

    Only keys are read to find the parts' bounds; texts are encoded in the partitions of the input and ids alone are shuffled, once.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tie"), "text")
    keys = saved(rows.select("doc_id", "tie", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("size")), "token-keys")
    bounds = part_bounds(keys, partition_bytes)
    discard(keys)

    def run(record_batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in record_batches:
            for part, counts, ids in encoded(batch, tokenizer, end):
                ids = ids.astype("<u2" if int(ids.max()) < 1 << 16 else "<u4")
                edges = np.concatenate([[0], np.cumsum(counts)]) * ids.itemsize
                if edges[-1] < 1 << 31:
                    data = pa.Array.from_buffers(pa.binary(), len(part), [None, pa.py_buffer(edges.astype(np.int32)), pa.py_buffer(ids)])
                else:
                    data = pa.Array.from_buffers(pa.large_binary(), len(part), [None, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(ids)]).cast(pa.binary())
                own = zip(part.column("doc_id").to_pylist(), part.column("tie").to_pylist(), strict=True)
                at = pa.array([bisect_right(bounds, (d is not None, d or 0, tie)) for d, tie in own], pa.int32())
                yield pa.RecordBatch.from_arrays([at, part.column("doc_id"), part.column("tie"), pa.array(counts), data], ["part", "doc_id", "tie", "n", "ids"])

    ids = rows.mapInArrow(run, "part int, doc_id long, tie long, n long, ids binary")
    return ids.repartitionById(len(bounds) + 1, "part").sortWithinPartitions("doc_id", "tie").drop("tie")


def write_files(docs: DataFrame, tokenizer: str, out: str, end: int = 2, file_tokens: int = FILE_TOKENS, partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """Write every text's ids to files under ``out``; returns part, file, path, n_docs, n_tokens of each file.

    Files in (part, file) order hold the documents in ascending doc_id order,
    nulls first. A null or empty text is the end id alone. A file takes
    documents until it holds ``file_tokens`` ids, so a very long document gets a
    larger one. An empty table gives no files.
    """

    def run(record_batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k = 0, 0
        doc_ids: list = []
        held: list[np.ndarray] = []

        def flush():
            nonlocal k, doc_ids, held
            path, ids = f"{out}/part-{part:06d}-{k:06d}.dac", np.concatenate(held)
            files.write(path, file_parts(doc_ids, np.array([len(x) for x in held]), ids))
            row = pa.RecordBatch.from_pydict({"part": [part], "file": [k], "path": [path], "n_docs": [len(held)], "n_tokens": [len(ids)]})
            k, doc_ids, held = k + 1, [], []
            return row

        n = 0
        for batch in record_batches:
            part = batch.column("part")[0].as_py() if len(batch) else part  # the same in all rows of a partition
            for doc_id, size, ids in zip(batch.column("doc_id").to_pylist(), batch.column("n").to_pylist(), batch.column("ids"), strict=True):
                data = ids.as_buffer()
                doc_ids.append(doc_id)
                held.append(np.frombuffer(data, "<u2" if data.size == 2 * size else "<u4"))
                n += size
                if n >= file_tokens:
                    yield flush()
                    n = 0
        if held:
            yield flush()

    ids = encoded_documents(docs, tokenizer, end, partition_bytes)
    return saved(ids.mapInArrow(run, "part long, file long, path string, n_docs long, n_tokens long"), "token-files")


def read_files(written: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, read from the files that write_files() returned."""
    parts = carried(written.groupBy("part").agg(F.sum("n_tokens").alias("tokens")), "part", {"token0": "tokens"}).select("part", "token0")
    within = W.partitionBy("part").orderBy("file")
    based = written.withColumn("_upto", F.sum("n_tokens").over(within)).join(parts, "part").withColumn("base", F.col("token0") + F.col("_upto") - F.col("n_tokens"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, base in zip(frame["path"], frame["base"], strict=True):
                doc_ids, nulls, counts, codes = opened(files.read(path))
                ends = np.cumsum(counts)
                starts, sums = ends - counts, np.empty(len(ends), np.int64)
                first = 0
                while first < len(ends):  # some documents at a time
                    last = max(first + 1, int(np.searchsorted(ends, starts[first] + (1 << 20), "right")))
                    ids = codes[np.arange(starts[first], ends[last - 1])].astype("<u4")
                    for k in range(first, last):
                        sums[k] = zlib.crc32(ids[starts[k] - starts[first] : ends[k] - starts[first]].tobytes())
                    first = last
                yield pd.DataFrame({"doc_id": pd.Series(doc_ids).astype("Int64").mask(nulls == 1), "start": base + starts, "n_tokens": counts, "ids_crc32": sums})

    spread = based.select("path", "base").repartition(max(1, written.count()))
    return spread.mapInPandas(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_output(docs: DataFrame, tokenizer: str, end: int = 2) -> DataFrame:
    """Write ``docs`` as token files in the shared folder and describe each document from what the files give back.

    Null and empty texts have the end id alone; rows that repeat a doc_id are
    documents of their own; an empty table gives no rows. Other columns of
    ``docs`` play no part.
    """
    return read_files(write_files(docs, tokenizer, new_path(docs.sparkSession, "tokens"), end))
