"""Token counts by a scan for separators: flat token files carry no index, so
each block is searched for end-of-document ids at once, and a prefix scan over
the blocks' summaries gives each block the separator before it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import files
from .common import carried, new_path, saved
from .tokenfiles import encoded

DTYPE = "<u2"
BLOCK_TOKENS = 1 << 20
FILE_TOKENS = 1 << 21
#: tasks that blocks are dealt to at most
MOST_TASKS = 20_000


def write_flat(docs: DataFrame, tokenizer: str, out: str, end: int, file_tokens: int = FILE_TOKENS) -> DataFrame:
    """Flat files of 16-bit ids, each text followed by ``end``, cut anywhere, written in the partitions of ``docs``.

    Returns doc_id, part and k (its number within the part) of every document, and
    part, k, path and n (ids) of every file, told apart by the path. The stream is the files in order of part and k. An id
    of 65,536 or more is an error.
    """

    def run(record_batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k, n_file = TaskContext.get().partitionId(), 0, 0
        held: list[np.ndarray] = []

        def rows_of(doc_ids, numbers, paths, counts) -> pa.RecordBatch:
            n = len(numbers)
            columns = [doc_ids, pa.array(np.full(n, part)), pa.array(numbers, pa.int64()), pa.array(paths, pa.string()), pa.array(counts, pa.int64())]
            return pa.RecordBatch.from_arrays(columns, ["doc_id", "part", "k", "path", "n"])

        def flush(whole: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, n_file
            ids = np.concatenate(held) if held else np.zeros(0, DTYPE)
            while len(ids) >= file_tokens or whole and len(ids):
                path, own = f"{out}/part-{part:06d}-{n_file:06d}.bin", ids[:file_tokens]
                files.write(path, [own.tobytes()])
                yield rows_of(pa.nulls(1, pa.int64()), [n_file], [path], [len(own)])
                ids, n_file = ids[file_tokens:], n_file + 1
            held = [ids]

        for batch in record_batches:
            for rows, _, ids in encoded(batch, tokenizer, end):
                if len(ids) and int(ids.max()) > np.iinfo(DTYPE).max:
                    raise ValueError(f"id {int(ids.max())} does not fit files of {DTYPE}")
                held.append(ids.astype(DTYPE))
                if sum(map(len, held)) >= file_tokens:
                    yield from flush(False)
                n = len(rows)
                yield rows_of(rows.column("doc_id"), np.arange(k, k + n), [None] * n, [None] * n)
                k += n
        yield from flush(True)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return saved(rows.mapInArrow(run, "doc_id long, part long, k long, path string, n long"), "flat-docs")


def listed(spark: SparkSession, folder: str, width: int = np.dtype(DTYPE).itemsize) -> DataFrame:
    """part, k, path and n (ids of ``width`` bytes) of a folder's files in order of name, for flat files that no table lists."""
    found = spark.read.format("binaryFile").load(folder).select("path", (F.col("length") / width).cast("long").alias("n"))
    # a part is a range of the sorted names
    return saved(found.orderBy("path").select(F.spark_partition_id().cast("long").alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("k"), "path", "n"), "flat-names")


def scan(stream: DataFrame, end: int, dtype: str = DTYPE, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """doc (number in the stream, from 0) and n_tokens, with its separator, of every document in flat files.

    ``stream`` has part, k, path and n (ids) of each file; in order of part and k
    they are one stream, and a document may span blocks and files. Tokens after
    the last separator are no document. No files, or none with tokens, give no
    rows. Nothing of a file reaches the driver, not its name either.
    """
    blocks = stream.where("n > 0").select("part", "k", "path", "n", F.explode(F.expr(f"sequence(0, (n - 1) div {block_tokens})")).alias("block"))
    blocks = blocks.withColumn("first", F.col("block") * block_tokens).withColumn("n", F.least(F.lit(block_tokens), F.col("n") - F.col("first")))
    size = stream.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    tasks = min(MOST_TASKS, size[0] + size[1] // block_tokens + 1)
    blocks = blocks.repartition(tasks, "part", "k", "block")

    def summarise(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [np.flatnonzero(files.read_ids(p, f, n, dtype) == end) for p, f, n in zip(frame["path"], frame["first"], frame["n"], strict=True)]
            yield frame.assign(ends=[len(x) for x in found], last=pd.array([int(x[-1]) if len(x) else None for x in found], "Int64"))

    summed = saved(blocks.mapInPandas(summarise, "part long, k long, path string, n long, block long, first long, ends long, last long"), "scan-blocks")
    # the prefix scan, first over the parts, then within each: tokens and separators before a block, and where the last of them stands
    parts = carried(summed.groupBy("part").agg(F.sum("n").alias("tokens"), F.sum("ends").alias("seps")), "part", {"token0": "tokens", "sep0": "seps"}).select("part", "token0", "sep0")
    within = W.partitionBy("part").orderBy("k", "block").rowsBetween(W.unboundedPreceding, -1)
    placed = summed.withColumn("_n", F.coalesce(F.sum("n").over(within), F.lit(0))).withColumn("_ends", F.coalesce(F.sum("ends").over(within), F.lit(0))).join(parts, "part")
    placed = placed.withColumn("base", F.col("token0") + F.col("_n")).withColumn("doc0", F.col("sep0") + F.col("_ends"))
    ends = placed.groupBy("part").agg(F.max(F.col("base") + F.col("last")).alias("last_end"))
    open_ = carried(ends, "part", maxima={"open0": "last_end"}).select("part", "open0")
    placed = placed.withColumn("prior", F.max(F.col("base") + F.col("last")).over(within)).join(open_, "part").where("ends > 0")
    placed = placed.select("path", "first", "n", "base", "doc0", F.coalesce("prior", "open0", F.lit(-1)).alias("open"))

    def emit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples():
                at = row.base + np.flatnonzero(files.read_ids(row.path, row.first, row.n, dtype) == end)
                yield pd.DataFrame({"doc": row.doc0 + np.arange(len(at)), "n_tokens": np.diff(at, prepend=row.open)})

    return placed.repartition(tasks, "base").mapInPandas(emit, "doc long, n_tokens long")


def token_counts(docs: DataFrame, tokenizer: str, end: int = 2) -> DataFrame:
    """doc_id and n_tokens (with the end id) of every row of ``docs``, counted by scanning flat token files of them.

    The end id must be one that the tokenizer gives no text; ids must be under
    65,536. Null and empty texts count 1. Rows that repeat a doc_id are documents
    of their own. An empty table gives no rows. Other columns play no part.
    """
    spark = docs.sparkSession
    out = new_path(spark, "flat")
    both = write_flat(docs, tokenizer, out, end)
    written = both.where("path is null")
    parts = carried(written.groupBy("part").agg(F.count("*").alias("docs")), "part", {"doc0": "docs"}).select("part", "doc0")
    numbered = written.join(parts, "part").select("doc_id", (F.col("doc0") + F.col("k")).alias("doc"))
    return numbered.join(scan(both.where("path is not null"), end), "doc").select("doc_id", "n_tokens")
