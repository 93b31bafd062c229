"""Ingest as a stream: new files of a folder become records, good ones and errors apart."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def watched(spark: SparkSession, folder: str, schema: str, fmt: str = "json", files_a_batch: int = 100) -> DataFrame:
    """New files of a folder; the checkpoint of the query that reads them keeps each from being taken twice."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).format(fmt).load(folder)


def ingest(stream: DataFrame, parse: Callable[[DataFrame], DataFrame], ok_path: str, error_path: str, checkpoint: str, *, drain: bool = False, every: str = "3 seconds") -> StreamingQuery:
    """Parse each batch and route its rows by their ``error``; ``drain`` takes what is there and stops.

    A batch that is run again after a failure overwrites its own folder, so its
    rows are there once.
    """

    def batch(df: DataFrame, n: int) -> None:
        parsed = parse(df).persist()
        try:
            parsed.where("error is null").drop("error").write.mode("overwrite").parquet(f"{ok_path}/batch={n}")
            parsed.where("error is not null").write.mode("overwrite").json(f"{error_path}/batch={n}")
        finally:
            parsed.unpersist()

    w = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if drain else w.trigger(processingTime=every)).start()


def settled(listings: DataFrame, path: str, size: str, seen: str, still: float) -> DataFrame:
    """path (text), size and ready_at of files that are whole: whose size has stood for ``still`` seconds between listings.

    ``listings`` is a stream of rows that say what size a file had when it was
    seen, in order of time for each file. A file passes once, at the first listing
    that far from the first of the same size; if its size changes later, it may
    pass again. State holds one size and time for each file.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, since, passed = state.get if state.exists else (None, 0, False)
        out = []
        for x, at in pd.concat(list(frames)).sort_values(["_at", "_size"])[["_size", "_at"]].itertuples(index=False):
            if held is None or x != held:
                held, since, passed = x, at, False
            elif not passed and at - since >= still * 1e6:
                out.append((key[0], x, at))
                passed = True
        state.update((int(held), int(since), bool(passed)))
        yield pd.DataFrame(out, columns=["path", "size", "ready_at"])

    rows = listings.select(F.col(path).cast("string").alias("path"), F.col(size).cast("long").alias("_size"), F.unix_micros(F.col(seen).cast("timestamp")).alias("_at")).where("path is not null and _size is not null and _at is not null")
    out = rows.groupBy("path").applyInPandasWithState(run, "path string, size long, ready_at long", "held long, since long, passed boolean", "append", GroupStateTimeout.NoTimeout)
    return out.withColumn("ready_at", F.timestamp_micros("ready_at"))


def windowed(stream: DataFrame, at: str, keys: list[str], value: str, width: str, late: str) -> DataFrame:
    """Count and sum for each window and key; rows later than ``late`` are dropped, and state with them."""
    return stream.withWatermark(at, late).groupBy(F.window(at, width), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"))


def deduplicated(stream: DataFrame, at: str, keys: list[str], late: str) -> DataFrame:
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)
