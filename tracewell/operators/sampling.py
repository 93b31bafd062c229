"""Seeded orders of rows for training."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def grouped_order(df: DataFrame, group: str, order: Sequence[str], seed: int, epoch: int = 0) -> DataFrame:
    """``df`` with slot (its group's number in the epoch's shuffle) and position (its own), both from 0.

    Groups go by a hash of seed, epoch and group, and a group's rows stay together
    in ``order``. Groups are counted first and dealt to 4,096 ranges of hashes, so
    running sums are taken over the ranges and then within each; no task sorts
    all rows or all groups.
    """
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(str(epoch)), F.col(group).cast("string")))
    sizes = df.groupBy(group).agg(F.count("*").alias("_n")).withColumn("_hash", key).withColumn("_range", F.substring("_hash", 1, 3))
    ranges = sizes.groupBy("_range").agg(F.count("*").alias("_groups"), F.sum("_n").alias("_rows"))
    before = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)  # over at most 4,096 rows
    ranges = ranges.select("_range", F.coalesce(F.sum("_groups").over(before), F.lit(0)).alias("_slot0"), F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_row0"))
    within = W.partitionBy("_range").orderBy("_hash", group)
    placed = sizes.withColumn("_slot", F.row_number().over(within) - 1).withColumn("_row", F.sum("_n").over(within.rowsBetween(W.unboundedPreceding, 0)) - F.col("_n"))
    placed = placed.join(F.broadcast(ranges), "_range").select(group, (F.col("_slot0") + F.col("_slot")).alias("slot"), (F.col("_row0") + F.col("_row")).alias("_start"))
    own = F.row_number().over(W.partitionBy(group).orderBy(*order)) - 1
    return df.withColumn("_own", own).join(placed, group).withColumn("position", F.col("_start") + F.col("_own")).drop("_own", "_start")
