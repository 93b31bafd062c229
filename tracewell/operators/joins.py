"""Joins on order and distance, built from equi-joins and windows so that none is a nested loop."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def asof(left: DataFrame, right: DataFrame, keys: Sequence[str], at: str, value: str, tie: str, name: str = "asof") -> DataFrame:
    """Each left row with ``value`` of the last right row of its keys at or before it: one union, one sort a key."""
    columns = left.columns
    probe = left.withColumn("_side", F.lit(1)).withColumn("_v", F.lit(None).cast(right.schema[value].dataType))
    build = right.select(*keys, at, tie, F.col(value).alias("_v")).withColumn("_side", F.lit(0))
    both = probe.unionByName(build, allowMissingColumns=True)
    w = W.partitionBy(*keys).orderBy(at, "_side", tie).rowsBetween(W.unboundedPreceding, 0)
    return both.withColumn(name, F.last("_v", ignorenulls=True).over(w)).where("_side = 1").select(*columns, name)


def within(left: DataFrame, right: DataFrame, keys: Sequence[str], at: str, radius: float) -> DataFrame:
    """Pairs of rows of equal keys at most ``radius`` apart: both sides are dealt to bins of that width, and
    each left row meets its own bin and the two beside it."""
    binned = right.select(*keys, *[F.col(c).alias(f"r_{c}") for c in right.columns if c not in keys]).withColumn("_bin", F.floor(F.col(f"r_{at}") / radius))
    spread = left.withColumn("_bin", F.explode(F.array(*[F.floor(F.col(at) / radius) + k for k in (-1, 0, 1)])))
    return spread.join(binned, [*keys, "_bin"]).where(F.abs(F.col(at) - F.col(f"r_{at}")) <= radius).drop("_bin")


def interpolated(left: DataFrame, right: DataFrame, keys: Sequence[str], at: str, value: str, name: str = "interp") -> DataFrame:
    """The right series, as a line through its samples, at the left rows' places; held at its ends."""
    columns = left.columns
    probe = left.withColumn("_side", F.lit(1))
    build = right.select(*keys, F.col(at), F.struct(F.col(at).alias("x"), F.col(value).alias("y")).alias("_p")).withColumn("_side", F.lit(0))
    both = probe.unionByName(build, allowMissingColumns=True)
    up = W.partitionBy(*keys).orderBy(at, "_side").rowsBetween(W.unboundedPreceding, 0)
    down = W.partitionBy(*keys).orderBy(F.desc(at), "_side").rowsBetween(W.unboundedPreceding, 0)
    both = both.withColumn("_a", F.last("_p", ignorenulls=True).over(up)).withColumn("_b", F.last("_p", ignorenulls=True).over(down))
    line = F.when(F.col("_b.x") == F.col("_a.x"), F.col("_a.y")).otherwise(F.col("_a.y") + (F.col("_b.y") - F.col("_a.y")) * (F.col(at) - F.col("_a.x")) / (F.col("_b.x") - F.col("_a.x")))
    y = F.when(F.col("_a").isNull(), F.col("_b.y")).when(F.col("_b").isNull(), F.col("_a.y")).otherwise(line)
    return both.withColumn(name, y).where("_side = 1").select(*columns, name)


def nearest(points: DataFrame, centers: DataFrame, distance, center_id: str, *, most_centers: int = 10_000) -> DataFrame:
    """Each point with the id of its nearest center (ties: the smaller id) and the distance.

    ``centers`` is a small dimension table (lanes, cells); its rows are counted,
    and it goes out as one array, so each point keeps one row throughout.
    """
    n = centers.count()
    if n > most_centers:
        raise ValueError(f"{n} centers; a dimension table of at most {most_centers} is meant here")
    held = centers.agg(F.collect_list(F.struct(*centers.columns)).alias("_centers"))
    best = F.array_min(F.transform("_centers", lambda c: F.struct(distance(c).alias("d"), c[center_id].alias("id"))))
    return points.join(F.broadcast(held)).withColumn("_best", best).withColumn("nearest_id", F.col("_best.id")).withColumn("nearest_d", F.col("_best.d")).drop("_best", "_centers")
