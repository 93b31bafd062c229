"""Scale of a drawn record: from its calibration pulse, else from the grid's period, else from its strips' height."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import kernels
from . import sequence as seq

Cols = Sequence[str]


def periods(df: DataFrame, keys: Cols, index: str, value: str, low: int = 4, high: int = 80, prominence: float = 0.05, distance: int = 3) -> DataFrame:
    """keys and period: the least lag in [low, high) at which a series' autocorrelation, as a share of that at lag 0, peaks; null if it nowhere does, or the series is flat."""
    both = seq.lag_sums(df, keys, index, value, high - 1, F.stddev_pop(value).alias("_sd"), F.var_pop(value).alias("_var"), F.count(value).alias("_n"))
    found = F.filter(F.slice("sums", low, high - low), lambda a: a.isNotNull())
    both = both.withColumn("_share", F.transform(found, lambda a: a / (F.col("_var") * F.col("_n") + 1e-9)))
    first = F.get(kernels.find_peaks(F.col("_share"), None, distance, prominence), F.lit(0)) + low
    return both.withColumn("_first", first).select(*keys, F.when(F.col("_sd") >= 1e-6, F.col("_first")).alias("period"))


def smoothed(df: DataFrame, keys: Cols, index: str, value: str, half: int, name: str = "smooth") -> DataFrame:
    """Mean over 2 * half + 1 samples, with the series mirrored at its ends; ``index`` counts from 0."""
    n = F.count("*").over(W.partitionBy(*keys))
    counted = df.withColumn("_n", n).withColumn("_at", F.col(index).cast("long"))
    head = counted.where(F.col("_at") < half).withColumn("_at", -1 - F.col("_at"))
    tail = counted.where(F.col("_at") >= F.col("_n") - half).withColumn("_at", 2 * F.col("_n") - 1 - F.col("_at"))
    whole = counted.unionByName(head).unionByName(tail)
    mean = F.sum(value).over(W.partitionBy(*keys).orderBy("_at").rowsBetween(-half, half)) / (2 * half + 1)
    return whole.withColumn(name, mean).where((F.col("_at") >= 0) & (F.col("_at") < F.col("_n"))).drop("_at", "_n")


def plateaus(df: DataFrame, keys: Cols, index: str, value: str, extent: str, half: int = 1, least: float = 0.04, shortest: int = 10) -> DataFrame:
    """keys and height of each strip's pulse: the mean of what lies above half the highest rise over the strip's base.

    The profile is smoothed first; its base is the median of its first fifth (three
    samples at least). Strips of under ``shortest`` samples, whose rise is under
    ``least`` of their ``extent``, or with under three samples above half of it,
    have none and no row.
    """
    series = W.partitionBy(*keys)
    s = smoothed(df, keys, index, value, half, "_s").withColumn("_n", F.count("*").over(series)).where(F.col("_n") >= shortest)
    s = s.withColumn("_base", F.median(F.when(F.col(index) < F.greatest(F.lit(3), F.floor(F.col("_n") / 5)), F.col("_s"))).over(series))
    s = s.withColumn("_up", F.col("_s") - F.col("_base")).withColumn("_top", F.max("_up").over(series))
    high = F.col("_up") > 0.5 * F.col("_top")
    found = s.groupBy(*keys).agg(F.avg(F.when(high, F.col("_up"))).alias("height"), F.count_if(high).alias("_count"), F.max("_top").alias("_top"), F.max(extent).alias("_extent"))
    return found.where((F.col("_top") >= least * F.col("_extent")) & (F.col("_count") >= 3)).select(*keys, "height")


def calibrated(records: DataFrame, heights: DataFrame, spacings: DataFrame, strips: DataFrame, keys: Cols, columns: int = 1) -> DataFrame:
    """keys, px_per_mv, px_per_sec, method and confidence of every record.

    ``records`` has keys and width, ``heights`` a height for each pulse, ``spacings``
    the grid's periods h and v, ``strips`` lo and hi. A pulse counts first: the
    median height, with a confidence that falls with the heights' spread (0.5 for
    one alone). Then the grid's spacing, the mean of both ways, at 0.7, with ten
    spacings a unit and 25 a second. Then strips of four units, at 0.25; without
    any strip 80 a unit, at 0.15. A method counts if it is sure enough.
    """
    # fixed values: confidences of the methods and the gates they have to pass
    pulse = heights.groupBy(*keys).agg(F.median("height").alias("_height"), F.stddev_pop("height").alias("_sd"), F.count("height").alias("_pulses"))
    agree = 1 - F.least(F.col("_sd") / (F.col("_height") + 1e-9), F.lit(1.0))
    pulse = pulse.withColumn("_sure", F.when(F.col("_pulses") >= 2, F.least(F.lit(0.95), 0.6 + 0.35 * agree)).otherwise(0.5))
    grid = spacings.select(*keys, F.coalesce((F.col("h") + F.col("v")) / 2.0, F.col("h").cast("double"), F.col("v").cast("double")).alias("_grid"))
    tall = strips.groupBy(*keys).agg(F.avg(F.col("hi") - F.col("lo")).alias("_tall"))
    all_ = records.join(pulse, list(keys), "left").join(grid, list(keys), "left").join(tall, list(keys), "left")
    by_pulse, by_grid = F.col("_sure") >= 0.45, F.col("_grid").isNotNull()
    wide = F.col("width") / (10.0 / columns)
    choose = lambda a, b, c: F.when(by_pulse, a).when(by_grid, b).otherwise(c)
    return all_.select(
        *keys,
        choose(F.col("_height"), F.col("_grid") * 10, F.coalesce(F.col("_tall") / 4.0, F.lit(80.0))).alias("px_per_mv"),
        choose(wide, F.col("_grid") * 25, F.col("width") / 10.0).alias("px_per_sec"),
        choose(F.lit("calibration_pulse"), F.lit("grid_spacing"), F.lit("estimated")).alias("method"),
        choose(F.col("_sure"), F.lit(0.7), F.when(F.col("_tall").isNotNull(), 0.25).otherwise(0.15)).alias("confidence"),
    )
