"""Operators on ordered samples: each takes a long-form frame, the columns that
part it into series (``keys``), a total order and a value column, and works with
windows over one series at a time."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

Cols = Sequence[str]
#: a series whose threshold is under this has no beats
FLAT = 1e-6
#: rows of an island that is folded as one array
FOLD = 256


def _by(keys: Cols, order: Cols):
    return W.partitionBy(*keys).orderBy(*order)


def numbered(df: DataFrame, keys: Cols, order: Cols, name: str = "i") -> DataFrame:
    """Sample numbers from 0."""
    return df.withColumn(name, F.row_number().over(_by(keys, order)) - 1)


def time_axis(df: DataFrame, fs: float, index: str = "i") -> DataFrame:
    return df.withColumn("t_sec", F.col(index) / F.lit(float(fs)))


def first_difference(df: DataFrame, keys: Cols, order: Cols, value: str, name: str = "diff") -> DataFrame:
    """x[i] - x[i-1]; null at a series' start."""
    return df.withColumn(name, F.col(value) - F.lag(value).over(_by(keys, order)))


def moving_mean(df: DataFrame, keys: Cols, order: Cols, value: str, taps: int, name: str = "smooth") -> DataFrame:
    """Mean over ``taps`` samples around each one, as if zeros stood beyond the ends."""
    half = taps // 2
    frame = _by(keys, order).rowsBetween(-half, half)
    return df.withColumn(name, F.sum(value).over(frame) / taps)


def rolling_median(df: DataFrame, keys: Cols, order: Cols, value: str, half: int, name: str = "median") -> DataFrame:
    """Median of up to 2 * half + 1 samples; the window is shorter at the ends."""
    return df.withColumn(name, F.percentile(value, F.lit(0.5)).over(_by(keys, order).rowsBetween(-half, half)))


def runs(df: DataFrame, keys: Cols, index: str, flag: Column, merge_gap: int = 0, min_length: int = 1) -> DataFrame:
    """start, stop (exclusive) and length of runs of true flags, after joining runs at most ``merge_gap`` apart."""
    hits = df.where(flag)
    w = _by(keys, [index])
    opened = F.when(F.col(index) - F.lag(index).over(w) <= merge_gap + 1, 0).otherwise(1)
    hits = hits.withColumn("_opens", opened).withColumn("_run", F.sum("_opens").over(w))
    out = hits.groupBy(*keys, "_run").agg(F.min(index).alias("start"), (F.max(index) + 1).alias("stop"))
    out = out.withColumn("length", F.col("stop") - F.col("start"))
    return out.where(F.col("length") >= min_length).drop("_run")


def clusters(df: DataFrame, keys: Cols, at: str, gap: float, *, tie: Cols = ()) -> DataFrame:
    """lo, hi and size of groups of values in which neighbours are at most ``gap`` apart."""
    w = _by(keys, [at, *tie])
    opens = F.when(F.col(at) - F.lag(at).over(w) <= gap, 0).otherwise(1)
    marked = df.withColumn("_opens", opens).withColumn("_group", F.sum("_opens").over(w))
    return marked.groupBy(*keys, "_group").agg(F.min(at).alias("lo"), F.max(at).alias("hi"), F.count("*").alias("size")).drop("_group")


def forward_fill(df: DataFrame, keys: Cols, order: Cols, value: str, name: str = "filled") -> DataFrame:
    held = F.last(value, ignorenulls=True).over(_by(keys, order).rowsBetween(W.unboundedPreceding, 0))
    return df.withColumn(name, held)


def lerp_fill(df: DataFrame, keys: Cols, index: str, value: str, name: str = "filled") -> DataFrame:
    """Nulls take the line between the known samples around them, or the nearest known one at the ends."""
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(index).alias("i"), F.col(value).alias("v")))
    w = _by(keys, [index])
    before = F.last(known, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))
    after = F.first(known, ignorenulls=True).over(w.rowsBetween(0, W.unboundedFollowing))
    df = df.withColumn("_a", before).withColumn("_b", after)
    line = F.col("_a.v") + (F.col("_b.v") - F.col("_a.v")) * (F.col(index) - F.col("_a.i")) / (F.col("_b.i") - F.col("_a.i"))
    filled = F.coalesce(value, F.when(F.col("_a").isNull(), F.col("_b.v")).when(F.col("_b").isNull(), F.col("_a.v")).otherwise(line))
    return df.withColumn(name, filled).drop("_a", "_b")


def despiked(df: DataFrame, keys: Cols, index: str, value: str, k: float, name: str = "clean") -> DataFrame:
    """Samples further than k median absolute deviations from the series' median are put on the line between their neighbours."""
    series = W.partitionBy(*keys)
    df = df.withColumn("_mid", F.median(value).over(series)).withColumn("_off", F.abs(F.col(value) - F.col("_mid")))
    df = df.withColumn("_mad", F.median("_off").over(series)).withColumn("_kept", F.when(F.col("_off") <= k * F.col("_mad"), F.col(value)))
    return lerp_fill(df, keys, index, "_kept", name).drop("_mid", "_off", "_mad", "_kept")


def spike_runs_replaced(df: DataFrame, keys: Cols, index: str, value: str, half: int, limit: float, longest: int, name: str = "clean") -> DataFrame:
    """Runs of at most ``longest`` samples further than ``limit`` from the rolling median go to the line between their neighbours."""
    df = rolling_median(df, keys, [index], value, half, "_med")
    w = _by(keys, [index])
    df = df.withColumn("_bad", F.abs(F.col(value) - F.col("_med")) > limit)
    df = df.withColumn("_flip", F.when(F.col("_bad") == F.lag("_bad").over(w), 0).otherwise(1)).withColumn("_run", F.sum("_flip").over(w))
    df = df.withColumn("_len", F.count("*").over(W.partitionBy(*keys, "_run")))
    df = df.withColumn("_kept", F.when(~(F.col("_bad") & (F.col("_len") <= longest)), F.col(value)))
    return lerp_fill(df, keys, index, "_kept", name).drop("_med", "_bad", "_flip", "_run", "_len", "_kept")


def local_peaks(df: DataFrame, keys: Cols, order: Cols, value: str, height: float | None = None) -> DataFrame:
    """Samples above both neighbours (ends are none), and at least ``height``."""
    w = _by(keys, order)
    df = df.withColumn("_p", F.lag(value).over(w)).withColumn("_n", F.lead(value).over(w))
    top = (F.col(value) > F.col("_p")) & (F.col(value) > F.col("_n"))
    return df.where(top if height is None else top & (F.col(value) >= height)).drop("_p", "_n")


def _folded(df: DataFrame, keys: Cols, at: str, gap: float, fold: Column, stream) -> DataFrame:
    """keys and ``at``: what is left of each island, a run of values in which neighbours are under ``gap`` apart.

    Islands of up to FOLD rows are folded as arrays by ``fold``, of _island, where
    their series are; longer ones go to tasks of their own, in order, and stream
    through ``stream``, which gets keys, ``at`` and _opens, true for the first row of each.
    """
    w = _by(keys, [at])
    opens = F.coalesce(F.col(at) - F.lag(at).over(w) >= gap, F.lit(True))
    marked = df.select(*keys, at).where(F.col(at).isNotNull()).withColumn("_opens", opens).withColumn("_no", F.sum(F.col("_opens").cast("long")).over(w.rowsBetween(W.unboundedPreceding, 0)))
    marked = marked.withColumn("_size", F.count("*").over(W.partitionBy(*keys, "_no")))
    small = marked.where(F.col("_size") <= FOLD).groupBy(*keys, "_no").agg(F.array_sort(F.collect_list(at)).alias("_island"))
    long = marked.where(F.col("_size") > FOLD).repartition(*keys, "_no").sortWithinPartitions(*keys, "_no", at).select(*keys, at, "_opens")
    return small.select(*keys, F.explode(fold).alias(at)).unionByName(long.mapInArrow(stream, long.drop("_opens").schema))


def spaced_rows(candidates: DataFrame, keys: Cols, index: str, distance: int) -> DataFrame:
    """keys and index (long) of the candidates kept from left to right, each at least ``distance`` after the last one kept.

    A candidate that far after the one before is kept whatever came earlier, so
    islands between such candidates stand alone; within one, the last one kept is
    the only state.
    """
    whole = candidates.withColumn(index, F.col(index).cast("long"))
    start = F.struct(F.lit(None).cast("long").alias("last"), F.array().cast("array<long>").alias("kept"))
    keep = lambda acc, x: F.when(acc["last"].isNull() | (x - acc["last"] >= distance), F.struct(x.alias("last"), F.array_append(acc["kept"], x).alias("kept"))).otherwise(acc)
    fold = F.aggregate("_island", start, keep)["kept"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = 0
        for batch in batches:
            keep = []
            for x, opens in zip(batch.column(index).to_pylist(), batch.column("_opens").to_pylist(), strict=True):
                keep.append(opens or x - last >= distance)
                last = x if keep[-1] else last
            yield batch.filter(pa.array(keep, pa.bool_())).select([*keys, index])

    return _folded(whole, keys, index, distance, fold, run)


def spaced(candidates: DataFrame, keys: Cols, index: str, distance: int) -> DataFrame:
    """kept: spaced_rows() as an array for each series."""
    rows = spaced_rows(candidates, keys, index, distance)
    return rows.groupBy(*keys).agg(F.array_sort(F.collect_list(index)).alias("kept"))


def threshold_peak_rows(df: DataFrame, keys: Cols, index: str, value: str, share: float = 0.5, group_gap: int = 2, refractory: int = 0) -> DataFrame:
    """The highest sample of each group above ``share`` of the series' largest magnitude; later groups within ``refractory`` of a kept one go.

    A series with no sample above that, one of negative waves, is taken by magnitude. A flat one (that share under FLAT) has no beats.
    """
    series = W.partitionBy(*keys)
    top = df.withColumn("_max", F.max(F.abs(value)).over(series)).withColumn("_hi", F.max(value).over(series))
    top = top.withColumn("_x", F.when(F.col("_hi") > share * F.col("_max"), F.col(value)).otherwise(F.abs(value)))
    top = top.where((share * F.col("_max") >= FLAT) & (F.col("_x") > share * F.col("_max")))
    w = _by(keys, [index])
    top = top.withColumn("_opens", F.when(F.col(index) - F.lag(index).over(w) <= group_gap, 0).otherwise(1)).withColumn("_group", F.sum("_opens").over(w))
    best = top.groupBy(*keys, "_group").agg(F.min_by(index, F.struct(-F.col("_x"), F.col(index))).alias("at"))
    return spaced_rows(best, keys, "at", refractory)


def threshold_peaks(df: DataFrame, keys: Cols, index: str, value: str, share: float = 0.5, group_gap: int = 2, refractory: int = 0) -> DataFrame:
    """kept: threshold_peak_rows() as an array for each series."""
    rows = threshold_peak_rows(df, keys, index, value, share, group_gap, refractory)
    return rows.groupBy(*keys).agg(F.array_sort(F.collect_list("at")).alias("kept"))


def midpoints(df: DataFrame, keys: Cols, order: Cols, center: str) -> DataFrame:
    """lo and hi half-way to the neighbouring centers; open (null) at the ends."""
    w = _by(keys, order)
    return df.withColumn("lo", (F.lag(center).over(w) + F.col(center)) / 2).withColumn("hi", (F.col(center) + F.lead(center).over(w)) / 2)


def above_share(df: DataFrame, keys: Cols, value: str, share: float, name: str = "above") -> DataFrame:
    return df.withColumn(name, F.col(value) > share * F.max(value).over(W.partitionBy(*keys)))


def first_wide_gap(df: DataFrame, keys: Cols, order: Cols, at: str, factor: float) -> DataFrame:
    """The number of the first gap over ``factor`` times the series' median gap (null if none)."""
    gaps = numbered(first_difference(df, keys, order, at, "_gap").where("_gap is not null"), keys, order, "gap_no")
    gaps = gaps.withColumn("_mid", F.median("_gap").over(W.partitionBy(*keys)))
    return gaps.groupBy(*keys).agg(F.min(F.when(F.col("_gap") > factor * F.col("_mid"), F.col("gap_no"))).alias("split"))


def even_chain(df: DataFrame, keys: Cols, at: str, tolerance: float = 0.3) -> DataFrame:
    """start, stop and members of the longest chain whose gaps stay within ``tolerance`` of the median gap; the first of equals."""
    w = _by(keys, [at])
    g = df.withColumn("_gap", F.col(at) - F.lag(at).over(w)).withColumn("_mid", F.median("_gap").over(W.partitionBy(*keys)))
    g = g.withColumn("_opens", F.when(F.abs(F.col("_gap") - F.col("_mid")) <= tolerance * F.col("_mid"), 0).otherwise(1)).withColumn("_chain", F.sum("_opens").over(w))
    each = g.groupBy(*keys, "_chain").agg(F.min(at).alias("start"), F.max(at).alias("stop"), F.count("*").alias("members"))
    best = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("members"), "start"))
    return each.withColumn("_best", best).where("_best = 1").drop("_best", "_chain")


def merged_close_rows(df: DataFrame, keys: Cols, value: str, gap: float) -> DataFrame:
    """keys and value: sorted values, each joined to the one before as their mean while it is under ``gap`` away.

    A mean is never above the last value in it, so a value at least ``gap`` after
    the one before begins anew: islands between such values stand alone.
    """
    whole = df.withColumn(value, F.col(value).cast("double"))
    start = F.struct(F.lit(None).cast("double").alias("mean"), F.array().cast("array<double>").alias("done"))
    closed = lambda acc: F.when(acc["mean"].isNull(), acc["done"]).otherwise(F.array_append(acc["done"], acc["mean"]))
    merge = lambda acc, x: F.when(acc["mean"].isNull() | (x - acc["mean"] >= gap), F.struct(x.alias("mean"), closed(acc).alias("done"))).otherwise(F.struct(((acc["mean"] + x) / 2).alias("mean"), acc["done"].alias("done")))
    fold = F.aggregate("_island", start, merge, closed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, mean = None, 0.0  # the keys of the open mean, as one row
        for batch in batches:
            head, ends, means = batch.select(list(keys)), [], []
            for k, (x, opens) in enumerate(zip(batch.column(value).to_pylist(), batch.column("_opens").to_pylist(), strict=True)):
                if opens or x - mean >= gap:
                    if k:
                        ends.append(k - 1)
                        means.append(mean)
                    elif held is not None:
                        yield pa.RecordBatch.from_arrays([*held.columns, pa.array([mean], pa.float64())], names=[*keys, value])
                    mean = x
                else:
                    mean = (mean + x) / 2
            if ends:
                yield pa.RecordBatch.from_arrays([*head.take(pa.array(ends)).columns, pa.array(means, pa.float64())], names=[*keys, value])
            held = head.slice(len(batch) - 1, 1) if len(batch) else held
        if held is not None:
            yield pa.RecordBatch.from_arrays([*held.columns, pa.array([mean], pa.float64())], names=[*keys, value])

    return _folded(whole, keys, value, gap, fold, run)


def merged_close(df: DataFrame, keys: Cols, value: str, gap: float) -> DataFrame:
    """merged: merged_close_rows() as an array for each series."""
    rows = merged_close_rows(df, keys, value, gap)
    return rows.groupBy(*keys).agg(F.array_sort(F.collect_list(value)).alias("merged"))


def momentum_track(arrays: DataFrame, array: str, keep: float = 0.6, clip: float = 22.0, name: str = "tracked") -> DataFrame:
    """A tracker with velocity keep * v + (1 - keep) * step, clipped, over an array; nulls coast on the velocity."""
    start = F.struct(F.col(array)[0].cast("double").alias("y"), F.lit(0.0).alias("v"), F.array().cast("array<double>").alias("out"))

    def step(acc, x):
        v = F.greatest(F.lit(-clip), F.least(F.lit(clip), F.when(x.isNull(), acc["v"]).otherwise(keep * acc["v"] + (1 - keep) * (x - acc["y"]))))
        y = F.when(x.isNull(), acc["y"] + v).otherwise(x)
        return F.struct(y.cast("double").alias("y"), v.cast("double").alias("v"), F.array_append(acc["out"], y.cast("double")).alias("out"))

    return arrays.withColumn(name, F.aggregate(array, start, step, lambda acc: acc["out"]))


def lag_sums(df: DataFrame, keys: Cols, index: str, value: str, lags: int, *more: Column) -> DataFrame:
    """keys, sums and the aggregates ``more`` of each series: sums[k] is that of the centered products x[i] * x[i + k + 1], null without such a pair.

    A sample meets the next ones within its series, by their index, in one window, so nothing is joined or multiplied.
    """
    line = W.partitionBy(*keys).orderBy("_i")
    known = F.col("_i").isNotNull()
    for k in keys:
        known = known & F.col(k).isNotNull()
    mean = F.avg(value).over(line.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    c = df.withColumn("_i", F.col(index).cast("long")).withColumn("_x", F.col(value) - mean)
    ahead = [F.sum("_x").over(line.rangeBetween(k, k)).alias(f"_x{k}") for k in range(1, lags + 1)]
    sums = F.array(*[F.sum(F.when(known, F.col("_x") * F.col(f"_x{k}"))) for k in range(1, lags + 1)])
    return c.select("*", *ahead).groupBy(*keys).agg(sums.alias("sums"), *more)


def autocorrelation(df: DataFrame, keys: Cols, index: str, value: str, lags: int) -> DataFrame:
    """lag and the sum of centered products x[i] * x[i + lag] for lags 1 to ``lags``, where there are any."""
    sums = lag_sums(df, keys, index, value, lags).select(*keys, F.posexplode("sums").alias("lag", "acf"))
    return sums.where(F.col("acf").isNotNull()).withColumn("lag", F.col("lag") + 1)


def decayed(df: DataFrame, keys: Cols, order: Cols, top: int, value: str, position: str) -> DataFrame:
    """The ``top`` strongest samples of each series, in order of position."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(value), *order))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= top).drop("_rank").orderBy(*keys, position)
