"""Operators on drawn traces: points (x, y) of a picture's ink, label and lane
positions, row densities. A record is a picture, so what is gathered in an array
is bounded by a picture's height or width."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import signal as S
from . import kernels
from . import sequence as seq

Cols = Sequence[str]
#: steps of matching labels to traces that one task takes for a record, and tasks that share a record at most
SHARE, PARTS = 1 << 24, 32


def offset_matches(labels: DataFrame, traces: DataFrame, keys: Cols, name: str, at: str, tolerance: float = 45.0) -> DataFrame:
    """keys, offset, matches, error and pairs (of name and trace) of the offset that matches most of a record's labels to
    its traces, then with the least error, then of the first label and trace that propose it.

    Every label and trace propose the offset between them. Under an offset the
    labels choose in order of position, each the nearest trace (ties: the lower)
    that is within ``tolerance`` and not taken. Labels and traces of a record meet
    once, as two arrays, and its offsets are tried where these are; of a large
    record, up to PARTS tasks try a share of them each. Places that are null or
    not finite match nothing.
    """
    finite = lambda c: ~F.isnan(c) & (F.abs(c) < float("inf"))
    place = F.col(at).cast("double")
    label, none = F.struct(place.alias("y"), F.col(name).alias("name")), F.lit(None)
    own = labels.where(finite(place)).select(*keys, label.alias("_label"), none.cast("double").alias("_trace"))
    both = own.unionByName(traces.where(finite(place)).select(*keys, none.cast(own.schema["_label"].dataType).alias("_label"), place.alias("_trace")))
    gathered = both.dropna(subset=list(keys)).groupBy(*keys).agg(F.array_sort(F.collect_list("_label")).alias("_labels"), F.array_sort(F.collect_set("_trace")).alias("_traces"))
    n, m = F.size("_labels").cast("long"), F.size("_traces")
    parts = F.least(F.lit(PARTS), F.ceil(n * n * m / SHARE)).cast("int")
    shares = gathered.where((n > 0) & (m > 0)).withColumn("_parts", parts).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    tried = shares.repartition(*keys, "_part").withColumn("_m", kernels.best_offsets(F.col("_labels.y"), F.col("_traces"), F.col("_part"), F.col("_parts"), tolerance)).where(F.col("_m.rank").isNotNull())
    trace = F.get("_traces", F.col("_m.trace"))
    taken = F.filter(F.zip_with("_labels", "_m.taken", lambda x, t: F.struct(x["name"].alias("name"), F.get("_traces", F.when(t >= 0, t)).alias("trace"))), lambda p: p["trace"].isNotNull())
    found = F.struct((trace - F.get("_labels.y", F.col("_m.label"))).alias("offset"), (-F.col("_m.rank")).alias("matches"), F.col("_m.error").alias("error"), taken.alias("pairs"))
    best = F.min_by(found, F.struct("_m.rank", "_m.error", "_m.label", "_m.trace"))
    return tried.groupBy(*keys).agg(best.alias("_b")).select(*keys, "_b.*")


def followed(points: DataFrame, keys: Cols, x: str, y: str, base: Column, gap: float = 3, most: float = 40.0) -> DataFrame:
    """keys, x and trace: the place of the trace in each column of points, null where the nearest group of points is more than ``most`` from the last place.

    Points of a column at most ``gap`` apart are one group, placed half-way
    between its ends. A lone group is the trace wherever it is; of several, the
    nearest to the last place (ties: the lower) is, if near enough. A trace begins
    at ``base``. As a lone group needs no history, a record is cut there, and what
    is folded over is a run of columns with several groups.
    """
    groups = seq.clusters(points.select(*keys, x, y).distinct(), [*keys, x], y, gap)
    columns = groups.groupBy(*keys, x).agg(F.array_sort(F.collect_list((F.col("lo") + F.col("hi")) / 2)).alias("_groups"))
    w = W.partitionBy(*keys).orderBy(x)
    cut = columns.withColumn("_run", F.sum((F.size("_groups") == 1).cast("long")).over(w))
    runs = cut.groupBy(*keys, "_run").agg(F.array_sort(F.collect_list(F.struct(x, "_groups"))).alias("_columns")).withColumn("_base", base.cast("double"))
    none = F.lit(None).cast("double")

    def step(acc: Column, column: Column) -> Column:
        nearest = F.array_min(F.transform(column["_groups"], lambda c: F.struct(F.abs(c - acc["last"]).alias("d"), c.alias("c"))))
        lone = F.size(column["_groups"]) == 1
        place = F.when(lone, F.get(column["_groups"], F.lit(0))).when(nearest["d"] <= most, nearest["c"])
        return S.let(place, lambda p: F.struct(F.coalesce(p, acc["last"]).alias("last"), F.array_append(acc["out"], p).alias("out")))

    start = F.struct(F.col("_base").alias("last"), F.slice(F.array(none), 1, 0).alias("out"))
    folded = runs.withColumn("_out", F.aggregate("_columns", start, step)["out"])
    return folded.select(*keys, F.explode(F.arrays_zip(F.col(f"_columns.{x}").alias("x"), F.col("_out").alias("trace"))).alias("_p")).select(*keys, F.col("_p.x").alias(x), F.col("_p.trace").alias("trace"))


def unfolded(places: DataFrame, keys: Cols, x: str, base: Column, scale: float, name: str = "mv") -> DataFrame:
    """Every column from a record's first to its last with its height above ``base`` in units of ``scale``; columns without a place lie on the line between those around."""
    ends = places.groupBy(*keys).agg(F.min(x).alias("_lo"), F.max(x).alias("_hi"))
    grid = ends.select(*keys, F.explode(F.sequence("_lo", "_hi")).alias(x))
    filled = seq.lerp_fill(grid.join(places, [*keys, x], "left"), keys, x, "trace")
    return filled.select(*keys, x, ((base - F.col("filled")) / scale).alias(name))


def lanes(density: DataFrame, keys: Cols, y: str, mass: str, taps: int = 7, distance: int = 70, prominence: float = 0.12, height: float = 0.3, jump: float = 1.6) -> DataFrame:
    """keys and lanes: the peaks of a record's density by row, smoothed over ``taps`` rows, with the lane that a crowd hides put back.

    ``density`` has a row for each y from 0 on. Prominence and height are shares
    of the record's highest smoothed value. If six close lanes come before the
    first gap of over ``jump`` times their usual one, and five after it, a lane
    half-way across that gap is added. The usual gap is the median of the smaller
    half of all gaps, two at least. Fewer than six peaks stand as they are.
    """
    smooth = seq.moving_mean(density, keys, [y], mass, taps, "_smooth")
    whole = smooth.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(y, "_smooth"))).alias("_rows")).withColumn("_rows", F.col("_rows._smooth"))
    found = whole.withColumn("_p", kernels.find_peaks_by_share(F.col("_rows"), height, distance, prominence))
    gaps = F.zip_with(F.slice("_p", 2, F.size("_p")), F.slice("_p", 1, F.greatest(F.size("_p") - 1, F.lit(0))), lambda b, a: b - a)
    usual = S.median(F.slice(F.array_sort(F.col("_gaps")), F.lit(1), F.greatest(F.lit(2), F.floor(F.size("_gaps") / 2).cast("int"))).cast("array<double>"))
    split = F.array_position(F.transform("_gaps", lambda g: g > jump * F.col("_usual")), F.lit(True)).cast("int")
    hidden = F.rint((F.get("_p", F.col("_split") - 1) + F.get("_p", F.col("_split"))) / 2).cast("long")
    full = F.concat(F.slice("_p", F.lit(1), F.col("_split")), F.array(hidden), F.slice("_p", F.col("_split") + 1, F.size("_p")))
    found = found.where(F.size("_p") >= 0).withColumn("_gaps", gaps).withColumn("_usual", usual).withColumn("_split", split)
    crowded = (F.size("_p") >= 6) & (F.col("_split") == 6) & (F.size("_p") == 11)
    return found.select(*keys, F.when(crowded, full).otherwise(F.col("_p")).alias("lanes"))


def pulses(points: DataFrame, keys: Cols, x: str, y: str, unit: float, gap: int = 3, low: float = 0.55, high: float = 1.35) -> DataFrame:
    """keys, at, top and height of the calibration pulse: the first column whose longest stroke is between ``low`` and
    ``high`` units tall; null in a record without one.

    Points of a column at most ``gap`` apart are one stroke; of equally long ones the first counts.
    """
    strokes = seq.clusters(points.select(*keys, x, y).distinct(), [*keys, x], y, gap)
    longest = strokes.groupBy(*keys, x).agg(F.min_by(F.struct("lo", "hi"), F.struct(F.col("lo") - F.col("hi"), F.col("lo"))).alias("_s")).withColumn("_h", F.col("_s.hi") - F.col("_s.lo"))
    tall = (F.col("_h") > low * unit) & (F.col("_h") < high * unit)
    return longest.groupBy(*keys).agg(F.min_by(F.struct(F.col(x).alias("at"), F.col("_s.lo").alias("top"), F.col("_h").alias("height")), F.when(tall, F.col(x))).alias("_p")).select(*keys, "_p.*")


def crossing(points: DataFrame, keys: Cols, series: str, first: str, second: str, x: str, y: str, radius: float) -> DataFrame:
    """Where the first series of a record is highest (ties: the least x): at, top, how many points of either series lie within
    ``radius`` of that x, and the second's nearest point to it (ties: the lesser x); nulls without points of the second."""
    own = points.where(F.col(series).isin(first, second) & F.col(x).isNotNull() & F.col(y).isNotNull())
    is_first, is_second = F.col(series) == first, F.col(series) == second
    tops = own.where(is_first).groupBy(*keys).agg(F.min_by(F.struct(F.col(x).alias("at"), F.col(y).alias("top")), F.struct(-F.col(y), F.col(x))).alias("_t")).select(*keys, "_t.*")
    away = F.abs(F.col(x) - F.col("at"))
    nearest = F.min_by(F.struct(F.col(x).alias("x"), F.col(y).alias("y")), F.when(is_second, F.struct(away, F.col(x), F.col(y))))
    met = own.join(tops, list(keys)).groupBy(*keys, "at", "top").agg(F.count_if(is_first & (away <= radius)).alias("near_first"), F.count_if(is_second & (away <= radius)).alias("near_second"), nearest.alias("_n"))
    return met.select(*keys, "at", "top", "near_first", "near_second", F.col("_n.x").alias("second_at"), F.col("_n.y").alias("second_y"), (F.col("top") - F.col("_n.y")).alias("apart"))


def bounds(lanes_: DataFrame, keys: Cols, at: str, least: float, edge: float = 0.55) -> DataFrame:
    """up and down: how far a lane's band reaches to either side, half-way to its neighbours but ``least`` at least.

    The first and the last lane take the gap that they have for the one they lack; the first reaches ``edge`` of it upwards.
    """
    w = W.partitionBy(*keys).orderBy(at)
    before, after = F.col(at) - F.lag(at).over(w), F.lead(at).over(w) - F.col(at)
    both = lanes_.withColumn("_up", F.coalesce(before, after)).withColumn("_down", F.coalesce(after, before)).withColumn("_no", F.row_number().over(w))
    half = lambda c, share=0.5: F.floor(share * F.col(c))
    wide = F.greatest(F.lit(least), half("_up"))
    return both.withColumn("up", F.when(F.col("_no") == 1, F.greatest(wide, half("_down", edge))).otherwise(wide)).withColumn("down", F.greatest(F.lit(least), half("_down"))).drop("_up", "_down", "_no")
