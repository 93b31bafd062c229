"""Does a rebuilt signal keep what a reader looks at: beats, heart rates, and how metrics answer to noise."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import joins
from . import sequence as seq

Cols = Sequence[str]


def _ptp_around(centers: DataFrame, series: DataFrame, keys: Cols, beat: str, at: str, index: str, value: str, half: int, name: str) -> DataFrame:
    """keys, beat and the range of the series from ``half`` samples before ``at`` up to, but not with, as many after."""
    own = series.select(*keys, F.col(index).alias(at), F.col(value).alias("v"))
    met = joins.within(centers.select(*keys, beat, at), own, keys, at, half).where(F.col(f"r_{at}") < F.col(at) + half)
    return met.groupBy(*keys, beat).agg((F.max("r_v") - F.min("r_v")).alias(name))


def beat_distortion(test: DataFrame, ref: DataFrame, keys: Cols, index: str, value: str, ratio: float, window: int, half_ref: int, half_test: int, refractory: int) -> DataFrame:
    """keys, beats and wdd (%): how far the beats' usual height in ``test`` is from that in ``ref``.

    Beats are found in ``test``; each is matched to the sample of ``ref`` furthest
    from the median of ``window`` samples around (``ratio`` samples of ref to one
    of test). Heights are ranges around the two places, and wdd is the root mean
    square of the relative errors of rate and median height, where the rate's is 0
    as matched beats share it. Null with under two beats, as found or as matched.
    """
    found = seq.threshold_peak_rows(test, keys, index, value, refractory=refractory).withColumnRenamed("at", "_beat")
    aimed = found.withColumn("_at", F.rint(F.col("_beat") * ratio).cast("long"))
    samples = ref.select(*keys, F.col(index).cast("long").alias("_at"), F.col(value).alias("v"))
    met = joins.within(aimed, samples, keys, "_at", window).where(F.col("r__at") < F.col("_at") + window)
    met = met.withColumn("_mid", F.median("r_v").over(W.partitionBy(*keys, "_beat")))
    centers = met.groupBy(*keys, "_beat").agg(F.min_by("r__at", F.struct(-F.abs(F.col("r_v") - F.col("_mid")), F.col("r__at"))).alias("_center"))
    of_ref = _ptp_around(centers, ref, keys, "_beat", "_center", index, value, half_ref, "_ref")
    of_test = _ptp_around(centers.withColumn("_own", F.col("_beat")), test, keys, "_beat", "_own", index, value, half_test, "_test")
    usual = of_ref.join(of_test, [*keys, "_beat"]).groupBy(*keys).agg(F.count("*").alias("beats"), F.median("_ref").alias("_r"), F.median("_test").alias("_t"))
    error = (F.col("_r") - F.col("_t")) / F.greatest(F.abs("_r"), F.lit(1e-3))
    all_ = test.select(*keys).distinct().join(usual, list(keys), "left")
    return all_.select(*keys, F.coalesce("beats", F.lit(0)).alias("beats"), F.when(F.col("beats") >= 2, 100 * F.sqrt(error * error / 2)).alias("wdd"))


def _uniform(text: Column, part: int) -> Column:
    """A number in (0, 1) from eight hexadecimal digits of the text's md5."""
    return (F.conv(F.substring(F.md5(text), 1 + 8 * part, 8), 16, 10).cast("double") + 0.5) / float(1 << 32)


def normal(*key: Column) -> Column:
    """A standard normal number that follows from the key alone, the same in every run and partition."""
    text = F.concat_ws(":", *[k.cast("string") for k in key])
    return F.sqrt(-2 * F.log(_uniform(text, 0))) * F.cos(2 * F.pi() * _uniform(text, 1))


def noised(df: DataFrame, array: str, key: str, levels: Sequence[tuple[str, float, float]], seed: int = 0) -> DataFrame:
    """A row for each row and level (name, deviation, gain): level and noised, the array times the gain with normal noise of that deviation."""
    wide = df.withColumn("_level", F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(float(s)).alias("sd"), F.lit(float(g)).alias("gain")) for n, s, g in levels])))
    noise = lambda v, i: v * F.col("_level.gain") + F.col("_level.sd") * normal(F.lit(seed), F.col("_level.name"), F.col(key), i)
    return wide.withColumn("level", F.col("_level.name")).withColumn("noised", F.transform(array, noise)).drop("_level")


def chosen_rate(rates: DataFrame, keys: Cols, lead: str, rate: str, priority: Sequence[str], low: float = 25, high: float = 220) -> DataFrame:
    """keys, lead and rate of the first lead by priority whose rate lies between the limits."""
    place = F.array_position(F.array(*map(F.lit, priority)), F.col(lead))
    fit = (place > 0) & (F.col(rate) > low) & (F.col(rate) < high)
    return rates.groupBy(*keys).agg(F.min_by(F.struct(F.col(lead), F.col(rate)), F.when(fit, place)).alias("_c")).select(*keys, "_c.*")


def amplitudes(samples: DataFrame, keys: Cols, lead: str, value: str, up: str = "V5", down: str = "V1") -> DataFrame:
    """keys, rise (largest less median of lead ``up``) and fall (median less smallest of lead ``down``)."""
    of = lambda name: F.when(F.col(lead) == name, F.col(value))
    return samples.groupBy(*keys).agg((F.max(of(up)) - F.median(of(up))).alias("rise"), (F.median(of(down)) - F.min(of(down))).alias("fall"))


def compared(printed: DataFrame, measured: DataFrame, keys: Cols, params: Sequence[tuple[str, str]]) -> DataFrame:
    """A row for each key and param (name, unit): printed, measured and the size of their difference (null where either is)."""
    both = printed.select(*keys, F.struct(*[F.col(p).cast("double").alias(p) for p, _ in params]).alias("_p")).join(measured.select(*keys, F.struct(*[F.col(p).cast("double").alias(p) for p, _ in params]).alias("_m")), list(keys), "full")
    rows = F.array(*[F.struct(F.lit(p).alias("param"), F.lit(u).alias("unit"), F.col(f"_p.{p}").alias("printed"), F.col(f"_m.{p}").alias("measured")) for p, u in params])
    return both.select(*keys, F.explode(rows).alias("_r")).select(*keys, "_r.*").withColumn("error", F.abs(F.col("printed") - F.col("measured")))


def agreement(errors: DataFrame, error: str, consistent: str) -> DataFrame:
    """One row: mean error, shares of errors of at most 5 and 10, rows that tell of consistency, consistent ones and their share."""
    e = F.col(error)
    known = errors.agg(F.count(e).alias("n"), F.avg(e).alias("mae"), F.avg(F.when(e.isNotNull(), (e <= 5).cast("int"))).alias("within_5"), F.avg(F.when(e.isNotNull(), (e <= 10).cast("int"))).alias("within_10"), F.count(consistent).alias("judged"), F.count_if(consistent).alias("consistent"))
    return known.withColumn("consistency", F.col("consistent") / F.greatest(F.col("judged"), F.lit(1)))
