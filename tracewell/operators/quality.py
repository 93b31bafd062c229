"""Checks of recordings: statistics of channels, rule flags and lead laws."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import signal as S

LIMB = ("I", "II", "III", "aVR", "aVL", "aVF")
CHEST = ("V1", "V2", "V3", "V4", "V5", "V6")
RATES, LEAD_COUNTS = (100, 250, 500, 1000), (6, 12)


def channel_stats(df: DataFrame, keys: Sequence[str], value: str, flat: float = 1e-4, far: float = 50.0) -> DataFrame:
    """Count, moments, range and flags of each channel, in one pass of partial aggregation but for the median."""
    v = F.col(value)
    g = df.groupBy(*keys).agg(
        F.count(v).alias("n"),
        F.avg(v).alias("mean"),
        F.stddev_samp(v).alias("std_samp"),
        F.stddev_pop(v).alias("std_pop"),
        F.median(v).alias("median"),
        F.min(v).alias("lo"),
        F.max(v).alias("hi"),
        F.count_if(F.isnan(v) | (F.abs(v) == F.lit(float("inf")))).alias("n_bad"),
    )
    g = g.withColumn("ptp", F.col("hi") - F.col("lo")).withColumn("flat", F.coalesce(F.col("std_pop") < flat, F.lit(True)))
    g = g.withColumn("far", F.greatest(F.abs("lo"), F.abs("hi")) > far)
    status = F.when((F.col("n_bad") > 0) | (F.col("n") == 0), "FAIL").when(F.col("flat") | F.col("far"), "WARN").otherwise("OK")
    return g.withColumn("status", status)


def missing(channels: Column, expected: Sequence[str]) -> Column:
    return F.array_except(F.array(*map(F.lit, expected)), channels)


def lead_laws(df: DataFrame, leads: dict[str, str], tolerance: float = 0.10) -> DataFrame:
    """Residuals of the limb leads' laws: II = I + III, aVR = -(I + II) / 2, aVL = I - II / 2, aVF = II - I / 2.

    ``leads`` names the array column of each limb lead. Adds rmse of the four,
    worst and status: skip where a lead is missing or has 5 samples or fewer.
    """
    x = {k: F.col(c) for k, c in leads.items()}
    laws = {
        "rmse_iii": (x["III"], S.combined(x["II"], x["I"], 1.0, -1.0)),
        "rmse_avr": (x["aVR"], S.combined(x["I"], x["II"], -0.5, -0.5)),
        "rmse_avl": (x["aVL"], S.combined(x["I"], x["II"], 1.0, -0.5)),
        "rmse_avf": (x["aVF"], S.combined(x["II"], x["I"], 1.0, -0.5)),
    }
    whole = F.least(*[F.coalesce(F.size(c), F.lit(-1)) for c in x.values()]) > 5
    for name, (got, law) in laws.items():
        df = df.withColumn(name, F.when(whole, S.rms(S.combined(got, law, 1.0, -1.0))))
    df = df.withColumn("worst", F.greatest(*laws))
    return df.withColumn("status", F.when(~whole, "skip").when(F.col("worst") <= tolerance, "OK").otherwise("REVIEW"))


def derived_leads(i: Column, ii: Column, least_std: float = 0.03) -> dict[str, Column]:
    """III, aVR, aVL and aVF from I and II, centered on their medians, where both vary enough."""
    ok = (S.std_pop(i) > least_std) & (S.std_pop(ii) > least_std)
    a, b = S.centered(i), S.centered(ii)
    made = {"III": S.combined(b, a, 1.0, -1.0), "aVR": S.combined(a, b, -0.5, -0.5), "aVL": S.combined(a, b, 1.0, -0.5), "aVF": S.combined(b, a, 1.0, -0.5)}
    return {k: F.when(ok, v) for k, v in made.items()}


def verified(records: DataFrame) -> DataFrame:
    """errors, warnings and status of universal records, by rules on required fields, rates, lead sets, sample counts and values."""
    names, sig = F.map_keys("leads"), F.map_values("leads")
    n_expected = (F.col("sampling_rate") * F.col("duration_sec")).cast("long")
    rule = lambda cond, text: F.when(F.coalesce(cond, F.lit(False)), F.lit(text))
    errors = F.array_compact(
        F.array(
            rule(F.col("leads").isNull() | (F.size("leads") == 0), "no leads"),
            rule(F.col("sampling_rate").isNull(), "no sampling_rate"),
            rule(F.col("duration_sec").isNull(), "no duration_sec"),
            rule(F.exists(sig, lambda s: F.exists(s, lambda v: F.isnan(v) | (F.abs(v) == float("inf")))), "values not finite"),
            rule(F.size(missing(names, LIMB)) > 0, "limb leads missing"),
        )
    )
    warnings = F.array_compact(
        F.array(
            rule(~F.col("sampling_rate").isin(*RATES), "unusual sampling_rate"),
            rule(~F.col("num_leads").isin(*LEAD_COUNTS), "unusual num_leads"),
            rule(F.exists(sig, lambda s: F.abs(F.size(s) - n_expected) > 20), "sample count off"),
            rule(F.exists(sig, lambda s: F.array_max(F.transform(s, F.abs)) > 50), "values out of range"),
        )
    )
    out = records.withColumn("errors", errors).withColumn("warnings", warnings)
    return out.withColumn("status", F.when(F.size("errors") > 0, "FAIL").when(F.size("warnings") > 0, "WARN").otherwise("OK"))


def low_confidence(stats: DataFrame, record: str, beats: str, flat_share: str) -> DataFrame:
    """Leads whose beat count strays from the record's median beats (over leads that have any), or whose baseline is too flat or too busy."""
    mid = F.median(F.when(F.col(beats) > 0, F.col(beats))).over(W.partitionBy(record)).cast("int")
    out = stats.withColumn("_mid", mid)
    strays = F.abs(F.col(beats) - F.col("_mid")) > F.greatest(F.lit(2.0), 0.35 * F.col("_mid"))
    flag = F.coalesce(strays, F.lit(True)) | (F.col(flat_share) > 0.985) | (F.col(flat_share) < 0.55)
    return out.withColumn("low_confidence", flag).drop("_mid")


def flat_share(df: DataFrame, keys: Sequence[str], value: str, within: float = 0.15) -> DataFrame:
    mid = F.median(value).over(W.partitionBy(*keys))
    return df.withColumn("_mid", mid).groupBy(*keys).agg(F.avg((F.abs(F.col(value) - F.col("_mid")) < within).cast("double")).alias("flat_share"))
