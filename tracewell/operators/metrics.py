"""Fidelity of a rebuilt signal against its reference, and scores of classifiers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import signal as S

EPS = 1e-12


def sums(ref: Column, got: Column) -> dict[str, Column]:
    """Squared error, squared deviation of the reference from its mean, and largest error."""
    n = F.least(F.size(ref), F.size(got))
    r, g = F.slice(ref, 1, n), F.slice(got, 1, n)
    err = F.zip_with(r, g, lambda a, b: a - b)
    return {
        "n": n,
        "sse": S.total(F.transform(err, lambda e: e * e)),
        "ss": S.let(S.mean(r), lambda m: S.total(F.transform(r, lambda v: (v - m) * (v - m)))),
        "maxae": F.array_max(F.transform(err, F.abs)),
    }


def correlation(ref: Column, got: Column, flat: float) -> Column:
    """Pearson's r; ``flat`` where either side doesn't vary."""
    n = F.least(F.size(ref), F.size(got))
    r, g = F.slice(ref, 1, n), F.slice(got, 1, n)
    product = lambda x, y: S.total(F.zip_with(x, y, lambda a, b: a * b))
    both = lambda x, y: S.let(F.struct(product(x, x).alias("xx"), product(y, y).alias("yy"), product(x, y).alias("xy")), lambda p: F.when((p["xx"] > EPS) & (p["yy"] > EPS), p["xy"] / F.sqrt(p["xx"] * p["yy"])).otherwise(F.lit(flat)))
    return S.let(S.centered(r, S.mean), lambda x: S.let(S.centered(g, S.mean), lambda y: both(x, y)))


def fidelity(df: DataFrame, ref: str, got: str, flat_r: float = 1.0) -> DataFrame:
    """rmse, maxae, snr (dB), prd (%) and r of each row's pair of arrays; sums stay for pooling."""
    for name, c in sums(F.col(ref), F.col(got)).items():
        df = df.withColumn(name, c)
    df = df.withColumn("rmse", F.sqrt(F.col("sse") / F.nullif(F.col("n"), F.lit(0))))
    df = df.withColumn("snr", 10 * F.log10((F.col("ss") + EPS) / (F.col("sse") + EPS)))
    df = df.withColumn("prd", 100 * F.sqrt(F.col("sse") / (F.col("ss") + EPS)))
    return df.withColumn("r", correlation(F.col(ref), F.col(got), flat_r))


def snr_both_centered(ref: Column, got: Column) -> Column:
    """SNR after taking each side's own mean off."""
    error = lambda r, g: S.total(F.zip_with(r, g, lambda a, b: (a - b) * (a - b)))
    snr = lambda r, g: 10 * F.log10((S.total(F.transform(r, lambda v: v * v)) + EPS) / (error(r, g) + EPS))
    return S.let(S.centered(ref, S.mean), lambda r: S.let(S.centered(got, S.mean), lambda g: snr(r, g)))


def prd_band(prd: Column) -> Column:
    return F.when(prd < 2, "very good").when(prd < 9, "good").otherwise("review")


def pooled(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The same metrics over all samples of each group: from sums of the rows' sums."""
    g = df.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("sse").alias("sse"), F.sum("ss").alias("ss"), F.max("maxae").alias("maxae"))
    g = g.withColumn("rmse", F.sqrt(F.col("sse") / F.nullif(F.col("n"), F.lit(0))))
    return g.withColumn("prd", 100 * F.sqrt(F.col("sse") / (F.col("ss") + EPS)))


def auc(df: DataFrame, score: str, label: str, keys: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve by average ranks; null for groups of one label.

    Ranks come from counts of each distinct score, so a window holds distinct
    scores only, after partial aggregation.
    """
    at = df.groupBy(*keys, score).agg(F.count("*").alias("c"), F.sum(F.col(label).cast("long")).alias("p"))
    below = F.sum("c").over(W.partitionBy(*keys).orderBy(score)) - F.col("c")
    ranked = at.withColumn("rank", below + (F.col("c") + 1) / 2)
    g = ranked.groupBy(*keys).agg(F.sum(F.col("rank") * F.col("p")).alias("ranks"), F.sum("p").alias("pos"), F.sum(F.col("c") - F.col("p")).alias("neg"))
    value = (F.col("ranks") - F.col("pos") * (F.col("pos") + 1) / 2) / (F.nullif(F.col("pos"), F.lit(0)) * F.nullif(F.col("neg"), F.lit(0)))
    return g.select(*keys, "pos", "neg", value.alias("auc"))


def f1(df: DataFrame, predicted: str, label: str, keys: Sequence[str] = ()) -> DataFrame:
    p, y = F.col(predicted) == 1, F.col(label) == 1
    g = df.groupBy(*keys).agg(F.count_if(p & y).alias("tp"), F.count_if(p & ~y).alias("fp"), F.count_if(~p & y).alias("fn"))
    return g.withColumn("f1", F.when(2 * F.col("tp") + F.col("fp") + F.col("fn") > 0, 2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn"))).otherwise(F.lit(0.0)))


def dice(p: Column, t: Column) -> Column:
    """Smoothed Dice overlap of two masks."""
    both = S.total(F.zip_with(p, t, lambda a, b: a * b))
    return (2 * both + 1) / (S.total(p) + S.total(t) + 1)


def normalised(df: DataFrame, keys: Sequence[str], value: str, train: Column, name: str = "z") -> DataFrame:
    """(x - mean) / (population std + 1e-6), with mean and std of each key's training rows."""
    stats = df.where(train).groupBy(*keys).agg(F.avg(value).alias("_mu"), F.stddev_pop(value).alias("_sd"))
    return df.join(stats, list(keys), "left").withColumn(name, (F.col(value) - F.col("_mu")) / (F.col("_sd") + 1e-6)).drop("_mu", "_sd")
