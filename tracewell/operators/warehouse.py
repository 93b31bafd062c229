"""Lookups, integrity checks and list queries of the relational side."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def lookup(df: DataFrame, dim: DataFrame, on: Sequence[str], defaults: dict[str, object]) -> DataFrame:
    """Left join; columns of the dimension that find no row take their defaults."""
    out = df.join(dim, list(on), "left")
    return out.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in defaults.items()})


def orphans(child: DataFrame, parent: DataFrame, fk: str, pk: str) -> DataFrame:
    """Child rows whose (non-null) key no parent has."""
    keys = parent.select(F.col(pk).alias(fk)).distinct()
    return child.where(F.col(fk).isNotNull()).join(keys, fk, "left_anti")


def paired(df: DataFrame, other: DataFrame, on: Sequence[str]) -> DataFrame:
    return df.join(other.select(*on).distinct(), list(on), "left_semi")


def violations(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that more than one row has, and how many."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def searched(df: DataFrame, text: str, columns: Sequence[str], equal: dict[str, str] | None = None) -> DataFrame:
    """Rows that hold ``text`` in one of the columns, whatever the case, and equal every filter that isn't 'all'."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.lower(c).contains(text.lower())
    for c, v in (equal or {}).items():
        if v != "all":
            hit = hit & (F.col(c) == v)
    return df.where(hit)


def visible(df: DataFrame, role: str, user: object, owner: str) -> DataFrame:
    """A patient sees their own rows, staff all."""
    return df.where(F.col(owner) == user) if role == "PATIENT" else df


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def upserted(target: DataFrame, changes: DataFrame, keys: Sequence[str], order: Sequence[Column] = ()) -> DataFrame:
    """``target`` with each key of ``changes`` replaced or added; the last change by ``order`` wins."""
    new = latest(changes, keys, order or [F.lit(1)])
    return target.join(new.select(*keys), list(keys), "left_anti").unionByName(new)


def snapshot_diff(before: DataFrame, after: DataFrame, key: str, stamp: str) -> DataFrame:
    """Keys added, deleted or changed between two snapshots."""
    b, a = before.select(key, F.col(stamp).alias("_b")), after.select(key, F.col(stamp).alias("_a"))
    both = b.withColumn("_in_b", F.lit(True)).join(a.withColumn("_in_a", F.lit(True)), key, "full")
    kind = F.when(F.col("_in_b").isNull(), "added").when(F.col("_in_a").isNull(), "deleted").when(~F.col("_a").eqNullSafe(F.col("_b")), "changed")
    return both.select(key, kind.alias("change")).where("change is not null")


def top_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= n)


def shares(df: DataFrame, category: str, places: int = 2) -> DataFrame:
    """Rows and percent of all rows of each category."""
    g = df.groupBy(category).agg(F.count("*").alias("n"))
    return g.withColumn("percent", F.round(100 * F.col("n") / F.sum("n").over(W.partitionBy()), places))


def described(df: DataFrame, keys: Sequence[str], codes: str, dim: DataFrame, code: str, text: str, sep: str = "; ") -> DataFrame:
    """Texts of an array of codes, joined in code order; codes without a text are passed over."""
    each = df.select(*keys, F.explode(codes).alias(code)).join(dim.select(code, text), code)
    pieces = F.array_sort(F.collect_list(F.struct(code, text)))
    return each.groupBy(*keys).agg(F.array_join(F.transform(pieces, lambda s: s[text]), sep).alias("described"))


def sampled(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows by a seeded hash of the key: the same ones each time."""
    return df.orderBy(F.xxhash64(F.lit(seed), key), key).limit(n)


def split(df: DataFrame, key: str, share: float, seed: int = 0, name: str = "part") -> DataFrame:
    """'train' or 'val', with about ``share`` of the keys in 'val', fixed by a seeded hash."""
    at = F.pmod(F.xxhash64(F.lit(seed), key), F.lit(10_000))
    return df.withColumn(name, F.when(at < int(share * 10_000), "val").otherwise("train"))
