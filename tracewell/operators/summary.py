"""Joins by what a file's name says, sets of classes, and the tables of reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

Cols = Sequence[str]


def base_name(path: Column) -> Column:
    """What follows the last slash or backslash."""
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def name_key(path: Column, digits: int = 5) -> Column:
    """The first ``digits`` digits in a row in a file's name, as a number; null without."""
    return F.nullif(F.regexp_extract(base_name(path), rf"(\d{{{digits}}})", 1), F.lit("")).cast("long")


def stem_before(path: Column, suffix: str) -> Column:
    """A file's name without ``suffix`` at its end; null if it doesn't end so."""
    name = base_name(path)
    return F.when(name.endswith(suffix), F.left(name, F.length(name) - len(suffix)))


def paired(left: DataFrame, right: DataFrame, left_path: str, right_path: str, left_suffix: str, right_suffix: str) -> DataFrame:
    """Pairs of rows whose files have one stem before their suffixes; files without a partner go."""
    a = left.withColumn("stem", stem_before(F.col(left_path), left_suffix)).where("stem is not null")
    b = right.withColumn("stem", stem_before(F.col(right_path), right_suffix)).where("stem is not null")
    return a.join(b, "stem")


def class_sets(codes: DataFrame, mapping: DataFrame, record: str, code: str, name: str, classes: Sequence[str], unknown: str = "UNK") -> DataFrame:
    """record, n_codes, classes (sorted, each once) and hot (1 for each of ``classes`` that is there, else 0).

    ``mapping`` gives codes their class; codes without one, or of a class that is not asked for, count for none, and a record with none has ``unknown``.
    """
    known = codes.join(mapping.select(code, name), code, "left").withColumn("_class", F.when(F.col(name).isin(*classes), F.col(name)))
    sets = known.groupBy(record).agg(F.count(code).alias("n_codes"), F.array_sort(F.collect_set("_class")).alias("_set"))
    hot = F.array(*[F.array_contains("_set", c).cast("int") for c in classes])
    return sets.select(record, "n_codes", F.when(F.size("_set") > 0, F.col("_set")).otherwise(F.array(F.lit(unknown))).alias("classes"), hot.alias("hot"))


def path_details(points: DataFrame, keys: Cols, x: str, y: str, order: Cols, scale: float) -> DataFrame:
    """A row for each path: points, segments, median y, ranges, amplitude in units, and its first three points with their heights over the median."""
    w = W.partitionBy(*keys).orderBy(*order)
    numbered = points.withColumn("_n", F.row_number().over(w))
    first = F.array_sort(F.collect_list(F.when(F.col("_n") <= 3, F.struct("_n", F.col(x).alias("x"), F.col(y).alias("y")))))
    g = numbered.groupBy(*keys).agg(F.count("*").alias("points"), F.median(y).alias("median_y"), F.min(x).alias("x_lo"), F.max(x).alias("x_hi"), F.min(y).alias("y_lo"), F.max(y).alias("y_hi"), first.alias("_first"))
    heights = F.transform("_first", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"), ((F.col("median_y") - p["y"]) / scale).alias("mv")))
    return g.withColumn("segments", F.col("points") - 1).withColumn("amplitude", (F.col("y_hi") - F.col("y_lo")) / scale).withColumn("first3", heights).drop("_first")


def page_totals(pages: DataFrame, file: str, page: str, x: str, per_second: float, fs: float) -> DataFrame:
    """A row for each page of a file with its span, seconds and samples, and one with the file's totals (a null page)."""
    each = pages.groupBy(file, page).agg(F.min(x).alias("x_lo"), F.max(x).alias("x_hi"))
    each = each.withColumn("seconds", (F.col("x_hi") - F.col("x_lo")) / per_second).withColumn("samples", F.rint(F.col("seconds") * fs).cast("long"))
    both = each.rollup(file, page).agg(F.min("x_lo").alias("x_lo"), F.max("x_hi").alias("x_hi"), F.sum("seconds").alias("seconds"), F.sum("samples").alias("samples"), F.grouping(page).cast("int").alias("total"))
    return both.where(F.col(file).isNotNull())


def evaluation(scores: DataFrame, columns: Cols, verdict: str) -> DataFrame:
    """One row: rows, mean and median of each column, and a verdict by the mean of one."""
    aggs = [a for c in columns for a in (F.avg(c).alias(f"mean_{c}"), F.median(c).alias(f"median_{c}"))]
    out = scores.agg(F.count("*").alias("rows"), *aggs)
    v = F.col(f"mean_{verdict}")
    # fixed values: limits of the verdicts
    return out.withColumn("verdict", F.when(v > 0.95, "very good").when(v > 0.85, "good").when(v > 0.7, "fair").otherwise("poor"))


def cell(value: Column, places: int, factor: float = 1.0) -> Column:
    """A number as text with fixed decimals, or a dash for null."""
    return F.coalesce(F.format_string(f"%.{places}f", value * factor), F.lit("-"))


def report_rows(scores: DataFrame, keys: Cols, flat: Column) -> DataFrame:
    """Scores as a report prints them: decibels and per cents, errors in thousandths of the unit, a dash for null; of flat rows only the note."""
    shown = lambda c: F.when(flat, F.lit("")).otherwise(c)
    return scores.select(
        *keys,
        shown(cell(F.col("snr"), 1)).alias("snr"),
        shown(cell(F.col("prd"), 2)).alias("prd"),
        shown(cell(F.col("r"), 5)).alias("r"),
        shown(cell(F.col("rmse"), 2, 1000.0)).alias("rmse"),
        shown(cell(F.col("maxae"), 1, 1000.0)).alias("maxae"),
        F.when(flat, "flat").when(F.col("prd") < 2, "very good").when(F.col("prd") < 9, "good").otherwise("review").alias("band"),
    )
