"""Queries over array signals: a row of ``embeddings`` is a signal of 64 samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import signal as S
from ..operators import joins, metrics, quality
from .registry import query, read

_E = "(SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings)"


def _signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select("vec_id", "label", S.doubles(F.col("embedding")).alias("x"))


def _long(df: DataFrame, *names: str) -> DataFrame:
    """Array columns as rows (vec_id, i, value), rounded for comparison."""
    return df.select("vec_id", F.posexplode(names[0]).alias("i", "v")).select("vec_id", "i", F.round("v", 6).alias("value"))


@query("""
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
k AS (SELECT vec_id, x, k AS i, k * 63 / 99.0 AS pos, least(CAST(floor(k * 63 / 99.0) AS INTEGER), 62) AS lo FROM e, range(100) t(k))
SELECT vec_id, CAST(i AS INTEGER) AS i, round(x[lo + 1] + (x[lo + 2] - x[lo + 1]) * (pos - lo), 6) AS value FROM k""")
def resample_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(_signals(spark, sf_dir).withColumn("y", S.resampled(F.col("x"), 100)), "y")


@query("""
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings)
SELECT vec_id, CAST(k AS INTEGER) AS i, round(x[least(CAST(floor(k * 64 / 20.0 + 0.5) AS INTEGER), 63) + 1], 6) AS value FROM e, range(20) t(k)""")
def decimate_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(_signals(spark, sf_dir).withColumn("y", S.decimated(F.col("x"), 20)), "y")


@query(f"""
WITH u AS (SELECT vec_id, unnest(x) AS v, generate_subscripts(x, 1) - 1 AS i FROM {_E})
SELECT vec_id, CAST(i AS INTEGER) AS i, round(v - median(v) OVER (PARTITION BY vec_id), 6) AS value FROM u""")
def center_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(_signals(spark, sf_dir).withColumn("y", S.centered(F.col("x"))), "y")


@query(f"""
WITH u AS (SELECT vec_id, unnest(x) AS v, generate_subscripts(x, 1) - 1 AS i FROM {_E}),
c AS (SELECT *, v - median(v) OVER (PARTITION BY vec_id) AS d FROM u)
SELECT vec_id, CAST(i AS INTEGER) AS i, round(d / (1.4826 * median(abs(d)) OVER (PARTITION BY vec_id)) * 0.35, 6) AS value FROM c""")
def robust_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(_signals(spark, sf_dir).withColumn("y", S.robust_scaled(F.col("x"))), "y")


@query(f"""
WITH u AS (SELECT vec_id, unnest(x) AS v, generate_subscripts(x, 1) - 1 AS i FROM {_E})
SELECT vec_id, CAST(i AS INTEGER) AS i, round(v * 0.35 / stddev_pop(v) OVER (PARTITION BY vec_id), 6) AS value FROM u""")
def std_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(_signals(spark, sf_dir).withColumn("y", S.std_scaled(F.col("x"))), "y")


_LIMB = {"I": 1, "II": 11, "III": 21, "aVR": 31, "aVL": 41, "aVF": 51}


@query(f"""
WITH s AS (SELECT vec_id, k, x[k] AS i, x[10 + k] AS ii, x[20 + k] AS iii, x[30 + k] AS avr, x[40 + k] AS avl, x[50 + k] AS avf FROM {_E}, range(1, 11) t(k)),
g AS (SELECT vec_id, sqrt(avg(pow(iii - (ii - i), 2))) AS a, sqrt(avg(pow(avr + (i + ii) / 2, 2))) AS b, sqrt(avg(pow(avl - (i - ii / 2), 2))) AS c, sqrt(avg(pow(avf - (ii - i / 2), 2))) AS d FROM s GROUP BY vec_id)
SELECT vec_id, round(a, 6) AS rmse_iii, round(b, 6) AS rmse_avr, round(c, 6) AS rmse_avl, round(d, 6) AS rmse_avf, round(greatest(a, b, c, d), 6) AS worst, CASE WHEN greatest(a, b, c, d) <= 0.25 THEN 'OK' ELSE 'REVIEW' END AS status FROM g""")
def linear_law_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _signals(spark, sf_dir)
    for lead, at in _LIMB.items():
        df = df.withColumn(f"lead_{lead}", F.slice("x", at, 10))
    out = quality.lead_laws(df, {k: f"lead_{k}" for k in _LIMB}, 0.25)
    return out.select("vec_id", *[F.round(c, 6).alias(c) for c in ("rmse_iii", "rmse_avr", "rmse_avl", "rmse_avf", "worst")], "status")


@query(f"""
WITH s AS (SELECT vec_id, k, x[k] AS i, x[16 + k] AS ii FROM {_E}, range(1, 17) t(k)), c AS (SELECT vec_id, k, i - median(i) OVER (PARTITION BY vec_id) AS i, ii - median(ii) OVER (PARTITION BY vec_id) AS ii FROM s)
SELECT vec_id, round(sum(abs(ii - i)), 5) AS iii, round(sum(abs(i + ii) / 2), 5) AS avr, round(sum(abs(i - ii / 2)), 5) AS avl, round(sum(abs(ii - i / 2)), 5) AS avf FROM c GROUP BY vec_id""")
def derive_leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _signals(spark, sf_dir).withColumn("a", F.slice("x", 1, 16)).withColumn("b", F.slice("x", 17, 16))
    made = quality.derived_leads(F.col("a"), F.col("b"))
    return df.select("vec_id", *[F.round(S.total(F.transform(made[k], F.abs)), 5).alias(k.lower()) for k in ("III", "aVR", "aVL", "aVF")])


_PAIRS = f"""
p AS (SELECT a.vec_id, a.label, a.x AS r, b.x AS g FROM {_E} a JOIN {_E} b ON b.vec_id = a.vec_id + 1),
u AS (SELECT vec_id, label, unnest(r) AS r, unnest(g) AS g FROM p),
m AS (SELECT vec_id, label, count(*) AS n, sum(pow(r - g, 2)) AS sse, count(*) * var_pop(r) AS ss, max(abs(r - g)) AS maxae, corr(r, g) AS r FROM u GROUP BY ALL)"""


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _signals(spark, sf_dir)
    after = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("x").alias("g"))
    return metrics.fidelity(e.join(after, "vec_id"), "x", "g")


@query(f"""
WITH {_PAIRS}
SELECT vec_id, label, round(sqrt(sse / n), 6) AS rmse, round(maxae, 6) AS maxae, round(10 * log10((ss + 1e-12) / (sse + 1e-12)), 5) AS snr, round(100 * sqrt(sse / (ss + 1e-12)), 5) AS prd, round(r, 6) AS r,
  CASE WHEN 100 * sqrt(sse / (ss + 1e-12)) < 2 THEN 'very good' WHEN 100 * sqrt(sse / (ss + 1e-12)) < 9 THEN 'good' ELSE 'review' END AS band FROM m""")
def fidelity_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _pairs(spark, sf_dir)
    return f.select("vec_id", "label", *[F.round(c, p).alias(c) for c, p in (("rmse", 6), ("maxae", 6), ("snr", 5), ("prd", 5), ("r", 6))], metrics.prd_band(F.col("prd")).alias("band"))


@query(f"""
WITH {_PAIRS}
SELECT label, grouping(label) AS whole, count(*) AS signals, CAST(sum(n) AS BIGINT) AS n, round(sqrt(sum(sse) / sum(n)), 6) AS pooled_rmse, round(100 * sqrt(sum(sse) / sum(ss)), 5) AS pooled_prd,
  round(avg(100 * sqrt(sse / (ss + 1e-12))), 5) AS mean_prd, round(avg(r), 6) AS mean_r FROM m GROUP BY GROUPING SETS ((label), ())""")
def fidelity_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _pairs(spark, sf_dir)
    g = f.rollup("label").agg(
        F.grouping("label").cast("long").alias("whole"),
        F.count("*").alias("signals"),
        F.sum("n").cast("long").alias("n"),
        F.round(F.sqrt(F.sum("sse") / F.sum("n")), 6).alias("pooled_rmse"),
        F.round(100 * F.sqrt(F.sum("sse") / F.sum("ss")), 5).alias("pooled_prd"),
        F.round(F.avg("prd"), 5).alias("mean_prd"),
        F.round(F.avg("r"), 6).alias("mean_r"),
    )
    return g


@query("""
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
d AS (SELECT vec_id, x, list_transform(range(32), lambda k: x[least(CAST(floor(k * 63 / 31.0) AS INTEGER), 62) + 1] + (x[least(CAST(floor(k * 63 / 31.0) AS INTEGER), 62) + 2] - x[least(CAST(floor(k * 63 / 31.0) AS INTEGER), 62) + 1]) * (k * 63 / 31.0 - least(CAST(floor(k * 63 / 31.0) AS INTEGER), 62))) AS y FROM e),
b AS (SELECT vec_id, x[k + 1] AS r, y[lo + 1] + (y[lo + 2] - y[lo + 1]) * (pos - lo) AS g FROM (SELECT vec_id, x, y, k, k * 31 / 63.0 AS pos, least(CAST(floor(k * 31 / 63.0) AS INTEGER), 30) AS lo FROM d, range(64) t(k)))
SELECT vec_id, round(sqrt(avg(pow(r - g, 2))), 6) AS rmse, round(max(abs(r - g)), 6) AS maxae, round(max(r) - min(r), 6) AS span, round(CASE WHEN max(r) - min(r) > 1e-6 THEN 100 * sqrt(avg(pow(r - g, 2))) / (max(r) - min(r)) END, 5) AS percent FROM b GROUP BY vec_id""")
def roundtrip_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _signals(spark, sf_dir).withColumn("back", S.resampled(S.resampled(F.col("x"), 32), 64))
    f = metrics.fidelity(e, "x", "back").withColumn("span", S.span(F.col("x")))
    percent = F.when(F.col("span") > 1e-6, 100 * F.col("rmse") / F.col("span"))
    return f.select("vec_id", F.round("rmse", 6).alias("rmse"), F.round("maxae", 6).alias("maxae"), F.round("span", 6).alias("span"), F.round(percent, 5).alias("percent"))


@query(f"""
WITH u AS (SELECT vec_id, vec_id % 10 + 1 AS fold, unnest(x) AS v, generate_subscripts(x, 1) - 1 AS i FROM {_E}),
s AS (SELECT i, avg(v) AS mu, stddev_pop(v) AS sd FROM u WHERE fold <= 8 GROUP BY i)
SELECT vec_id, CAST(i AS INTEGER) AS i, round((v - mu) / (sd + 1e-6), 5) AS z FROM u JOIN s USING (i) WHERE fold > 8""")
def zscore_train_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = _signals(spark, sf_dir).select("vec_id", (F.col("vec_id") % 10 + 1).alias("fold"), F.posexplode("x").alias("i", "v"))
    return metrics.normalised(u, ["i"], "v", F.col("fold") <= 8).where("fold > 8").select("vec_id", "i", F.round("z", 5).alias("z"))


@query(f"""
WITH u AS (SELECT vec_id, vec_id % 10 + 1 AS fold, unnest(x) AS v, generate_subscripts(x, 1) - 1 AS i FROM {_E}),
s AS (SELECT i, avg(v) AS mu, stddev_pop(v) AS sd FROM u WHERE fold <= 8 GROUP BY i)
SELECT vec_id, fold, CAST(i AS INTEGER) AS i, round((v - mu) / (sd + 1e-6), 5) AS z FROM u JOIN s USING (i)""")
def zscore_all_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector by the means and deviations of the training folds, 1 to 8."""
    u = _signals(spark, sf_dir).select("vec_id", (F.col("vec_id") % 10 + 1).alias("fold"), F.posexplode("x").alias("i", "v"))
    return metrics.normalised(u, ["i"], "v", F.col("fold") <= 8).select("vec_id", "fold", "i", F.round("z", 5).alias("z"))


@query(f"""
WITH u AS (SELECT vec_id, unnest(x) AS v, generate_subscripts(x, 1) AS i, label FROM {_E}), c AS (SELECT label, i, avg(v) AS c FROM u GROUP BY ALL),
d AS (SELECT u.vec_id, c.label, sqrt(sum(pow(u.v - c.c, 2))) AS d FROM u JOIN c USING (i) GROUP BY ALL)
SELECT vec_id, min_by(label, (round(d, 9), label)) AS nearest_id, round(min(d), 5) AS nearest_d FROM d GROUP BY vec_id""")
def nearest_neighbour(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _signals(spark, sf_dir)
    mean = e.select("label", F.posexplode("x").alias("i", "v")).groupBy("label", "i").agg(F.avg("v").alias("c"))
    centers = mean.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "c"))), lambda s: s["c"]).alias("c"))
    far = lambda c: F.round(F.sqrt(S.total(F.zip_with("x", c["c"], lambda a, b: (a - b) * (a - b)))), 9)
    out = joins.nearest(e, centers, far, "label")
    return out.select("vec_id", "nearest_id", F.round("nearest_d", 5).alias("nearest_d"))


@query(f"""
WITH u AS (SELECT vec_id, unnest(x) AS v FROM {_E})
SELECT vec_id, round((2 * sum(CASE WHEN v > 0.05 AND v > 0 THEN 1 ELSE 0 END) + 1.0) / (sum(CASE WHEN v > 0 THEN 1 ELSE 0 END) + sum(CASE WHEN v > 0.05 THEN 1 ELSE 0 END) + 1), 6) AS dice FROM u GROUP BY vec_id""")
def mask_dice(spark: SparkSession, sf_dir: str) -> DataFrame:
    mask = lambda t: F.transform("x", lambda v: F.when(v > t, 1.0).otherwise(0.0))
    return _signals(spark, sf_dir).select("vec_id", F.round(metrics.dice(mask(0.05), mask(0.0)), 6).alias("dice"))


@query("""
WITH s AS (SELECT l.quality, l.toxic, d.n_chars AS score FROM labels l JOIN documents d USING (doc_id)),
t AS (SELECT 'quality' AS class, score, quality AS y FROM s UNION ALL SELECT 'toxic', score, toxic FROM s),
r AS (SELECT class, y, rank() OVER (PARTITION BY class ORDER BY score) + (count(*) OVER (PARTITION BY class, score) - 1) / 2.0 AS rk FROM t)
SELECT class, CAST(sum(y) AS BIGINT) AS pos, CAST(sum(1 - y) AS BIGINT) AS neg, round((sum(rk * y) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * sum(1 - y)), 8) AS auc FROM r GROUP BY class""")
def class_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.auc(_scored(spark, sf_dir), "score", "y", ["class"]).select("class", "pos", "neg", F.round("auc", 8).alias("auc"))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").alias("score"))
    s = read(spark, sf_dir, "labels").join(d, "doc_id")
    return s.unpivot(["doc_id", "score"], ["quality", "toxic"], "class", "y")


@query("""
WITH s AS (SELECT l.quality, l.toxic, d.n_chars AS score FROM labels l JOIN documents d USING (doc_id)),
t AS (SELECT 'quality' AS class, score, quality AS y FROM s UNION ALL SELECT 'toxic', score, toxic FROM s)
SELECT class, count(*) FILTER (WHERE score > 1000 AND y = 1) AS tp, count(*) FILTER (WHERE score > 1000 AND y = 0) AS fp, count(*) FILTER (WHERE score <= 1000 AND y = 1) AS fn,
  round(2.0 * count(*) FILTER (WHERE score > 1000 AND y = 1) / (2 * count(*) FILTER (WHERE score > 1000 AND y = 1) + count(*) FILTER (WHERE score > 1000 AND y = 0) + count(*) FILTER (WHERE score <= 1000 AND y = 1)), 8) AS f1 FROM t GROUP BY class""")
def class_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _scored(spark, sf_dir).withColumn("p", (F.col("score") > 1000).cast("int"))
    return metrics.f1(s, "p", "y", ["class"]).select("class", "tp", "fp", "fn", F.round("f1", 8).alias("f1"))
