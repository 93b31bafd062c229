"""Queries over long-form signals: a record is a user, a channel an event type, a sample an event's value."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import joins, quality
from ..operators import sequence as seq
from .registry import query, read

KEYS = ["user_id", "event_type"]
ORDER = ["ts", "event_id"]
_NUM = "(SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events)"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")


def _numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seq.numbered(_events(spark, sf_dir), ["user_id"], ORDER)


def _r(*names: str, places: int = 6):
    return [F.round(n, places).alias(n) for n in names]


@query("""
WITH g AS (SELECT user_id, event_type, count(value) n, avg(value) mean, stddev_samp(value) std_samp, stddev_pop(value) std_pop,
  median(value) median, min(value) lo, max(value) hi FROM events GROUP BY ALL)
SELECT user_id, event_type, n, round(mean, 6) AS mean, round(std_samp, 6) AS std_samp, round(std_pop, 6) AS std_pop, round(median, 6) AS median, lo, hi,
  round(hi - lo, 6) AS ptp, coalesce(std_pop < 1e-4, true) AS flat, greatest(abs(lo), abs(hi)) > 50 AS far,
  CASE WHEN n = 0 THEN 'FAIL' WHEN coalesce(std_pop < 1e-4, true) OR greatest(abs(lo), abs(hi)) > 50 THEN 'WARN' ELSE 'OK' END AS status FROM g""")
def signal_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = quality.channel_stats(_events(spark, sf_dir), KEYS, "value")
    return g.select(*KEYS, "n", *_r("mean", "std_samp", "std_pop", "median"), "lo", "hi", *_r("ptp"), "flat", "far", "status")


@query("""
WITH m AS (SELECT user_id, event_type, value, avg(value) OVER w AS mu, lag(value) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS prev FROM events WINDOW w AS (PARTITION BY user_id, event_type)),
d AS (SELECT user_id, event_type, value, value - mu AS x, CASE WHEN (value - mu) * (prev - mu) < 0 THEN 1 ELSE 0 END AS crossing FROM m)
SELECT user_id, event_type, count(*) AS n, round(quantile_cont(value, 0.25), 6) AS p25, round(quantile_cont(value, 0.75), 6) AS p75,
  round(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 6) AS iqr, round(sqrt(avg(value * value)), 6) AS rms,
  round(sum(crossing) / count(*), 6) AS zero_crossing_rate,
  round(CASE WHEN avg(x*x) > 1e-12 THEN avg(x*x*x) / pow(avg(x*x), 1.5) END, 5) AS skewness,
  round(CASE WHEN avg(x*x) > 1e-12 THEN avg(x*x*x*x) / pow(avg(x*x), 2) - 3 END, 5) AS kurtosis_excess
FROM d GROUP BY user_id, event_type""")
def signal_stats_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window as W

    # summed in order: a value at the mean crosses it or not by the sum's last bit
    w = W.partitionBy(*KEYS).orderBy(*ORDER)
    mu = F.avg("value").over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    d = _events(spark, sf_dir).withColumn("mu", mu).withColumn("prev", F.lag("value").over(w))
    d = d.withColumn("x", F.col("value") - F.col("mu"))
    d = d.withColumn("crossing", F.when(F.col("x") * (F.col("prev") - F.col("mu")) < 0, 1).otherwise(0))
    m = lambda k: F.avg(F.expr("*".join(["x"] * k)))
    both = F.percentile("value", F.array(F.lit(0.25), F.lit(0.75)))  # one buffer of values for both
    return d.groupBy(*KEYS).agg(
        F.count("*").alias("n"),
        F.round(both[0], 6).alias("p25"),
        F.round(both[1], 6).alias("p75"),
        F.round(both[1] - both[0], 6).alias("iqr"),
        F.round(F.sqrt(F.avg(F.col("value") * F.col("value"))), 6).alias("rms"),
        F.round(F.sum("crossing") / F.count("*"), 6).alias("zero_crossing_rate"),
        F.round(F.when(m(2) > 1e-12, m(3) / F.pow(m(2), F.lit(1.5))), 5).alias("skewness"),
        F.round(F.when(m(2) > 1e-12, m(4) / F.pow(m(2), F.lit(2)) - 3), 5).alias("kurtosis_excess"),
    )


@query("""
WITH g AS (SELECT user_id, event_type, count(value) n, stddev_pop(value) sd, min(value) lo, max(value) hi FROM events GROUP BY ALL)
SELECT CASE WHEN n = 0 THEN 'FAIL' WHEN coalesce(sd < 1e-4, true) OR greatest(abs(lo), abs(hi)) > 50 THEN 'WARN' ELSE 'OK' END AS status, count(*) AS channels FROM g GROUP BY 1""")
def verify_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.channel_stats(_events(spark, sf_dir), KEYS, "value").groupBy("status").agg(F.count("*").alias("channels"))


@query("""
WITH kinds AS (SELECT DISTINCT event_type FROM events), users AS (SELECT DISTINCT user_id FROM events), has AS (SELECT DISTINCT user_id, event_type FROM events)
SELECT u.user_id, count(*) - count(h.event_type) AS n_missing, coalesce(string_agg(CASE WHEN h.event_type IS NULL THEN k.event_type END, ',' ORDER BY k.event_type), '') AS missing, count(h.event_type) = count(*) AS complete
FROM users u CROSS JOIN kinds k LEFT JOIN has h ON h.user_id = u.user_id AND h.event_type = k.event_type GROUP BY u.user_id""")
def missing_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    kinds = sorted(r[0] for r in e.select("event_type").distinct().collect())
    g = e.groupBy("user_id").agg(F.collect_set("event_type").alias("has")).withColumn("gone", quality.missing(F.col("has"), kinds))
    return g.select("user_id", F.size("gone").cast("long").alias("n_missing"), F.array_join("gone", ",").alias("missing"), (F.size("gone") == 0).alias("complete"))


@query("""
WITH d AS (SELECT user_id, epoch(ts) - lag(epoch(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rr FROM events)
SELECT user_id, count(rr) AS beats, round(median(rr), 3) AS median_rr, round(3600 / median(rr), 6) AS rate, round(stddev_pop(rr) / avg(rr), 6) AS rr_cv
FROM d WHERE rr > 60 AND rr < 864000 GROUP BY user_id""")
def first_diff_rr(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    d = seq.first_difference(e, ["user_id"], ORDER, "at", "rr").where("rr > 60 and rr < 864000")
    return d.groupBy("user_id").agg(F.count("rr").alias("beats"), F.round(F.median("rr"), 3).alias("median_rr"), F.round(3600 / F.median("rr"), 6).alias("rate"), F.round(F.stddev_pop("rr") / F.avg("rr"), 6).alias("rr_cv"))


@query("""
WITH d AS (SELECT user_id, value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS diff FROM events)
SELECT user_id, count(diff) AS diffs, round(sqrt(avg(diff * diff)), 6) AS rmssd FROM d GROUP BY user_id""")
def hr_rmssd(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = seq.first_difference(_events(spark, sf_dir), ["user_id"], ORDER, "value")
    return d.groupBy("user_id").agg(F.count("diff").alias("diffs"), F.round(F.sqrt(F.avg(F.col("diff") * F.col("diff"))), 6).alias("rmssd"))


@query("""SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) / 7, 6) AS smooth FROM events""")
def moving_mean_zero_pad(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seq.moving_mean(_events(spark, sf_dir), ["user_id"], ORDER, "value", 7).select("event_id", *_r("smooth"))


@query("""SELECT event_id, round(median(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 12 PRECEDING AND 12 FOLLOWING), 6) AS median FROM events""")
def rolling_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seq.rolling_median(_events(spark, sf_dir), ["user_id"], ORDER, "value", 12).select("event_id", *_r("median"))


@query(f"""
WITH n AS {_NUM}, h AS (SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY user_id ORDER BY i) <= 2 THEN 0 ELSE 1 END AS opens FROM n WHERE value > 20),
r AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY i) AS run FROM h)
SELECT user_id, min(i) AS start, max(i) + 1 AS stop, max(i) + 1 - min(i) AS length FROM r GROUP BY user_id, run HAVING max(i) + 1 - min(i) >= 2""")
def islands_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = seq.runs(_numbered(spark, sf_dir), ["user_id"], "i", F.col("value") > 20, merge_gap=1, min_length=2)
    return out.select("user_id", *[F.col(c).cast("long").alias(c) for c in ("start", "stop", "length")])


@query("""
WITH o AS (SELECT user_id, ts, event_id, CASE WHEN epoch(ts) - lag(epoch(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= 3600 THEN 0 ELSE 1 END AS opens FROM events),
g AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS grp FROM o)
SELECT user_id, round(min(epoch(ts)), 3) AS lo, round(max(epoch(ts)), 3) AS hi, count(*) AS size FROM g GROUP BY user_id, grp""")
def gap_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    return seq.clusters(e, ["user_id"], "at", 3600, tie=["event_id"]).select("user_id", *_r("lo", "hi", places=3), "size")


def _masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _numbered(spark, sf_dir).withColumn("v", F.when(F.col("event_type") != "error", F.col("value")))


@query(f"""
WITH n AS (SELECT event_id, user_id, i, CASE WHEN event_type <> 'error' THEN value END AS v FROM {_NUM})
SELECT event_id, last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS filled FROM n""")
def ffill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seq.forward_fill(_masked(spark, sf_dir), ["user_id"], ["i"], "v").select("event_id", "filled")


_LERP = """
k AS (SELECT *, last_value(CASE WHEN {v} IS NOT NULL THEN i END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ia,
  first_value(CASE WHEN {v} IS NOT NULL THEN i END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ib,
  last_value({v} IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS va,
  first_value({v} IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS vb FROM {src})
SELECT event_id, round(coalesce({v}, CASE WHEN ia IS NULL THEN vb WHEN ib IS NULL THEN va ELSE va + (vb - va) * (i - ia) / (ib - ia) END), 6) AS {out} FROM k"""


@query(f"""
WITH n AS (SELECT event_id, user_id, i, CASE WHEN event_type <> 'error' THEN value END AS v FROM {_NUM}), {_LERP.format(v="v", src="n", out="filled")}""")
def lerp_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seq.lerp_fill(_masked(spark, sf_dir), ["user_id"], "i", "v").select("event_id", *_r("filled"))


@query(f"""
WITH n AS {_NUM}, m AS (SELECT *, abs(value - median(value) OVER (PARTITION BY user_id)) AS off FROM n),
d AS (SELECT *, CASE WHEN off <= 4 * median(off) OVER (PARTITION BY user_id) THEN value END AS kept FROM m), {_LERP.format(v="kept", src="d", out="clean")}""")
def despike_mad(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seq.despiked(_numbered(spark, sf_dir), ["user_id"], "i", "value", 4.0).select("event_id", *_r("clean"))


@query(f"""
WITH n AS {_NUM}, m AS (SELECT *, abs(value - median(value) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN 12 PRECEDING AND 12 FOLLOWING)) > 60 AS bad FROM n),
f AS (SELECT *, CASE WHEN bad = lag(bad) OVER (PARTITION BY user_id ORDER BY i) THEN 0 ELSE 1 END AS flip FROM m),
r AS (SELECT *, sum(flip) OVER (PARTITION BY user_id ORDER BY i) AS run FROM f),
d AS (SELECT *, CASE WHEN NOT (bad AND count(*) OVER (PARTITION BY user_id, run) <= 2) THEN value END AS kept FROM r), {_LERP.format(v="kept", src="d", out="clean")}""")
def despike_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seq.spike_runs_replaced(_numbered(spark, sf_dir), ["user_id"], "i", "value", 12, 60.0, 2).select("event_id", *_r("clean"))


_PEAKS = f"""
n AS {_NUM}, p AS (SELECT user_id, i, value FROM (SELECT *, lag(value) OVER w AS pv, lead(value) OVER w AS nv FROM n WINDOW w AS (PARTITION BY user_id ORDER BY i)) WHERE value > pv AND value > nv AND value >= 20)"""


@query(f"WITH {_PEAKS} SELECT user_id, i, value FROM p")
def local_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seq.local_peaks(_numbered(spark, sf_dir), ["user_id"], ["i"], "value", 20.0).select("user_id", F.col("i").cast("long").alias("i"), "value")


@query(f"""
WITH RECURSIVE {_PEAKS}, c AS (SELECT user_id, i, row_number() OVER (PARTITION BY user_id ORDER BY i) AS k FROM p),
s AS (SELECT user_id, k, i AS last, CAST(1 AS BIGINT) AS kept, i AS total FROM c WHERE k = 1
  UNION ALL SELECT c.user_id, c.k, CASE WHEN c.i - s.last >= 5 THEN c.i ELSE s.last END, s.kept + CASE WHEN c.i - s.last >= 5 THEN 1 ELSE 0 END, s.total + CASE WHEN c.i - s.last >= 5 THEN c.i ELSE 0 END FROM s JOIN c ON c.user_id = s.user_id AND c.k = s.k + 1)
SELECT user_id, max(kept) AS kept, CAST(max_by(total, k) AS BIGINT) AS total FROM s GROUP BY user_id""")
def peaks_min_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = seq.local_peaks(_numbered(spark, sf_dir), ["user_id"], ["i"], "value", 20.0)
    k = seq.spaced_rows(p, ["user_id"], "i", 5)
    return k.groupBy("user_id").agg(F.count("*").alias("kept"), F.sum("i").alias("total"))


@query(f"""
WITH RECURSIVE n AS {_NUM}, t AS (SELECT * FROM (SELECT *, max(abs(value)) OVER (PARTITION BY user_id) AS top FROM n) WHERE value > 0.3 * top),
o AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY i) AS grp FROM (SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY user_id ORDER BY i) <= 2 THEN 0 ELSE 1 END AS opens FROM t)),
b AS (SELECT user_id, i FROM (SELECT *, row_number() OVER (PARTITION BY user_id, grp ORDER BY value DESC, i) AS best FROM o) WHERE best = 1),
c AS (SELECT user_id, i, row_number() OVER (PARTITION BY user_id ORDER BY i) AS k FROM b),
s AS (SELECT user_id, k, i AS last, CAST(1 AS BIGINT) AS kept FROM c WHERE k = 1
  UNION ALL SELECT c.user_id, c.k, CASE WHEN c.i - s.last >= 4 THEN c.i ELSE s.last END, s.kept + CASE WHEN c.i - s.last >= 4 THEN 1 ELSE 0 END FROM s JOIN c ON c.user_id = s.user_id AND c.k = s.k + 1)
SELECT user_id, max(kept) AS beats FROM s GROUP BY user_id""")
def threshold_beats(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = seq.threshold_peak_rows(_numbered(spark, sf_dir), ["user_id"], "i", "value", 0.3, 2, 4)
    return k.groupBy("user_id").agg(F.count("*").alias("beats"))


@query("""
WITH c AS (SELECT event_type, user_id, median(value) AS center FROM events GROUP BY ALL)
SELECT user_id, event_type, round((lag(center) OVER w + center) / 2, 6) AS lo, round((center + lead(center) OVER w) / 2, 6) AS hi FROM c WINDOW w AS (PARTITION BY user_id ORDER BY center, event_type)""")
def band_midpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _events(spark, sf_dir).groupBy("user_id", "event_type").agg(F.median("value").alias("center"))
    return seq.midpoints(c, ["user_id"], ["center", "event_type"], "center").select("user_id", "event_type", *_r("lo", "hi"))


@query("""
WITH d AS (SELECT CAST(date_trunc('day', ts) AS DATE) AS day, count(*) AS c FROM events GROUP BY 1), n AS (SELECT row_number() OVER (ORDER BY day) - 1 AS i, c - avg(c) OVER () AS x FROM d)
SELECT CAST(b.i - a.i AS INTEGER) AS lag, round(sum(a.x * b.x), 4) AS acf FROM n a JOIN n b ON b.i - a.i BETWEEN 1 AND 10 GROUP BY 1""")
def autocorr(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _events(spark, sf_dir).groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("c")).withColumn("all", F.lit(1))
    n = seq.numbered(d, ["all"], ["day"])
    return seq.autocorrelation(n, ["all"], "i", "c", 10).select("lag", F.round("acf", 4).alias("acf"))


@query("""
WITH e AS (SELECT event_id, user_id, ts, value FROM events WHERE event_type = 'click'), p AS (SELECT event_id, user_id, ts, value FROM events WHERE event_type = 'purchase')
SELECT e.event_id, (SELECT max_by(p.value, (p.ts, p.event_id)) FROM p WHERE p.user_id = e.user_id AND p.ts <= e.ts) AS last_purchase FROM e""")
def asof_last_purchase(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    clicks, buys = e.where("event_type = 'click'"), e.where("event_type = 'purchase'")
    return joins.asof(clicks, buys, ["user_id"], "ts", "value", "event_id", "last_purchase").select("event_id", "last_purchase")


@query("""
WITH p AS (SELECT event_id, user_id, epoch(ts) AS at FROM events WHERE event_type = 'purchase'), c AS (SELECT event_id, user_id, epoch(ts) AS at, value FROM events WHERE event_type <> 'purchase')
SELECT p.event_id, count(*) AS near, max(c.value) AS most, max_by(c.event_id, (c.value, -c.event_id)) AS most_id FROM p JOIN c ON c.user_id = p.user_id AND abs(c.at - p.at) <= 7200 GROUP BY p.event_id""")
def interval_join_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).drop("ts")
    near = joins.within(e.where("event_type = 'purchase'"), e.where("event_type <> 'purchase'").drop("event_type"), ["user_id"], "at", 7200.0)
    best = F.max_by("r_event_id", F.struct("r_value", -F.col("r_event_id")))
    return near.groupBy("event_id").agg(F.count("*").alias("near"), F.max("r_value").alias("most"), best.alias("most_id"))


@query("""
WITH l AS (SELECT event_id, user_id, epoch(ts) AS x FROM events WHERE event_type = 'click'), r AS (SELECT user_id, epoch(ts) AS x, max_by(value, event_id) AS y FROM events WHERE event_type = 'purchase' GROUP BY ALL),
a AS (SELECT l.*, (SELECT max(x) FROM r WHERE r.user_id = l.user_id AND r.x <= l.x) AS xa, (SELECT min(x) FROM r WHERE r.user_id = l.user_id AND r.x >= l.x) AS xb FROM l),
b AS (SELECT a.*, ra.y AS ya, rb.y AS yb FROM a LEFT JOIN r ra ON ra.user_id = a.user_id AND ra.x = a.xa LEFT JOIN r rb ON rb.user_id = a.user_id AND rb.x = a.xb)
SELECT event_id, round(CASE WHEN xa IS NULL THEN yb WHEN xb IS NULL THEN ya WHEN xa = xb THEN ya ELSE ya + (yb - ya) * (x - xa) / (xb - xa) END, 4) AS interp FROM b""")
def interpolation_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).withColumn("x", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    right = e.where("event_type = 'purchase'").groupBy("user_id", "x").agg(F.max_by("value", "event_id").alias("y"))
    return joins.interpolated(e.where("event_type = 'click'").select("event_id", "user_id", "x"), right, ["user_id"], "x", "y").select("event_id", F.round("interp", 4).alias("interp"))


@query(f"""
WITH n AS {_NUM}, g AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY i) - 1 AS k, gap FROM (SELECT user_id, i, epoch(ts) - lag(epoch(ts)) OVER (PARTITION BY user_id ORDER BY i) AS gap FROM n) WHERE gap IS NOT NULL),
m AS (SELECT *, median(gap) OVER (PARTITION BY user_id) AS mid FROM g)
SELECT user_id, min(CASE WHEN gap > 3 * mid THEN k END) AS split FROM m GROUP BY user_id""")
def first_wide_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _numbered(spark, sf_dir).withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    return seq.first_wide_gap(n, ["user_id"], ["i"], "at", 3.0).select("user_id", F.col("split").cast("long").alias("split"))


@query("""
SELECT user_id, count(*) FILTER (WHERE value > 0.2 * top) AS above FROM (SELECT user_id, value, max(value) OVER (PARTITION BY user_id) AS top FROM events) GROUP BY user_id""")
def above_share_of_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seq.above_share(_events(spark, sf_dir), ["user_id"], "value", 0.2).groupBy("user_id").agg(F.count_if("above").alias("above"))


@query("""
WITH d AS (SELECT DISTINCT user_id, CAST(epoch(date_trunc('day', ts)) / 86400 AS BIGINT) AS day FROM events),
g AS (SELECT *, day - lag(day) OVER (PARTITION BY user_id ORDER BY day) AS gap FROM d), m AS (SELECT *, median(gap) OVER (PARTITION BY user_id) AS mid FROM g),
o AS (SELECT *, sum(CASE WHEN abs(gap - mid) <= 0.3 * mid THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY day) AS chain FROM m),
c AS (SELECT user_id, chain, min(day) AS start, max(day) AS stop, count(*) AS members FROM o GROUP BY ALL)
SELECT user_id, start, stop, members FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY members DESC, start) AS best FROM c) WHERE best = 1""")
def even_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _events(spark, sf_dir).select("user_id", F.unix_date(F.to_date("ts")).cast("long").alias("day")).distinct()
    return seq.even_chain(d, ["user_id"], "day")


@query("""
SELECT user_id, event_type, round(avg(CASE WHEN abs(value - mid) < 5 THEN 1.0 ELSE 0.0 END), 6) AS flat_share FROM (SELECT *, median(value) OVER (PARTITION BY user_id, event_type) AS mid FROM events) GROUP BY ALL""")
def flat_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.flat_share(_events(spark, sf_dir), KEYS, "value", 5.0).select(*KEYS, *_r("flat_share"))


@query("""
WITH b AS (SELECT user_id, event_type, count(*) FILTER (WHERE value > 20) AS beats FROM events GROUP BY ALL),
f AS (SELECT user_id, event_type, avg(CASE WHEN abs(value - mid) < 12 THEN 1.0 ELSE 0.0 END) AS flat_share FROM (SELECT *, median(value) OVER (PARTITION BY user_id, event_type) AS mid FROM events) GROUP BY ALL),
m AS (SELECT b.*, f.flat_share, CAST(trunc(median(CASE WHEN beats > 0 THEN beats END) OVER (PARTITION BY b.user_id)) AS INTEGER) AS mid FROM b JOIN f USING (user_id, event_type))
SELECT user_id, event_type, beats, coalesce(abs(beats - mid) > greatest(2.0, 0.35 * mid), true) OR flat_share > 0.985 OR flat_share < 0.55 AS low_confidence FROM m""")
def low_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    b = e.groupBy(*KEYS).agg(F.count_if(F.col("value") > 20).alias("beats"))
    s = b.join(quality.flat_share(e, KEYS, "value", 12.0), KEYS)
    return quality.low_confidence(s, "user_id", "beats", "flat_share").select(*KEYS, "beats", "low_confidence")


@query("""
SELECT user_id, CAST(time_bucket(INTERVAL 1 day, ts) AS DATE) AS day, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _events(spark, sf_dir).groupBy("user_id", F.window("ts", "1 day")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return g.select("user_id", F.to_date("window.start").alias("day"), "n", "total")


@query("""
SELECT CAST(epoch(s) AS BIGINT) AS start, count(*) AS n FROM (SELECT time_bucket(INTERVAL 6 hour, ts) - INTERVAL 6 hour * k AS s FROM events CROSS JOIN range(4) t(k)) GROUP BY 1""")
def sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _events(spark, sf_dir).groupBy(F.window("ts", "24 hours", "6 hours")).agg(F.count("*").alias("n"))
    return g.select(F.unix_seconds(F.col("window.start").cast("timestamp")).alias("start"), "n")


@query("""
WITH o AS (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 minute THEN 0 ELSE 1 END AS opens FROM events),
g AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM o)
SELECT user_id, CAST(epoch_us(min(ts)) AS BIGINT) AS start, count(*) AS n FROM g GROUP BY user_id, s""")
def session(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _events(spark, sf_dir).groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count("*").alias("n"))
    return g.select("user_id", F.unix_micros(F.col("w.start").cast("timestamp")).alias("start"), "n")
