"""Queries over drawn traces: a picture is a user or an event type, its ink are events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import calibration, traces
from ..operators import sequence as seq
from .fragments import peaks_sql
from .registry import query, read
from .signals import ORDER, _events, _numbered

_DAY = "CAST(date_diff('day', TIMESTAMP '2024-01-01', date_trunc('day', ts)) AS BIGINT)"


def _points(spark: SparkSession, sf_dir: str, scale: float) -> DataFrame:
    """user_id, x (a day) and y (a whole number) of every event."""
    day = F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")).cast("long")
    return _events(spark, sf_dir).select("user_id", day.alias("x"), F.floor(F.col("value") / scale).alias("y"))


@query("""
WITH RECURSIVE l AS (SELECT user_id, event_id AS name, value AS y, row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) AS label FROM events WHERE event_type = 'purchase'),
t AS (SELECT DISTINCT user_id, value AS trace FROM events WHERE event_type = 'view'),
h AS (SELECT user_id, trace - y AS off, min({'l': label, 't': trace}) AS f FROM l JOIN t USING (user_id) GROUP BY user_id, trace - y),
w AS (SELECT h.user_id, off, f, label, name, trace, abs(trace - (y + off)) AS d FROM h JOIN l USING (user_id) JOIN t USING (user_id) WHERE abs(trace - (y + off)) <= 8),
c AS (SELECT user_id, off, f, label, name, list({'d': d, 't': trace} ORDER BY d, trace) AS c FROM w GROUP BY user_id, off, f, label, name),
n AS (SELECT *, row_number() OVER (PARTITION BY user_id, off ORDER BY label) AS k FROM c),
r AS (SELECT DISTINCT user_id, off, f, 0::BIGINT AS k, 0.0::DOUBLE AS error, []::STRUCT(name BIGINT, trace DOUBLE)[] AS pairs FROM n
  UNION ALL SELECT user_id, off, f, k, CASE WHEN p IS NULL THEN error ELSE error + p.d END, CASE WHEN p IS NULL THEN pairs ELSE list_append(pairs, {'name': name, 'trace': p.t}) END
  FROM (SELECT r.user_id, r.off, r.f, n.k, r.error, r.pairs, n.name, list_filter(n.c, lambda x: NOT list_contains(list_transform(r.pairs, lambda q: q.trace), x.t))[1] AS p FROM r JOIN n ON n.user_id = r.user_id AND n.off = r.off AND n.k = r.k + 1)),
e AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY user_id, off ORDER BY k DESC) = 1),
b AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY len(pairs) DESC, error, f) = 1)
SELECT user_id, round(off, 6) AS offset, CAST(len(pairs) AS BIGINT) AS matches, round(error, 6) AS error, p.name AS name, p.trace AS trace FROM b, unnest(pairs) u(p)""")
def offset_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    labels = e.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("name"), F.col("value").alias("y"))
    found = traces.offset_matches(labels, e.where("event_type = 'view'").select("user_id", F.col("value").alias("y")), ["user_id"], "name", "y", 8.0)
    return found.select("user_id", F.round("offset", 6).alias("offset"), F.col("matches").cast("long").alias("matches"), F.round("error", 6).alias("error"), F.explode("pairs").alias("p")).select("user_id", "offset", "matches", "error", "p.name", "p.trace")


@query(f"""
WITH RECURSIVE p AS (SELECT DISTINCT user_id, {_DAY} AS x, CAST(floor(value / 4.0) AS BIGINT) AS y FROM events),
g0 AS (SELECT *, CASE WHEN y - lag(y) OVER (PARTITION BY user_id, x ORDER BY y) <= 3 THEN 0 ELSE 1 END AS opens FROM p),
g1 AS (SELECT *, sum(opens) OVER (PARTITION BY user_id, x ORDER BY y) AS g FROM g0),
g2 AS (SELECT user_id, x, (min(y) + max(y)) / 2.0 AS c FROM g1 GROUP BY user_id, x, g),
c AS (SELECT user_id, x, list(c ORDER BY c) AS cs, row_number() OVER (PARTITION BY user_id ORDER BY x) AS k FROM g2 GROUP BY user_id, x),
r AS (SELECT DISTINCT user_id, CAST(NULL AS BIGINT) AS x, 0::BIGINT AS k, 5.0::DOUBLE AS last, CAST(NULL AS DOUBLE) AS trace FROM c
  UNION ALL SELECT user_id, x, k, coalesce(trace, last), trace FROM (SELECT r.user_id, c.x, c.k, r.last, CASE WHEN len(c.cs) = 1 THEN c.cs[1] ELSE (SELECT CASE WHEN min({{'d': abs(q - r.last), 'c': q}}).d <= 6 THEN min({{'d': abs(q - r.last), 'c': q}}).c END FROM unnest(c.cs) u(q)) END AS trace
    FROM r JOIN c ON c.user_id = r.user_id AND c.k = r.k + 1)),
s AS (SELECT user_id, x, trace FROM r WHERE x IS NOT NULL),
grid AS (SELECT user_id, unnest(range(lo, hi + 1)) AS x FROM (SELECT user_id, min(x) AS lo, max(x) AS hi FROM s GROUP BY user_id)),
f AS (SELECT grid.user_id, grid.x, trace, last_value(CASE WHEN trace IS NOT NULL THEN {{'i': grid.x, 'v': trace}} END IGNORE NULLS) OVER (PARTITION BY grid.user_id ORDER BY grid.x) AS a,
  first_value(CASE WHEN trace IS NOT NULL THEN {{'i': grid.x, 'v': trace}} END IGNORE NULLS) OVER (PARTITION BY grid.user_id ORDER BY grid.x ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b FROM grid LEFT JOIN s ON s.user_id = grid.user_id AND s.x = grid.x)
SELECT user_id, x, trace, round((5.0 - coalesce(trace, CASE WHEN a IS NULL THEN b.v WHEN b IS NULL THEN a.v ELSE a.v + (b.v - a.v) * (x - a.i) / (b.i - a.i) END)) / 2.5, 6) AS mv FROM f""")
def trace_follow(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["user_id"]
    places = traces.followed(_points(spark, sf_dir, 4.0), keys, "x", "y", F.lit(5.0), gap=3, most=6.0)
    heights = traces.unfolded(places, keys, "x", F.lit(5.0), 2.5)
    return heights.join(places, ["user_id", "x"], "left").select("user_id", "x", "trace", F.round("mv", 6).alias("mv"))


_DENSITY = """d0 AS (SELECT user_id, least(CAST(floor(value / 2) AS BIGINT), 99) AS y, count(*) AS mass FROM events GROUP BY ALL),
d1 AS (SELECT user_id, unnest(range(100)) AS y FROM (SELECT DISTINCT user_id FROM events)),
d2 AS (SELECT d1.user_id, d1.y AS "at", sum(coalesce(mass, 0)) OVER (PARTITION BY d1.user_id ORDER BY d1.y ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) / 3 AS v FROM d1 LEFT JOIN d0 ON d0.user_id = d1.user_id AND d0.y = d1.y)"""


@query(f"""
WITH RECURSIVE {_DENSITY},{peaks_sql("p", "d2", "user_id", 3, "0.1 * hi", "0.05 * hi")},
l AS (SELECT user_id, list("at" ORDER BY "at") AS ls FROM p GROUP BY user_id),
g AS (SELECT *, list_transform(range(1, len(ls)), lambda i: ls[i + 1] - ls[i]) AS gaps FROM l),
u AS (SELECT *, list_median(list_slice(list_sort(gaps), 1, greatest(2, len(gaps) // 2))) AS usual FROM g),
s AS (SELECT *, list_position(list_transform(gaps, lambda x: x > 1.6 * usual), true) AS split FROM u)
SELECT users.user_id, CAST(coalesce(CASE WHEN len(ls) = 11 AND split = 6 THEN 12 ELSE len(ls) END, 0) AS BIGINT) AS n_lanes,
  coalesce(array_to_string(CASE WHEN len(ls) = 11 AND split = 6 THEN list_concat(list_concat(ls[1:6], [CAST(round_even((ls[6] + ls[7]) / 2.0, 0) AS BIGINT)]), ls[7:]) ELSE ls END, ','), '') AS lanes FROM (SELECT DISTINCT user_id FROM events) users LEFT JOIN s ON s.user_id = users.user_id""")
def lane_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    mass = e.groupBy("user_id", F.least(F.floor(F.col("value") / 2), F.lit(99).cast("long")).alias("y")).agg(F.count("*").alias("mass"))
    grid = e.select("user_id").distinct().withColumn("y", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(99).cast("long"))))
    density = grid.join(mass, ["user_id", "y"], "left").withColumn("mass", F.coalesce("mass", F.lit(0)))
    found = traces.lanes(density, ["user_id"], "y", "mass", taps=3, distance=3, prominence=0.05, height=0.1)
    return found.select("user_id", F.size("lanes").cast("long").alias("n_lanes"), F.array_join(F.col("lanes").cast("array<string>"), ",").alias("lanes"))


@query(f"""
WITH p AS (SELECT DISTINCT user_id, {_DAY} AS x, CAST(floor(value) AS BIGINT) AS y FROM events),
g0 AS (SELECT *, CASE WHEN y - lag(y) OVER (PARTITION BY user_id, x ORDER BY y) <= 3 THEN 0 ELSE 1 END AS opens FROM p),
g1 AS (SELECT *, sum(opens) OVER (PARTITION BY user_id, x ORDER BY y) AS g FROM g0),
g2 AS (SELECT user_id, x, min(y) AS lo, max(y) AS hi FROM g1 GROUP BY user_id, x, g),
c AS (SELECT user_id, x, min({{'h': lo - hi, 'lo': lo}}) AS s FROM g2 GROUP BY user_id, x),
f AS (SELECT user_id, min(CASE WHEN -s.h > 0.55 * 4 AND -s.h < 1.35 * 4 THEN {{'x': x, 'top': s.lo, 'h': -s.h}} END) AS b FROM c GROUP BY user_id)
SELECT user_id, b.x AS "at", b.top AS top, b.h AS height FROM f""")
def pulse_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces.pulses(_points(spark, sf_dir, 1.0), ["user_id"], "x", "y", 4.0)


@query("""
WITH e AS (SELECT user_id, event_type, epoch(ts) / 3600 AS x, value AS y FROM events WHERE event_type IN ('click', 'purchase')),
t AS (SELECT user_id, min({'v': -y, 'x': x}) AS t FROM e WHERE event_type = 'click' GROUP BY user_id),
m AS (SELECT e.*, t.x AS "at", -t.v AS top, abs(e.x - t.x) AS away FROM e JOIN t ON t.user_id = e.user_id)
SELECT user_id, round("at", 6) AS "at", top, count(*) FILTER (event_type = 'click' AND away <= 72) AS near_first, count(*) FILTER (event_type = 'purchase' AND away <= 72) AS near_second,
  round(min(CASE WHEN event_type = 'purchase' THEN {'d': away, 'x': x, 'y': y} END).x, 6) AS second_at, min(CASE WHEN event_type = 'purchase' THEN {'d': away, 'x': x, 'y': y} END).y AS second_y,
  round(top - min(CASE WHEN event_type = 'purchase' THEN {'d': away, 'x': x, 'y': y} END).y, 6) AS apart FROM m GROUP BY user_id, "at", top""")
def crossing_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).withColumn("x", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 / 3600)
    c = traces.crossing(e, ["user_id"], "event_type", "click", "purchase", "x", "value", 72.0)
    return c.select("user_id", F.round("at", 6).alias("at"), "top", "near_first", "near_second", F.round("second_at", 6).alias("second_at"), "second_y", F.round("apart", 6).alias("apart"))


@query("""
WITH l AS (SELECT DISTINCT user_id, CAST(floor(value) AS BIGINT) AS "at" FROM events WHERE event_type = 'purchase'),
g AS (SELECT *, "at" - lag("at") OVER w AS before, lead("at") OVER w - "at" AS after, row_number() OVER w AS no FROM l WINDOW w AS (PARTITION BY user_id ORDER BY "at")),
b AS (SELECT user_id, "at", no, coalesce(before, after) AS up, coalesce(after, before) AS down FROM g)
SELECT user_id, "at", CAST(CASE WHEN no = 1 THEN greatest(2, floor(0.5 * up), floor(0.55 * down)) ELSE greatest(2, floor(0.5 * up)) END AS BIGINT) AS up, CAST(greatest(2, floor(0.5 * down)) AS BIGINT) AS down FROM b""")
def lane_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    lanes = _events(spark, sf_dir).where("event_type = 'purchase'").select("user_id", F.floor("value").alias("at")).distinct()
    return traces.bounds(lanes, ["user_id"], "at", 2).select("user_id", "at", F.col("up").cast("long").alias("up"), F.col("down").cast("long").alias("down"))


def _acf_sql(name: str, source: str, high: int, low: int) -> str:
    """CTEs that end in ``name`` (user_id, period) from ``source`` (user_id, i, v)."""
    return f"""
{name}_c AS (SELECT user_id, i, v - avg(v) OVER (PARTITION BY user_id) AS x FROM {source}),
{name}_n AS (SELECT user_id, var_pop(v) * count(v) AS zero, stddev_pop(v) AS sd FROM {source} GROUP BY user_id),
{name}_a AS (SELECT a.user_id, b.i - a.i - {low} AS "at", sum(a.x * b.x) / (any_value(zero) + 1e-9) AS v FROM {name}_c a JOIN {name}_c b ON b.user_id = a.user_id AND b.i - a.i BETWEEN {low} AND {high - 1} JOIN {name}_n n ON n.user_id = a.user_id GROUP BY a.user_id, b.i - a.i),
{peaks_sql(name + "_p", name + "_a", "user_id", 3, prominence="0.05")},
{name} AS (SELECT n.user_id, CASE WHEN sd >= 1e-6 THEN min("at") + {low} END AS period FROM {name}_n n LEFT JOIN {name}_p p ON p.user_id = n.user_id GROUP BY n.user_id, sd)"""


_SERIES = "s AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, value AS v FROM events)"


@query(f"""
WITH RECURSIVE {_SERIES},{_acf_sql("q", "s", 30, 4)}
SELECT user_id, CAST(period AS BIGINT) AS period FROM q""")
def grid_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calibration.periods(_numbered(spark, sf_dir), ["user_id"], "i", "value", low=4, high=30)


@query(f"""
WITH RECURSIVE {_SERIES},{_acf_sql("q", "s", 30, 4)},
v0 AS (SELECT user_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) - 1) AS i, floor(epoch(ts)) % 86400 / 3600.0 AS v FROM events),{_acf_sql("u", "v0", 20, 4)},
e AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) - 1 AS i, value AS v, count(*) OVER (PARTITION BY user_id, event_type) AS n, max(value) OVER (PARTITION BY user_id, event_type) AS hi FROM events),
w AS (SELECT user_id, event_type, i AS "at", v, n, hi FROM e UNION ALL SELECT user_id, event_type, -1, v, n, hi FROM e WHERE i = 0 UNION ALL SELECT user_id, event_type, n, v, n, hi FROM e WHERE i = n - 1),
m AS (SELECT *, sum(v) OVER (PARTITION BY user_id, event_type ORDER BY "at" ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) / 3 AS s FROM w),
b AS (SELECT *, median(CASE WHEN "at" < greatest(3, n // 5) THEN s END) OVER (PARTITION BY user_id, event_type) AS base FROM m WHERE "at" >= 0 AND "at" < n AND n >= 10),
t AS (SELECT *, max(s - base) OVER (PARTITION BY user_id, event_type) AS top FROM b),
h AS (SELECT user_id, event_type, avg(CASE WHEN s - base > 0.5 * top THEN s - base END) AS height FROM t GROUP BY user_id, event_type, hi, top HAVING top >= 0.62 * hi AND count(*) FILTER (s - base > 0.5 * top) >= 3),
p AS (SELECT user_id, median(height) AS height, CASE WHEN count(*) >= 2 THEN least(0.95, 0.6 + 0.35 * (1 - least(stddev_pop(height) / (median(height) + 1e-9), 1.0))) ELSE 0.5 END AS sure FROM h GROUP BY user_id),
r AS (SELECT user_id, CAST(sum(c) AS DOUBLE) AS width, avg(hi) AS tall FROM (SELECT user_id, event_type, count(*) AS c, max(value) AS hi FROM events GROUP BY ALL) GROUP BY user_id),
z AS (SELECT r.user_id, width, tall, height, sure, CASE WHEN q.period IS NULL AND u.period IS NULL THEN NULL ELSE (coalesce(q.period, u.period) + coalesce(u.period, q.period)) / 2.0 END AS grid FROM r LEFT JOIN p USING (user_id) LEFT JOIN q USING (user_id) LEFT JOIN u USING (user_id))
SELECT user_id, round(CASE WHEN sure >= 0.45 THEN height WHEN grid IS NOT NULL THEN grid * 10 ELSE tall / 4 END, 6) AS px_per_mv, round(CASE WHEN sure >= 0.45 THEN width / 10 WHEN grid IS NOT NULL THEN grid * 25 ELSE width / 10 END, 6) AS px_per_sec,
  CASE WHEN sure >= 0.45 THEN 'calibration_pulse' WHEN grid IS NOT NULL THEN 'grid_spacing' ELSE 'estimated' END AS method, round(CASE WHEN sure >= 0.45 THEN sure WHEN grid IS NOT NULL THEN 0.7 ELSE 0.25 END, 6) AS confidence FROM z""")
def scale_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window as W

    e, keys = _events(spark, sf_dir), ["user_id"]
    h = calibration.periods(_numbered(spark, sf_dir), keys, "i", "value", low=4, high=30).withColumnRenamed("period", "h")
    hours = e.withColumn("i", F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("ts"), "event_id")) - 1).withColumn("hour", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1e6) % 86400 / 3600.0)
    v = calibration.periods(hours, keys, "i", "hour", low=4, high=20).withColumnRenamed("period", "v")
    strips = e.groupBy("user_id", "event_type").agg(F.lit(0.0).alias("lo"), F.max("value").alias("hi"), F.count("*").alias("n"))
    profile = seq.numbered(e, ["user_id", "event_type"], ORDER).withColumn("hi", F.max("value").over(W.partitionBy("user_id", "event_type")))
    heights = calibration.plateaus(profile, ["user_id", "event_type"], "i", "value", "hi", half=1, least=0.62)
    records = strips.groupBy("user_id").agg(F.sum("n").cast("double").alias("width"))
    c = calibration.calibrated(records, heights, h.join(v, keys, "full"), strips, keys)
    return c.select("user_id", F.round("px_per_mv", 6).alias("px_per_mv"), F.round("px_per_sec", 6).alias("px_per_sec"), "method", F.round("confidence", 6).alias("confidence"))
