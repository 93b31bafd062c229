"""Queries on names of files, classes of records, and reports; the first version of the processed document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import documents as D
from ..operators import summary
from .arrays import _PAIRS, _pairs
from .documents import _records
from .registry import query, read
from .signals import ORDER, _events


@query("""
WITH p AS (SELECT page_id, CASE WHEN regexp_extract(regexp_extract(split_part(url, '?', 1), '([^/]*)$', 1), '(\\d{2})', 1) <> '' THEN CAST(regexp_extract(regexp_extract(split_part(url, '?', 1), '([^/]*)$', 1), '(\\d{2})', 1) AS BIGINT) END AS key FROM pages)
SELECT page_id, key, coalesce(lang, 'unknown') AS lang FROM p LEFT JOIN documents ON doc_id = key""")
def name_key_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", summary.name_key(F.split("url", r"\?")[0], 2).alias("key"))
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), "lang")
    return pages.join(docs, "key", "left").select("page_id", "key", F.coalesce("lang", F.lit("unknown")).alias("lang"))


@query("""
WITH l AS (SELECT DISTINCT conv_id FROM conversations), r AS (SELECT page_id, regexp_extract(split_part(url, '?', 1), '([^/]*)$', 1) AS name FROM pages)
SELECT conv_id, page_id, name AS stem FROM l JOIN r ON name = CAST(conv_id AS VARCHAR) WHERE name <> ''""")
def file_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    signals = read(spark, sf_dir, "conversations").select("conv_id").distinct().withColumn("signals", F.concat(F.lit("out/"), F.col("conv_id"), F.lit("_signals.json")))
    prints = read(spark, sf_dir, "pages").select("page_id", F.concat(F.split("url", r"\?")[0], F.lit(".pdf")).alias("printed"))
    return summary.paired(signals, prints, "signals", "printed", "_signals.json", ".pdf").where("stem <> ''").select("conv_id", "page_id", "stem")


_CLASSES = ("AFRICA", "AMERICA", "ASIA", "EUROPE")


@query("""
WITH m AS (SELECT s_suppkey, r_name FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey),
k AS (SELECT l_orderkey, l_suppkey, CASE WHEN r_name IN ('AFRICA', 'AMERICA', 'ASIA', 'EUROPE') THEN r_name END AS c FROM lineitem LEFT JOIN m ON s_suppkey = l_suppkey),
g AS (SELECT l_orderkey, count(l_suppkey) AS n_codes, list_sort(list_distinct(list(c) FILTER (c IS NOT NULL))) AS s FROM k GROUP BY l_orderkey)
SELECT l_orderkey, n_codes, CASE WHEN len(s) > 0 THEN array_to_string(s, ',') ELSE 'UNK' END AS classes, array_to_string(list_transform(['AFRICA', 'AMERICA', 'ASIA', 'EUROPE'], lambda x: CAST(coalesce(list_contains(s, x), false) AS INTEGER)), '') AS hot FROM g""")
def class_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    mapping = read(spark, sf_dir, "supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("l_suppkey"), "r_name")
    found = summary.class_sets(read(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey"), mapping, "l_orderkey", "l_suppkey", "r_name", _CLASSES)
    return found.select("l_orderkey", "n_codes", F.array_join("classes", ",").alias("classes"), F.array_join(F.col("hot").cast("array<string>"), "").alias("hot"))


@query("""
WITH n AS (SELECT user_id, event_type, epoch(ts) / 3600 AS x, value AS y, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events),
g AS (SELECT user_id, event_type, count(*) AS points, median(y) AS median_y, min(x) AS x_lo, max(x) AS x_hi, min(y) AS y_lo, max(y) AS y_hi, max(CASE WHEN n = 1 THEN y END) AS y1, max(CASE WHEN n = 2 THEN y END) AS y2, max(CASE WHEN n = 3 THEN y END) AS y3 FROM n GROUP BY ALL)
SELECT user_id, event_type, points, points - 1 AS segments, round(median_y, 6) AS median_y, round(x_lo, 6) AS x_lo, round(x_hi, 6) AS x_hi, y_lo, y_hi, round((y_hi - y_lo) / 10, 6) AS amplitude, y1, y2, y3, round((median_y - y1) / 10, 6) AS mv1, round((median_y - y3) / 10, 6) AS mv3 FROM g""")
def path_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).withColumn("x", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 / 3600)
    d = summary.path_details(e, ["user_id", "event_type"], "x", "value", ORDER, 10.0)
    point = lambda k, c: F.get("first3", F.lit(k))[c]
    r = lambda c, name: F.round(c, 6).alias(name)
    return d.select("user_id", "event_type", "points", "segments", r("median_y", "median_y"), r("x_lo", "x_lo"), r("x_hi", "x_hi"), "y_lo", "y_hi", r("amplitude", "amplitude"), point(0, "y").alias("y1"), point(1, "y").alias("y2"), point(2, "y").alias("y3"), r(point(0, "mv"), "mv1"), r(point(2, "mv"), "mv3"))


@query("""
WITH p AS (SELECT user_id, event_type, min(epoch_us(ts) // 1000000) AS x_lo, max(epoch_us(ts) // 1000000) AS x_hi FROM events GROUP BY ALL),
s AS (SELECT *, (x_hi - x_lo) / 3600 AS seconds, CAST(round_even((x_hi - x_lo) / 3600 * 250, 0) AS BIGINT) AS samples FROM p)
SELECT user_id, event_type, min(x_lo) AS x_lo, max(x_hi) AS x_hi, round(sum(seconds), 6) AS seconds, CAST(sum(samples) AS BIGINT) AS samples, CAST(grouping(event_type) AS INTEGER) AS total FROM s GROUP BY GROUPING SETS ((user_id, event_type), (user_id))""")
def page_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).withColumn("x", F.expr("unix_micros(cast(ts as timestamp)) div 1000000"))
    t = summary.page_totals(e, "user_id", "event_type", "x", 3600.0, 250.0)
    return t.withColumn("seconds", F.round("seconds", 6))


@query(f"""
WITH {_PAIRS},
s AS (SELECT 10 * log10((ss + 1e-12) / (sse + 1e-12)) AS snr, r, 100 * sqrt(sse / (ss + 1e-12)) AS prd FROM m)
SELECT count(*) AS rows, round(avg(snr), 5) AS mean_snr, round(median(snr), 5) AS median_snr, round(avg(r), 6) AS mean_r, round(median(r), 6) AS median_r, round(avg(prd), 4) AS mean_prd, round(median(prd), 4) AS median_prd,
  CASE WHEN avg(r) > 0.95 THEN 'very good' WHEN avg(r) > 0.85 THEN 'good' WHEN avg(r) > 0.7 THEN 'fair' ELSE 'poor' END AS verdict FROM s""")
def evaluation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = summary.evaluation(_pairs(spark, sf_dir), ["snr", "r", "prd"], "r")
    places = {"mean_r": 6, "median_r": 6, "mean_prd": 4, "median_prd": 4, "mean_snr": 5, "median_snr": 5}
    return s.select("rows", *[F.round(c, n).alias(c) for c, n in places.items()], "verdict")


@query(f"""
WITH {_PAIRS},
s AS (SELECT vec_id, label, 10 * log10((ss + 1e-12) / (sse + 1e-12)) AS snr, 100 * sqrt(sse / (ss + 1e-12)) AS prd, r, sqrt(sse / n) AS rmse, maxae, label % 3 = 0 AS flat FROM m)
SELECT vec_id, label, CASE WHEN flat THEN '' ELSE format('{{:.1f}}', snr) END AS snr, CASE WHEN flat THEN '' ELSE format('{{:.2f}}', prd) END AS prd, CASE WHEN flat THEN '' ELSE format('{{:.5f}}', r) END AS r,
  CASE WHEN flat THEN '' ELSE format('{{:.2f}}', rmse * 1000) END AS rmse, CASE WHEN flat THEN '' ELSE format('{{:.1f}}', maxae * 1000) END AS maxae,
  CASE WHEN flat THEN 'flat' WHEN prd < 2 THEN 'very good' WHEN prd < 9 THEN 'good' ELSE 'review' END AS band FROM s""")
def report_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.report_rows(_pairs(spark, sf_dir), ["vec_id", "label"], F.col("label") % 3 == 0)


@query("""
WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
r AS (SELECT vec_id, 60 + abs(x[1]) * 100 AS digital, CASE WHEN label % 4 <> 0 THEN 60 + label END AS printed FROM e)
SELECT 'rec-' || vec_id AS record_id, 'processed-ecg/v1' AS schema, 12 AS lead_count, 5 AS n_samples, 'low' AS v1_confidence, 'high' AS i_confidence, 'V1' AS low_leads, round(round_even(digital, 1), 6) AS digital_bpm, CAST(printed AS BIGINT) AS printed_bpm, round(round_even(abs(round_even(digital, 1) - printed), 1), 6) AS abs_diff_bpm FROM r""")
def processed_v1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The document is written as JSON and read back by path."""
    x = read(spark, sf_dir, "embeddings").select(F.concat(F.lit("rec-"), "vec_id").alias("record_id"), F.bround(60 + F.abs(F.element_at("embedding", 1).cast("double")) * 100, 1).alias("digital"), F.when(F.col("label") % 4 != 0, 60 + F.col("label")).alias("printed"))
    records = _records(spark, sf_dir).join(x, "record_id").withColumn("low", F.array(F.lit("V1")))
    doc = D.processed_v1(records, "low", "digital", "printed").select("record_id", F.to_json("document").alias("d"))
    j = lambda path, kind="string": F.get_json_object("d", f"$.{path}").cast(kind)
    return doc.select(
        "record_id",
        j("schema").alias("schema"),
        j("recording.lead_count", "int").alias("lead_count"),
        j("recording.n_samples", "int").alias("n_samples"),
        j("leads.V1.confidence").alias("v1_confidence"),
        j("leads.I.confidence").alias("i_confidence"),
        j("quality.low_confidence_leads[0]").alias("low_leads"),
        F.round(j("quality.hr_crosscheck.digital_bpm", "double"), 6).alias("digital_bpm"),
        j("quality.hr_crosscheck.printed_bpm", "bigint").alias("printed_bpm"),
        F.round(j("quality.hr_crosscheck.abs_diff_bpm", "double"), 6).alias("abs_diff_bpm"),
    )
