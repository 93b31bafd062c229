"""Queries over the relational tables: lookups, checks, lists and key figures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import categories as C
from ..operators import metrics
from ..operators import warehouse as wh
from .registry import query, read


@query("""
SELECT count(*) AS orders, count(DISTINCT o_custkey) AS customers, count(*) FILTER (WHERE o_orderstatus = 'F') AS completed, count(*) FILTER (WHERE o_orderstatus = 'P') AS pending,
  count(*) FILTER (WHERE o_orderdate >= TIMESTAMP '1998-10-01' AND o_orderdate < TIMESTAMP '1998-11-01') AS this_month, round(avg(o_totalprice), 2) AS mean_price, round(max(o_totalprice) * 1.25, 2) AS axis_top FROM orders""")
def kpi_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, d = read(spark, sf_dir, "orders"), F.col("o_orderdate")
    return o.agg(
        F.count("*").alias("orders"),
        F.countDistinct("o_custkey").alias("customers"),
        F.count_if(F.col("o_orderstatus") == "F").alias("completed"),
        F.count_if(F.col("o_orderstatus") == "P").alias("pending"),
        F.count_if((d >= F.lit("1998-10-01").cast("timestamp_ntz")) & (d < F.lit("1998-11-01").cast("timestamp_ntz"))).alias("this_month"),
        F.round(F.avg("o_totalprice"), 2).alias("mean_price"),
        F.round(F.max("o_totalprice") * 1.25, 2).alias("axis_top"),
    )


@query("SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, count(*) AS n FROM orders GROUP BY 1")
def monthly_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").groupBy(F.date_trunc("month", "o_orderdate").cast("date").alias("month")).agg(F.count("*").alias("n"))


@query("SELECT o_orderpriority, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 2) AS percent FROM orders GROUP BY 1")
def share_of_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wh.shares(read(spark, sf_dir, "orders"), "o_orderpriority")


@query("""SELECT c_custkey, c_name, n_name FROM customer JOIN nation ON n_nationkey = c_nationkey
WHERE (contains(lower(c_name), '00014') OR contains(lower(n_name), 'nation_3')) AND c_mktsegment = 'BUILDING'""")
def search_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer").join(read(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    return wh.searched(c, "00014", ["c_name"], None).unionByName(wh.searched(c, "NATION_3", ["n_name"], None)).distinct().where("c_mktsegment = 'BUILDING'").select("c_custkey", "c_name", "n_name")


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_custkey = 37")
def rls_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wh.visible(read(spark, sf_dir, "orders"), "PATIENT", 37, "o_custkey").select("o_orderkey", "o_orderstatus")


@query("""
SELECT c_custkey, CASE WHEN c_acctbal IS NULL THEN 'unknown' WHEN c_acctbal < 60 THEN 'bradycardia' WHEN c_acctbal > 100 THEN 'tachycardia' ELSE 'normal' END AS category,
  coalesce(c_acctbal BETWEEN 350 AND 4400, false) AS in_range, coalesce(nullif(trim(nullif(c_mktsegment, 'MACHINERY')), ''), 'unknown') AS segment,
  CASE WHEN c_acctbal > 0 THEN round(70 / pow(c_acctbal / 100, 2), 6) END AS bmi,
  CASE WHEN upper(c_mktsegment) IN ('ADMIN', 'ADMINISTRATOR') THEN 'ADMIN' WHEN upper(c_mktsegment) IN ('NAKES', 'DOCTOR', 'NURSE', 'STAFF') THEN 'NAKES' ELSE 'PATIENT' END AS role FROM customer""")
def case_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, bal = read(spark, sf_dir, "customer"), F.col("c_acctbal")
    segment = C.or_unknown(F.nullif("c_mktsegment", F.lit("MACHINERY")))
    return c.select("c_custkey", C.rate_category(bal).alias("category"), C.in_range(bal, 350, 4400).alias("in_range"), segment.alias("segment"), F.round(C.bmi(F.lit(70.0), bal), 6).alias("bmi"), C.role(F.col("c_mktsegment")).alias("role"))


@query("""
SELECT o_orderkey, CAST(date_diff('year', CAST(o_orderdate AS DATE), DATE '2024-06-15') - CASE WHEN strftime(DATE '2024-06-15', '%m%d') < strftime(o_orderdate, '%m%d') THEN 1 ELSE 0 END AS INTEGER) AS age FROM orders""")
def age_in_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    born = F.to_date("o_orderdate")
    return read(spark, sf_dir, "orders").select("o_orderkey", C.age_years(born, F.to_date(F.lit("2024-06-15"))).alias("age"))


@query("""
SELECT o_custkey, o_orderkey, o_totalprice, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS INTEGER) AS rank FROM orders) WHERE rank <= 3""")
def recent_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wh.top_n(read(spark, sf_dir, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.col("o_orderkey")], 3).select("o_custkey", "o_orderkey", "o_totalprice", "rank")


@query("""
SELECT c_custkey, coalesce(n_name, 'unknown') AS n_name FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey < 3) ON n_nationkey = c_nationkey""")
def lookup_with_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    dim = read(spark, sf_dir, "nation").where("n_regionkey < 3").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return wh.lookup(read(spark, sf_dir, "customer"), dim, ["c_nationkey"], {"n_name": "unknown"}).select("c_custkey", "n_name")


@query("SELECT count(*) AS n, min(o_orderkey) AS first FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def semi_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    returned = read(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return wh.paired(read(spark, sf_dir, "orders"), returned, ["o_orderkey"]).agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first"))


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def anti_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = read(spark, sf_dir, "orders").where("o_orderstatus = 'F'")
    return wh.orphans(read(spark, sf_dir, "customer"), done, "c_custkey", "o_custkey").select("c_custkey")


@query("SELECT o_custkey, CAST(o_orderdate AS DATE) AS day, count(*) AS n FROM orders GROUP BY ALL HAVING count(*) > 1")
def unique_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wh.violations(read(spark, sf_dir, "orders").withColumn("day", F.to_date("o_orderdate")), ["o_custkey", "day"])


@query("""
WITH e AS (SELECT r_regionkey, r_name, n_nationkey, n_name FROM region JOIN nation ON n_regionkey = r_regionkey WHERE n_nationkey % 2 = 0)
SELECT r_name, string_agg(n_name, '; ' ORDER BY n_nationkey) AS described FROM e GROUP BY r_name""")
def code_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read(spark, sf_dir, "nation")
    held = n.groupBy("n_regionkey").agg(F.collect_list("n_nationkey").alias("codes")).join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return wh.described(held, ["r_name"], "codes", n.where("n_nationkey % 2 = 0"), "n_nationkey", "n_name")


@query("""
WITH t AS (SELECT user_id, event_id, value FROM events WHERE event_id % 2 = 0), b AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM t),
c AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events WHERE event_id % 7 = 1)
SELECT user_id, event_id, value FROM c WHERE k = 1 UNION ALL SELECT user_id, event_id, value FROM b WHERE k = 1 AND user_id NOT IN (SELECT user_id FROM c)""")
def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select("user_id", "event_id", "value")
    base = wh.latest(e.where("event_id % 2 = 0"), ["user_id"], [F.desc("event_id")])
    return wh.upserted(base, e.where("event_id % 7 = 1"), ["user_id"], [F.desc("event_id")])


@query("""
WITH b AS (SELECT * FROM events WHERE ts < TIMESTAMP '2024-01-16' OR ts IS NULL), c AS (SELECT * FROM events WHERE ts >= TIMESTAMP '2024-01-16'),
x AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM c
  UNION ALL SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) FROM b WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.user_id = b.user_id))
SELECT user_id, event_id, value FROM x WHERE k = 1""")
def upsert_latest_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event is on one side: those before a time are the base, the rest the changes."""
    e = read(spark, sf_dir, "events").select("user_id", "event_id", "value", F.coalesce(F.col("ts") >= F.lit("2024-01-16").cast("timestamp_ntz"), F.lit(False)).alias("late"))
    base = wh.latest(e.where("not late").drop("late"), ["user_id"], [F.desc("event_id")])
    return wh.upserted(base, e.where("late").drop("late"), ["user_id"], [F.desc("event_id")])


@query("""
WITH b AS (SELECT o_orderkey, o_totalprice AS v FROM orders WHERE o_orderkey % 10 < 8), a AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS v FROM orders WHERE o_orderkey % 10 > 1)
SELECT coalesce(b.o_orderkey, a.o_orderkey) AS o_orderkey, CASE WHEN b.o_orderkey IS NULL THEN 'added' WHEN a.o_orderkey IS NULL THEN 'deleted' ELSE 'changed' END AS change
FROM b FULL JOIN a ON a.o_orderkey = b.o_orderkey WHERE a.o_orderkey IS NULL OR b.o_orderkey IS NULL OR a.v <> b.v""")
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("v"))
    after = o.where("o_orderkey % 10 > 1").withColumn("v", F.when(F.col("o_orderkey") % 5 == 0, F.col("v") + 1).otherwise(F.col("v")))
    return wh.snapshot_diff(o.where("o_orderkey % 10 < 8"), after, "o_orderkey", "v")


@query("""
SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(CAST(l_quantity AS DECIMAL(18, 2))) AS DOUBLE) AS quantity FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)""")
def cube_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    quantity = F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double")
    return read(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), quantity.alias("quantity"))


@query()
def approx_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.approx_count_distinct("l_partkey", 0.02).alias("parts"))


@query("""
SELECT n_name, count(*) AS orders, CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS DOUBLE) AS total FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey WHERE r_name = 'ASIA' GROUP BY n_name""")
def sessions_by_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region").where("r_name = 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey"))
    c = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey").join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    o = read(spark, sf_dir, "orders").select("o_custkey", "o_totalprice").join(c, F.col("o_custkey") == F.col("c_custkey"))
    return o.groupBy("n_name").agg(F.count("*").alias("orders"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total"))


@query("""
WITH x AS (SELECT doc_id, quality AS v, 'quality' AS k FROM labels UNION ALL SELECT doc_id, toxic, 'toxic' FROM labels)
SELECT k AS class, CAST(sum(v) AS BIGINT) AS positives, count(*) AS labelled FROM x GROUP BY k""")
def class_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = read(spark, sf_dir, "labels").unpivot(["doc_id"], ["quality", "toxic"], "class", "v")
    return x.groupBy("class").agg(F.sum(F.col("v").cast("long")).alias("positives"), F.count("*").alias("labelled"))


@query("""
SELECT l.doc_id, max(CASE WHEN lang = 'en' THEN 1 ELSE 0 END) AS en, max(CASE WHEN lang = 'de' THEN 1 ELSE 0 END) AS de, max(CASE WHEN lang = 'fr' THEN 1 ELSE 0 END) AS fr FROM labels l JOIN documents d ON d.doc_id = l.doc_id GROUP BY l.doc_id HAVING max(CASE WHEN lang IN ('en', 'de', 'fr') THEN 1 ELSE 0 END) = 1""")
def multi_hot_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "labels").join(read(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    hot = lambda v: F.max(F.when(F.col("lang") == v, 1).otherwise(0)).alias(v)
    return d.groupBy("doc_id").agg(hot("en"), hot("de"), hot("fr")).where("en + de + fr > 0")


@query("""
SELECT page_id, regexp_extract(regexp_extract(split_part(split_part(url, '?', 1), '#', 1), '/([^/]*)$', 1), '^([^.]*)', 1) AS stem,
  CASE lower(regexp_extract(split_part(split_part(url, '?', 1), '#', 1), '/[^/]*\\.([^./]+)$', 1)) WHEN 'csv' THEN 'csv' WHEN 'json' THEN 'json' WHEN 'pdf' THEN 'pdf' WHEN 'xml' THEN 'xml' WHEN 'dat' THEN 'wfdb' ELSE 'unknown' END AS format FROM pages""")
def format_sniff(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = F.regexp_extract(F.regexp_replace("url", r"[?#].*$", ""), r"/([^/]*)$", 1)
    return read(spark, sf_dir, "pages").select("page_id", F.regexp_extract(last, r"^([^.]*)", 1).alias("stem"), C.file_format(last).alias("format"))


@query("""SELECT base, page_id FROM (SELECT page_id, split_part(split_part(url, '://', 2), '/', 1) AS base, row_number() OVER (PARTITION BY split_part(split_part(url, '://', 2), '/', 1) ORDER BY url, page_id) AS k FROM pages) WHERE k = 1""")
def distinct_by_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "pages").withColumn("base", F.regexp_extract("url", "^[^:]*://([^/]*)", 1))
    return wh.latest(p, ["base"], [F.col("url"), F.col("page_id")]).select("base", "page_id")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", F.from_json("props", "k BIGINT")["k"].alias("k"))


@query("""
SELECT page_id, regexp_extract(html, '<html lang="([a-z]+)"', 1) AS lang, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, len(regexp_extract_all(html, '<p>')) AS paragraphs, contains(html, '<article') AS has_article FROM pages""")
def html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.col("html")
    return read(spark, sf_dir, "pages").select("page_id", F.regexp_extract(h, '<html lang="([a-z]+)"', 1).alias("lang"), F.regexp_extract(h, "<title>([^<]*)</title>", 1).alias("title"), F.regexp_count(h, F.lit("<p>")).cast("long").alias("paragraphs"), h.contains("<article").alias("has_article"))


@query("""
SELECT doc_id, nullif(regexp_extract(text, '([A-Za-z0-9._]+@[A-Za-z0-9.-]+)', 1), '') AS mail, TRY_CAST(nullif(regexp_extract(text, 'version ([0-9]+)', 1), '') AS INTEGER) AS version, coalesce(nullif(regexp_extract(text, 'Licensed under ([A-Z][A-Za-z-]+)', 1), ''), nullif(regexp_extract(text, 'under the ([A-Z]+)', 1), '')) AS license FROM documents""")
def regex_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return read(spark, sf_dir, "documents").select("doc_id", C.matched(t, "([A-Za-z0-9._]+@[A-Za-z0-9.-]+)").alias("mail"), C.matched(t, "version ([0-9]+)").try_cast("int").alias("version"), C.matched(t, "Licensed under ([A-Z][A-Za-z-]+)", "under the ([A-Z]+)").alias("license"))


@query("""
SELECT conv_id, string_agg(role || ':' || CAST(length(text) AS VARCHAR), ' | ' ORDER BY turn) AS notes, count(*) AS turns FROM conversations GROUP BY conv_id""")
def ordered_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "conversations").withColumn("piece", F.concat("role", F.lit(":"), F.length("text")))
    ordered = F.array_sort(F.collect_list(F.struct("turn", "piece")))
    return c.groupBy("conv_id").agg(F.array_join(F.transform(ordered, lambda s: s["piece"]), " | ").alias("notes"), F.count("*").alias("turns"))


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_totalprice = (SELECT max(o_totalprice) FROM orders)")
def arg_max_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = F.max(F.struct("o_totalprice", "o_orderkey", "o_orderpriority")).alias("b")
    return read(spark, sf_dir, "orders").agg(best).select("b.o_orderkey", "b.o_orderpriority")


@query("""
SELECT lower(x.kind) AS kind, x.id FROM (SELECT 'Customer' AS kind, c_nationkey AS id FROM customer UNION SELECT 'Supplier', s_nationkey FROM supplier) x
WHERE x.id IN (SELECT n_nationkey FROM nation EXCEPT SELECT n_nationkey FROM nation WHERE n_regionkey = 1)""")
def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer").select(F.lit("customer").alias("kind"), F.col("c_nationkey").alias("id"))
    s = read(spark, sf_dir, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_nationkey").alias("id"))
    n = read(spark, sf_dir, "nation")
    kept = n.select(F.col("n_nationkey").alias("id")).exceptAll(n.where("n_regionkey = 1").select("n_nationkey"))
    return c.unionByName(s).distinct().join(kept, "id", "left_semi").select("kind", "id")


@query("""
WITH d AS (SELECT conv_id, turn, CASE conv_id % 6 WHEN 0 THEN 'Sinus bradycardia' WHEN 1 THEN 'TACHYCARDIA' WHEN 2 THEN 'Lead off' WHEN 3 THEN 'Sinus rhythm' WHEN 4 THEN 'Arrhythmia' END AS dx, 40 + (conv_id * 7 + turn) % 120 AS hr FROM conversations),
c AS (SELECT *, CASE WHEN lower(dx) LIKE '%brady%' THEN 'brady' WHEN lower(dx) LIKE '%tachy%' THEN 'tachy' WHEN lower(dx) LIKE '%lead off%' THEN 'lead_off' WHEN lower(dx) LIKE '%sinus%' OR lower(dx) LIKE '%arrhythmia%' OR lower(dx) LIKE '%rhythm%' THEN 'sinus' ELSE 'other' END AS category FROM d)
SELECT conv_id, turn, category, CASE category WHEN 'brady' THEN hr BETWEEN -8 AND 68 WHEN 'tachy' THEN hr BETWEEN 92 AND 258 WHEN 'sinus' THEN hr BETWEEN 42 AND 118 END AS consistent FROM c""")
def rhythm_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A diagnosis and a heart rate for each turn: the rhythm's category, and whether the rate fits its range; null where it has none."""
    kinds = ("Sinus bradycardia", "TACHYCARDIA", "Lead off", "Sinus rhythm", "Arrhythmia")
    dx = F.coalesce(*(F.when(F.col("conv_id") % 6 == k, name) for k, name in enumerate(kinds)))
    c = read(spark, sf_dir, "conversations").select("conv_id", "turn", (40 + (F.col("conv_id") * 7 + F.col("turn")) % 120).alias("hr"), C.rhythm(dx).alias("r"))
    return c.select("conv_id", "turn", "r.category", C.consistent(F.col("hr"), F.col("r.lo"), F.col("r.hi")).alias("consistent"))


@query("""
WITH s AS (SELECT l.quality, l.toxic, d.n_chars AS score FROM labels l JOIN documents d USING (doc_id)),
t AS (SELECT 'quality' AS class, score, quality AS y FROM s UNION ALL SELECT 'toxic', score, toxic FROM s),
r AS (SELECT class, y, rank() OVER (PARTITION BY class ORDER BY score) + (count(*) OVER (PARTITION BY class, score) - 1) / 2.0 AS rk FROM t),
a AS (SELECT class, (sum(rk * y) - sum(y) * (sum(y) + 1) / 2.0) / nullif(sum(y) * sum(1 - y), 0) AS auc FROM r GROUP BY class),
f AS (SELECT class, 2.0 * count(*) FILTER (WHERE score > 1000 AND y = 1) / (2 * count(*) FILTER (WHERE score > 1000 AND y = 1) + count(*) FILTER (WHERE score > 1000 AND y = 0) + count(*) FILTER (WHERE score <= 1000 AND y = 1)) AS f1 FROM t GROUP BY class)
SELECT round(avg(auc), 8) AS macro_auc, round(avg(f1), 8) AS macro_f1 FROM a JOIN f USING (class)""")
def macro_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means over the classes: of the AUC, where a class has both labels, and of F1."""
    d = read(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").alias("score"))
    s = read(spark, sf_dir, "labels").join(d, "doc_id").unpivot(["doc_id", "score"], ["quality", "toxic"], "class", "y")
    f = metrics.f1(s.withColumn("p", (F.col("score") > 1000).cast("int")), "p", "y", ["class"]).select("class", "f1")
    a = metrics.auc(s, "score", "y", ["class"]).select("class", "auc")
    return a.join(f, "class").agg(F.round(F.avg("auc"), 8).alias("macro_auc"), F.round(F.avg("f1"), 8).alias("macro_f1"))
