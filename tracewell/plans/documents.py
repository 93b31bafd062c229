"""Queries that build nested documents, run kernels, and drain a stream."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import documents as D
from ..functions import signal as S
from ..operators import kernels
from .registry import query, read


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals as universal records: 12 leads of 5 samples from each array."""
    from ..sources.records import LEADS

    x = S.doubles(F.col("embedding"))
    leads = F.map_from_entries(F.array(*[F.struct(F.lit(lead).alias("key"), F.transform(F.slice(x, 5 * k + 1, 5), lambda v: F.bround(v, 4)).alias("value")) for k, lead in enumerate(LEADS)]))
    return read(spark, sf_dir, "embeddings").select(
        F.concat(F.lit("rec-"), "vec_id").alias("record_id"),
        leads.alias("leads"),
        F.lit(500).alias("sampling_rate"),
        F.lit(0.01).alias("duration_sec"),
        F.lit(12).alias("num_leads"),
        F.lit("parquet").alias("input_format"),
        F.lit("unknown").alias("device_vendor"),
        F.when(F.col("label") > 4, F.concat(F.lit("p"), "label")).alias("patient_id"),
        F.col("label").alias("hr"),
    )


@query("""
SELECT 'rec-' || vec_id AS record_id, CASE WHEN label > 4 THEN 'p' || label END AS patient, 12 AS num_leads, round(CAST(round_even(CAST(embedding[6] AS DOUBLE), 4) AS DOUBLE), 4) AS first_ii, 0 AS missing FROM embeddings""")
def nested_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = D.processed(_records(spark, sf_dir))
    return d.select("record_id", F.col("patient.id").alias("patient"), F.col("recording.num_leads").alias("num_leads"), F.round(F.col("leads")["II"]["signal"][0], 4).alias("first_ii"), F.size("quality.missing_leads").alias("missing"))


@query("""
SELECT 'rec-' || vec_id AS record_id, CAST(16 AS INTEGER) AS entries, 'DiagnosticReport' AS first, CASE WHEN label > 4 THEN 'p' || label ELSE 'unknown' END AS patient FROM embeddings""")
def clinical_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = D.bundles(_records(spark, sf_dir), F.lit("2024-01-01T00:00:00Z"), "hr")
    kind = lambda k, f: F.get_json_object(F.col("entry")[k]["resource"], f)
    return b.select("record_id", F.size("entry").alias("entries"), kind(0, "$.resourceType").alias("first"), kind(1, "$.id").alias("patient"))


@query()
def high_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings")
    return e.select("vec_id", kernels.high_passed(S.doubles(F.col("embedding")), 250.0).alias("filtered"))


@query()
def fft_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings")
    return e.select("vec_id", kernels.fft_resample(S.doubles(F.col("embedding")), 128).alias("resampled"))


@query()
def peak_finder(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings")
    return e.select("vec_id", kernels.find_peaks(S.doubles(F.col("embedding")), 0.05, 3, 0.05).alias("peaks"))


@query()
def cheapest_track(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A track is 500 ids in a row, so that more vectors make more tracks, not longer ones."""
    e = read(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 500).alias("track"), F.col("label").alias("x"), F.element_at("embedding", 1).cast("double").alias("v"))
    return kernels.tracked(e, ["track"], "x", "v")


def _shared(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local run without one takes the machine's."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (base or tempfile.gettempdir()).rstrip("/")


def _stream(spark: SparkSession, source: str) -> DataFrame:
    """A table, one file or a folder of them, as a stream of its files."""
    reader = spark.readStream.schema(spark.read.parquet(source).schema)
    folder, name = source.rsplit("/", 1)
    path = spark._jvm.org.apache.hadoop.fs.Path(source)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isFile():
        return reader.option("pathGlobFilter", name).parquet(folder)
    return reader.parquet(source)


@query("SELECT user_id, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE value IS NOT NULL GROUP BY user_id")
def stream_drain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a stream, drained once through a stateful aggregation; a batch's totals replace those before it, as Parquet in the shared folder."""
    from uuid import uuid4

    out = f"{_shared(spark)}/drained-{uuid4().hex}"
    totals = _stream(spark, f"{sf_dir}/events.parquet").where("value is not null").groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))

    def batch(df: DataFrame, n: int) -> None:
        df.write.mode("overwrite").parquet(f"{out}/batch={n:06d}")
        done.append(n)

    done: list[int] = []
    totals.writeStream.outputMode("complete").foreachBatch(batch).option("checkpointLocation", f"{out}-checkpoint").trigger(availableNow=True).start().awaitTermination()
    schema = "user_id long, n long, total double"
    return spark.read.schema(schema).parquet(f"{out}/batch={done[-1]:06d}") if done else spark.createDataFrame([], schema)


@query("""
WITH e AS (SELECT user_id, event_id, CAST(floor(value / 30) AS BIGINT) AS size, ts FROM events),
f AS (SELECT *, CASE WHEN size = lag(size) OVER w THEN 0 ELSE 1 END AS opens FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, size)),
g AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts, size) AS run FROM f),
h AS (SELECT *, min(ts) OVER (PARTITION BY user_id, run) AS since FROM g)
SELECT CAST(user_id AS VARCHAR) AS path, size, CAST(strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS VARCHAR) AS ready_at FROM h WHERE epoch_us(ts) - epoch_us(since) >= 36000000000 GROUP BY user_id, run, size""")
def settled_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user stands for a file, the events' values for the sizes that listings saw; files that stood still for ten hours."""
    from uuid import uuid4

    from ..streaming import ingest

    base = _shared(spark)
    source = f"{sf_dir}/events.parquet"
    stream = _stream(spark, source)
    out = f"{base}/settled-{uuid4().hex}"
    found = ingest.settled(stream.withColumn("size", F.floor(F.col("value") / 30)), "user_id", "size", "ts", 36_000)
    found.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-checkpoint").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("path string, size long, ready_at timestamp").parquet(out).withColumn("ready_at", F.date_format("ready_at", "yyyy-MM-dd HH:mm:ss.SSSSSS"))
