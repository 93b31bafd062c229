"""Queries whose two sides, or whose folds, cover the table."""

from tracewell.plans.catalogue import QUERIES


def test_upsert_covers_every_user(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    got = QUERIES["upsert_latest_all"](spark, sf)
    assert {x.user_id for x in got.collect()} == {x.user_id for x in e.select("user_id").distinct().collect()}


def test_zscores_of_every_vector(spark, sf):
    n = spark.read.parquet(f"{sf}/embeddings.parquet").count()
    got = QUERIES["zscore_all_folds"](spark, sf)
    assert got.select("vec_id").distinct().count() == n and got.select("fold").distinct().count() == 10
