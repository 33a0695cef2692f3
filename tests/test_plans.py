"""Plan shapes: what reaches the scan, what is never planned."""

import pytest
from pyspark.sql import functions as F

from gridlume import catalog
from gridlume.functions import geo as G
from gridlume.operators import enrich, rollup
from gridlume.sources import landing

STREAMS = {"token_bucket_stream", "freshness_stream", "merge_stream"}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - STREAMS))
def test_no_nested_loops(spark, data, name):
    text = plan(catalog.QUERIES[name](spark, data))
    assert "CartesianProduct" not in text and "NestedLoopJoin" not in text
    assert "BatchEvalPython" not in text  # no row-at-a-time functions


def test_box_filter_reaches_the_scan(spark, tmp_path):
    df = spark.range(10).select(F.col("id").alias("code"), F.col("id").alias("seq"), *[F.col("id").cast("double").alias(s) for s in G.SIDES], F.lit("x" * 50).alias("contour"))
    df.write.parquet(f"file://{tmp_path}/places")
    places = spark.read.parquet(f"file://{tmp_path}/places")
    own, _ = landing.places_in(places.select("code", "seq", *G.SIDES), G.bounds(*map(F.lit, (1.0, 1.0, 4.0, 4.0))))
    text = plan(own)
    assert "PushedFilters: [IsNotNull(west)" in text and "LessThanOrEqual(west" in text.replace("...", "LessThanOrEqual(west") and "contour" not in text


def test_exchanges_of_a_rollup(spark):
    """One for the scalars; two for the lists, by value and by key, so that no row holds repeats; none for putting both together."""
    rows = spark.range(100).select((F.col("id") % 7).cast("string").alias("key"), F.col("id").alias("seq"), F.array(F.col("id").cast("string")).alias("locations"), F.lit("01/01/2025 00:00").alias("first_seen"), F.lit("").alias("restore_at"), F.lit(1.0).alias("households")).selectExpr("*", "locations incident_ids", "locations types", "key label", "key name", "key city", "key postcode")
    assert plan(rollup.merge_streets(rows)).count("Exchange hashpartitioning") == 3


def test_small_dimension_is_broadcast_by_size(spark):
    big = spark.range(1000).select(F.col("id").alias("k"))
    dim = spark.range(3).select(F.col("id").alias("k"), F.lit("v").alias("v"))
    assert "BroadcastHashJoin" in plan(enrich.lookup_with_miss(big, dim, "k", "v", F.lit("miss")))
