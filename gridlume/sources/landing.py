"""Landed inputs: files that other systems drop, read with explicit schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlume.functions.geo import bounds, center, geometry_bounds, snapped
from gridlume.operators.ingest import REPORT, decode_json
from gridlume.sources.reports import report_files


def tables(spark: SparkSession, path: str, *names: str) -> list[DataFrame]:
    """Parquet tables of a folder; local timestamps become instants of the session's zone (UTC)."""
    found = []
    for name in names:
        df = spark.read.parquet(f"{path}/{name}.parquet")
        found.append(df.withColumns({c: F.col(c).cast("timestamp") for c, t in df.dtypes if t == "timestamp_ntz"}))
    return found


def report_landing(spark: SparkSession, path: str) -> DataFrame:
    """Reports (one JSON text a file) of a folder partitioned by ``insee``: ``insee, report, error``; bad files keep their row."""
    rows = report_files(spark, path).withColumnRenamed("error", "_unread").drop("path")
    found = decode_json(rows, "value", REPORT, out="report")
    return found.withColumn("error", F.coalesce("_unread", "error")).drop("value", "_unread")


def places_in(places: DataFrame, box: Column, most: int = 200) -> tuple[DataFrame, DataFrame]:
    """Places whose box meets the snapped viewport, first of each code, and the one-row guard against too many.

    The box columns (south, west, north, east) are plain, so the comparison reaches the Parquet scan.
    """
    from gridlume.operators.paging import limit_guard
    from gridlume.operators.rollup import distinct_first

    b = snapped(box, 0.0001)
    hit = places.where((F.col("west") <= b["east"]) & (F.col("east") >= b["west"]) & (F.col("south") <= b["north"]) & (F.col("north") >= b["south"]))
    own = distinct_first(hit, ["code"]).withColumn("center", center(bounds(F.col("south"), F.col("west"), F.col("north"), F.col("east"))))
    return own, limit_guard(hit, most)


def with_boxes(places: DataFrame, polygons: str = "polygons") -> DataFrame:
    """``places`` with plain box columns of their outlines (null without one), ready to be written as Parquet."""
    return places.withColumn("_b", geometry_bounds(F.col(polygons))).select("*", "_b.*").drop("_b")


def request_box(contour_box: Column, viewport: Column, center_point: Column) -> Column:
    """The box in which a place's streets are asked for: its outline's grown by 4 %, else the viewport, else 0.03 degrees around."""
    from gridlume.functions.geo import padded

    c = center_point
    near = F.when(c.isNotNull(), bounds(c["lat"] - 0.03, c["lng"] - 0.03, c["lat"] + 0.03, c["lng"] + 0.03))
    return F.coalesce(F.when(contour_box.isNotNull(), padded(contour_box, 0.04)), viewport, near)
