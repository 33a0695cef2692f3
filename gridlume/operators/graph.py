"""Connected components of an edge table, in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlume.runtime import Written


def _hung(edges: DataFrame, both_ways: bool) -> DataFrame:
    """Each node's neighbours hang on the least of them and itself: the larger ones (``both_ways``), or the smaller ones and itself."""
    sides = edges.unionByName(edges.select(F.col("lo").alias("hi"), F.col("hi").alias("lo"))) if both_ways else edges
    root = sides.groupBy("hi").agg(F.min("lo").alias("root")).select("hi", F.least("hi", "root").alias("root"))
    met = sides.join(root, "hi")
    if both_ways:
        out = met.where("lo > hi").select(F.col("lo").alias("hi"), F.col("root").alias("lo"))
    else:
        out = met.select(F.col("lo").alias("hi"), F.col("root").alias("lo")).unionByName(root.select("hi", F.col("root").alias("lo")))
    return out.where("hi <> lo").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, component`` (the least node reachable) for every node of ``edges`` (two columns of numbers).

    Star contraction: rounds grow with the logarithm of the longest path, and each is written. A node with very many neighbours
    is one row of a partial minimum, then a skewed join that Spark splits. Self links and nulls are ignored.
    """
    a, b = (F.col(f"`{c}`") for c in edges.columns[:2])
    written = Written(edges.sparkSession, "components")
    now, seen = written.save(edges.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).where(a.isNotNull() & b.isNotNull() & (a != b)).distinct()), None
    while (state := tuple(now.agg(F.count("*"), F.bit_xor(F.xxhash64("hi", "lo")), F.bit_xor(F.xxhash64("lo", "hi"))).first())) != seen:
        seen = state
        now = written.save(_hung(_hung(now, True), False))
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(now.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct())
