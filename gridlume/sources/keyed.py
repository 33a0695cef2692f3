"""Keyed tables with expiry: a cache's contract on Parquet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlume.functions.scalars import digest_key

LEAST_TTL_S = 60


def put(entries: DataFrame, now_ms: Column, ttl_s: Column, prefix: str = "") -> DataFrame:
    """``key, value, written_ms, expires_ms``; times to live are whole seconds, at least a minute; none or less stores nothing."""
    ttl = F.greatest(F.ceil(ttl_s), F.lit(LEAST_TTL_S))
    return entries.where(ttl_s > 0).select(F.concat(F.lit(prefix), F.col("key")).alias("key"), "value", now_ms.cast("long").alias("written_ms"), (now_ms + ttl * 1000).cast("long").alias("expires_ms"))


def upsert(table: DataFrame, new: DataFrame) -> DataFrame:
    """The table after its rows and the new ones: the last written of each key."""
    both = table.unionByName(new)
    return both.groupBy("key").agg(F.max_by(F.struct("value", "written_ms", "expires_ms"), F.struct("written_ms", "expires_ms")).alias("r")).select("key", "r.*")


def get(table: DataFrame, keys: DataFrame, now_ms: Column, prefix: str = "") -> DataFrame:
    """``keys`` with their live value, null where there is none or it has expired."""
    live = table.where(F.col("expires_ms") > now_ms).select("key", "value")
    return keys.withColumn("_k", F.concat(F.lit(prefix), F.col("key"))).join(live.withColumnRenamed("key", "_k"), "_k", "left").drop("_k")


def versioned(value: Column, schema: str, version: int) -> Column:
    """A stored JSON value as a struct, null (so a miss) if its ``version`` is another."""
    parsed = F.from_json(value, schema)
    return F.when(parsed["version"] == version, parsed)


def batch_key(prefix: str, box_key: Column, names: Column) -> Column:
    """The cache key of a batch of names in a box: prefix, box, digest of the sorted names."""
    return F.concat_ws(":", F.lit(prefix), box_key, digest_key(names))
