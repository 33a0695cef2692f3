"""Streaming state: one small state a key, however many events it sees.

State lives in the RocksDB provider (``use_rocksdb``); within a batch a key's events are taken in order of time, then id.
They are sorted in memory for that, so bound a batch by its source (``maxFilesPerTrigger``).
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from gridlume.runtime import shared_dir, ship


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class TokenBucket(StatefulProcessor):
    """A key's balance and the time it holds for."""

    def __init__(self, rate: float, burst: float):
        self.rate, self.burst = rate, burst

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.balance = handle.getValueState("balance", "tokens double, at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:  # noqa: N802
        tokens, at = self.balance.get() if self.balance.exists() else (float(self.burst), None)
        f = pd.concat(list(rows)).sort_values(["ms", "event_id"])
        out = []
        for ms, event in zip(f["ms"].tolist(), f["event_id"].tolist(), strict=True):
            tokens = min(self.burst, tokens + max(0, ms - (ms if at is None else at)) * self.rate / 1000)
            at, ok = ms, tokens >= 1
            tokens -= ok
            out.append((key[0], event, ms, ok, tokens, None if ok else max(1, math.ceil((1 - tokens) / self.rate))))
        self.balance.update((float(tokens), at))
        yield pd.DataFrame(out, columns=["key", "event_id", "ms", "allowed", "tokens", "retry_after"]).astype({"retry_after": "Int64"})

    def close(self) -> None:
        pass


class FreshnessCache(StatefulProcessor):
    """When a key was last refreshed."""

    def __init__(self, fresh_ms: int):
        self.fresh_ms = fresh_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.entry = handle.getValueState("entry", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:  # noqa: N802
        at = self.entry.get()[0] if self.entry.exists() else None
        f = pd.concat(list(rows)).sort_values(["ms", "event_id"])
        out = []
        for ms, event in zip(f["ms"].tolist(), f["event_id"].tolist(), strict=True):
            outcome = "MISS" if at is None else "HIT" if ms - at < self.fresh_ms else "STALE"
            at = at if outcome == "HIT" else ms
            out.append((key[0], event, ms, outcome))
        self.entry.update((at,))
        yield pd.DataFrame(out, columns=["key", "event_id", "ms", "outcome"])

    def close(self) -> None:
        pass


def token_bucket_stream(events: DataFrame, key: str, rate: float, burst: float) -> DataFrame:
    """``key, event_id, ms, allowed, tokens, retry_after`` of a stream with ``event_id`` and ``ms``."""
    rows = events.select(F.col(key).alias("key"), "event_id", "ms")
    ship(events.sparkSession)
    kind = dict(rows.dtypes)["key"]
    return rows.groupBy("key").transformWithStateInPandas(TokenBucket(rate, burst), f"key {kind}, event_id long, ms long, allowed boolean, tokens double, retry_after long", "Append", "None")


def freshness_stream(events: DataFrame, key: str, fresh_ms: int) -> DataFrame:
    """``key, event_id, ms, outcome`` of a stream with ``event_id`` and ``ms``."""
    rows = events.select(F.col(key).alias("key"), "event_id", "ms")
    ship(events.sparkSession)
    kind = dict(rows.dtypes)["key"]
    return rows.groupBy("key").transformWithStateInPandas(FreshnessCache(fresh_ms), f"key {kind}, event_id long, ms long, outcome string", "Append", "None")


def coalesce_stream(events: DataFrame, key: str, time: str, within: str) -> DataFrame:
    """The first of equal requests within a watermark."""
    return events.withWatermark(time, within).dropDuplicatesWithinWatermark([key])


def rate_counts(events: DataFrame, key: str, time: str, seconds: int, late: str) -> DataFrame:
    """Requests a key and fixed window; the window closes with the watermark."""
    return events.withWatermark(time, late).groupBy(F.window(time, f"{seconds} seconds"), key).agg(F.count("*").alias("n"))


def drain(stream: DataFrame, name: str) -> DataFrame:
    """Run a stream over all that has arrived, into Parquet files of the shared folder, and return them as a table."""
    root = f"{shared_dir(stream.sparkSession)}/stream-{name}-{uuid.uuid4().hex}"
    query = stream.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{root}/out")
