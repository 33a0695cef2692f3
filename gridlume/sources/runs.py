"""A keyed table as sorted runs: writing adds a run, reading merges the runs, and runs are merged into larger ones now and then.

A run is a Parquet folder, dealt by a hash of the key into buckets and sorted by key inside. It is written beside the others
and then renamed, so it is there as a whole or not at all. Its name says which writes it covers: ``run-<first>-<last>-<rows>``. Merged
runs cover what they were made of, and readers leave out what another run covers. Covered runs are removed by the next merge, so a
reader that began before a merge has until then to finish, and a merge that breaks off leaves nothing that counts. Merging takes the newest runs as long as they outweigh half of the next
older one, so a row is written again about as often as the logarithm of the table's size, not once for each write.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_ENTRY = "key string, value string, written_ms long, expires_ms long"


@dataclass(frozen=True, order=True)
class Run:
    first: int
    last: int
    rows: int

    @property
    def name(self) -> str:
        return f"run-{self.first:010d}-{self.last:010d}-{self.rows:012d}"


class RunStore:
    """``root``: a folder that all executors share. Entries are those of ``keyed.put``; there is one writer at a time."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 16):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets
        path = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        self._fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(path)

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def runs(self) -> list[Run]:
        """Runs that no other one covers, oldest first."""
        found = self._found()
        return [r for r in found if not _covered(r, found)]

    def _found(self) -> list[Run]:
        names = (s.getPath().getName() for s in self._fs.listStatus(self._path("")))
        return sorted(Run(*map(int, n.split("-")[1:])) for n in names if n.startswith("run-"))

    def _write(self, entries: DataFrame, first: int, last: int) -> Run:
        new = f".new-{uuid.uuid4().hex}"
        rows = entries.select("key", "value", "written_ms", "expires_ms").withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(self.buckets)).cast("int"))
        rows.repartition(self.buckets, "bucket").sortWithinPartitions("bucket", "key").write.partitionBy("bucket").parquet(f"{self.root}/{new}")
        run = Run(first, last, self._rows(new).count())
        if not self._fs.rename(self._path(new), self._path(run.name)):
            raise OSError(f"{run.name} could not be put in place")
        return run

    def _rows(self, name: str) -> DataFrame:
        return self.spark.read.schema(f"{_ENTRY}, bucket int").parquet(f"{self.root}/{name}")

    def add(self, entries: DataFrame) -> Run:
        """One more run, of ``key, value, written_ms, expires_ms``; nothing else is read or written. Several rows of a key are fine."""
        at = max((r.last for r in self.runs()), default=0) + 1
        return self._write(_newest(entries), at, at)

    def table(self, runs: list[Run] | None = None) -> DataFrame:
        """All rows of all runs, with their bucket; of a key, several."""
        out = None
        for r in self.runs() if runs is None else runs:
            out = self._rows(r.name) if out is None else out.unionByName(self._rows(r.name))
        return self.spark.createDataFrame([], f"{_ENTRY}, bucket int") if out is None else out

    def read(self) -> DataFrame:
        """``key, value, written_ms, expires_ms``: the entry of each key that was written last."""
        return _newest(self.table())

    def get(self, keys: DataFrame, prefix: str = "") -> DataFrame:
        """``keys`` (``key``) with the last ``value, written_ms, expires_ms`` of each, null without one; only the keys' buckets are looked into."""
        own = keys.withColumn("_key", F.concat(F.lit(prefix), F.col("key")))
        asked = own.select(F.col("_key").alias("key")).distinct().withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(self.buckets)).cast("int"))
        found = _newest(self.table().join(asked, ["bucket", "key"], "left_semi"))
        return own.join(found.withColumnRenamed("key", "_key"), "_key", "left").drop("_key")

    def merge(self, now_ms: Column | None = None) -> list[Run]:
        """Merge the newest runs where they are worth it; entries that have expired by ``now_ms`` go if the oldest run is among them."""
        found = self._found()
        runs = [r for r in found if not _covered(r, found)]
        for r in found:
            if r not in runs:
                self._fs.delete(self._path(r.name), True)
        k, rows = len(runs) - 1, runs[-1].rows if runs else 0
        while k > 0 and runs[k - 1].rows <= 2 * rows:
            k, rows = k - 1, rows + runs[k - 1].rows
        if k < len(runs) - 1:
            own = _newest(self.table(runs[k:]))
            if now_ms is not None and k == 0:  # what is older could come to light again otherwise
                own = own.where(F.col("expires_ms") > now_ms)
            self._write(own, runs[k].first, runs[-1].last)
        return self.runs()


def _covered(run: Run, runs: list[Run]) -> bool:
    return any(o != run and o.first <= run.first and run.last <= o.last for o in runs)


def _newest(rows: DataFrame) -> DataFrame:
    last = F.max_by(F.struct("value", "written_ms", "expires_ms"), F.struct("written_ms", "expires_ms", "value"))
    return rows.groupBy("key").agg(last.alias("r")).select("key", "r.*")


def freshness(found: DataFrame, now_ms: Column, fresh_until_ms: Column) -> DataFrame:
    """``found`` (of ``RunStore.get``) with ``cache``: HIT while fresh, STALE until it expires (``value`` is served, a refresh is due), else MISS and no value."""
    live = F.coalesce(F.col("expires_ms") > now_ms, F.lit(False))
    state = F.when(~live, "MISS").when(F.coalesce(now_ms < fresh_until_ms, F.lit(False)), "HIT").otherwise("STALE")
    return found.withColumn("cache", state).withColumn("value", F.when(F.col("cache") != "MISS", F.col("value")))
