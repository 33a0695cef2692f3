"""Intermediate tables in the folder that every executor shares."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from gridlume.runtime import shared_dir, ship

class Scratch:
    """Written tables of one operator call: lineage is cut and lost executors only cost a re-read."""

    def __init__(self, spark: SparkSession, name: str):
        ship(spark)
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, table: str, release: bool = True, batch_rows: int | None = None) -> DataFrame:
        """Write ``df`` as Parquet and return the written table; ``release`` the shuffle files of the finished job then.

        While it is written, Arrow batches hold no more than ``batch_rows`` rows (or the session's own limit, if that is less).
        """
        conf, name = self.spark.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
        before = conf.get(name)
        if batch_rows and not 0 < int(before) <= batch_rows:
            conf.set(name, str(batch_rows))
        try:
            df.write.mode("overwrite").parquet(f"{self.root}/{table}")
        finally:
            conf.set(name, before)
        if release:
            self.spark._jvm.System.gc()  # Spark drops shuffle files once the driver has collected their handles
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{table}")

    def drop(self, *tables: str) -> None:
        """Remove tables that nothing reads any more (``drop()`` removes all)."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for path in [f"{self.root}/{t}" for t in tables] or [self.root]:
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)
