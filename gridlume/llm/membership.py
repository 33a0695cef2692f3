"""Marking the rows whose id is in another table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Ids (16 bytes each) up to which the list goes to every task; longer lists are joined by shuffle.
MOST_BROADCAST_IDS = 1_000_000


def mark_members(rows: DataFrame, ids: DataFrame, most: int = MOST_BROADCAST_IDS) -> DataFrame:
    """``rows`` (with ``doc_id``) and a boolean ``target``: whether the id is in the only column of ``ids``. Null ids are not."""
    wanted = ids.select(F.col(ids.columns[0]).cast("long").alias("doc_id")).where("doc_id is not null").distinct().withColumn("target", F.lit(True))
    if wanted.limit(most + 1).count() <= most:
        wanted = F.broadcast(wanted)
    return rows.join(wanted, "doc_id", "left").withColumn("target", F.coalesce("target", F.lit(False)))
