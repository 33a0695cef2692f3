"""Ranks and running totals of whole tables, without a window over one partition.

Rows are range-partitioned by group and order and written, so that a range's number is fixed. A window within each range and
the ranges' totals before it make up the result: no task sees more than a range, however large a group is; the window
over totals has one row a range and group.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridlume.runtime import Written, unused


def _same(df: DataFrame, other: DataFrame, columns: list[str]) -> Column:
    return reduce(lambda a, b: a & b, (df[f"`{c}`"].eqNullSafe(other[f"`{c}`"]) for c in columns))


def running_total(rows: DataFrame, value: Column, order: list[Column], out: str, group: list[str] | None = None) -> DataFrame:
    """``rows`` with ``out``: the sum of ``value`` over the rows of the group up to and with each row.

    ``order``: expressions that tell any two rows of a group apart (ties are in either order, else). Groups may be null, and a null
    value counts as nothing. An empty table stays empty.
    """
    group, added, part = group or [], unused(rows, "_value"), unused(rows, "_range")
    keys = [F.col(f"`{c}`") for c in group]
    ranged = rows.withColumn(added, F.coalesce(value.cast("long"), F.lit(0))).repartitionByRange(*keys, *order).withColumn(part, F.spark_partition_id())
    ranged = Written(rows.sparkSession, "order").save(ranged)
    totals = ranged.groupBy(*keys, part).agg(F.sum(added).alias("_total"))
    before = totals.withColumn("_before", F.coalesce(F.sum("_total").over(W.partitionBy(*(keys or [F.lit(0)])).orderBy(part).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_total")
    inside = unused(rows, "_inside")
    summed = ranged.withColumn(inside, F.sum(added).over(W.partitionBy(*keys, part).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)))
    joined = summed.join(before, _same(summed, before, [part, *group]))
    return joined.select(*(summed[f"`{c}`"] for c in rows.columns), (F.col(inside) + F.col("_before")).alias(out))


def global_rank(rows: DataFrame, order: list[Column], out: str = "rank", group: list[str] | None = None) -> DataFrame:
    """``rows`` with their place from 1 on in each group, or in the whole table."""
    return running_total(rows, F.lit(1), order, out, group)
