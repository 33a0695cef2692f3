"""Nearest-first paging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridlume.operators.order import global_rank

PAGE_SIZE, MOST_PLACES = 6, 200


def nearest_pages(places: DataFrame, lat: Column, lng: Column, group: list[str] | None = None, page_size: int = PAGE_SIZE, most: int | None = None) -> DataFrame:
    """``places`` (code, lat, lng) with rank and page by squared degree distance to a point, ties by code, unplaced last.

    Without ``group`` the places of one viewport (a few hundred) are ranked together; with it, each group is. ``most``: only
    the nearest so many are wanted; they are found by a distributed top-k before anything meets in one task.
    """
    dy, dx = F.col("lat") - lat, F.col("lng") - lng
    order = [(dy * dy + dx * dx).asc_nulls_last(), F.col("code")]
    if most is not None and not group:
        places = places.orderBy(*order).limit(most)
    w = W.partitionBy(*group) if group else W.partitionBy(F.lit(0))
    rank = F.row_number().over(w.orderBy(*order))
    return places.withColumn("rank", rank).withColumn("page", F.floor((F.col("rank") - 1) / page_size).cast("int"))


def page_slice(ranked: DataFrame, offset: int, page_size: int = PAGE_SIZE) -> DataFrame:
    """The places of one page."""
    return ranked.where(F.col("rank").between(offset + 1, offset + page_size))


def limit_guard(rows: DataFrame, most: int = MOST_PLACES) -> DataFrame:
    """One row (``n``, ``too_many``) that never counts further than one above the limit."""
    return rows.limit(most + 1).agg(F.count("*").alias("n")).withColumn("too_many", F.col("n") > most)


def cursor_state(next_offset: Column, total: Column, expires_at: Column, now: Column, matches: Column, page_size: int = PAGE_SIZE) -> Column:
    """``expired``, ``invalid`` or ``ok``: expiry first, then the match of viewport and list, then the offset's arithmetic."""
    fits = matches & (next_offset == F.floor(next_offset)) & (next_offset > 0) & (next_offset % page_size == 0) & (next_offset < total)
    return F.when(expires_at <= now, "expired").when(F.coalesce(fits, F.lit(False)), "ok").otherwise("invalid")


def next_offset(offset: Column, total: Column, page_size: int = PAGE_SIZE) -> Column:
    """Where the next page begins; null after the last."""
    after = F.least(offset + page_size, total)
    return F.when(after < total, after)


def label_rank(rows: DataFrame, label: str, key: str, group: list[str], out: str = "rank") -> DataFrame:
    """``rows`` with their place in presentation order: language-aware on the label, then the key.

    Within each group (a page, a place), or, without ``group``, in the whole table, which is ranked over ranges of labels.
    """
    if not group:
        return global_rank(rows, [F.collate(F.col(label), "UNICODE"), F.col(key)], out)
    w = W.partitionBy(*group).orderBy(F.collate(F.col(label), "UNICODE"), F.col(key))
    return rows.withColumn(out, F.row_number().over(w))


def by_label(rows: DataFrame, label: str = "label", key: str = "key") -> DataFrame:
    """Presentation order: language-aware on the label, then the key."""
    return rows.orderBy(F.collate(F.col(label), "UNICODE"), F.col(key))
