"""Connected components by alternating large-star and small-star steps, all in DataFrames."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlume.llm.scratch import Scratch


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """Hang the neighbours of each node (only the smaller ones if ``small``, else the larger) on its least neighbour."""
    if small:
        sides = edges.select("u", "v")  # v < u holds
    else:
        sides = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = sides.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = sides.join(least, "u")
    if small:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    else:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.where("u <> v").distinct()


def connected_components(edges: DataFrame, scratch: Scratch, tag: str) -> DataFrame:
    """``node, component`` (least reachable node) for every node of ``edges`` (two columns of ids, any names).

    Rounds grow with the logarithm of the longest chain and have no limit. Each round is written to the shared folder, and ends the
    loop when it changes nothing. A node with very many neighbours is pre-aggregated by ``min`` and joined under
    adaptive skew handling. Null ids and self links are ignored; no rows give no rows.
    """
    a, b = edges.columns[:2]
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(f"`{a}` is not null and `{b}` is not null and u <> v").distinct()
    now, seen, last = scratch.save(now, f"{tag}-0", release=False), None, f"{tag}-0"
    for k in itertools.count(1):
        # no arithmetic on the ids: they may be any 64-bit numbers
        print_ = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first()
        if tuple(print_) == seen:
            break
        seen = tuple(print_)
        now = scratch.save(_star(_star(now, False), True), f"{tag}-{k}", release=False)
        scratch.drop(last)
        last = f"{tag}-{k}"
    members = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return members.union(roots)
