"""Renewals of keys with very many events: chains of pointers instead of one walk.

An entry that was renewed at time t is renewed next by the first event at or after t + ``lasts``. A key's events are ranked over
ranges and cut into blocks of equal length; a block's task follows the pointers inside it for every event at once, so each event
knows the last renewal of its block if the chain came in there. The time at which that one runs out points on into a later
block; its place follows from a running count of events up to that time. Such pointers between blocks are few: only where chains
can come in. Doubling them tells which ones the key's own chain uses, in as many rounds as the logarithm of the blocks. At the
end each block, given where its chain comes in and what was in force before, is finished by itself.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridlume.operators.order import global_rank, running_total
from gridlume.runtime import Written, ship

#: Events of a key up to which it is walked by one task; events in a block of a larger key.
MOST_EVENTS, BLOCK = 1_000_000, 200_000


def _pointers(ms: np.ndarray, lasts: int) -> np.ndarray:
    """For each event (in order) the place of the one that renews next, at least the number of events if it lies outside."""
    return np.maximum(np.searchsorted(ms, ms + lasts), np.arange(1, len(ms) + 1))


def _last_in_block(ms: np.ndarray, lasts: int) -> np.ndarray:
    """For each event the last renewal inside the block, if the event is one."""
    after = _pointers(ms, lasts)
    at = np.where(after < len(ms), after, np.arange(len(ms)))
    while True:
        further = at[at]
        if (further == at).all():
            return at
        at = further


def renewals(events: DataFrame, key: str, lasts: int, block: int = BLOCK) -> DataFrame:
    """``key, event_id, ms, renews, since, leader`` of every event (``key``, ``ms``, ``event_id``; no null times).

    The first event of a key renews, and each first one at or after the last renewal's time plus ``lasts``. ``since``: the time of the
    renewal in force just before the event (null before the first); ``leader``: the id of the one in force from the event on.
    """
    spark = events.sparkSession
    ship(spark)
    written, own = Written(spark, "renewals"), F.col(f"`{key}`")
    keys = written.save(events.groupBy(own).agg(F.count("*").alias("most")).select(own.alias("_key"), "most").withColumn("k", F.monotonically_increasing_id()))
    named = events.select(own.alias("_own"), "ms", "event_id")
    rows = named.join(keys, F.col("_own").eqNullSafe(F.col("_key"))).select("k", "ms", "event_id")
    ranked = global_rank(rows, [F.col("ms"), F.col("event_id")], "r", ["k"])
    ranked = written.save(ranked.withColumn("block", F.floor((F.col("r") - 1) / block)))

    def exits(table: pa.Table) -> pa.Table:
        table = table.sort_by("r")
        at = pa.array(_last_in_block(table["ms"].to_numpy(), lasts))
        return pa.table([table["k"], table["r"], table["block"], table["r"].take(at), table["ms"].take(at), table["event_id"].take(at)], ["k", "r", "block", "last", "last_ms", "last_id"])

    through = written.save(ranked.groupBy("k", "block").applyInArrow(exits, "k long, r long, block long, last long, last_ms long, last_id long"))
    # where each block's last renewals run out: the number of events before that time
    dues = through.groupBy("k", "last").agg(F.min("block").alias("block"), F.min("last_ms").alias("last_ms"))
    line = ranked.select("k", "ms", F.lit(1).alias("one"), F.lit(None).cast("long").alias("last"), F.lit(None).cast("long").alias("block"))
    line = line.unionByName(dues.select("k", (F.col("last_ms") + lasts).alias("ms"), F.lit(0).alias("one"), "last", "block"))
    counted = running_total(line, F.col("one"), [F.col("ms"), F.col("one"), F.col("last")], "before", ["k"]).where("one = 0")
    onward = counted.select("k", "last", F.greatest(F.col("before") + 1, (F.col("block") + 1) * block + 1).alias("to"))
    onward = written.save(onward.join(keys.select("k", "most"), "k").where(F.col("to") <= F.col("most")).select("k", "last", "to"))
    first = keys.select("k", F.lit(1).cast("long").alias("r"))
    nodes = onward.select("k", F.col("to").alias("r")).unionByName(first).distinct()
    jump = written.save(nodes.join(through.select("k", "r", "last"), ["k", "r"]).join(onward, ["k", "last"]).select("k", F.col("r").alias("a"), F.col("to").alias("b")))
    jumps = []
    while jump.limit(1).count():
        jumps.append(jump)
        jump = written.save(jump.join(jump.select("k", F.col("a").alias("b"), F.col("b").alias("c")), ["k", "b"]).select("k", "a", F.col("c").alias("b")))
    entered = written.save(first)
    for jump in reversed(jumps):
        entered = written.save(entered.unionByName(entered.join(jump, [entered["k"] == jump["k"], entered["r"] == jump["a"]]).select(entered["k"], jump["b"].alias("r"))).distinct())
    entries = entered.join(through, ["k", "r"]).select("k", "block", F.col("r").alias("entry"), "last_ms", "last_id")
    blocks = ranked.groupBy("k", "block").agg(F.count("*").alias("n")).join(entries, ["k", "block"], "left")
    before = W.partitionBy("k").orderBy("block").rowsBetween(W.unboundedPreceding, -1)  # a row a block
    blocks = blocks.select("k", "block", "entry", F.last("last_ms", True).over(before).alias("since"), F.last("last_id", True).over(before).alias("leader"))

    def finished(table: pa.Table) -> pa.Table:
        table = table.sort_by("r")
        ms, ids, r = (table[c].to_numpy() for c in ("ms", "event_id", "r"))
        entry, since, leader = (table[c][0].as_py() for c in ("entry", "since", "leader"))
        renews, after = np.zeros(len(ms), bool), _pointers(ms, lasts).tolist()
        i = len(ms) if entry is None else int(entry - r[0])
        while i < len(ms):
            renews[i], i = True, after[i]
        # the renewal in force from each event on; -1: the one of before the block
        now = np.maximum.accumulate(np.where(renews, np.arange(len(ms)), -1))
        prior = np.append(-1, now[:-1])
        at = [since if p < 0 else int(ms[p]) for p in prior.tolist()]
        own = [leader if p < 0 else int(ids[p]) for p in now.tolist()]
        return pa.table([table["k"], table["event_id"], table["ms"], pa.array(renews), pa.array(at, pa.int64()), pa.array(own, pa.int64())], ["k", "event_id", "ms", "renews", "since", "leader"])

    done = ranked.join(blocks, ["k", "block"]).groupBy("k", "block").applyInArrow(finished, "k long, event_id long, ms long, renews boolean, since long, leader long")
    return done.join(keys, "k").select(F.col("_key").alias(key), "event_id", "ms", "renews", "since", "leader")
