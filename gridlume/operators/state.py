"""Stateful operators as walks over ordered events.

Events are dealt by key and sorted within their partition (a sort that spills), and one pass carries the state of the key at
hand from batch to batch. Neither a key's events nor its results are ever held, and a key of any length costs its length;
as each step needs the one before, one key is one task's work. For keys with very many events, freshness and coalescing know
another way (``renewal``), which deals them over all tasks, and budgets are cut where they have filled up. The streaming twins keep the same state between micro-batches.
Events of a key are ordered by time, then id; keys may be null, and a null time adds none: no time passes up to such an event.
"""

from __future__ import annotations

import math
from collections import OrderedDict, deque
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridlume.operators.order import global_rank, running_total
from gridlume.operators.renewal import BLOCK, MOST_EVENTS, renewals
from gridlume.runtime import Written, ship

# Per provider refill a second, burst, concurrency, timeout (ms) and body limit (bytes).
POLICIES = {
    "reports": (1.0, 12, 6, 5_000, 2 * 1024 * 1024),
    "directory": (0.5, 4, 2, 5_000, 5 * 1024 * 1024),
    "geocoder": (2.0, 8, 4, 3_000, 256 * 1024),
    "geometry": (0.1, 6, 2, 7_000, 8 * 1024 * 1024),
    "verification": (5.0, 10, 5, 5_000, 64 * 1024),
}
RECENT_TTL_MS, RECENT_ENTRIES, RECENT_BYTES = 10_000, 128, 16 * 1024 * 1024
QUEUE_LENGTH, QUEUE_WAIT_MS = 64, 15_000


def _walk(events: DataFrame, key: str, columns: list[str], start: Callable[[], Any], step: Callable[..., tuple], fields: dict[str, pa.DataType]) -> DataFrame:
    """``key`` and ``fields`` of every event: ``step(state, *columns)`` gives the next state and the values of ``fields``.

    ``columns`` begin with those that order a key's events.
    """
    kind = dict(events.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: Any = run  # no key is equal to a function
        state: Any = None
        for batch in batches:
            out = []
            for k, *values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if k != now:
                    now, state = k, start()
                state, row = step(state, *values)
                out.append(row)
            made = zip(*out, strict=True) if out else [[]] * len(fields)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(c), t) for c, t in zip(made, fields.values(), strict=True))], [key, *fields])

    ship(events.sparkSession)
    rows = events.select(key, *columns).repartition(key).sortWithinPartitions(key, *columns)
    names = {pa.int64(): "long", pa.float64(): "double", pa.bool_(): "boolean", pa.string(): "string"}
    return rows.mapInArrow(run, f"`{key}` {kind}, " + ", ".join(f"{c} {names[t]}" for c, t in fields.items()))


def _timed(events: DataFrame, key: str, millis: str, event_id: str, *more: Column) -> DataFrame:
    return events.select(key, F.col(millis).cast("long").alias("ms"), F.col(event_id).cast("long").alias("event_id"), *more)


_EVENT = {"event_id": pa.int64(), "ms": pa.int64()}


def token_bucket(events: DataFrame, key: str, rate: float, burst: float, millis: str = "ms", event_id: str = "event_id", most_events: int = MOST_EVENTS) -> DataFrame:
    """``key, event_id, ms, allowed, tokens, retry_after`` for every event.

    Elapsed time refills up to the burst (a clock that goes back mints nothing); an event takes one token if there is one, else waits
    at least a second; the balance is kept even on refusal. A key with more than ``most_events`` events is cut where it rests
    long enough to fill up whatever was left, and each stretch is walked by itself; one that never rests so long is one walk.
    """
    rate, burst = float(rate), float(burst)

    def step(state: tuple[float, int | None], ms: int | None, event: int) -> tuple:
        tokens, at = state
        elapsed = 0 if ms is None or at is None else max(0, ms - at)
        have = min(burst, tokens + elapsed * rate / 1000)
        ok = have >= 1
        left = have - 1 if ok else have
        return (left, ms), (event, ms, ok, left, None if ok else max(1, math.ceil((1 - have) / rate)))

    fields = _EVENT | {"allowed": pa.bool_(), "tokens": pa.float64(), "retry_after": pa.int64()}
    rows, own = _timed(events, key, millis, event_id), F.col(f"`{key}`")
    walked = lambda df, by: _walk(df, by, ["ms", "event_id"], lambda: (burst, None), step, fields)
    written = Written(events.sparkSession, "buckets")
    large = written.save(rows.groupBy(own).count().where(F.col("count") > most_events).select(own.alias("_large")).withColumn("_n", F.monotonically_increasing_id()))
    if not large.limit(1).count():
        return walked(rows, key)
    same = own.eqNullSafe(F.col("_large"))
    # a full bucket is full to the last bit: no sum of what was left and more than the burst is less than the burst
    ranked = written.save(global_rank(rows.join(large, same).select("_n", "ms", "event_id"), [F.col("ms"), F.col("event_id")], "_r", ["_n"]))
    before = ranked.select("_n", (F.col("_r") + 1).alias("_r"), F.col("ms").alias("_ms"))
    rested = F.coalesce((F.col("ms") - F.col("_ms")) * rate / 1000 >= burst, F.lit(False))
    cut = running_total(ranked.join(before, ["_n", "_r"], "left"), rested.cast("int"), [F.col("_r")], "_stretch", ["_n"])
    found = walked(cut.select(F.struct("_n", "_stretch").alias("_part"), "ms", "event_id"), "_part")
    found = found.join(large, F.col("_part._n") == F.col("_n")).select(F.col("_large").alias(key), *fields)
    return walked(rows.join(large, same, "left_anti"), key).unionByName(found)


def _by_size(events: DataFrame, key: str, walked: Callable[[DataFrame], DataFrame], dealt: Callable[[DataFrame], DataFrame], most_events: int) -> DataFrame:
    """``walked`` of the keys with up to ``most_events`` timed events (counted first), ``dealt`` of all others; events without a time are walked."""
    own = F.col(f"`{key}`")
    large = Written(events.sparkSession, "state-keys").save(events.groupBy(own).agg(F.count("ms").alias("n")).where(F.col("n") > most_events).select(own.alias("_large")))
    if not large.limit(1).count():
        return walked(events)
    timed, same = F.col("ms").isNotNull(), own.eqNullSafe(F.col("_large"))
    # a key's first timed event finds nothing in force, with or without events before that have no time
    small = events.where(timed).join(large, same, "left_anti").unionByName(events.where(~timed))
    return walked(small).unionByName(dealt(events.where(timed).join(large, same, "left_semi")))


def swr_cache(events: DataFrame, key: str, fresh_ms: int, stale_ms: int | None = None, millis: str = "ms", event_id: str = "event_id", most_events: int = MOST_EVENTS, block: int = BLOCK) -> DataFrame:
    """``key, event_id, ms, outcome``: MISS without an entry, HIT while fresh, else STALE with a refresh behind the answer.

    An entry is kept for the longer of both times; misses and stale reads renew it, hits don't. An event without a time misses.
    Keys with more than ``most_events`` events are cut into blocks of ``block`` events.
    """
    keep = None if stale_ms is None else max(fresh_ms, stale_ms)

    def step(at: int | None, ms: int | None, event: int) -> tuple:
        age = None if at is None or ms is None else ms - at
        outcome = "MISS" if age is None or (keep is not None and age >= keep) else "HIT" if age < fresh_ms else "STALE"
        return (at if outcome == "HIT" else ms), (event, ms, outcome)

    def dealt(rows: DataFrame) -> DataFrame:
        gone = F.col("since").isNull() if keep is None else F.col("since").isNull() | (F.col("ms") - F.col("since") >= keep)
        return renewals(rows, key, fresh_ms, block).select(F.col(f"`{key}`"), "event_id", "ms", F.when(gone, "MISS").when(F.col("renews"), "STALE").otherwise("HIT").alias("outcome"))

    walked = lambda rows: _walk(rows, key, ["ms", "event_id"], lambda: None, step, _EVENT | {"outcome": pa.string()})
    return _by_size(_timed(events, key, millis, event_id), key, walked, dealt, most_events)


def coalesce_requests(events: DataFrame, key: str, lasts_ms: int, millis: str = "ms", event_id: str = "event_id", most_events: int = MOST_EVENTS, block: int = BLOCK) -> DataFrame:
    """``key, event_id, ms, leader``: requests that arrive while an equal one runs share it; ``leader`` is that one's id.

    A request without a time leads itself. Keys with more than ``most_events`` events are cut into blocks of ``block`` events.
    """

    def step(state: tuple[int | None, int | None], ms: int | None, event: int) -> tuple:
        until, leader = state
        if until is None or ms is None or ms >= until:
            until, leader = None if ms is None else ms + lasts_ms, event
        return (until, leader), (event, ms, leader)

    walked = lambda rows: _walk(rows, key, ["ms", "event_id"], lambda: (None, None), step, _EVENT | {"leader": pa.int64()})
    dealt = lambda rows: renewals(rows, key, lasts_ms, block).select(F.col(f"`{key}`"), "event_id", "ms", "leader")
    return _by_size(_timed(events, key, millis, event_id), key, walked, dealt, most_events)


def rate_window(events: DataFrame, key: str, most: int, seconds: int, time: str = "ts", event_id: str = "event_id") -> DataFrame:
    """``events`` with ``allowed``: the first ``most`` of each key in each fixed window."""
    window = F.window(time, f"{seconds} seconds")
    place = F.row_number().over(W.partitionBy(key, "_w").orderBy(time, event_id))
    return events.withColumn("_w", window).withColumn("allowed", place <= most).drop("_w")


def latest_page(pages: DataFrame, identity: list[str], order: str) -> DataFrame:
    """The last delivery of each page: a retried page replaces its first answer and is never counted twice."""
    rest = [c for c in pages.columns if c not in identity]
    return pages.groupBy(*identity).agg(F.max_by(F.struct(*rest), F.col(order)).alias("r")).select(*identity, "r.*")


def drop_late(results: DataFrame, client: str, request: str) -> DataFrame:
    """Results of each client's newest request; those of requests that were superseded are ignored."""
    newest = results.groupBy(client).agg(F.max(request).alias(request))
    return results.join(newest, [client, request], "left_semi")


def expired(expires_at: Column, now: Column) -> Column:
    """Whether a cursor's first expiry, never extended, has come."""
    return expires_at <= now


def recent_cache(events: DataFrame, cache: str, key: str, ttl_ms: int = RECENT_TTL_MS, entries: int = RECENT_ENTRIES, most_bytes: int = RECENT_BYTES, millis: str = "ms", chars: str = "chars", event_id: str = "event_id") -> DataFrame:
    """``cache, event_id, hit``: a bounded cache that evicts in order of insertion; reading doesn't renew, two bytes a character.

    The limits tie all keys of a cache together, so a cache is one walk. Before the first time nothing has a time to live: events without one
    come first, are no hits, and leave nothing in the cache.
    """

    def start() -> list:
        return [OrderedDict(), 0]

    def step(state: list, now: int | None, event: int, k: Any, n: int | None) -> tuple:
        held, used = state
        if now is None:
            return state, (event, False)
        # entries live equally long, so the oldest goes first
        while held and next(iter(held.values()))[0] <= now:
            used -= held.popitem(last=False)[1][1]
        hit, size = k in held, 2 * int(n or 0)
        if not hit and entries > 0 and size <= most_bytes:
            while held and (len(held) >= entries or used + size > most_bytes):
                used -= held.popitem(last=False)[1][1]
            held[k] = (now + ttl_ms, size)
            used += size
        return [held, used], (event, hit)

    rows = _timed(events, cache, millis, event_id, F.col(key).alias("key"), F.col(chars).alias("chars"))
    return _walk(rows, cache, ["ms", "event_id", "key", "chars"], start, step, {"event_id": pa.int64(), "hit": pa.bool_()})


def permit_queue(events: DataFrame, provider: str, rate: float, burst: float, concurrency: int, queue: int = QUEUE_LENGTH, wait_ms: int = QUEUE_WAIT_MS, millis: str = "ms", lasts: str = "lasts_ms", event_id: str = "event_id") -> DataFrame:
    """``provider, event_id, outcome, start_ms``: a first-in-first-out queue before a concurrency limit and a token bucket.

    outcome: ``started``, or ``concurrency`` (the queue was full, or the wait for a place ran out) or ``budget`` (no token
    came in time). Only the head of the queue is ever tried. A provider is simulated by one task, event by event. A null duration
    is none; a request without a time never comes to the queue: outcome and start are null.
    """
    kind = dict(events.dtypes)[provider]

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["ms", "event_id"]).reset_index(drop=True)
        arrive, last, n = f["ms"].to_numpy(), f["lasts"].to_numpy(), len(f)
        outcome, start = np.full(n, "", object), np.full(n, -1, np.int64)
        waiting: deque[int] = deque()
        ends: list[int] = []
        tokens, at, now = float(burst), None, 0

        def pump() -> int | None:
            """Serve the head at ``now``; the next moment at which something can change, if known."""
            nonlocal tokens, at
            while waiting:
                i, expires = waiting[0], int(arrive[waiting[0]]) + wait_ms
                ends[:] = [e for e in ends if e > now]
                if len(ends) >= concurrency:
                    if now >= expires:
                        outcome[waiting.popleft()] = "concurrency"
                        continue
                    return min(min(ends), expires)
                have = min(burst, tokens + max(0, now - (now if at is None else at)) * rate / 1000)
                at = now
                if have >= 1:
                    tokens = have - 1
                    waiting.popleft()
                    outcome[i], start[i] = "started", now
                    ends.append(now + int(last[i]))
                    continue
                tokens = have
                if now >= expires:
                    outcome[waiting.popleft()] = "budget"
                    continue
                return min(now + 1000 * max(1, int(np.ceil((1 - have) / rate))), expires, *(ends or [expires]))
            return None

        k, due = 0, None
        while k < n or due is not None:
            if due is None or (k < n and arrive[k] <= due):
                now = int(arrive[k])
                if len(waiting) >= queue:
                    outcome[k] = "concurrency"
                else:
                    waiting.append(k)
                k += 1
            else:
                now = due
            due = pump()
        return pd.DataFrame({provider: f[provider], "event_id": f["event_id"], "outcome": outcome, "start_ms": pd.array([None if s < 0 else int(s) for s in start], "Int64")})

    rows = events.select(provider, F.col(millis).cast("long").alias("ms"), F.coalesce(F.col(lasts).cast("long"), F.lit(0)).alias("lasts"), F.col(event_id).cast("long").alias("event_id"))
    schema = f"`{provider}` {kind}, event_id long, outcome string, start_ms long"
    untimed = rows.where("ms is null").select(provider, "event_id", F.lit(None).cast("string").alias("outcome"), F.lit(None).cast("long").alias("start_ms"))
    return rows.where("ms is not null").groupBy(provider).applyInPandas(run, schema).unionByName(untimed)
