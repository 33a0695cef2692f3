"""Budgets, caches and queues: worked cases."""

import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridlume.operators import state
from gridlume.sources import keyed


def events(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "event_id long, k string, ms long")


def test_token_bucket(spark):
    got = state.token_bucket(events(spark, [("a", 0), ("a", 0), ("a", 0), ("a", 500), ("a", 1500), ("b", 7)]), "k", 1.0, 2.0).orderBy("event_id").collect()
    assert [(r.allowed, r.tokens, r.retry_after) for r in got] == [(True, 1, None), (True, 0, None), (False, 0, 1), (False, 0.5, 1), (True, 0.5, None), (True, 1, None)]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.integers(0, 20_000), min_size=1, max_size=30))
def test_balance_stays_in_bounds(times):
    from pyspark.sql import SparkSession

    got = state.token_bucket(events(SparkSession.getActiveSession(), [("a", t) for t in times]), "k", 0.5, 3.0).collect()
    assert all(0 <= r.tokens <= 3 for r in got)
    tokens, at, want = 3.0, None, {}
    for ms, i in sorted((t, i) for i, t in enumerate(times)):
        tokens = min(3.0, tokens + (ms - (ms if at is None else at)) * 0.5 / 1000)
        at, want[i] = ms, tokens >= 1
        tokens -= tokens >= 1
    assert {r.event_id: r.allowed for r in got} == want and math.isfinite(tokens)


def test_freshness(spark):
    got = state.swr_cache(events(spark, [("a", 0), ("a", 899), ("a", 900), ("a", 1799), ("a", 1800)]), "k", 900).orderBy("event_id").collect()
    assert [r.outcome for r in got] == ["MISS", "HIT", "STALE", "HIT", "STALE"]


def test_coalesce(spark):
    got = state.coalesce_requests(events(spark, [("a", 0), ("a", 5), ("a", 10), ("a", 12)]), "k", 10).orderBy("event_id").collect()
    assert [r.leader for r in got] == [0, 0, 2, 2]


def test_recent_cache(spark):
    rows = [("c", "a", 0, 1), ("c", "b", 1, 1), ("c", "a", 2, 1), ("c", "c", 3, 1), ("c", "a", 4, 1), ("c", "big", 5, 100), ("c", "big", 6, 100), ("c", "a", 10_004, 1)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "event_id long, cache string, k string, ms long, chars int")
    got = [r.hit for r in state.recent_cache(df, "cache", "k", entries=2, most_bytes=50).orderBy("event_id").collect()]
    # reading a does not renew it: c evicts a; the oversized entry is never kept; expiry is inclusive
    assert got == [False, False, True, False, False, False, False, False]


@pytest.mark.parametrize(
    ("rows", "kw", "want"),
    [
        ([(0, 10), (0, 10), (0, 10)], {"rate": 1.0, "burst": 9, "concurrency": 2}, [("started", 0), ("started", 0), ("started", 10)]),
        # the release at 1 ms tries the head again, which then waits a whole second from there
        ([(0, 1), (0, 1), (0, 1)], {"rate": 1.0, "burst": 2, "concurrency": 9}, [("started", 0), ("started", 0), ("started", 1001)]),
        ([(0, 99_999), (0, 1)], {"rate": 1.0, "burst": 9, "concurrency": 1}, [("started", 0), ("concurrency", None)]),
        ([(0, 1), (0, 1)], {"rate": 0.01, "burst": 1, "concurrency": 9}, [("started", 0), ("budget", None)]),
        ([(0, 50), (0, 1), (0, 1)], {"rate": 1.0, "burst": 9, "concurrency": 1, "queue": 1}, [("started", 0), ("started", 50), ("concurrency", None)]),
    ],
)
def test_permits(spark, rows, kw, want):
    df = spark.createDataFrame([(i, "p", ms, n) for i, (ms, n) in enumerate(rows)], "event_id long, provider string, ms long, lasts_ms long")
    got = state.permit_queue(df, "provider", **kw).orderBy("event_id").collect()
    assert [(r.outcome, r.start_ms) for r in got] == want


def test_keyed(spark):
    new = spark.createDataFrame([("a", "1", 0.0), ("b", "2", 30.0), ("c", "3", -1.0)], "key string, value string, ttl double")
    table = keyed.put(new, F.lit(0), F.col("ttl"))
    keys = spark.createDataFrame([("a",), ("b",), ("c",)], "key string")
    assert {r.key: r.value for r in keyed.get(table, keys, F.lit(59_999)).collect()} == {"a": None, "b": "2", "c": None}
    assert {r.key: r.value for r in keyed.get(table, keys, F.lit(60_000)).collect()} == {"a": None, "b": None, "c": None}


def test_walks_carry_state_over_batches(spark):
    """More events of a key than a batch holds; null keys are a key of their own."""
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = [(k, i, i * 100) for k in ("a", None, "b") for i in range(50)]
        events = spark.createDataFrame(rows, "k string, event_id long, ms long")
        got = state.token_bucket(events, "k", 2.0, 3.0).collect()
        tokens, at, want = 3.0, None, []
        for i in range(50):
            tokens = min(3.0, tokens + (0 if at is None else i * 100 - at) * 2.0 / 1000)
            at = i * 100
            want.append(tokens >= 1)
            tokens -= tokens >= 1
        assert all([r.allowed for r in sorted(got, key=lambda r: r.event_id) if r.k == k] == want for k in ("a", None, "b"))
        shared = state.coalesce_requests(events, "k", 1000).collect()
        assert all(r.leader == r.event_id // 10 * 10 for r in shared) and len(shared) == 150
        seen = state.swr_cache(events, "k", 500, 1000).collect()
        assert {(r.event_id, r.outcome) for r in seen if r.event_id < 7} == {(0, "MISS"), (5, "STALE"), *((i, "HIT") for i in (1, 2, 3, 4, 6))}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_recent_cache_against_brute_force(spark):
    rng = random.Random(4)
    rows = [(i % 2, i, rng.randrange(12), rng.randrange(3000), rng.randrange(1, 60)) for i in range(400)]
    events = spark.createDataFrame(rows, "c long, event_id long, k long, ms long, chars long")
    got = {r.event_id: r.hit for r in state.recent_cache(events, "c", "k", ttl_ms=400, entries=4, most_bytes=200).collect()}
    for c in (0, 1):
        held = []
        for _, i, k, ms, chars in sorted((r for r in rows if r[0] == c), key=lambda r: (r[3], r[1])):
            held = [h for h in held if h[1] > ms]
            assert got[i] == any(h[0] == k for h in held)
            if not got[i] and 2 * chars <= 200:
                while len(held) >= 4 or sum(h[2] for h in held) + 2 * chars > 200:
                    held.pop(0)
                held.append((k, ms + 400, 2 * chars))


def test_events_without_a_time(spark):
    """They come first, find nothing and leave nothing behind."""
    rows = [(0, "c", "a", 5, 1), (1, "c", "a", None, 1), (2, "c", "a", 6, None), (3, None, "a", None, 1)]
    df = spark.createDataFrame(rows, "event_id long, cache string, k string, ms long, chars int")
    assert {r.event_id: r.hit for r in state.recent_cache(df, "cache", "k").collect()} == {0: False, 1: False, 2: True, 3: False}
    df = spark.createDataFrame([(0, "p", 0, 5), (1, "p", None, 5), (2, "p", 1, None), (3, None, None, None)], "event_id long, p string, ms long, lasts_ms long")
    got = {r.event_id: (r.outcome, r.start_ms) for r in state.permit_queue(df, "p", rate=1.0, burst=9, concurrency=5).collect()}
    assert got == {0: ("started", 0), 1: (None, None), 2: ("started", 1), 3: (None, None)}
    df = spark.createDataFrame([(0, "a", None), (1, "a", 10), (2, "a", None), (3, "a", 11)], "event_id long, k string, ms long")
    for most in (1_000_000, 0):
        assert {r.event_id: r.outcome for r in state.swr_cache(df, "k", 5, most_events=most).collect()} == {0: "MISS", 2: "MISS", 1: "MISS", 3: "HIT"}
        assert {r.event_id: r.leader for r in state.coalesce_requests(df, "k", 5, most_events=most).collect()} == {0: 0, 2: 2, 1: 1, 3: 1}


@pytest.mark.parametrize(("fresh", "stale", "block"), [(40, 90, 7), (0, 3, 25), (3000, None, 30)])
def test_large_keys_equal_the_walk(spark, fresh, stale, block):
    """One key cut into blocks, shorter and longer than what lasts, with ties and gaps; and a null key."""
    rng = random.Random(fresh + block)
    at, rows = 0, []
    for _ in range(100):
        at += rng.choice([0, 0, 1, 3, 15, 60]) if rng.random() < 0.97 else 700
        rows.append((rng.choice(["a", "a", "a", None]), at))
    df = events(spark, rows)
    for op, args in ((state.swr_cache, (fresh, stale)), (state.coalesce_requests, (fresh,))):
        walked = sorted(map(tuple, op(df, "k", *args).collect()), key=str)
        dealt = sorted(map(tuple, op(df, "k", *args, most_events=20, block=block).collect()), key=str)
        assert walked == dealt and len(walked) == 100


def test_retried_pages_take_back_their_share(spark, tmp_path):
    """Deliveries in several batches, replays and late ones among them, amount to the batch merge of the newest of each page."""
    from gridlume.operators import rollup
    from gridlume.streaming import facts, twins

    twins.use_rocksdb(spark)
    rng = random.Random(11)
    rows = []
    for version in range(120):
        key, page = rng.choice("abc"), rng.randrange(5)
        rows.append((key, page, version, float(rng.randrange(9)), f"label {page}", rng.sample(["t1", "t2", "t3", ""], 2), [f"i{rng.randrange(4)}"], [f"l{rng.randrange(3)}"]))
    df = spark.createDataFrame(rows, "key string, page long, version long, households double, label string, types array<string>, incident_ids array<string>, locations array<string>")
    for column in ("name", "city", "postcode"):
        df = df.withColumn(column, F.col("label"))
    share = facts.page_fact(F.col("households"), **{c: F.col(c) for c in ("label", "name", "city", "postcode", "types", "incident_ids", "locations")})
    sent = df.select("key", "page", "version", share.alias("fact"))
    for k, low in enumerate((40, 0, 40, 80)):  # out of order, and one batch twice
        sent.where(F.col("version").between(low, low + 39)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(sent.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    revisions = twins.drain(facts.street_facts_stream(stream), "facts-test")
    got = {r["key"]: r for r in facts.latest_facts(revisions).collect()}
    newest = df.groupBy("key", "page").agg(F.max_by(F.struct(*[c for c in df.columns if c not in ("key", "page")]), "version").alias("r")).select("key", "page", "r.*")
    whole = newest.withColumn("seq", F.col("page")).withColumns({c: F.lit("") for c in ("first_seen", "restore_at")})
    want = {r["key"]: r for r in rollup.merge_streets(whole).collect()}
    assert set(got) == set(want)
    for key, r in want.items():
        assert [got[key][c] for c in ("households", "label", "types", "incident_ids", "locations")] == [r[c] for c in ("households", "label", "types", "incident_ids", "locations")]
    assert revisions.count() > len(want)


def test_large_budgets_equal_the_walk_to_the_last_bit(spark):
    rng = random.Random(17)
    at, rows = 0, []
    for _ in range(120):
        at += rng.choice([0, 0, 100, 333, 700, 1900, 2999, 3000, 3001, 9000])
        rows.append((rng.choice(["a", "a", None]), at))
    df = events(spark, rows).unionByName(spark.createDataFrame([(900, "a", None), (901, "a", None), (902, None, None), (903, "b", 5)], "event_id long, k string, ms long"))
    walked = sorted(map(tuple, state.token_bucket(df, "k", 1 / 1.5, 2.0).collect()), key=str)
    assert walked == sorted(map(tuple, state.token_bucket(df, "k", 1 / 1.5, 2.0, most_events=20).collect()), key=str) and len(walked) == 124
