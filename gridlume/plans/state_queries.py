"""Queries over caches, budgets and queues, batch and streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlume.operators import state
from gridlume.sources.landing import tables
from gridlume.streaming import facts, twins


def _events(spark: SparkSession, d: str) -> DataFrame:
    return tables(spark, d, "events")[0].withColumn("ms", F.unix_millis("ts"))


_E = "(select *, epoch_us(ts) // 1000 as ms, row_number() over (partition by user_id order by epoch_us(ts) // 1000, event_id) as rn from events)"


def _bucket_sql(rate: float, burst: float) -> str:
    have = f"least({burst}::double, b.tokens + greatest(0, e.ms - b.ms) * {rate}::double / 1000)"
    return f"""
with recursive e as {_E},
b as (select user_id, rn, event_id, ms, {burst} >= 1 as allowed, ({burst} - case when {burst} >= 1 then 1 else 0 end)::double as tokens, null::bigint as retry_after from e where rn = 1 union all
  select e.user_id, e.rn, e.event_id, e.ms, {have} >= 1, {have} - case when {have} >= 1 then 1 else 0 end, case when {have} < 1 then greatest(1, ceil((1 - {have}) / {rate}::double))::bigint end from b join e on e.user_id = b.user_id and e.rn = b.rn + 1)
select user_id, event_id, ms, allowed, round(tokens, 6) as tokens, retry_after from b
"""


RATE, BURST = 1 / 7000, 3.0


def token_bucket(spark: SparkSession, d: str) -> DataFrame:
    return state.token_bucket(_events(spark, d), "user_id", RATE, BURST).withColumn("tokens", F.round("tokens", 6))


TOKEN_BUCKET = _bucket_sql(RATE, BURST)



def large_key_budget(spark: SparkSession, d: str) -> DataFrame:
    """The same budget with each user's events cut where the bucket has filled up: the way that keys with very many events go."""
    return state.token_bucket(_events(spark, d), "user_id", RATE, BURST, most_events=0).withColumn("tokens", F.round("tokens", 6))


LARGE_KEY_BUDGET = TOKEN_BUCKET

FRESH_MS = 3_600_000 * 6


def swr_cache(spark: SparkSession, d: str) -> DataFrame:
    return state.swr_cache(_events(spark, d), "user_id", FRESH_MS)


SWR_CACHE = f"""
with recursive e as {_E},
c as (select user_id, rn, event_id, ms, ms as at, 'MISS' as outcome from e where rn = 1 union all
  select e.user_id, e.rn, e.event_id, e.ms, case when e.ms - c.at < {FRESH_MS} then c.at else e.ms end, case when e.ms - c.at < {FRESH_MS} then 'HIT' else 'STALE' end from c join e on e.user_id = c.user_id and e.rn = c.rn + 1)
select user_id, event_id, ms, outcome from c
"""


def coalesce_requests(spark: SparkSession, d: str) -> DataFrame:
    return state.coalesce_requests(_events(spark, d), "user_id", FRESH_MS)


COALESCE_REQUESTS = f"""
with recursive e as {_E},
c as (select user_id, rn, event_id, ms, ms + {FRESH_MS} as until, event_id as leader from e where rn = 1 union all
  select e.user_id, e.rn, e.event_id, e.ms, case when e.ms >= c.until then e.ms + {FRESH_MS} else c.until end, case when e.ms >= c.until then e.event_id else c.leader end from c join e on e.user_id = c.user_id and e.rn = c.rn + 1)
select user_id, event_id, ms, leader from c
"""


STALE_MS = 9_000_000


def large_key_cache(spark: SparkSession, d: str) -> DataFrame:
    """A cache entry an event type, its events cut into blocks: the way that keys with very many events go."""
    return state.swr_cache(_events(spark, d), "event_type", STALE_MS // 3, STALE_MS, most_events=0, block=97)


LARGE_KEY_CACHE = f"""
with recursive e as (select event_type, event_id, epoch_us(ts) // 1000 as ms, row_number() over (partition by event_type order by epoch_us(ts) // 1000, event_id) as rn from events),
c as (select event_type, rn, event_id, ms, ms as at, 'MISS' as outcome from e where rn = 1 union all
  select e.event_type, e.rn, e.event_id, e.ms, case when e.ms - c.at < {STALE_MS // 3} then c.at else e.ms end, case when e.ms - c.at >= {STALE_MS} then 'MISS' when e.ms - c.at < {STALE_MS // 3} then 'HIT' else 'STALE' end from c join e on e.event_type = c.event_type and e.rn = c.rn + 1)
select event_type, event_id, ms, outcome from c
"""


def large_key_requests(spark: SparkSession, d: str) -> DataFrame:
    """Requests of an event type that share one in flight, cut into blocks likewise."""
    return state.coalesce_requests(_events(spark, d), "event_type", STALE_MS, most_events=0, block=97)


LARGE_KEY_REQUESTS = f"""
with recursive e as (select event_type, event_id, epoch_us(ts) // 1000 as ms, row_number() over (partition by event_type order by epoch_us(ts) // 1000, event_id) as rn from events),
c as (select event_type, rn, event_id, ms, ms + {STALE_MS} as until, event_id as leader from e where rn = 1 union all
  select e.event_type, e.rn, e.event_id, e.ms, case when e.ms >= c.until then e.ms + {STALE_MS} else c.until end, case when e.ms >= c.until then e.event_id else c.leader end from c join e on e.event_type = c.event_type and e.rn = c.rn + 1)
select event_type, event_id, ms, leader from c
"""


def rate_window(spark: SparkSession, d: str) -> DataFrame:
    return state.rate_window(tables(spark, d, "events")[0], "user_id", 2, 86_400).select("event_id", "allowed")


RATE_WINDOW = "select event_id, row_number() over (partition by user_id, time_bucket(interval '1 day', ts, timestamp '1970-01-01') order by ts, event_id) <= 2 as allowed from events"


def latest_page(spark: SparkSession, d: str) -> DataFrame:
    e = tables(spark, d, "events")[0]
    pages = e.select("user_id", (F.col("event_id") % 4).alias("page"), "event_id", "value")
    out = state.latest_page(pages, ["user_id", "page"], "event_id")
    return out.groupBy("user_id").agg(F.count("*").alias("pages"), F.sum("event_id").alias("ids"))


LATEST_PAGE = "with p as (select user_id, event_id % 4 as page, max(event_id) as event_id from events group by 1, 2) select user_id, count(*) as pages, sum(event_id)::bigint as ids from p group by 1"


def late_results(spark: SparkSession, d: str) -> DataFrame:
    e = tables(spark, d, "events")[0].select("user_id", F.floor(F.col("event_id") / 100).alias("request"), "event_id")
    return state.drop_late(e, "user_id", "request").select("user_id", "event_id", state.expired(F.col("event_id"), F.lit(5000)).alias("expired"))


LATE_RESULTS = "select user_id, event_id, event_id <= 5000 as expired from events where (user_id, event_id // 100) in (select user_id, max(event_id // 100) from events group by 1)"


def recent_cache(spark: SparkSession, d: str) -> DataFrame:
    """Bounded caches, one an event type, with eviction by insertion."""
    e = _events(spark, d).withColumn("chars", F.length("props"))
    return state.recent_cache(e, "event_type", "user_id", ttl_ms=3_600_000 * 8, entries=16, most_bytes=600)


_LIVE = "list_filter(c.held, lambda x: x.until > e.ms)"
_FITS = "list_filter(range(0, len(live) + 1), lambda j: len(live) - j < 16 and coalesce(list_sum(list_transform(live[j + 1:], lambda x: x.size)), 0) + size <= 600)"
RECENT_CACHE = f"""
with recursive e as (select event_type, event_id, user_id, epoch_us(ts) // 1000 as ms, 2 * length(props) as size, row_number() over (partition by event_type order by epoch_us(ts) // 1000, event_id) as rn from events),
c as (
  select event_type, 0::bigint as rn, null::bigint as event_id, false as hit, []::struct(k bigint, until bigint, size bigint)[] as held from e where rn = 1
  union all
  select event_type, rn, event_id, hit, case when hit or size > 600 then live else list_append(live[list_min({_FITS}) + 1:], {{'k': user_id::bigint, 'until': ms + 28800000, 'size': size::bigint}}) end
  from (select e.event_type, e.rn, e.event_id, e.user_id, e.ms, e.size, {_LIVE} as live, len(list_filter({_LIVE}, lambda x: x.k = e.user_id)) > 0 as hit from c join e on e.event_type = c.event_type and e.rn = c.rn + 1))
select event_type, event_id, hit from c where rn > 0
"""


def permit_queue(spark: SparkSession, d: str) -> DataFrame:
    """Queues, one an event type (an event simulation: held against small worked cases in the tests)."""
    e = _events(spark, d).withColumn("lasts_ms", (F.col("event_id") % 50) * 60_000)
    return state.permit_queue(e, "event_type", rate=0.002, burst=4, concurrency=2, queue=8, wait_ms=1_200_000)


def _event_stream(spark: SparkSession, d: str) -> DataFrame:
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").option("maxFilesPerTrigger", 16).parquet(d)
    return stream.withColumn("ms", F.unix_millis(F.col("ts").cast("timestamp")))


def token_bucket_stream(spark: SparkSession, d: str) -> DataFrame:
    """The same budget as streaming state; equal to the batch fold."""
    twins.use_rocksdb(spark)
    out = twins.drain(twins.token_bucket_stream(_event_stream(spark, d), "user_id", RATE, BURST), "bucket")
    return out.withColumn("tokens", F.round("tokens", 6)).withColumnRenamed("key", "user_id")


def freshness_stream(spark: SparkSession, d: str) -> DataFrame:
    """The same cache as streaming state; equal to the batch fold."""
    twins.use_rocksdb(spark)
    return twins.drain(twins.freshness_stream(_event_stream(spark, d), "user_id", FRESH_MS), "freshness").withColumnRenamed("key", "user_id")


def merge_stream(spark: SparkSession, d: str) -> DataFrame:
    """Pages of streets as a stream, each delivered many times: four pages a user, whose newest event is the page's share."""
    twins.use_rocksdb(spark)
    k = F.col("event_id")
    share = facts.page_fact(k % 7, label=F.col("event_type"), types=F.array("event_type"), incident_ids=F.array((k % 3).cast("string"), F.lit("")))
    stream = _event_stream(spark, d).select(F.col("user_id").alias("key"), (k % 4).alias("page"), k.alias("version"), share.alias("fact"))
    out = facts.latest_facts(twins.drain(facts.street_facts_stream(stream), "facts"))
    return out.select("key", "pages", "households", "label", F.array_join("types", ",").alias("types"), F.array_join("incident_ids", ",").alias("ids"))


MERGE_STREAM = """
with p as (select user_id, event_id % 4 as page, max(event_id) as e, arg_max(event_type, event_id) as t from events group by 1, 2),
t as (select user_id, t, min(page) as first from p group by 1, 2), i as (select user_id, (e % 3)::varchar as i, min(page) as first from p group by 1, 2),
l as (select user_id, string_agg(t, ',' order by first) as types from t group by 1), m as (select user_id, string_agg(i, ',' order by first) as ids from i group by 1)
select p.user_id as key, count(*) as pages, sum(e % 7)::double as households, arg_min(t, page) as label, any_value(types) as types, any_value(ids) as ids from p join l using (user_id) join m using (user_id) group by p.user_id
"""

_ALL = (token_bucket, swr_cache, coalesce_requests, large_key_budget, large_key_cache, large_key_requests, rate_window, latest_page, late_results, recent_cache)
QUERIES = {f.__name__: f for f in (*_ALL, permit_queue, token_bucket_stream, freshness_stream, merge_stream)}
ORACLE_SQL = {f.__name__: globals()[f.__name__.upper()] for f in _ALL} | {"token_bucket_stream": TOKEN_BUCKET, "freshness_stream": SWR_CACHE, "merge_stream": MERGE_STREAM}
