"""Queries over lookups, paging, filters and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlume.operators import enrich, features, ingest, paging, rollup
from gridlume.plans.standins import addresses
from gridlume.sources import keyed, sinks
from gridlume.sources.landing import tables


def lookup_with_miss(spark: SparkSession, d: str) -> DataFrame:
    lines, parts = tables(spark, d, "lineitem", "part")
    # every third part stands under a key that nobody asks for
    dim = parts.select(F.expr("case when p_partkey % 3 = 0 then -1 - p_partkey else p_partkey end").alias("l_partkey"), F.struct(F.lit("ok").alias("status"), F.col("p_brand").alias("label")).alias("found"))
    out = enrich.lookup_with_miss(lines.select("l_partkey", "l_quantity"), dim, "l_partkey", "found", F.struct(F.lit("miss").alias("status"), F.lit("").alias("label")))
    return out.groupBy(F.col("found.status").alias("status"), F.col("found.label").alias("label")).agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"))


LOOKUP_WITH_MISS = "select case when p_partkey is null then 'miss' else 'ok' end as status, coalesce(p_brand, '') as label, count(*) as n, sum(l_quantity) as quantity from lineitem left join (select * from part where p_partkey % 3 <> 0) on p_partkey = l_partkey group by 1, 2"


def fallback_key_join(spark: SparkSession, d: str) -> DataFrame:
    lines, parts = tables(spark, d, "lineitem", "part")
    dim = parts.select(F.expr("case when p_partkey % 5 < 2 then p_partkey else -9 - p_partkey end").alias("p_partkey"), "p_name")
    rows = lines.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", (F.col("l_partkey") - 1).alias("other"))
    out = enrich.fallback_key_join(rows, dim, "l_partkey", "other", "p_partkey", "p_name")
    return out.groupBy("l_partkey").agg(F.min("p_name").alias("name"), F.count("p_name").alias("n"), F.count("*").alias("all"))


FALLBACK_KEY_JOIN = 'with dim as (select * from part where p_partkey % 5 < 2) select l_partkey, min(coalesce(a.p_name, b.p_name)) as name, count(coalesce(a.p_name, b.p_name)) as n, count(*) as "all" from lineitem left join dim a on a.p_partkey = l_partkey left join dim b on b.p_partkey = l_partkey - 1 group by 1'


def _sources(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows = tables(spark, d, "part")[0].select(F.col("p_partkey").alias("k"), "p_name")
    one = rows.select(F.expr("case when k % 6 = 5 then -1 - k else k end").alias("k"), F.expr("case k % 6 when 0 then 'ok' when 1 then 'miss' when 2 then 'failed' when 3 then 'rate_limited' else 'failed' end").alias("status"), F.concat(F.lit("p"), "p_name").alias("payload"))
    two = rows.select(F.expr("case when k % 5 = 4 then -1 - k else k end").alias("k"), F.expr("case k % 5 when 0 then 'ok' when 1 then 'miss' when 2 then 'rate_limited' else 'failed' end").alias("status"), F.concat(F.lit("f"), "p_name").alias("payload"))
    return rows.select("k"), one, two


_SRC = """with r as (select p_partkey as k, p_name, case p_partkey % 6 when 0 then 'ok' when 1 then 'miss' when 2 then 'failed' when 3 then 'rate_limited' when 4 then 'failed' else 'miss' end as one,
  case p_partkey % 5 when 0 then 'ok' when 1 then 'miss' when 2 then 'rate_limited' when 3 then 'failed' else 'miss' end as two from part)"""


def source_fallback(spark: SparkSession, d: str) -> DataFrame:
    return enrich.source_fallback(*_sources(spark, d), "k")


SOURCE_FALLBACK = f"{_SRC} select k, case when one = 'ok' then 'ok' when one = 'rate_limited' then 'error' when two in ('ok', 'miss') then two else 'error' end as status, case when one = 'ok' then 'p' || p_name when one <> 'rate_limited' and two = 'ok' then 'f' || p_name end as payload, case when one in ('ok', 'rate_limited') then 1 else 2 end as lookups from r"


def failure_only_fallback(spark: SparkSession, d: str) -> DataFrame:
    return enrich.failure_fallback(*_sources(spark, d), "k")


FAILURE_ONLY_FALLBACK = f"{_SRC} select k, case when one in ('ok', 'miss') then one when one = 'rate_limited' then 'error' when two in ('ok', 'miss') then two else 'error' end as status, case when one = 'ok' then 'p' || p_name when one = 'failed' and two = 'ok' then 'f' || p_name end as payload from r"


def best_match(spark: SparkSession, d: str) -> DataFrame:
    p = tables(spark, d, "part")[0]
    k = F.col("p_partkey")
    rows = p.select(F.col("p_brand").alias("q"), F.struct(F.col("p_size"), k).alias("r"), (k / 10.0).alias("lng"), (k / 20.0).alias("lat"), F.when(k % 2 == 0, F.col("p_name")).alias("label"), F.lit(0.5).alias("score"), F.lit(None).cast("string").alias("type"), F.lit("x").alias("postcode"), F.lit(None).cast("string").alias("citycode"))
    out = enrich.best_match(rows, "q", "r").select("q", ingest.public_geocode(F.struct("found.*", F.col("q").alias("query"), F.lit(None).cast("string").alias("message"))).alias("g"))
    return out.select("q", "g.status", "g.lng", "g.lat", "g.label", "g.type", "g.postcode", "g.citycode")


BEST_MATCH = "select q, 'ok' as status, k / 10.0::double as lng, k / 20.0::double as lat, case when k % 2 = 0 then n else '' end as label, '' as type, 'x' as postcode, '' as citycode from (select p_brand as q, arg_min(p_partkey, (p_size, p_partkey)) as k, arg_min(p_name, (p_size, p_partkey)) as n from part group by 1)"


def unseen_keys(spark: SparkSession, d: str) -> DataFrame:
    orders, customers = tables(spark, d, "orders", "customer")
    return enrich.unseen(customers.select("c_custkey", "c_name"), orders.select(F.expr("case when o_orderkey % 8 = 0 then o_custkey else -1 - o_custkey end").alias("c_custkey")), "c_custkey")


UNSEEN_KEYS = "select c_custkey, c_name from customer where c_custkey not in (select o_custkey from orders where o_orderkey % 8 = 0)"


def warnings_union(spark: SparkSession, d: str) -> DataFrame:
    o = tables(spark, d, "orders")[0]
    lists = rollup.union_distinct(F.array("o_orderpriority", "o_orderstatus"), F.array(F.lit("F"), F.col("o_orderpriority")))
    return o.select("o_orderkey", F.array_join(lists, ",").alias("warnings"))


WARNINGS_UNION = "select o_orderkey, o_orderpriority || ',' || o_orderstatus || case when o_orderstatus = 'F' then '' else ',F' end as warnings from orders"


def line_requests(spark: SparkSession, d: str) -> DataFrame:
    p = tables(spark, d, "part")[0]
    k = F.col("p_partkey")
    rows = p.select(k.alias("seq"), F.when(k % 3 == 0, F.lit("  ")).when(k % 3 == 1, F.concat(F.lit(" id"), (k % 50).cast("string"))).alias("id"), F.when(k % 7 == 0, F.lit(" ")).otherwise(F.concat(F.lit(" é "), F.lower("p_brand"))).alias("name"))
    return enrich.line_requests(rows).select("result_key", "seq", "name_key")


LINE_REQUESTS = "with r as (select p_partkey as seq, 'E ' || upper(p_brand) as name_key, case when p_partkey % 3 = 1 then 'id' || (p_partkey % 50) else 'E ' || upper(p_brand) end as result_key from part where p_partkey % 7 <> 0) select result_key, max(seq) as seq, arg_max(name_key, seq) as name_key from r group by 1"


def allowed_requests(spark: SparkSession, d: str) -> DataFrame:
    e = tables(spark, d, "events")[0]
    k = F.col("event_id")
    policies = spark.createDataFrame([("a", ["https://one.example"], ["GET"]), ("b", ["https://two.example:8443", "https://one.example"], ["POST", "GET"])], "provider string, origins array<string>, methods array<string>")
    url = F.expr("case event_id % 7 when 0 then 'https://one.example/x?y=1' when 1 then 'http://one.example/' when 2 then 'https://u:p@one.example/' when 3 then 'https://two.example:8443/z' when 4 then 'https://one.example:443/' when 5 then 'nonsense' else 'https://three.example/' end")
    rows = e.select(k, F.expr("case event_id % 3 when 0 then 'a' when 1 then 'b' else 'c' end").alias("provider"), F.expr("case when event_id % 10 = 0 then '' else 'k' end").alias("key"), url.alias("url"), F.expr("case when event_id % 2 = 0 then 'get' else 'POST' end").alias("method"))
    return enrich.allowed_requests(rows, policies).select("event_id", "allowed")


ALLOWED_REQUESTS = "select event_id, event_id % 10 <> 0 and case event_id % 3 when 0 then event_id % 7 in (0, 4) and event_id % 2 = 0 when 1 then event_id % 7 in (0, 3, 4) else false end as allowed from events"


def parameter_faults(spark: SparkSession, d: str) -> DataFrame:
    lines = tables(spark, d, "lineitem")[0]
    rows = lines.select(F.col("l_orderkey").alias("request_id"), (F.col("l_linenumber").cast("long") * 1_000_000 + F.col("l_partkey")).alias("pos"), F.when(F.col("l_partkey") % 10 == 0, "zoom").otherwise(F.concat(F.lit("p"), (F.col("l_partkey") % 8).cast("string"))).alias("name"))
    return enrich.parameter_faults(rows, [f"p{i}" for i in range(7)])


PARAMETER_FAULTS = "with r as (select l_orderkey as request_id, l_linenumber * 1000000 + l_partkey as pos, case when l_partkey % 10 = 0 then 'zoom' else 'p' || (l_partkey % 8) end as name from lineitem), g as (select request_id, name, min(pos) as pos, count(*) as n from r group by 1, 2) select request_id, arg_min(name, pos) as fault from g where n > 1 or name not in ('p0', 'p1', 'p2', 'p3', 'p4', 'p5', 'p6') group by 1"


def _places(spark: SparkSession, d: str) -> DataFrame:
    s = tables(spark, d, "supplier")[0]
    k = F.col("s_suppkey")
    return s.select(F.lpad(k.cast("string"), 6, "0").alias("code"), F.when(k % 9 > 0, 48 + k * 37 % 1000 / 1000.0).alias("lat"), F.when(k % 9 > 0, 2 + k * 53 % 1000 / 1000.0).alias("lng"))


_PLACES = "(select lpad(s_suppkey::varchar, 6, '0') as code, case when s_suppkey % 9 > 0 then 48 + s_suppkey * 37 % 1000 / 1000.0::double end as lat, case when s_suppkey % 9 > 0 then 2 + s_suppkey * 53 % 1000 / 1000.0::double end as lng from supplier)"


def nearest_pages(spark: SparkSession, d: str) -> DataFrame:
    return paging.nearest_pages(_places(spark, d), F.lit(48.5), F.lit(2.5)).select("code", "rank", "page")


NEAREST_PAGES = f"select code, rank, ((rank - 1) // 6)::int as page from (select code, row_number() over (order by (lat - 48.5::double) * (lat - 48.5::double) + (lng - 2.5::double) * (lng - 2.5::double) nulls last, code) as rank from {_PLACES})"


def limit_guard(spark: SparkSession, d: str) -> DataFrame:
    a = paging.limit_guard(_places(spark, d), 50).withColumn("most", F.lit(50))
    return a.union(paging.limit_guard(tables(spark, d, "nation")[0], 200).withColumn("most", F.lit(200)))


LIMIT_GUARD = "select least(51, count(*)) as n, count(*) > 50 as too_many, 50 as most from supplier union all select least(201, count(*)), count(*) > 200, 200 from nation"


def cursor_state(spark: SparkSession, d: str) -> DataFrame:
    e = tables(spark, d, "events")[0]
    k = F.col("event_id")
    state = paging.cursor_state((k % 40).cast("double") - F.when(k % 11 == 0, 0.5).otherwise(0.0), F.lit(30), k % 100, F.lit(20), k % 13 > 0)
    return e.select("event_id", state.alias("state"), paging.next_offset(k % 40, F.lit(30)).alias("next"))


CURSOR_STATE = "select event_id, case when event_id % 100 <= 20 then 'expired' when event_id % 13 > 0 and event_id % 11 > 0 and event_id % 40 > 0 and event_id % 40 % 6 = 0 and event_id % 40 < 30 then 'ok' else 'invalid' end as state, case when event_id % 40 + 6 < 30 then event_id % 40 + 6 end as next from events"


def _streets(spark: SparkSession, d: str) -> DataFrame:
    return rollup.street_rollup(addresses(spark, d))


def street_filter(spark: SparkSession, d: str) -> DataFrame:
    docs, labels = tables(spark, d, "documents", "labels")
    rows = docs.join(labels, "doc_id", "left").select("doc_id", F.col("text").alias("label"), F.col("lang").alias("postcode"), F.col("source").alias("city"), F.filter(F.array(F.when(F.col("toxic") == 1, "T"), F.when(F.col("quality") == 1, "Q")), lambda x: x.isNotNull()).alias("types"), F.array("source").alias("locations"))
    return features.street_filter(rows, "Q", "  THE ").select("doc_id")


STREET_FILTER = "select doc_id from documents join labels using (doc_id) where quality = 1 and contains(lower(text || ' ' || lang || ' ' || source || ' ' || case when toxic = 1 then 'T ' else '' end || 'Q ' || source), 'the')"


def _styled(spark: SparkSession, d: str) -> DataFrame:
    p = tables(spark, d, "part")[0]
    k = F.col("p_partkey")
    types = F.filter(F.array(F.when(k % 3 == 0, "Incident HTA"), F.when(k % 4 == 0, "Incident BT"), F.when(k % 5 == 0, "Travaux HTA")), lambda x: x.isNotNull())
    point = F.when(k % 2 == 0, F.struct(F.lit("ok").alias("status"), (k / 8.0).alias("lng"), (k / 4.0).alias("lat")))
    lines = F.when(k % 7 == 0, F.array(F.array(F.array(k / 2.0, k / 4.0), F.array(k / 8.0, k / 16.0))))
    return p.select(k, k.cast("string").alias("key"), F.col("p_name").alias("label"), types.alias("types"), F.slice(F.array(*map(F.lit, "abcdef")), 1, (k % 7).cast("int")).alias("incident_ids"), point.alias("geocode"), lines.alias("lines"))


def feature_style(spark: SparkSession, d: str) -> DataFrame:
    s = features.feature_style(F.col("types"), F.col("incident_ids"))
    t = features.tag(F.concat(F.lit("x Incident "), F.coalesce(F.get("types", F.lit(0)), F.lit("?"))))
    return _styled(spark, d).select("p_partkey", s["color"].alias("color"), s["radius"].alias("radius"), F.round(s["line_width"], 6).alias("line_width"), features.tone(F.col("types")).alias("tone"), t["class"].alias("tag"), t["text"].alias("tag_text"))


FEATURE_STYLE = """
with p as (select p_partkey as k, greatest(1, p_partkey % 7)::double as n from part)
select k as p_partkey, case when k % 3 = 0 then '#e45245' when k % 4 = 0 then '#e98a19' else '#087d70' end as color, least(13.0::double, 7 + n * 1.5::double) as radius, round(least(6.6::double, 4.2::double + least(1.2::double, (n - 1) * 0.35::double)), 6) as line_width,
  case when k % 3 = 0 or k % 5 = 0 then 'hta' when k % 4 = 0 then 'bt' else 'other' end as tone, case when k % 3 = 0 then 'hta' when k % 4 = 0 then 'bt' when k % 5 = 0 then 'hta' else 'other' end as tag,
  'x ' || case when k % 3 = 0 then 'Incident HTA' when k % 4 = 0 then 'Incident BT' when k % 5 = 0 then 'Travaux HTA' else '?' end as tag_text from p
"""


def geojson_features(spark: SparkSession, d: str) -> DataFrame:
    out = features.layers(features.geojson_features(_styled(spark, d), "14"))
    j = lambda p: F.get_json_object("feature", p)
    return out.select("key", "layer", j("$.type").alias("type"), j("$.id").alias("id"), j("$.properties.label").alias("label"), j("$.properties.selected").alias("selected"), F.from_json(F.when(F.col("layer") == "points", j("$.geometry.coordinates")).otherwise(j("$.geometry.coordinates[0][1]")), "array<double>").alias("c")).select("key", "layer", "type", "id", "label", "selected", F.get("c", F.lit(0)).alias("x"), F.get("c", F.lit(1)).alias("y"))


GEOJSON_FEATURES = "select p_partkey::varchar as key, case when p_partkey % 7 = 0 then 'lines' else 'points' end as layer, 'Feature' as type, p_partkey::varchar as id, p_name as label, case when p_partkey = 14 then 'true' else 'false' end as selected, p_partkey / 8.0::double as x, p_partkey / case when p_partkey % 7 = 0 then 16.0::double else 4.0::double end as y from part where p_partkey % 7 = 0 or p_partkey % 2 = 0"


def area_features(spark: SparkSession, d: str) -> DataFrame:
    n = tables(spark, d, "nation")[0]
    k = F.col("n_nationkey").cast("string")
    ring = F.concat(F.lit("[[["), k, F.lit(",0],[1,1],[2,0],["), k, F.lit(",0]]]"))
    one = F.concat(F.lit('{"type":"Feature","properties":{"k":'), k, F.lit('},"geometry":{"type":"Polygon","coordinates":'), ring, F.lit("}}"))
    many = F.concat(F.lit('{"type":"Feature","geometry":{"type":"MultiPolygon","coordinates":['), ring, F.lit(","), ring, F.lit("]}}"))
    bad = F.lit('{"type":"Feature","geometry":{"type":"Point","coordinates":[1,2]}}')
    deep = F.lit('{"type":"Feature","geometry":{"type":"MultiPolygon","coordinates":[[[[1,2],[3,null],null]]]}}')
    inner = F.expr("n_nationkey % 4")
    body = F.when(inner == 0, F.concat(one, F.lit(","), many)).when(inner == 1, one).when(inner == 2, F.concat(one, F.lit(","), bad)).when(F.expr("n_nationkey % 8 = 3"), F.concat(one, F.lit(","), deep)).otherwise(F.lit(""))
    rows = n.select(F.col("n_nationkey").alias("key"), F.concat(F.lit('{"type":"'), F.when(F.col("n_nationkey") % 5 == 4, "Oops").otherwise("FeatureCollection"), F.lit('","features":['), body, F.lit("]}")).alias("text"))
    out = features.area_features(rows)
    return out.select("key", F.col("pos").cast("long").alias("pos"), "properties", F.size("polygons").cast("long").alias("n"))


AREA_FEATURES = "with n as (select n_nationkey as k from nation where n_nationkey % 5 <> 4 and n_nationkey % 4 < 2) select k as key, 0::bigint as pos, '{\"k\":' || k || '}' as properties, 1::bigint as n from n union all select k, 1, '{}', 2 from n where k % 4 = 0"


def json_decode(spark: SparkSession, d: str) -> DataFrame:
    e = tables(spark, d, "events")[0]
    rows = e.select("event_id", F.when(F.col("event_id") % 10 == 0, F.lit("{bad")).when(F.col("event_id") % 10 == 1, F.lit("7")).otherwise(F.col("props")).alias("t"))
    return ingest.decode_json(rows, "t", "k string").select("event_id", F.col("value.k").alias("k"), "error")


JSON_DECODE = "select event_id, case when event_id % 10 > 1 then json_extract_string(props, '$.k') end as k, case when event_id % 10 <= 1 then 'invalid response' end as error from events"


def keyed_cache(spark: SparkSession, d: str) -> DataFrame:
    """Entries written by events, replaced, read at a later time."""
    e = tables(spark, d, "events")[0]
    k = F.col("event_id")
    rows = e.select((k % 500).cast("string").alias("key"), k.cast("string").alias("value"), k)
    old = keyed.put(rows.where("event_id % 2 = 0").withColumn("ttl", F.col("event_id") % 90 - 10), F.col("event_id") * 1000, F.col("ttl"), "p:")
    new = keyed.put(rows.where("event_id % 2 = 1").withColumn("ttl", F.col("event_id") % 90 - 10), F.col("event_id") * 1000, F.col("ttl"), "p:")
    keys = spark.range(600).select(F.col("id").cast("string").alias("key"))
    return keyed.get(keyed.upsert(old, new), keys, F.lit(9_950_000), "p:")


KEYED_CACHE = """
with w as (select 'p:' || (event_id % 500) as key, event_id, event_id * 1000 + greatest(60, event_id % 90 - 10) * 1000 as expires from events where event_id % 90 - 10 > 0),
l as (select key, max(event_id) as event_id, arg_max(expires, event_id) as expires from w group by 1)
select i::varchar as key, case when expires > 9950000 then event_id::varchar end as value from range(600) t(i) left join l on l.key = 'p:' || i
"""


def public_places(spark: SparkSession, d: str) -> DataFrame:
    """Report requests and published forms of places."""
    p = _places(spark, d).withColumn("postcodes", F.when(F.col("code") % 2 == 0, F.array(F.col("code"))).otherwise(F.expr("array()").cast("array<string>")))
    q = ingest.commune_query(F.col("code"), F.concat(F.lit("V"), "code"), F.col("postcodes"), F.col("lng"), F.col("lat"))
    j = F.to_json(ingest.public_place(F.col("code"), F.lit("V"), F.col("postcodes"), F.when(F.col("lat").isNotNull(), F.array("lng", "lat")), F.lit(None).cast("string")))
    return p.select(q.alias("q"), F.get_json_object(j, "$.center.lat").try_cast("double").alias("lat"), F.get_json_object(j, "$.contour").isNull().alias("bare")).select("q.insee", "q.CPVille", "q.department", "q.longitude", "q.latitude", "lat", "bare")


PUBLIC_PLACES = f"select code as insee, 'V' || code || case when code::int % 2 = 0 then ' ' || code else '' end as CPVille, code[1:2] as department, printf('%.6f', lng) as longitude, printf('%.6f', lat) as latitude, lat, true as bare from {_PLACES}"

def json_sink(spark: SparkSession, d: str) -> DataFrame:
    """What is written: one JSON object a row, nulls left out, constants added."""
    n = tables(spark, d, "nation")[0].select("n_nationkey", "n_name", F.when(F.col("n_nationkey") % 2 == 0, F.col("n_regionkey")).alias("n_regionkey"), *sinks.metadata(source="x"))
    return sinks.json_lines(n)


JSON_SINK = """select '{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '"' || case when n_nationkey % 2 = 0 then ',"n_regionkey":' || n_regionkey else '' end || ',"source":"x"}' as json from nation"""


def headlines(spark: SparkSession, d: str) -> DataFrame:
    o = tables(spark, d, "orders")[0]
    return o.select("o_orderkey", features.headline(F.col("o_orderkey") % 5, F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderkey") % 7)).alias("n"))


HEADLINES = "select o_orderkey, o_orderkey % 5 + case when o_orderkey % 3 > 0 then o_orderkey % 7 else 0 end as n from orders"

_ALL = (lookup_with_miss, fallback_key_join, source_fallback, failure_only_fallback, best_match, unseen_keys, warnings_union, line_requests, allowed_requests, parameter_faults, nearest_pages, limit_guard, cursor_state, street_filter, feature_style, geojson_features, area_features, json_decode, keyed_cache, public_places, json_sink, headlines)
QUERIES = {f.__name__: f for f in _ALL}
ORACLE_SQL = {f.__name__: globals()[f.__name__.upper()] for f in _ALL}
