"""Queries over roll-ups, set operations and sorts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlume.functions.scalars import earliest, latest
from gridlume.operators import ingest, rollup
from gridlume.plans.scalar_queries import LOCATION_CTES
from gridlume.plans.standins import DUCK_INCIDENTS, addresses, incidents
from gridlume.runtime import Written
from gridlume.sources.landing import tables

def _addr():
    return F.array(F.struct(F.col("flag").alias("location"), F.col("households").alias("households")))


#: DuckDB: milliseconds of a date text of the stand-ins (they hold no overflow).
_MS = "case when {c} = 'x' then 0 else epoch_ms(try_strptime({c}, '%d/%m/%Y %H:%M')) end"
_EARLIEST = "coalesce(arg_min({c}, ({ms}, {s})) filter ({c} <> ''), '')"
_LATEST = "coalesce(arg_max({c}, ({ms}, -{s})) filter ({c} <> ''), '')"


def _first(c: str, s: str = "seq") -> str:
    return _EARLIEST.format(c=c, ms=_MS.format(c=c), s=s)


def _last(c: str, s: str = "seq") -> str:
    return _LATEST.format(c=c, ms=_MS.format(c=c), s=s)


def _ordered(c: str, s: str = "seq") -> str:
    """DuckDB aggregate: distinct non-empty values in order of first appearance, comma-joined."""
    return f"array_to_string(list_transform(list_filter(list_sort(list(({s}, {c}))), lambda x, i: x[2] is not null and x[2] <> '' and i = list_position(list_transform(list_sort(list(({s}, {c}))), lambda y: y[2]), x[2])), lambda x: x[2]), ',')"


def entity_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Orders as incidents, re-nested: each order's lines become one report's list and are exploded again."""
    rows = incidents(spark, d)
    nested = rows.groupBy("okey").agg(F.array_sort(F.collect_list(F.struct("seq", "flag", "households", "start", "restore"))).alias("lines"))
    flat = nested.select("okey", F.posexplode("lines").alias("pos", "l")).select("okey", "pos", "l.*").withColumn("addresses", _addr())
    out = rollup.incident_rollup(flat, ["okey"], "pos")
    flags = F.array_distinct(F.transform("addresses", lambda a: a["location"]))
    return out.select("okey", "households", "start", "restore", F.size("addresses").cast("long").alias("n_addresses"), F.array_join(flags, ",").alias("flags"))


ENTITY_ROLLUP = f"with i as ({DUCK_INCIDENTS}) select okey, sum(households) as households, {_first('start')} as start, {_last('restore')} as restore, count(distinct (flag, households)) as n_addresses, {_ordered('flag')} as flags from i group by okey"


def street_rollup(spark: SparkSession, d: str) -> DataFrame:
    out = rollup.street_rollup(addresses(spark, d))
    return out.select("key", "label", "name", "city", "postcode", F.size("locations").cast("long").alias("n_locations"), F.array_join("incident_ids", ",").alias("ids"), F.array_join("types", ",").alias("types"), "first_seen", "restore_at", "households")


STREET_ROLLUP = rf"""
with {LOCATION_CTES},
x as (select c_custkey as seq, case when c_custkey % 9 = 0 then '' else concat('i', c_custkey % 40) end as oid, coalesce(case when c_custkey % 5 = 0 then null else c_mktsegment end, 'Incident') as kind,
  concat(lpad((1 + c_custkey % 31)::varchar, 2, '0'), '/0', 1 + c_custkey % 9, '/2025 10:00') as start, case when c_custkey % 7 = 0 then '' else concat(lpad((1 + c_custkey % 28)::varchar, 2, '0'), '/10/2025 1', c_custkey % 10, ':30') end as restore, (c_custkey % 13)::double as households from customer),
y as (select *, make_date(2025, start[4:5]::int, 1)::timestamp + to_days(start[1:2]::int - 1) as ms, a.l as location from x join located l using (seq) join a using (seq))
select id as key, arg_min(label, seq) as label, arg_min(name, seq) as name, arg_min(city, seq) as city, arg_min(postcode, seq) as postcode, count(distinct nullif(location, '')) as n_locations,
  coalesce(array_to_string(list_sort(list(distinct oid) filter (oid <> '')), ','), '') as ids, coalesce(array_to_string(list_sort(list(distinct kind) filter (kind <> '')), ','), '') as types, arg_min(start, (ms, seq)) as first_seen,
  coalesce(arg_max(restore, (strptime(restore, '%d/%m/%Y %H:%M'), -seq)) filter (restore <> ''), '') as restore_at, sum(households) as households
from y group by id
""".replace("strptime(restore, ", "try_strptime(restore, ")


def global_counters(spark: SparkSession, d: str) -> DataFrame:
    e = tables(spark, d, "events")[0]
    k = F.get_json_object("props", "$.k")
    reports = e.select(F.struct(F.struct(k.alias("compteurIncidentHTA"), F.concat(k, F.lit("x")).alias("compteurTravauxHTA"), F.concat(F.lit(" "), k).alias("compteurBT")).alias("resultMegacache")).alias("report"))
    return rollup.counters(reports, e)


GLOBAL_COUNTERS = "select sum(json_extract_string(props, '$.k')::double) as incidents, 0.0::double as works, sum(json_extract_string(props, '$.k')::double) as low_voltage, count(*) as address_rows from events"


def first_non_null(spark: SparkSession, d: str) -> DataFrame:
    rows = incidents(spark, d)
    return rows.groupBy("okey").agg(rollup.first_some("state", F.col("seq")).alias("some"), rollup.first_by("state", F.col("seq")).alias("first"))


FIRST_NON_NULL = f"with i as ({DUCK_INCIDENTS}) select okey, arg_min(state, seq) filter (state is not null) as some, list(state order by seq)[1] as first from i group by okey"


def _page_facts(spark: SparkSession, d: str) -> DataFrame:
    """Street-like partials: one a supplier group (page) and part flag.

    Rows are taken apart into two pairs of texts, pairs alike are put together, and their texts once more, before anything is gathered or a date is
    read: what is left of a page are its distinct texts, however many rows it has. The partials are written, so that merges that read them twice
    find them made.
    """
    s, key = F.col("s"), ["page", "k"]
    pair = lambda v, w: F.struct(F.lit(v).alias("of"), F.col(v).alias("v"), F.col(w).alias("w"))
    least = [F.min("s").alias("s"), F.sum("households").alias("households")]
    rows = incidents(spark, d).select((F.col("skey") % 5).alias("page"), (F.col("okey") % 300).alias("k"), "flag", "start", "restore", "state", "households", (F.col("okey") * 100 + F.col("seq")).alias("s"))
    pairs = rows.select(*key, "s", "households", F.inline(F.array(pair("flag", "state"), pair("start", "restore"))))
    pairs = pairs.groupBy(*key, "of", "v", "w").agg(*least)
    second = F.when(F.col("of") == "flag", "state").otherwise("restore")
    texts = F.inline(F.array(F.struct(F.col("of"), F.col("v")), F.struct(second.alias("of"), F.col("w").alias("v"))))
    alike = pairs.select(*key, "s", "households", texts).where("of = 'flag' or v <> ''").groupBy(*key, "of", "v").agg(*least)
    own = lambda c, value: F.when(F.col("of") == c, value)
    gathered = lambda c: F.transform(F.array_sort(F.collect_list(own(c, F.when(F.col("v").isNotNull(), F.struct("s", "v"))))), lambda x: x["v"])
    facts = alike.groupBy(*key).agg(
        *(rollup.first_by("v", own("flag", s)).alias(c) for c in ("label", "name", "city", "postcode")),
        earliest(own("start", F.col("v")), s).alias("first_seen"), latest(own("restore", F.col("v")), s).alias("restore_at"), F.sum(own("flag", F.col("households"))).alias("households"),
        gathered("start").alias("locations"), gathered("flag").alias("incident_ids"), gathered("state").alias("types"),
    )
    return Written(spark, "pages").save(facts.withColumn("key", F.col("k").cast("string")))


def partial_final_merge(spark: SparkSession, d: str) -> DataFrame:
    """Facts by page, merged: equal to one pass over all rows in what doesn't depend on order."""
    out = rollup.merge_streets(_page_facts(spark, d), seq="page")
    return out.select("key", "households", F.size("locations").cast("long").alias("n_locations"), F.array_join(F.array_sort("incident_ids"), ",").alias("ids"), F.array_join(F.array_sort("types"), ",").alias("types"), F.size("types").cast("long").alias("n_types"), "first_seen", "restore_at", "label")


_W = f"with i as (select *, (okey % 300)::varchar as key, skey % 5 as page, okey * 100 + seq as s from ({DUCK_INCIDENTS}))"
_PAGES = f", p as (select key, page, {_first('start', 's')} as f, {_last('restore', 's')} as l, arg_min(flag, (okey, seq)) as label from i group by key, page)"
PARTIAL_FINAL_MERGE = f"""{_W}{_PAGES},
m as (select key, {_first('f', 'page')} as first_seen, {_last('l', 'page')} as restore_at, arg_min(label, page) as label from p group by key)
select key, households, n_locations, ids, types, n_types, first_seen, restore_at, label from (select key, sum(households) as households, count(distinct start) filter (start <> '') as n_locations, array_to_string(list_sort(list(distinct flag)), ',') as ids,
  coalesce(array_to_string(list_sort(list(distinct state) filter (state is not null)), ','), '') as types, count(distinct state) as n_types from i group by key) join m using (key)
"""


def page_merge_browser(spark: SparkSession, d: str) -> DataFrame:
    """The browser's rule: lists of keys that merged come out sorted."""
    out = rollup.merge_streets(_page_facts(spark, d), seq="page", sort_lists=True)
    return out.select("key", "households", F.array_join("incident_ids", ",").alias("ids"), F.size("locations").cast("long").alias("n_locations"))


PAGE_MERGE_BROWSER = f"""{_W},
one as (select key, count(distinct page) as n from i group by key)
select key, sum(households) as households, case when any_value(n) > 1 then array_to_string(list_sort(list(distinct flag)), ',') else {_ordered('flag', 's')} end as ids, count(distinct start) filter (start <> '') as n_locations from i join one using (key) group by key
"""


def merge_headers(spark: SparkSession, d: str) -> DataFrame:
    o = tables(spark, d, "orders")[0]
    pages = o.select(
        F.col("o_orderkey").alias("seq"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("updated_at"), (F.col("o_orderkey") % 7).alias("address_rows"), (F.col("o_orderkey") % 3).alias("incidents"), F.lit(1).alias("works"), F.lit(2).alias("low_voltage"),
        F.when(F.col("o_orderkey") % 5 == 0, F.col("o_orderstatus")).alias("recap"), F.when(F.col("o_orderkey") % 1000 == 999, "c").alias("crises"), F.col("o_orderpriority").alias("viewport"), F.col("o_orderkey").alias("place_total"),
        F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderkey").cast("string")).alias("next_cursor"), F.array("o_orderpriority", "o_orderstatus").alias("warnings"),
    )
    out = rollup.merge_headers(pages)
    return out.withColumn("warnings", F.array_join("warnings", ","))


MERGE_HEADERS = """
with w as (select unnest([(o_orderkey * 2, o_orderpriority), (o_orderkey * 2 + 1, o_orderstatus)]) as p from orders), w2 as (select p[2] as w, min(p[1]) as s from w group by 1)
select max(strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ')) as updated_at, sum(o_orderkey % 7)::bigint as address_rows, sum(o_orderkey % 3)::bigint as incidents, count(*) as works, 2 * count(*) as low_voltage,
  arg_min(o_orderstatus, o_orderkey) filter (o_orderkey % 5 = 0) as recap, case when count(*) filter (o_orderkey % 1000 = 999) > 0 then 'c' end as crises, arg_min(o_orderpriority, o_orderkey) as viewport, min(o_orderkey) as place_total,
  case when max(o_orderkey) % 2 = 0 then max(o_orderkey)::varchar end as next_cursor, (select string_agg(w, ',' order by s) from w2) as warnings from orders
"""


def merge_headers_server(spark: SparkSession, d: str) -> DataFrame:
    """The server's warnings: all pages' lists one after another, repeats and all."""
    o = tables(spark, d, "customer")[0]
    pages = o.select(F.col("c_custkey").alias("seq"), F.lit("t").alias("updated_at"), F.array(F.col("c_mktsegment"), F.lit("w")).alias("warnings"))
    out = rollup.merge_headers(pages, distinct_warnings=False)
    return out.select("updated_at", F.size("warnings").cast("long").alias("n"), F.sha2(F.array_join("warnings", ","), 256).alias("warnings"))


MERGE_HEADERS_SERVER = "select 't' as updated_at, 2 * count(*) as n, sha256(string_agg(c_mktsegment || ',w', ',' order by c_custkey)) as warnings from customer"


def stats_refresh(spark: SparkSession, d: str) -> DataFrame:
    s = tables(spark, d, "supplier", "customer")[1]
    k = F.col("c_custkey")
    rows = s.select(
        F.when(k % 3 == 0, F.struct(F.lit("ok").alias("status"))).when(k % 3 == 1, F.struct(F.lit("miss").alias("status"))).alias("geocode"), (k % 4 != 0).alias("geocode_present"),
        F.when(k % 2 == 0, F.struct(F.lit("ok").alias("status"), F.slice(F.array(F.lit(1)), 1, (k % 5 % 2).cast("int")).alias("lines"))).alias("geometry"),
    )
    return rollup.refresh_stats(rows.withColumn("geocode", F.when(F.col("geocode_present"), F.col("geocode"))))


STATS_REFRESH = """
select count(*) as streets, count(*) filter (k % 4 <> 0 and k % 3 = 0) as geocoded, count(*) filter (k % 4 <> 0 and k % 3 <> 0) as geocode_misses,
  count(*) filter (k % 2 = 0 and k % 5 % 2 = 1) as with_lines, count(*) filter (k % 2 = 0 and k % 5 % 2 = 0) as line_misses from (select c_custkey as k from customer)
"""


def facet_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = incidents(spark, d).groupBy("okey").agg(rollup.sorted_distinct("flag").alias("types"))
    return rollup.facet_counts(rows, {"a": "A", "n": "N", "r": "R"})


FACET_COUNTS = "with o as (select l_orderkey, list(distinct l_returnflag) as t from lineitem group by 1) select count(*) as all, count(*) filter (list_contains(t, 'A')) as a, count(*) filter (list_contains(t, 'N')) as n, count(*) filter (list_contains(t, 'R')) as r from o".replace("as all", 'as "all"')


def date_extrema(spark: SparkSession, d: str) -> DataFrame:
    rows = incidents(spark, d)
    s = F.col("okey") * 100 + F.col("seq")
    return rows.groupBy("skey").agg(earliest(F.col("start"), s).alias("first"), latest(F.col("start"), s).alias("last"))


DATE_EXTREMA = f"with i as (select *, okey * 100 + seq as s from ({DUCK_INCIDENTS})) select skey, {_first('start', 's')} as first, {_last('start', 's')} as last from i group by skey"


def ordered_distinct(spark: SparkSession, d: str) -> DataFrame:
    e = tables(spark, d, "events")[0]
    return e.groupBy("user_id").agg(F.array_join(rollup.ordered_distinct("event_type", F.struct("ts", "event_id")), ",").alias("kinds"), F.array_join(rollup.sorted_distinct("event_type"), ",").alias("sorted"))


ORDERED_DISTINCT = "with f as (select user_id, event_type, min((ts, event_id)) as s from events group by all) select user_id, string_agg(event_type, ',' order by s) as kinds, string_agg(event_type, ',' order by event_type) as sorted from f group by 1"


def group_lines(spark: SparkSession, d: str) -> DataFrame:
    p = tables(spark, d, "part")[0]
    k = F.col("p_partkey")
    ways = p.select(k.alias("seq"), F.when(k % 7 == 0, "node").otherwise("way").alias("type"), F.when(k % 11 == 0, F.lit("  ")).otherwise(F.concat(F.lit(" "), F.lower("p_brand"), F.when(k % 2 == 0, F.lit(" é")).otherwise(F.lit(" E")))).alias("name"), F.slice(F.array(F.struct(k.cast("double").alias("lat"), F.lit(1.0).alias("lng")), F.struct(F.lit(2.0).alias("lat"), F.lit(1.0).alias("lng"))), 1, (k % 3).cast("int")).alias("line"))
    out = rollup.group_lines(ways)
    return out.select("key", F.array_join("names", ",").alias("names"), F.size("lines").cast("long").alias("n"), F.array_join(F.transform("lines", lambda x: F.get(x, F.lit(0))["lat"].cast("long").cast("string")), ",").alias("order"))


GROUP_LINES = """
with w as (select p_partkey as k, lower(p_brand) || case when p_partkey % 2 = 0 then ' é' else ' E' end as name from part where p_partkey % 7 <> 0 and p_partkey % 3 = 2 and p_partkey % 11 <> 0)
select upper(replace(name, 'é', 'e')) as key, string_agg(distinct name, ',' order by name collate en) as names, count(*) as n, string_agg(k::varchar, ',' order by k) as "order" from w group by 1
"""


def combine_polygons(spark: SparkSession, d: str) -> DataFrame:
    n = tables(spark, d, "nation")[0]
    k = F.col("n_nationkey")
    shape = F.when(k % 5 == 0, F.lit('{"type":"Point","coordinates":[]}')).when(k % 5 == 1, F.concat(F.lit('{"type":"Feature","geometry":null,"properties":{"k":'), k.cast("string"), F.lit("}}"))).when(k % 5 == 2, F.concat(F.lit('{"type":"FeatureCollection","features":[{"type":"Feature","geometry":'), k.cast("string"), F.lit('},{"type":"Feature","geometry":null}]}'))).when(k % 5 == 3, F.concat(F.lit('{"type":"Polygon","coordinates":['), k.cast("string"), F.lit("]}"))).otherwise(F.lit("oops"))
    rows = n.select(k.alias("seq"), shape.alias("polygon"))
    return rollup.combine_polygons(rows)


COMBINE_POLYGONS = """
with f as (select n_nationkey as k, case n_nationkey % 5 when 1 then '{"type":"Feature","geometry":null,"properties":{"k":' || n_nationkey || '}}' when 2 then '{"type":"Feature","geometry":' || n_nationkey || '},{"type":"Feature","geometry":null}'
  when 3 then '{"type":"Feature","geometry":{"type":"Polygon","coordinates":[' || n_nationkey || ']},"properties":{}}' end as f from nation)
select '{"type":"FeatureCollection","features":[' || string_agg(f, ',' order by k) || ']}' as polygon from f where f is not null
"""


def cache_outcomes(spark: SparkSession, d: str) -> DataFrame:
    e = tables(spark, d, "events")[0]
    return rollup.cache_outcomes(e.select(F.expr("case event_id % 4 when 0 then 'HIT' when 1 then 'STALE' when 2 then 'MISS' end").alias("outcome")))


CACHE_OUTCOMES = "select count(*) filter (event_id % 4 = 0) as hits, count(*) filter (event_id % 4 = 1) as stale, count(*) filter (event_id % 4 >= 2) as misses from events"


def dedupe_first(spark: SparkSession, d: str) -> DataFrame:
    e = tables(spark, d, "events")[0]
    return rollup.distinct_first(e.select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], "event_id")


DEDUPE_FIRST = "select user_id, event_type, min(event_id) as event_id, arg_min(value, event_id) as value from events group by 1, 2"


def dedupe_last(spark: SparkSession, d: str) -> DataFrame:
    e = tables(spark, d, "events")[0]
    return rollup.distinct_last(e.select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], "event_id", keep_place=True)


DEDUPE_LAST = "select user_id, event_type, arg_max(value, event_id) as value, min(event_id) as event_id from events group by 1, 2"


def merge_incidents(spark: SparkSession, d: str) -> DataFrame:
    """Two pages of incident facts under the merge key (place, id, start)."""
    rows = incidents(spark, d).select((F.col("okey") % 50).cast("string").alias("place_code"), F.col("flag").alias("id"), "start", "restore", "households", _addr().alias("addresses"), (F.col("okey") * 100 + F.col("seq")).alias("seq"), F.lit("s").alias("status"), F.lit("t").alias("type"), F.lit(0.0).alias("electric_state"))
    out = rollup.merge_incidents(rows)
    return out.select("merge_key", "households", "restore", F.size("addresses").cast("long").alias("n_addresses"))


MERGE_INCIDENTS = f"with i as (select *, okey * 100 + seq as s, (okey % 50)::varchar || ':' || flag || ':' || start as merge_key from ({DUCK_INCIDENTS})) select merge_key, sum(households) as households, {_last('restore', 's')} as restore, count(distinct (flag, households)) as n_addresses from i group by 1"


def report_explode(spark: SparkSession, d: str) -> DataFrame:
    """Customers' orders as JSON reports: decoded, exploded, defaults and fallback keys filled."""
    o = tables(spark, d, "orders")[0]
    k = F.col("o_orderkey")
    incident = F.struct(F.when(k % 5 == 0, F.lit("")).when(k % 3 == 0, F.concat(F.lit("o"), k.cast("string"))).alias("idCoupure"), F.when(k % 2 == 0, F.col("o_orderpriority")).alias("incidentCoupure"), F.concat(F.lit(" "), (k % 9).cast("string")).alias("nbFoyersCoupes"), F.when(k % 4 > 0, F.transform(F.sequence(F.lit(1), (k % 4).cast("int")), lambda i: F.struct(F.concat(F.lit("R. "), i.cast("string")).alias("localisation"), i.cast("string").alias("nbFoyersCoupes")))).alias("listeAdresses"))
    texts = o.groupBy("o_custkey").agg(F.transform(F.array_sort(F.collect_list(F.struct(k.alias("k"), incident.alias("i")))), lambda x: x["i"]).alias("l")).select(F.col("o_custkey").cast("string").alias("insee"), F.when(F.col("o_custkey") % 10 == 0, F.lit("{oops")).otherwise(F.to_json(F.struct(F.struct(F.col("l").alias("listeCoupuresInfoReseau")).alias("resultMegacache")))).alias("text"))
    good, bad = ingest.split_failures(ingest.decode_json(texts, "text", ingest.REPORT, "report"), F.col("insee"))
    rows = ingest.explode_incidents(good.select(F.lit(0).alias("seq"), "insee", F.lit("Lyon").alias("city"), "report"))
    out = rows.select("insee", F.col("pos").cast("long").alias("pos"), "key", "id", "type", "households", F.size("addresses").cast("long").alias("n_addresses"), F.aggregate("addresses", F.lit(0.0), lambda a, x: a + x["households"]).alias("address_households"))
    none = lambda t: F.lit(None).cast(t)
    return out.withColumn("warning", none("string")).unionByName(bad.select(none("string").alias("insee"), none("long").alias("pos"), none("string").alias("key"), none("string").alias("id"), none("string").alias("type"), none("double").alias("households"), none("long").alias("n_addresses"), none("double").alias("address_households"), "warning"))


REPORT_EXPLODE = """
with o as (select o_orderkey as k, o_custkey, o_orderpriority, row_number() over (partition by o_custkey order by o_orderkey) - 1 as pos from orders)
select o_custkey::varchar as insee, pos, case when k % 5 = 0 then '' when k % 3 = 0 then 'o' || k else o_custkey || ':' || pos end as key, case when k % 5 = 0 then '' when k % 3 = 0 then 'o' || k else '' end as id,
  case when k % 2 = 0 then o_orderpriority else '' end as type, (k % 9)::double as households, k % 4 as n_addresses, case k % 4 when 0 then 0 when 1 then 1 when 2 then 3 else 6 end::double as address_households, null::varchar as warning
from o where o_custkey % 10 <> 0
union all select null, null, null, null, null, null, null, null, w from (select distinct o_custkey || ': invalid response' as w from orders where o_custkey % 10 = 0)
"""

_ALL = (merge_headers_server, entity_rollup, street_rollup, global_counters, first_non_null, partial_final_merge, page_merge_browser, merge_headers, stats_refresh, facet_counts, date_extrema, ordered_distinct, group_lines, combine_polygons, cache_outcomes, dedupe_first, dedupe_last, merge_incidents, report_explode)
QUERIES = {f.__name__: f for f in _ALL}
ORACLE_SQL = {f.__name__: globals()[f.__name__.upper()] for f in _ALL}
