"""The three whole plans: a place's fact, a viewport's page, a browser's map."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlume.functions import text as X
from gridlume.operators import enrich, features, ingest, paging, rollup
from gridlume.sources.landing import tables


def place_fact(reports: DataFrame, geocodes: DataFrame, lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Incidents and enriched streets of reports (``seq, insee, city, report``).

    Decoded reports are exploded twice, rolled up by incident and by street, then looked up: ``geocodes`` (``q, geocode``) by
    the street's query key, ``lines`` (``key, lines``) by its name key.
    """
    found = ingest.explode_incidents(reports)
    incidents = rollup.incident_rollup(found.withColumn("seq", F.struct("seq", "pos")), ["key"])
    rows = ingest.explode_addresses(found).withColumn("seq", F.struct("seq", "pos", "addr_pos"))
    streets = rollup.street_rollup(rows).withColumn("q", enrich.geocode_key(F.col("name"), F.col("city"), F.col("postcode")))
    placed = enrich.lookup_with_miss(streets, geocodes, "q", "geocode", F.struct(F.lit("miss").alias("status"), F.lit(None).cast("double").alias("lng"), F.lit(None).cast("double").alias("lat")))
    named = placed.withColumn("name_key", X.fold_key(F.col("name")))
    found_lines = lines.select(F.col("key").alias("name_key"), F.struct(F.lit("ok").alias("status"), F.col("lines").alias("lines")).alias("geometry"))
    return incidents, enrich.lookup_with_miss(named, found_lines, "name_key", "geometry", F.struct(F.lit("miss").alias("status"), F.lit(None).cast(dict(lines.dtypes)["lines"]).alias("lines"))).drop("q", "name_key")


def viewport_page(places: DataFrame, facts: DataFrame, lat: Column, lng: Column, offset: int) -> DataFrame:
    """Street facts (``code`` beside the street's columns) of one page of places, nearest first, merged."""
    ranked = paging.page_slice(paging.nearest_pages(places, lat, lng, most=offset + paging.PAGE_SIZE), offset)
    return rollup.merge_streets(facts.join(ranked.select("code", "rank"), "code"), seq="rank")


def viewport_result(places: DataFrame, facts: DataFrame, incidents: DataFrame, outcomes: DataFrame, lat: Column, lng: Column, offset: int) -> DataFrame:
    """All of one page's answer as ``kind, pos, key, value``: streets in presentation order, incidents by id, warnings, cache counters and totals.

    ``facts`` and ``incidents`` (of a place: ``code`` beside the fact's columns); ``outcomes``: ``code, name, cache, warning``, where a place
    without an outcome failed: it gives a warning and counts as a miss, its facts are left out. Streets and incidents of several places merge. Positions
    begin at 1: streets by label, incidents by id (both language-aware), warnings by place, each text once.
    """
    ranked = paging.page_slice(paging.nearest_pages(places, lat, lng, most=offset + paging.PAGE_SIZE), offset)
    asked = outcomes.join(ranked.select("code", "rank"), "code")
    good = asked.where("cache is not null").select("code", "rank")
    streets = rollup.merge_streets(facts.join(good, "code"), seq="rank")
    merged = rollup.merge_incidents(incidents.join(good, "code"), seq="rank")
    row = lambda kind, key, value: (F.lit(kind).alias("kind"), F.col("pos").cast("long").alias("pos"), key.alias("key"), value.cast("double").alias("value"))
    failed = F.concat(F.col("name"), F.lit(" ("), F.col("code"), F.lit("): "), F.col("warning"))
    warnings = rollup.ordered_lists(asked.select("rank", F.array(F.when(F.col("cache").isNull(), failed).otherwise(F.col("warning"))).alias("w")), [], ["w"], F.col("rank"))
    totals = F.explode(F.array(*(F.struct(F.lit(i).alias("pos"), F.lit(c).alias("key"), F.col(c).cast("double").alias("value")) for i, c in enumerate(("hits", "stale", "misses"), 1))))
    counted = rollup.cache_outcomes(asked, "cache").select(totals.alias("t")).select("t.*")
    counted = counted.unionByName(places.agg(F.lit(4).alias("pos"), F.lit("places").alias("key"), F.count("*").cast("double").alias("value")))
    return (
        paging.label_rank(streets, "label", "key", [], "pos").select(*row("street", F.col("key"), F.col("households")))
        .unionByName(paging.label_rank(merged, "id", "merge_key", [], "pos").select(*row("incident", F.col("id"), F.col("households"))))
        .unionByName(warnings.select(F.posexplode("w").alias("pos", "w")).where("w is not null").withColumn("pos", F.row_number().over(paging.W.partitionBy(F.lit(0)).orderBy("pos"))).select(*row("warning", F.col("w"), F.lit(None))))
        .unionByName(counted.select(*row("total", F.col("key"), F.col("value"))))
    )


def browser_map(pages: DataFrame, facet: str, query: str, active_key: str = "") -> DataFrame:
    """Features of pages of streets: merged by the browser's rule, filtered, drawn."""
    merged = rollup.merge_streets(pages, seq="page", sort_lists=True).withColumn("lines", F.col("geometry.lines"))
    return features.geojson_features(features.street_filter(merged, facet, query), active_key)


#: Fixed value: customers of a report, so that its file has no more bytes than a landed report may have, whatever the table.
REPORT_CUSTOMERS = 10_000


def _report_texts(spark: SparkSession, d: str) -> DataFrame:
    """Reports of each nation as JSON, one for each range of customer keys: its customers as incidents with one address each."""
    c = tables(spark, d, "customer")[0]
    k = F.col("c_custkey")
    street = F.concat(F.lit("R. "), (k % 40).cast("string"), F.lit(", Ville "), F.col("c_nationkey").cast("string"), F.lit(" (69"), F.lpad(F.col("c_nationkey").cast("string"), 3, "0"), F.lit(")"))
    incident = F.struct(F.concat(F.lit("i"), (k % 60).cast("string")).alias("idCoupure"), F.col("c_mktsegment").alias("incidentCoupure"), F.lit("01/02/2025 10:00").alias("dateCoupure"), (k % 7).cast("string").alias("nbFoyersCoupes"), F.array(F.struct(street.alias("localisation"), (k % 5).cast("string").alias("nbFoyersCoupes"))).alias("listeAdresses"))
    by = c.groupBy("c_nationkey", F.floor(k / REPORT_CUSTOMERS).cast("long").alias("part")).agg(F.transform(F.array_sort(F.collect_list(F.struct(k.alias("k"), incident.alias("i")))), lambda x: x["i"]).alias("l"))
    return by.select(F.struct(F.col("c_nationkey").cast("long").alias("nation"), "part").alias("seq"), "part", F.col("c_nationkey").cast("string").alias("insee"), F.lit("Lyon").alias("city"), F.to_json(F.struct(F.struct(F.col("l").alias("listeCoupuresInfoReseau")).alias("resultMegacache"))).alias("text"))


def _reports(spark: SparkSession, d: str) -> DataFrame:
    return ingest.decode_json(_report_texts(spark, d), "text", ingest.REPORT, "report").select("seq", "insee", "city", "report")


def _dimensions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Geocodes of a third of the streets, lines of a quarter of the names."""
    n = spark.range(40).withColumn("id", F.col("id").cast("long"))
    places = tables(spark, d, "nation")[0].select(F.col("n_nationkey").alias("n"))
    keys = places.select(F.explode(F.sequence(F.lit(0), F.lit(39))).alias("i"), "n").where("(i + n) % 3 = 0")
    geo = keys.select(F.concat(F.lit("RUE "), F.col("i").cast("string"), F.lit(" VILLE "), F.col("n").cast("string"), F.lit(" 69"), F.lpad(F.col("n").cast("string"), 3, "0")).alias("q"), F.struct(F.lit("ok").alias("status"), (2 + F.col("i") / 100.0).alias("lng"), (48 + F.col("n") / 100.0).alias("lat")).alias("geocode"))
    lines = n.where("id % 4 = 0").select(F.concat(F.lit("RUE "), F.col("id").cast("string")).alias("key"), F.array(F.array(F.array(F.lit(2.0), F.lit(48.0)), F.array(F.lit(2.1), F.lit(48.1)))).alias("lines"))
    return geo, lines


def _fact(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return place_fact(_reports(spark, d), *_dimensions(spark, d))


def fact_streets(spark: SparkSession, d: str) -> DataFrame:
    streets = _fact(spark, d)[1]
    return streets.select("key", "label", "city", "postcode", F.array_join("incident_ids", ",").alias("ids"), F.array_join("types", ",").alias("types"), "households", F.col("geocode.status").alias("geocode"), F.col("geometry.status").alias("geometry"))


FACT_STREETS = """
with a as (select c_custkey % 40 as i, c_nationkey as n, 'i' || (c_custkey % 60) as id, c_mktsegment as t, (c_custkey % 5)::double as h from customer)
select 'RUE ' || i || '|69' || lpad(n::varchar, 3, '0') || '|VILLE ' || n as key, 'Rue ' || i as label, 'Ville ' || n as city, '69' || lpad(n::varchar, 3, '0') as postcode, array_to_string(list_sort(list(distinct id)), ',') as ids, array_to_string(list_sort(list(distinct t)), ',') as types, sum(h) as households,
  case when (i + n) % 3 = 0 then 'ok' else 'miss' end as geocode, case when i % 4 = 0 then 'ok' else 'miss' end as geometry from a group by i, n
"""


def fact_incidents(spark: SparkSession, d: str) -> DataFrame:
    return _fact(spark, d)[0].select("key", "id", "households", F.size("addresses").cast("long").alias("n_addresses"))


FACT_INCIDENTS = "select 'i' || (c_custkey % 60) as key, 'i' || (c_custkey % 60) as id, sum((c_custkey % 7)::double) as households, count(distinct (c_custkey % 40, c_nationkey, c_custkey % 5)) as n_addresses from customer group by 1"


def viewport_streets(spark: SparkSession, d: str) -> DataFrame:
    streets = _fact(spark, d)[1].withColumn("code", F.regexp_extract("city", r"(\d+)$", 1))
    places = tables(spark, d, "nation")[0].select(F.col("n_nationkey").cast("string").alias("code"), (48 + F.col("n_nationkey") * 7 % 25 / 10.0).alias("lat"), F.lit(2.0).alias("lng"))
    return viewport_page(places, streets, F.lit(48.0), F.lit(2.0), 6).select("key", "households", "label")


VIEWPORT_STREETS = """
with r as (select n_nationkey as n, row_number() over (order by pow(n_nationkey * 7 % 25 / 10.0::double, 2), n_nationkey::varchar) as rank from nation), a as (select c_custkey % 40 as i, c_nationkey as n, (c_custkey % 5)::double as h from customer)
select 'RUE ' || i || '|69' || lpad(n::varchar, 3, '0') || '|VILLE ' || n as key, sum(h) as households, 'Rue ' || i as label from a join r using (n) where rank between 7 and 12 group by i, n
"""


def viewport_page_result(spark: SparkSession, d: str) -> DataFrame:
    """The second page of a viewport with all that comes with it; every fourth place has failed."""
    code = F.regexp_extract("city", r"(\d+)$", 1)
    found = ingest.explode_incidents(_reports(spark, d))
    incidents = rollup.incident_rollup(found.withColumn("seq", F.struct("seq", "pos")), ["insee", "key"]).withColumnRenamed("insee", "code")
    n = tables(spark, d, "nation")[0].select(F.col("n_nationkey").alias("n"))
    places = n.select(F.col("n").cast("string").alias("code"), (48 + F.col("n") * 7 % 25 / 10.0).alias("lat"), F.lit(2.0).alias("lng"))
    cache = F.when(F.col("n") % 4 == 0, "HIT").when(F.col("n") % 4 == 1, "STALE").when(F.col("n") % 4 == 2, "MISS")
    warning = F.when(F.col("n") % 4 == 3, "no answer").when(F.col("n") % 4 == 2, "lines are late")
    outcomes = n.select(F.col("n").cast("string").alias("code"), F.concat(F.lit("Ville "), "n").alias("name"), cache.alias("cache"), warning.alias("warning"))
    return viewport_result(places, _fact(spark, d)[1].withColumn("code", code), incidents, outcomes, F.lit(48.0), F.lit(2.0), 6)


VIEWPORT_PAGE_RESULT = """
with r as (select n_nationkey as n, row_number() over (order by pow(n_nationkey * 7 % 25 / 10.0::double, 2), n_nationkey::varchar) as rank from nation),
p as (select * from r where rank between 7 and 12),
a as (select c_custkey % 40 as i, c_nationkey as n, 'i' || (c_custkey % 60) as id, (c_custkey % 5)::double as h, (c_custkey % 7)::double as hi from customer join p on p.n = c_nationkey where c_nationkey % 4 <> 3),
s as (select 'RUE ' || i || '|69' || lpad(n::varchar, 3, '0') || '|VILLE ' || n as key, 'Rue ' || i as label, sum(h) as h from a group by i, n),
c as (select id, sum(hi) as h from a group by 1),
w as (select case n % 4 when 3 then 'Ville ' || n || ' (' || n || '): no answer' else 'lines are late' end as w, min(rank) as first from p where n % 4 >= 2 group by 1)
select 'street' as kind, row_number() over (order by label collate en, key) as pos, key, h as value from s
union all select 'incident', row_number() over (order by id collate en), id, h from c
union all select 'warning', row_number() over (order by first), w, null from w
union all select 'total', 1, 'hits', count(*) filter (n % 4 = 0)::double from p union all select 'total', 2, 'stale', count(*) filter (n % 4 = 1)::double from p
union all select 'total', 3, 'misses', count(*) filter (n % 4 >= 2)::double from p union all select 'total', 4, 'places', count(*)::double from nation
"""


def map_features(spark: SparkSession, d: str) -> DataFrame:
    streets = _fact(spark, d)[1].withColumn("page", F.length("key"))
    pages = streets.union(streets.withColumn("page", F.col("page") + 1))
    out = browser_map(pages, "BUILDING", "rue 1")
    j = lambda p: F.get_json_object("feature", p)
    return out.select("key", j("$.geometry.type").alias("type"), j("$.properties.radius").cast("double").alias("radius"))


MAP_FEATURES = """
with a as (select c_custkey % 40 as i, c_nationkey as n, 'i' || (c_custkey % 60) as id, c_mktsegment as t from customer), s as (select i, n, count(distinct id) as k, list(distinct t) as ts from a group by 1, 2)
select 'RUE ' || i || '|69' || lpad(n::varchar, 3, '0') || '|VILLE ' || n as key, case when i % 4 = 0 then 'MultiLineString' else 'Point' end as type, least(13.0::double, 7 + k * 1.5::double) as radius from s where list_contains(ts, 'BUILDING') and (i = 1 or i between 10 and 19) and (i % 4 = 0 or (i + n) % 3 = 0)
"""

_ALL = (fact_streets, fact_incidents, viewport_streets, viewport_page_result, map_features)
QUERIES = {f.__name__: f for f in _ALL}
ORACLE_SQL = {f.__name__: globals()[f.__name__.upper()] for f in _ALL}
