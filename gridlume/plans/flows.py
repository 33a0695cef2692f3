"""Whole flows: landed files to a fact with its counts, a place to its street lines, pages in presentation order."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlume.functions import geo as G
from gridlume.functions.scalars import locale_sorted
from gridlume.functions.text import fold_key
from gridlume.operators import enrich, features, ingest, paging, rollup, spatial
from gridlume.plans import join_queries, pages
from gridlume.plans.geo_queries import _segments
from gridlume.runtime import Written, shared_dir
from gridlume.sources import keyed, landing
from gridlume.sources.landing import tables
from gridlume.sources.runs import RunStore, freshness


def _landed(spark: SparkSession, d: str) -> DataFrame:
    """Report files of each nation, dropped into a folder that is partitioned by place; those of one place in eight break off in the middle."""
    texts = pages._report_texts(spark, d)
    n = F.col("insee").cast("int")
    broken = texts.select("insee", "part", F.when(n % 8 == 5, F.substring("text", 1, 20)).otherwise(F.col("text")).alias("text"))
    folder = f"{shared_dir(spark)}/landed-{uuid.uuid4().hex}"
    broken.repartition("insee", "part").write.partitionBy("insee", "part").text(folder)
    return landing.report_landing(spark, folder)


def landed_fact(spark: SparkSession, d: str) -> DataFrame:
    """Landed files to streets: failed files become warnings and the others go on; then lookups and counts."""
    found, warnings = ingest.split_failures(_landed(spark, d), F.concat(F.lit("place "), F.col("insee")))
    reports = found.select(F.col("insee").cast("long").alias("seq"), "insee", F.lit("Lyon").alias("city"), "report")
    streets = pages.place_fact(reports, *pages._dimensions(spark, d))[1]
    stats = rollup.refresh_stats(streets)
    stats = stats.select(F.explode(F.array(*[F.struct(F.lit(c).alias("key"), F.col(c).cast("double").alias("value")) for c in stats.columns])).alias("s")).select(F.lit("stat").alias("kind"), "s.*")
    return (
        streets.select(F.lit("street").alias("kind"), "key", F.col("households").alias("value"))
        .unionByName(warnings.select(F.lit("warning").alias("kind"), F.col("warning").alias("key"), F.lit(None).cast("double").alias("value")))
        .unionByName(stats)
    )


LANDED_FACT = """
with a as (select c_custkey % 40 as i, c_nationkey as n, (c_custkey % 5)::double as h from customer where c_nationkey % 8 <> 5),
s as (select i, n, sum(h) as h from a group by 1, 2)
select 'street' as kind, 'RUE ' || i || '|69' || lpad(n::varchar, 3, '0') || '|VILLE ' || n as key, h as value from s
union all select distinct 'warning', 'place ' || c_nationkey || ': invalid response', null::double from customer where c_nationkey % 8 = 5
union all select 'stat', 'streets', count(*)::double from s union all select 'stat', 'geocoded', count(*) filter ((i + n) % 3 = 0)::double from s union all select 'stat', 'geocode_misses', count(*) filter ((i + n) % 3 <> 0)::double from s
union all select 'stat', 'with_lines', count(*) filter (i % 4 = 0)::double from s union all select 'stat', 'line_misses', count(*) filter (i % 4 <> 0)::double from s
"""


def street_lines(spark: SparkSession, d: str) -> DataFrame:
    """The lines of each place's streets: ways with one of the names in the place's box, grouped by name."""
    n = tables(spark, d, "nation")[0].select(F.col("n_nationkey").alias("place"))
    k = F.col("place")
    # every third place has no outline: its streets are asked for around its centre, or in the viewport
    lat = 48 + k * 0.0006
    ring = F.array(*[F.array(F.lit(x), y) for x, y in ((2.0, lat), (2.002, lat), (2.002, lat + 0.004), (2.0, lat + 0.004))])
    outline = F.when(k % 3 > 0, F.array(F.array(ring)))
    places = landing.with_boxes(n.withColumn("polygons", outline))
    box = F.when(F.col("south").isNotNull(), G.bounds(F.col("south"), F.col("west"), F.col("north"), F.col("east")))
    view = F.when(k % 6 == 0, G.bounds(F.lit(48.0), F.lit(2.0), F.lit(48.001), F.lit(2.001)))
    center = F.struct((lat + 0.03).alias("lat"), F.lit(2.031).alias("lng"))
    asked = places.select("place", landing.request_box(box, view, center).alias("box")).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(11))))
    geocode = F.struct(F.when(F.col("i") % 2 == 0, "ok").otherwise("miss").alias("status"), F.lit(48.0).alias("lat"), F.lit(2.0).alias("lng"))
    request = ingest.geometry_request(F.concat(F.lit("s"), F.col("i").cast("string")), F.concat(F.lit(" Rue É"), F.col("i").cast("string")), geocode)
    requests = asked.select("place", "box", request.alias("r")).select("place", "box", F.col("r.id").alias("id"), F.col("r.name").alias("name"), F.col("r.point").isNotNull().alias("located"))
    c = F.col("idx")
    ways = _segments(spark, d).select(c.alias("seq"), F.when(c % 10 == 0, "node").otherwise("way").alias("type"), F.concat(F.when(c % 2 == 0, F.lit("rue é")).otherwise(F.lit("RUE E")), (c % 14).cast("string"), F.lit(" ")).alias("name"), "line")
    lines = enrich.ways_in(requests, ways)
    return lines.groupBy("place", "key").agg(F.array_join(locale_sorted(F.collect_set("name")), ",").alias("names"), F.count("*").alias("n"), F.min("seq").alias("first")).join(requests.select("place", F.upper(F.regexp_replace(F.trim("name"), "É", "E")).alias("key"), "located"), ["place", "key"])


def matched_lines(requests: DataFrame, ways: DataFrame, place: str = "place") -> DataFrame:
    """``place, key, lines``: the lines of each requested street, for a fact to look up.

    ``requests``: place, name, box and point (null for a street that is not located). Ways are found by name and box; of a located street only the
    components of lines near its point stay, and a street none of whose lines is near has no row. The last request of a place and name counts.
    """
    found = enrich.ways_in(requests, ways, place)
    name = F.struct(place, "key")
    located = requests.where("point is not null").select(place, fold_key(F.col("name")).alias("key"), "point").dropDuplicates([place, "key"]).select(F.to_json(name).alias("street"), "point")
    # written once: all that follows reads it
    lines = Written(found.sparkSession, "matched").save(found.select(F.to_json(name).alias("street"), place, "key", F.col("seq").alias("idx"), "line"))
    near = spatial.nearest_components(lines.join(located.select("street"), "street", "left_semi"), located, "street").where("kept").select("street", "idx")
    kept = lines.join(located.select("street"), "street", "left_anti").unionByName(lines.join(near, ["street", "idx"]).select(lines.columns))
    return kept.groupBy(place, "key").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "line"))), lambda x: x["line"]).alias("lines"))


def matched_fact(spark: SparkSession, d: str) -> DataFrame:
    """Ways to the fact in one plan: requests of streets, ways by name and box, components near the street's point, lookup, counts."""
    n = tables(spark, d, "nation")[0].select(F.col("n_nationkey").alias("place"))
    i, k = F.col("i"), F.col("place")
    point = F.when(i % 3 > 0, F.struct((48 + i * 0.001).alias("lat"), (2 + k % 4 * 0.001).alias("lng")))
    box = G.bounds(48 + k * 0.0002, F.lit(2.0), 48.012 + k * 0.0002, F.lit(2.0041))
    streets = n.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(15)))).select("place", F.concat(F.lit("Rue é"), i.cast("string")).alias("name"), box.alias("box"), point.alias("point"))
    c = F.col("idx")
    ways = _segments(spark, d).select(c.alias("seq"), F.lit("way").alias("type"), F.concat(F.when(c % 2 == 0, F.lit("rue é")).otherwise(F.lit("RUE E")), (c % 14).cast("string")).alias("name"), "line")
    lines = matched_lines(streets, ways)
    rows = streets.withColumn("key", fold_key(F.col("name"))).join(lines, ["place", "key"], "left")
    return rows.select("place", "key", F.when(F.col("lines").isNull(), "miss").otherwise("ok").alias("status"), F.coalesce(F.size("lines"), F.lit(0)).cast("long").alias("n"))


_M = "(pi() * 6371000.0::double / 180.0::double)"
MATCHED_FACT = f"""
with recursive q as (select n_nationkey as k, i, 'RUE E' || i as key, 48 + n_nationkey * 0.0002::double as s, 48.012::double + n_nationkey * 0.0002::double as n, 48 + i * 0.001::double as py, 2 + n_nationkey % 4 * 0.001::double as px from nation, range(16) t(i)),
w as (select c_custkey as idx, c_custkey % 14 as i, 48 + c_custkey % 40 * 0.0004::double as y0, 2 + c_custkey % 9 * 0.0005::double as x0 from customer),
l as (select q.k, q.i, idx, y0, x0, y0 + 0.0002::double as y1, x0 + 0.0003::double as x1, py, px from q join w on w.i = q.i and s <= y0 + 0.0002::double and y0 <= n and 2.0::double <= x0 + 0.0003::double and x0 <= 2.0041::double),
p as (select k, i, idx, unnest([y0, y1]) as y, unnest([x0, x1]) as x from l where i % 3 > 0),
e as (select distinct a.k, a.i, a.idx as u, b.idx as v from p a join p b on a.k = b.k and a.i = b.i where sqrt(pow((a.x - b.x) * {_M} * cos((a.y + b.y) / 2 * pi() / 180), 2) + pow((a.y - b.y) * {_M}, 2)) <= 35),
r as (select k, i, idx as u, idx as v from l where i % 3 > 0 union select r.k, r.i, r.u, e.v from r join e on e.k = r.k and e.i = r.i and e.u = r.v),
comp as (select k, i, u as idx, min(v) as c from r group by all),
m as (select k, i, idx, px * {_M} * cos(py * pi() / 180) as px, py * {_M} as py, x0 * {_M} * cos(py * pi() / 180) as ax, y0 * {_M} as ay, x1 * {_M} * cos(py * pi() / 180) as zx, y1 * {_M} as zy from l where i % 3 > 0),
t as (select *, greatest(0, least(1, ((px - ax) * (zx - ax) + (py - ay) * (zy - ay)) / ((zx - ax) * (zx - ax) + (zy - ay) * (zy - ay)))) as t from m),
dist as (select k, i, idx, sqrt(pow(px - ax - t * (zx - ax), 2) + pow(py - ay - t * (zy - ay), 2)) as d from t),
by_ as (select k, i, c, min(d) as d, count(*) as n from comp join dist using (k, i, idx) group by all),
best as (select k, i, min(d) as closest from by_ group by all),
kept as (select by_.k, by_.i, sum(n) as n from by_ join best on best.k = by_.k and best.i = by_.i where closest <= 1800 and d <= least(1800, closest + 350) group by all union all select k, i, count(*) from l where i % 3 = 0 group by all)
select q.k as place, key, case when kept.n is null then 'miss' else 'ok' end as status, coalesce(kept.n, 0)::bigint as n from q left join kept on kept.k = q.k and kept.i = q.i
"""

STREET_LINES = """
with p as (select n_nationkey as k, 48 + n_nationkey * 0.0006::double as lat from nation),
b as (select k, case when k % 3 > 0 then lat - 0.04::double * (lat + 0.004::double - lat) when k % 6 = 0 then 48.0::double else lat + 0.03::double - 0.03::double end as s, case when k % 3 > 0 then 2.0::double - 0.04::double * (2.002::double - 2.0::double) when k % 6 = 0 then 2.0::double else 2.031::double - 0.03::double end as w,
  case when k % 3 > 0 then lat + 0.004::double + 0.04::double * (lat + 0.004::double - lat) when k % 6 = 0 then 48.001::double else lat + 0.03::double + 0.03::double end as n, case when k % 3 > 0 then 2.002::double + 0.04::double * (2.002::double - 2.0::double) when k % 6 = 0 then 2.001::double else 2.031::double + 0.03::double end as e from p),
w as (select c_custkey as seq, c_custkey % 14 as i, case when c_custkey % 2 = 0 then 'rue é' else 'RUE E' end || (c_custkey % 14) as name, 48 + c_custkey % 40 * 0.0004::double as y, 2 + c_custkey % 9 * 0.0005::double as x from customer where c_custkey % 10 <> 0)
select k as place, 'RUE E' || i as key, string_agg(distinct name, ',' order by name collate en) as names, count(*) as n, min(seq) as first, i % 2 = 0 as located
from b join w on i < 12 and s <= y + 0.0002::double and y <= n and w <= x + 0.0003::double and x <= e group by k, i
"""


def label_order(spark: SparkSession, d: str) -> DataFrame:
    """Presentation order of streets by label, of incidents by id (both language-aware) and of places by code."""
    p = tables(spark, d, "part")[0]
    k = F.col("p_partkey")
    label = F.when(k % 4 == 0, F.upper("p_type")).when(k % 4 == 1, F.lower("p_type")).when(k % 4 == 2, F.concat(F.lit("É"), F.lower("p_type"))).otherwise(F.concat(F.lit("e"), F.lower("p_type")))
    rows = p.select("p_brand", k.alias("key"), label.alias("label"), F.concat(F.when(k % 2 == 0, "i").otherwise("I"), (k % 50).cast("string")).alias("id"), F.lpad((k * 7 % 1000).cast("string"), 5, "0").alias("code"))
    ranked = paging.label_rank(paging.label_rank(rows, "label", "key", ["p_brand"], "by_label"), "id", "key", ["p_brand"], "by_id")
    return ranked.withColumn("by_code", F.row_number().over(paging.W.partitionBy("p_brand").orderBy("code", "key"))).select("key", "by_label", "by_id", "by_code")


LABEL_ORDER = """
with r as (select p_brand, p_partkey as key, case p_partkey % 4 when 0 then upper(p_type) when 1 then lower(p_type) when 2 then 'É' || lower(p_type) else 'e' || lower(p_type) end as label, case when p_partkey % 2 = 0 then 'i' else 'I' end || (p_partkey % 50) as id, lpad((p_partkey * 7 % 1000)::varchar, 5, '0') as code from part)
select key, row_number() over (partition by p_brand order by label collate en, key) as by_label, row_number() over (partition by p_brand order by id collate en, key) as by_id, row_number() over (partition by p_brand order by code, key) as by_code from r
"""


def label_rank_all(spark: SparkSession, d: str) -> DataFrame:
    """Presentation order of a whole table: every label's place among all, without a window over one partition."""
    k = F.col("p_partkey")
    label = F.when(k % 3 == 0, F.upper("p_type")).when(k % 3 == 1, F.concat(F.lit("É"), F.lower("p_type"))).otherwise(F.concat(F.lit("e"), F.lower("p_type")))
    rows = tables(spark, d, "part")[0].select(k.alias("key"), label.alias("label"))
    return paging.label_rank(rows, "label", "key", []).select("key", "rank")


LABEL_RANK_ALL = "select p_partkey as key, row_number() over (order by case p_partkey % 3 when 0 then upper(p_type) when 1 then 'É' || lower(p_type) else 'e' || lower(p_type) end collate en, p_partkey) as rank from part"


def _store(spark: SparkSession, name: str) -> RunStore:
    return RunStore(spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", buckets=4)


def keyed_runs(spark: SparkSession, d: str) -> DataFrame:
    """Entries written by events in four runs, two of them merged, read at a later time."""
    e = tables(spark, d, "events")[0]
    k = F.col("event_id")
    rows = e.select((k % 500).cast("string").alias("key"), k.cast("string").alias("value"), k)
    store = _store(spark, "runs")
    for part in range(4):
        own = rows.where(k % 4 == part).withColumn("ttl", k % 90 - 10)
        store.add(keyed.put(own, k * 1000, F.col("ttl"), "p:"))
        if part == 1:
            store.merge()
    found = store.get(spark.range(600).select(F.col("id").cast("string").alias("key")), "p:")
    return found.select("key", F.when(F.col("expires_ms") > 9_950_000, F.col("value")).alias("value"))


KEYED_RUNS = join_queries.KEYED_CACHE

FRESH_S, STALE_S = 300, 900


def fact_freshness(spark: SparkSession, d: str) -> DataFrame:
    """Facts of places, materialised in two refreshes and read back: fresh, stale (served, to be refreshed) or missing."""
    streets = pages._fact(spark, d)[1].withColumn("code", F.regexp_extract("city", r"(\d+)$", 1))
    facts = streets.groupBy("code").agg(F.count("*").alias("streets"), F.sum("households").alias("households"))
    store, n = _store(spark, "facts"), F.col("code").cast("int")
    for at, part in ((0, facts), (600_000, facts.where(n % 3 == 0))):
        # places are refreshed one after another, 20 seconds each
        now = at + n * 20_000
        fact = F.struct(F.lit(3).alias("version"), (now + FRESH_S * 1000).cast("long").alias("freshUntil"), "streets", "households")
        store.add(keyed.put(part.select(F.concat(F.lit("place:"), "code").alias("key"), F.to_json(fact).alias("value"), now.alias("now")), F.col("now"), F.lit(max(FRESH_S, STALE_S))))
    asked = store.get(spark.range(30).select(F.col("id").cast("string").alias("key")), "place:")
    read = F.lit(1_000_000)
    fact = keyed.versioned(F.col("value"), "version int, freshUntil long, streets long, households double", 3)
    out = freshness(asked.withColumn("fact", fact), read, F.col("fact.freshUntil"))
    served = F.col("cache") != "MISS"
    return out.select("key", "cache", F.when(served, F.col("fact.streets")).alias("streets"), F.when(served, F.col("fact.households")).alias("households"))


FACT_FRESHNESS = """
with a as (select c_custkey % 40 as i, c_nationkey as n, (c_custkey % 5)::double as h from customer),
f as (select n, count(distinct i) as streets, sum(h) as households, n * 20000 + case when n % 3 = 0 then 600000 else 0 end as t0 from a group by n),
s as (select *, case when t0 + 900000 <= 1000000 then 'MISS' when 1000000 < t0 + 300000 then 'HIT' else 'STALE' end as cache from f)
select k::varchar as key, coalesce(cache, 'MISS') as cache, case when cache <> 'MISS' then streets end as streets, case when cache <> 'MISS' then households end as households from range(30) t(k) left join s on s.n = k
"""


def page_collection(spark: SparkSession, d: str) -> DataFrame:
    """One page of the map as a GeoJSON text: its features in order of their keys."""
    streets = pages._fact(spark, d)[1].withColumn("page", F.lit(1))
    text = features.feature_collection(pages.browser_map(streets, "BUILDING", "rue 1"))
    whole = F.from_json("collection", "struct<type string, features array<struct<id string, geometry struct<type string>>>>")
    out = text.select(whole.alias("c"))
    return out.select("c.type", F.size("c.features").cast("long").alias("n"), F.sha2(F.array_join(F.transform("c.features", lambda f: F.concat(f["id"], F.lit(" "), f["geometry"]["type"])), ","), 256).alias("features"))


PAGE_COLLECTION = f"select 'FeatureCollection' as type, count(*) as n, sha256(string_agg(key || ' ' || type, ',' order by key)) as features from ({pages.MAP_FEATURES})"

_ALL = (landed_fact, street_lines, matched_fact, label_order, label_rank_all, keyed_runs, fact_freshness, page_collection)
QUERIES = {f.__name__: f for f in _ALL}
ORACLE_SQL = {f.__name__: globals()[f.__name__.upper()] for f in _ALL}
