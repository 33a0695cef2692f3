"""Roll-ups and their merges: pinned facts and order rules."""

from pyspark.sql import functions as F

from gridlume.operators import enrich, ingest, paging, rollup


def report(spark, *texts):
    rows = spark.createDataFrame([(i, "75056", "Paris", t) for i, t in enumerate(texts)], "seq int, insee string, city string, text string")
    return ingest.decode_json(rows, "text", ingest.REPORT, "report")


DOUBLE = """{"resultMegacache": {"compteurIncidentHTA": "2", "compteurTravauxHTA": 1, "compteurBT": "3", "listeCoupuresInfoReseau": [
 {"idCoupure": "outage-1", "dateCoupure": "21/03/2026 10:00", "dateRealimentation": "21/03/2026 12:00", "nbFoyersCoupes": "5", "listeAdresses": [{"localisation": "R. A, Paris", "nbFoyersCoupes": "2"}]},
 {"idCoupure": "outage-1", "dateCoupure": "21/03/2026 09:00", "dateRealimentation": "21/03/2026 13:00", "nbFoyersCoupes": 3, "listeAdresses": [{"localisation": "R. A, Paris", "nbFoyersCoupes": 2}]}]}}"""


def test_double_report(spark):
    r = report(spark, DOUBLE)
    found = ingest.explode_incidents(r)
    one = rollup.incident_rollup(found.withColumn("seq", F.col("pos")), ["key"]).collect()
    assert len(one) == 1
    row = one[0]
    assert (row.households, row.start, row.restore, len(row.addresses)) == (8, "21/03/2026 09:00", "21/03/2026 13:00", 1)
    addresses = ingest.explode_addresses(found)
    assert tuple(rollup.counters(r, addresses).first()) == (2, 1, 3, 2)
    street = rollup.street_rollup(addresses.withColumn("seq", F.col("pos"))).collect()
    assert len(street) == 1 and street[0].households == 4 and street[0].types == ["Incident"]


def test_keys(spark):
    text = '{"resultMegacache": {"listeCoupuresInfoReseau": [{"idCoupure": ""}, {"idCoupure": ""}, {}, {}]}}'
    keys = [r.key for r in ingest.explode_incidents(report(spark, text)).orderBy("pos").collect()]
    assert keys == ["", "", "75056:2", "75056:3"]


def test_failures(spark):
    r = report(spark, "{bad", DOUBLE, "", None, "7")
    good, bad = ingest.split_failures(r, F.col("insee"))
    assert good.count() == 1 and [x.warning for x in bad.collect()] == ["75056: invalid response"]


def test_merge_order(spark):
    rows = [("k", 1, ["b", "a", "", "b"], None), ("k", 2, ["c", "a"], "g"), ("z", 1, ["b", "", "a"], None)]
    df = spark.createDataFrame(rows, "key string, page int, locations array<string>, geocode string").selectExpr("*", "key label", "key name", "key city", "key postcode", "locations incident_ids", "locations types", "'x' first_seen", "'' restore_at", "1D households")
    server = {r.key: r for r in rollup.merge_streets(df, seq="page").collect()}
    browser = {r.key: r for r in rollup.merge_streets(df, seq="page", sort_lists=True).collect()}
    assert server["k"].locations == ["b", "a", "c"] and server["k"].geocode == "g" and server["k"].households == 2
    assert browser["k"].locations == ["", "a", "b", "c"] and browser["z"].locations == ["b", "", "a"]


def test_partial_then_final(spark):
    rows = [(i % 7, f"l{i % 5}", f"i{i % 3}", i % 4, float(i)) for i in range(200)]
    df = spark.createDataFrame(rows, "k int, l string, i string, page int, h double").selectExpr("concat(k, '') key", "l locations", "i incident_ids", "page", "h", "cast(row_number() over (order by h) as long) seq")
    whole = {r.key: (r.h, sorted(r.l)) for r in df.groupBy("key").agg(F.sum("h").alias("h"), rollup.ordered_distinct("locations", F.col("seq")).alias("l")).collect()}
    part = df.groupBy("key", "page").agg(F.sum("h").alias("households"), rollup.ordered_distinct("locations", F.col("seq")).alias("locations"), rollup.ordered_distinct("incident_ids", F.col("seq")).alias("incident_ids")).selectExpr("*", "key label", "key name", "key city", "key postcode", "incident_ids types", "'' first_seen", "'' restore_at")
    merged = {r.key: (r.households, sorted(r.locations)) for r in rollup.merge_streets(part, seq="page").collect()}
    assert merged == whole


def test_stats(spark):
    df = spark.createDataFrame([("ok", True, "ok", 1), (None, True, "ok", 0), (None, False, None, None), ("miss", True, "miss", 0)], "g string, p boolean, s string, n int")
    df = df.select(F.when(F.col("g").isNotNull(), F.struct(F.col("g").alias("status"))).alias("geocode"), F.col("p").alias("geocode_present"), F.when(F.col("s").isNotNull(), F.struct(F.col("s").alias("status"), F.when(F.col("n") > 0, F.array(F.lit(1))).otherwise(F.expr("array()").cast("array<int>")).alias("lines"))).alias("geometry"))
    assert rollup.refresh_stats(df).first().asDict() == {"streets": 4, "geocoded": 1, "geocode_misses": 2, "with_lines": 1, "line_misses": 2}


def test_fallback(spark):
    keys = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "k string")
    one = spark.createDataFrame([("a", "miss", None), ("b", "failed", None), ("c", "rate_limited", None)], "k string, status string, payload string")
    two = spark.createDataFrame([("a", "failed", None), ("b", "failed", None), ("c", "ok", "x"), ("d", "ok", "y")], "k string, status string, payload string")
    got = {r.k: (r.status, r.lookups) for r in enrich.source_fallback(keys, one, two, "k").collect()}
    assert got == {"a": ("error", 2), "b": ("error", 2), "c": ("error", 1), "d": ("ok", 2)}
    assert {r.k: r.status for r in enrich.failure_fallback(keys, one, two, "k").collect()} == {"a": "miss", "b": "error", "c": "error", "d": "miss"}


def test_pages(spark):
    places = spark.createDataFrame([(f"7500{i}", 48.85, 2.3 + i * 0.001) for i in range(1, 8)] + [("00001", None, None)], "code string, lat double, lng double")
    ranked = paging.nearest_pages(places, F.lit(48.85), F.lit(2.3))
    assert [r.code for r in paging.page_slice(ranked, 6).orderBy("rank").collect()] == ["75007", "00001"]


def test_polygons(spark):
    rows = [(1, '{"type":"Polygon","coordinates":[]}'), (2, '{"type":"Feature","geometry":null}'), (3, "oops"), (4, None)]
    df = spark.createDataFrame(rows, "seq int, polygon string")
    assert rollup.combine_polygons(df).first()[0].count('"Feature"') == 2
    assert rollup.combine_polygons(df.where("seq = 1")).first()[0] == rows[0][1]
    assert rollup.combine_polygons(df.where("seq > 2")).first()[0] is None


def test_ordered_lists(spark):
    """Least places by partial minimum: null and empty lists, null elements, null keys, repeats near and far."""
    rows = [("a", 2, ["y", "x"], ["q"]), ("a", 1, ["x", "x", None], None), ("b", 1, None, None), ("b", 2, [], []), (None, 5, ["n"], ["m", "n", "m"])]
    df = spark.createDataFrame(rows, "k string, seq long, v array<string>, w array<string>")
    got = {r.k: (r.v, r.w) for r in rollup.ordered_lists(df, ["k"], ["v", "w"], F.col("seq")).collect()}
    assert got == {"a": (["x", None, "y"], ["q"]), None: (["n"], ["m", "n"])}
    facts = rollup._with_lists(df.groupBy("k").count(), rollup.ordered_lists(df, ["k"], ["v", "w"], F.col("seq")), ["k"], ["v", "w"])
    assert {r.k: (r["count"], r.v, r.w) for r in facts.collect()} == {"a": (2, ["x", None, "y"], ["q"]), "b": (2, [], []), None: (1, ["n"], ["m", "n"])}


def test_a_hot_key_of_repeats_is_summed_up_before_it_meets(spark):
    """What is gathered is distinct values: the rows of the last grouping are those of (key, list, value)."""
    df = spark.range(0, 40_000, 1, 8).select(F.lit("hot").alias("k"), F.col("id").alias("seq"), F.array((F.col("id") % 5).cast("string")).alias("v"))
    got = rollup.ordered_lists(df, ["k"], ["v"], F.col("seq")).first()
    assert got.v == ["0", "1", "2", "3", "4"]
