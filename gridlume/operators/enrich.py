"""Lookup joins that attach points and lines to streets.

Dimensions are joined by shuffle or broadcast as their size decides (the optimizer's threshold); nothing here forces a broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlume.functions.geo import street_bounds
from gridlume.functions.text import fold_key, lookup_query, trim


def best_match(features: DataFrame, key: str, rank: str) -> DataFrame:
    """The top feature of each key as an ``ok`` struct, absent texts empty."""
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    top = features.groupBy(key).agg(F.min_by(F.struct("lng", "lat", "label", "score", "type", "postcode", "citycode"), F.col(rank)).alias("f")).select(key, "f.*")
    return top.select(key, F.struct(F.lit("ok").alias("status"), "lng", "lat", text("label"), "score", text("type"), text("postcode"), text("citycode")).alias("found"))


def lookup_with_miss(rows: DataFrame, dimension: DataFrame, key: str, value: str, miss: Column) -> DataFrame:
    """Left join on a unique key, with a miss value where nothing is found."""
    return rows.join(dimension.select(key, value), key, "left").withColumn(value, F.coalesce(F.col(value), miss))


def fallback_key_join(rows: DataFrame, dimension: DataFrame, first: str, second: str, key: str, value: str) -> DataFrame:
    """Left join on the first key, else on the second."""
    d = dimension.select(F.col(key).alias("_k"), F.col(value).alias("_v"))
    one, two = d.toDF("_k1", "_v1"), d.toDF("_k2", "_v2")
    return rows.join(one, F.col(first) == F.col("_k1"), "left").join(two, F.col(second) == F.col("_k2"), "left").withColumn(value, F.coalesce("_v1", "_v2")).drop("_k1", "_v1", "_k2", "_v2")


def source_fallback(rows: DataFrame, primary: DataFrame, fallback: DataFrame, key: str) -> DataFrame:
    """Ordered sources (``key``, ``status``, ``payload``): a hit of the first; after its miss or failure the second's answer.

    A primary that is rate-limited is an error and asks no further; a failing fallback is an error. ``lookups`` counts sources asked.
    """
    p = primary.select(key, F.col("status").alias("_p"), F.col("payload").alias("_pv"))
    f = fallback.select(key, F.col("status").alias("_f"), F.col("payload").alias("_fv"))
    one, two = F.coalesce("_p", F.lit("miss")), F.coalesce("_f", F.lit("miss"))
    status = F.when(one == "ok", "ok").when(one == "rate_limited", "error").when(two == "ok", "ok").when(two == "miss", "miss").otherwise("error")
    payload = F.when(one == "ok", F.col("_pv")).when((one != "rate_limited") & (two == "ok"), F.col("_fv"))
    asked = F.when(one.isin("ok", "rate_limited"), 1).otherwise(2)
    return rows.join(p, key, "left").join(f, key, "left").withColumns({"status": status, "payload": payload, "lookups": asked}).drop("_p", "_pv", "_f", "_fv")


def failure_fallback(rows: DataFrame, primary: DataFrame, fallback: DataFrame, key: str) -> DataFrame:
    """As above, but an empty answer of the first source counts: only its failure asks the second, rate limits ask no further."""
    p = primary.select(key, F.col("status").alias("_p"), F.col("payload").alias("_pv"))
    f = fallback.select(key, F.col("status").alias("_f"), F.col("payload").alias("_fv"))
    one, two = F.coalesce("_p", F.lit("miss")), F.coalesce("_f", F.lit("miss"))
    second = one == "failed"
    status = F.when(one.isin("ok", "miss"), one).when(~second, "error").when(two.isin("ok", "miss"), two).otherwise("error")
    payload = F.when(one == "ok", F.col("_pv")).when(second & (two == "ok"), F.col("_fv"))
    return rows.join(p, key, "left").join(f, key, "left").withColumns({"status": status, "payload": payload}).drop("_p", "_pv", "_f", "_fv")


def geocode_key(name: Column, city: Column, postcode: Column) -> Column:
    """The cache key of a street's geocode, at most 400 characters."""
    return F.substring(fold_key(lookup_query(name, city, postcode)), 1, 400)


def line_requests(rows: DataFrame, seq: str = "seq") -> DataFrame:
    """Requests (``id``, ``name``) with a usable name, the last of each id: the id itself or, where it is blank, the name key."""
    key = fold_key(F.col("name"))
    usable = rows.withColumn("name_key", key).where("name_key <> ''")
    rest = [c for c in usable.columns if c != "id"]
    keyed = usable.withColumn("result_key", F.coalesce(F.nullif(trim(F.coalesce("id", F.lit(""))), F.lit("")), F.col("name_key")))
    return keyed.groupBy("result_key").agg(F.max_by(F.struct(*rest), F.col(seq)).alias("r")).select("result_key", "r.*")


def ways_in(requests: DataFrame, ways: DataFrame, place: str = "place") -> DataFrame:
    """``place, key, seq, name, line``: named ways (``seq``, ``type``, ``name``, ``line``) that a place asks for, by name key and box.

    ``requests``: place, name and box (bounds) of each street. Names meet by their keys in one equi-join for all places; a way of
    under two points, without a name, or whose box does not meet the request's is not found. A name asked for twice is asked for once.
    """
    wanted = requests.select(place, fold_key(F.col("name")).alias("key"), F.col("box").alias("_box")).where("key <> ''").dropDuplicates([place, "key"])
    ok = ways.where((F.col("type") == "way") & (F.size("line") >= 2)).select("seq", trim(F.coalesce("name", F.lit(""))).alias("name"), "line")
    ok = ok.withColumn("key", fold_key(F.col("name"))).withColumn("_way", street_bounds(F.array("line"), F.lit(None).cast("struct<lat:double,lng:double>")))
    a, b = F.col("_box"), F.col("_way")
    meets = (a["west"] <= b["east"]) & (b["west"] <= a["east"]) & (a["south"] <= b["north"]) & (b["south"] <= a["north"])
    return wanted.join(ok, "key").where(meets).select(place, "key", "seq", "name", "line")


def unseen(rows: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """Rows whose key was not visited yet."""
    return rows.join(seen.select(key), key, "left_anti")


def allowed_requests(requests: DataFrame, policies: DataFrame, max_key: int = 64 * 1024) -> DataFrame:
    """``requests`` (provider, key, url, method) with ``allowed``: known provider, key of 1 to ``max_key``, https without
    user data, origin and method on the provider's lists."""
    url = F.col("url")
    host = F.try_parse_url(url, F.lit("AUTHORITY"))
    origin = F.lower(F.concat(F.try_parse_url(url, F.lit("PROTOCOL")), F.lit("://"), F.regexp_replace(host, ":443$", "")))
    size = F.length("key")
    ok = (size > 0) & (size <= max_key) & (F.lower(F.try_parse_url(url, F.lit("PROTOCOL"))) == "https") & ~F.contains(host, F.lit("@")) & F.array_contains("origins", origin) & F.array_contains("methods", F.upper("method"))
    return requests.join(policies.select("provider", "origins", "methods"), "provider", "left").withColumn("allowed", F.coalesce(ok, F.lit(False))).drop("origins", "methods")


def parameter_faults(parameters: DataFrame, allowed: list[str]) -> DataFrame:
    """The first parameter of each request (``request_id``, ``pos``, ``name``) that is unknown or given twice."""
    again = parameters.groupBy("request_id", "name").agg(F.min("pos").alias("pos"), F.count("*").alias("n"))
    bad = again.where(~F.col("name").isin(*allowed) | (F.col("n") > 1))
    return bad.groupBy("request_id").agg(F.min_by("name", "pos").alias("fault"))
