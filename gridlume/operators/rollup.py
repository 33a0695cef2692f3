"""Mergeable incident and street facts.

Order matters in these roll-ups (first value wins, lists keep their order), so each takes a ``seq`` (a number, or a struct of
positions) and never relies on row order. Sums count duplicates; only lists are distinct. All aggregates have map-side partials: lists
are taken apart, each value's least place is found by key and value, and only a key's distinct values meet in its row. What is
the whole result in one row (all warnings, all polygons) is still gathered there.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from gridlume.functions.scalars import earliest, french_millis, latest
from gridlume.functions.text import parse_location, street_id


def sequence(rows: DataFrame, *order: str | Column, partition: str | Column) -> DataFrame:
    """``rows`` with ``seq``, their place in ``order`` within a partition."""
    return rows.withColumn("seq", F.row_number().over(W.partitionBy(partition).orderBy(*order)).cast("long"))


def first_by(value: str | Column, seq: Column) -> Column:
    """Aggregate: the value of least ``seq``, null or not."""
    value = F.col(value) if isinstance(value, str) else value
    return F.min_by(F.struct(value.alias("v")), seq)["v"]


def first_some(value: str | Column, seq: Column) -> Column:
    """Aggregate: the first value that isn't null."""
    value = F.col(value) if isinstance(value, str) else value
    return F.min_by(value, F.when(value.isNotNull(), seq))


def ordered_distinct(value: str | Column, seq: Column, keep_empty: bool = False) -> Column:
    """Aggregate: distinct values in order of first appearance, empty texts dropped unless kept.

    Pairs are collected as a set, so equal (place, value) pairs are gone before the shuffle.
    """
    value = F.col(value) if isinstance(value, str) else value
    some = value.isNotNull() if keep_empty else value.isNotNull() & (value != "")
    pairs = F.array_sort(F.collect_set(F.when(some, F.struct(seq.alias("s"), value.alias("v")))))
    return F.array_distinct(F.transform(pairs, lambda p: p["v"]))


def sorted_distinct(value: str | Column, keep_empty: bool = False) -> Column:
    """Aggregate: distinct values in binary order."""
    value = F.col(value) if isinstance(value, str) else value
    return F.array_sort(F.collect_set(value if keep_empty else F.nullif(value, F.lit(""))))


def ordered_lists(rows: DataFrame, key: list[str], lists: list[str], seq: Column) -> DataFrame:
    """``key, lists``: a key's distinct elements of each list column (all of one type), in order of ``seq`` and of place in the list.

    A repeated element is gone after a partial minimum by key and element, wherever it stands. Null and empty lists add nothing; a key with none
    but such has no row here.
    """
    own = [F.col(f"`{c}`") for c in key]
    each = rows.select(*own, seq.alias("_seq"), F.explode(F.array(*(F.struct(F.lit(i).alias("kind"), F.col(c).alias("list")) for i, c in enumerate(lists)))).alias("_l"))
    each = each.select(*own, "_seq", F.col("_l.kind").alias("_kind"), F.posexplode("_l.list").alias("_pos", "_value"))
    least = each.groupBy(*own, "_kind", "_value").agg(F.min(F.struct("_seq", "_pos")).alias("_at"))
    gathered = lambda i: F.array_sort(F.collect_list(F.when(F.col("_kind") == i, F.struct("_at", "_value"))))
    return least.groupBy(*own).agg(*(F.transform(gathered(i), lambda x: x["_value"]).alias(c) for i, c in enumerate(lists)))


def _with_lists(facts: DataFrame, lists: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """``facts`` with list columns of ``lists``, empty where a key has none; keys may be null."""
    named = lists.select(*(F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(key)), *(F.col(c).alias(f"_l{i}") for i, c in enumerate(columns)))
    same = reduce(lambda a, b: a & b, (F.col(f"`{c}`").eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(key)))
    kinds = dict(lists.dtypes)
    empty = lambda c: F.expr("array()").cast(kinds[c])
    return facts.join(named, same, "left").select(*(F.col(f"`{c}`") for c in facts.columns), *(F.coalesce(f"_l{i}", empty(c)).alias(c) for i, c in enumerate(columns)))


def incident_rollup(incidents: DataFrame, key: list[str], seq: str = "seq") -> DataFrame:
    """One row a key: first scalars, summed households, earliest start, latest restore, distinct (text, number) addresses.

    Rows are gone through once: they are put together by key and address, then by key, so scalars and lists need not be joined. A row's scalars
    go with its first address; dates are read once a row.
    """
    own, s = [F.col(f"`{c}`") for c in key], F.col(seq)
    names = [c for c in ("id", "status", "type", "electric_state", "place_code") if c in incidents.columns and c not in key]
    dated = lambda c, sign: F.when(F.col(c) != "", F.struct((sign * french_millis(F.col(c))).alias("ms"), s.alias("s"), F.col(c).alias("v")))
    rows = incidents.select(*own, s.alias("_seq"), F.when(s.isNotNull(), F.struct(s.alias("s"), *names)).alias("_first"), "households", dated("start", 1).alias("_start"), dated("restore", -1).alias("_restore"), "addresses")
    rows = rows.select(*own, "_seq", "_first", "households", "_start", "_restore", F.posexplode_outer("addresses").alias("_pos", "_value"))
    head = F.coalesce("_pos", F.lit(0)) == 0
    once = [f(F.when(head, F.col(c))).alias(c) for f, c in ((F.min, "_first"), (F.sum, "households"), (F.min, "_start"), (F.min, "_restore"))]
    least = rows.groupBy(*own, "_value").agg(F.min(F.when(F.col("_pos").isNotNull(), F.struct("_seq", "_pos"))).alias("_at"), *once)
    gathered = F.array_sort(F.collect_list(F.when(F.col("_at").isNotNull(), F.struct("_at", "_value"))))
    out = least.groupBy(*own).agg(F.min("_first").alias("_first"), F.sum("households").alias("households"), F.min("_start").alias("_start"), F.min("_restore").alias("_restore"), F.transform(gathered, lambda x: x["_value"]).alias("addresses"))
    text = lambda c: F.coalesce(F.col(f"_{c}")["v"], F.lit("")).alias(c)
    return out.select(*own, *(F.col("_first")[c].alias(c) for c in names), "households", text("start"), text("restore"), "addresses")


def street_rollup(addresses: DataFrame, seq: str = "seq", parsed: str | None = None) -> DataFrame:
    """One row a street of address rows (``location``, ``city``, ``id``, ``raw_type``, ``start``, ``restore``, ``households``)."""
    rows = addresses if parsed else addresses.withColumn("_p", parse_location(F.col("location"), F.col("city")))
    p, s = F.col(parsed or "_p"), F.col(seq)
    rows = rows.select(street_id(p).alias("key"), p.alias("p"), s.alias("s"), "location", "id", F.coalesce("raw_type", F.lit("Incident")).alias("type"), "start", "restore", "households")
    s = F.col("s")
    out = rows.groupBy("key").agg(
        F.min_by("p", s).alias("p"), ordered_distinct("location", s).alias("locations"), sorted_distinct("id").alias("incident_ids"), sorted_distinct("type").alias("types"),
        earliest(F.col("start"), s).alias("first_seen"), latest(F.col("restore"), s).alias("restore_at"), F.sum("households").alias("households"),
    )
    return out.select("key", "p.label", "p.name", "p.city", "p.postcode", *[c for c in out.columns if c not in ("key", "p")])


def counters(reports: DataFrame, addresses: DataFrame) -> DataFrame:
    """The one-row sums of the three counters and the number of address rows, duplicates counted."""
    from gridlume.functions.scalars import js_number

    data = F.col("report.resultMegacache")
    names = {"compteurIncidentHTA": "incidents", "compteurTravauxHTA": "works", "compteurBT": "low_voltage"}
    sums = reports.agg(*[F.sum(js_number(data[c])).alias(n) for c, n in names.items()]).withColumn("address_rows", F.lit(0).cast("long"))
    rows = addresses.agg(F.count("*").alias("address_rows")).select(*[F.lit(0.0).alias(n) for n in names.values()], "address_rows")
    return sums.unionByName(rows).agg(*[F.sum(n).alias(n) for n in names.values()], F.sum("address_rows").alias("address_rows"))



def merge_streets(partials: DataFrame, *, seq: str = "seq", sort_lists: bool = False) -> DataFrame:
    """Final roll-up of street facts from pages: sums, date limits, list unions, the first geocode and geometry there are.

    ``sort_lists``: the browser's rule, under which keys that really merged get sorted lists with empty texts kept, and
    keys of a single page keep theirs; else the server's, which keeps order and drops empty texts.
    """
    s, names = F.col(seq), ["locations", "incident_ids", "types"]
    extra = [first_some(c, s).alias(c) for c in ("geocode", "geometry") if c in partials.columns]
    scalars = [first_by(c, s).alias(c) for c in ("label", "name", "city", "postcode")]
    facts = partials.groupBy("key").agg(*scalars, F.count("*").alias("_pages"), earliest(F.col("first_seen"), s).alias("first_seen"), latest(F.col("restore_at"), s).alias("restore_at"), F.sum("households").alias("households"), *extra)
    found = _with_lists(facts, ordered_lists(partials, ["key"], names, s), ["key"], names)
    final = lambda c: F.when(F.col("_pages") > 1, F.array_sort(c)).otherwise(F.col(c)) if sort_lists else F.filter(c, lambda v: v != "")
    order = ["key", "label", "name", "city", "postcode", *names, "first_seen", "restore_at", "households"]
    return found.select(*(final(c).alias(c) if c in names else F.col(c) for c in order), *(F.col(c) for c in ("geocode", "geometry") if c in partials.columns))


def merge_incidents(partials: DataFrame, seq: str = "seq") -> DataFrame:
    """Final roll-up of incident facts by place code, id and start (not the ingest key)."""
    keyed = partials.withColumn("merge_key", F.concat_ws(":", "place_code", "id", "start"))
    return incident_rollup(keyed, ["merge_key"], seq)


def merge_headers(pages: DataFrame, seq: str = "seq", distinct_warnings: bool = True) -> DataFrame:
    """The one-row header of merged pages: summed counters, greatest update time, first recap and crises, warnings.

    The cursor comes from the last page, viewport and total from the first. No pages give one row of nulls and zeros.
    ``distinct_warnings``: the browser's rule, each warning once; else the server's, all pages' lists one after another.
    """
    s = F.col(seq)
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("address_rows", "incidents", "works", "low_voltage") if c in pages.columns]
    firsts = [first_some(c, s).alias(c) for c in ("recap", "crises") if c in pages.columns] + [first_by(c, s).alias(c) for c in ("viewport", "place_total") if c in pages.columns]
    lasts = [F.max_by(F.struct(F.col(c).alias("v")), s)["v"].alias(c) for c in ("next_cursor",) if c in pages.columns]
    own = [_flat_kept(F.col("warnings"), s).alias("warnings")] if "warnings" in pages.columns and not distinct_warnings else []
    out = pages.agg(F.max("updated_at").alias("updated_at"), *sums, *firsts, *lasts, *own)
    if "warnings" not in pages.columns or own:
        return out
    # two single rows as one: of each column, one of them has a value at most
    once = ordered_lists(pages, [], ["warnings"], s)
    both = out.unionByName(once, allowMissingColumns=True)
    row = both.agg(*(F.max_by(c, F.col(c).isNotNull()).alias(c) for c in both.columns))
    return row.withColumn("warnings", F.coalesce("warnings", F.expr("array()").cast(dict(pages.dtypes)["warnings"])))


def distinct_first(rows: DataFrame, key: list[str], seq: str = "seq") -> DataFrame:
    """The first row of each key."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.min_by(F.struct(*rest), F.col(seq)).alias("r")).select(*key, "r.*")


def distinct_last(rows: DataFrame, key: list[str], seq: str = "seq", keep_place: bool = False) -> DataFrame:
    """The last row of each key; with ``keep_place`` its ``seq`` is that of the key's first row."""
    rest = [c for c in rows.columns if c not in key and not (keep_place and c == seq)]
    place = [F.min(seq).alias(seq)] if keep_place else []
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.col(seq)).alias("r"), *place).select(*key, "r.*", *([seq] if keep_place else []))


def refresh_stats(streets: DataFrame) -> DataFrame:
    """Street counts by lookup outcome; flags ``geocode_present`` and ``geometry_present`` tell null (a miss) from absent."""
    ok_point, ok_lines = F.col("geocode.status") == "ok", (F.col("geometry.status") == "ok") & (F.size("geometry.lines") > 0)
    here = lambda c: F.col(f"{c}_present") if f"{c}_present" in streets.columns else F.col(c).isNotNull()
    yes = lambda c: F.coalesce(c, F.lit(False))
    return streets.agg(F.count("*").alias("streets"), F.count_if(yes(ok_point)).alias("geocoded"), F.count_if(here("geocode") & ~yes(ok_point)).alias("geocode_misses"), F.count_if(yes(ok_lines)).alias("with_lines"), F.count_if(here("geometry") & ~yes(ok_lines)).alias("line_misses"))


def facet_counts(streets: DataFrame, facets: dict[str, str], types: str = "types") -> DataFrame:
    """One row of overlapping counts: all rows, and those whose list holds each facet's value."""
    return streets.agg(F.count("*").alias("all"), *[F.count_if(F.array_contains(types, v)).alias(n) for n, v in facets.items()])


def cache_outcomes(results: DataFrame, outcome: str = "outcome") -> DataFrame:
    """Hits, stale reads and misses; failures (null) are misses."""
    o = F.col(outcome)
    return results.agg(F.count_if(o == "HIT").alias("hits"), F.count_if(o == "STALE").alias("stale"), F.count_if(F.coalesce(o, F.lit("MISS")) == "MISS").alias("misses"))


def group_lines(ways: DataFrame) -> DataFrame:
    """Named ways (``seq``, ``type``, ``name``, ``line``) by name key: distinct names in language-aware order and all lines in order."""
    from gridlume.functions.scalars import locale_sorted
    from gridlume.functions.text import fold_key, trim

    ok = ways.where((F.col("type") == "way") & (F.size("line") >= 2)).select("seq", trim(F.coalesce("name", F.lit(""))).alias("name"), "line")
    ok = ok.withColumn("key", fold_key(F.col("name"))).where("key <> ''")
    return ok.groupBy("key").agg(locale_sorted(F.collect_set("name")).alias("names"), F.transform(F.array_sort(F.collect_list(F.struct("seq", "line"))), lambda x: x["line"]).alias("lines"))


def union_distinct(*lists: Column) -> Column:
    """The elements of several lists, each once, in order of first appearance."""
    return F.array_distinct(F.concat(*lists))


def combine_polygons(rows: DataFrame, polygon: str = "polygon", seq: str = "seq", strict: bool = True) -> DataFrame:
    """GeoJSON texts as one: none is null, one stays as it is, several become a collection of their features.

    Texts that are no GeoJSON are dropped: by declared kind if ``strict``, else by having a type at all.
    """
    p = F.col(polygon)
    kind = F.get_json_object(p, "$.type")
    ok = kind.isin("Polygon", "MultiPolygon", "Feature", "FeatureCollection") if strict else kind.isNotNull()
    inner = F.from_json(F.get_json_object(p, "$.features"), "array<string>")
    features = F.when((kind == "FeatureCollection") & inner.isNotNull(), inner).when(kind == "Feature", F.array(p)).otherwise(F.array(F.concat(F.lit('{"type":"Feature","geometry":'), p, F.lit(',"properties":{}}'))))
    found = rows.where(ok).agg(F.count("*").alias("n"), F.min_by(p, F.col(seq)).alias("one"), _flat_kept(features, F.col(seq)).alias("all"))
    return found.select(F.when(F.col("n") == 1, F.col("one")).when(F.col("n") > 1, F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join("all", ","), F.lit("]}"))).alias("polygon"))


def _flat_kept(lists: Column, seq: Column) -> Column:
    return F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(seq.alias("s"), lists.alias("v")))), lambda p: p["v"]))
