"""Filters, facets and map features of streets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlume.functions.geo import points_bounds

# Colour of a street by its gravest kind of incident.
COLOURS = (("Incident HTA", "#e45245"), ("Incident BT", "#e98a19"))
OTHER_COLOUR = "#087d70"


def street_filter(streets: DataFrame, facet: str = "all", query: str = "") -> DataFrame:
    """Streets of a facet (``all`` or a type) whose label, place, types or locations hold the query, in any case."""
    out = streets if facet == "all" else streets.where(F.array_contains("types", facet))
    wanted = query.strip().lower()
    text = F.lower(F.concat_ws(" ", "label", "postcode", "city", "types", "locations"))
    return out.where(F.contains(text, F.lit(wanted))) if wanted else out


def feature_style(types: Column, incident_ids: Column) -> Column:
    """``struct<color, radius, line_width>``: colour by exact type, sizes by the number of incidents (at least one)."""
    colour = F.lit(OTHER_COLOUR)
    for kind, value in reversed(COLOURS):
        colour = F.when(F.array_contains(types, kind), value).otherwise(colour)
    n = F.greatest(F.size(incident_ids), F.lit(1)).cast("double")
    return F.struct(colour.alias("color"), F.least(F.lit(13.0), 7.0 + n * 1.5).alias("radius"), F.least(F.lit(6.6), 4.2 + F.least(F.lit(1.2), (n - 1) * 0.35)).alias("line_width"))


def tone(types: Column) -> Column:
    """``hta``, ``bt`` or ``other`` by what the types' names hold."""
    holds = lambda s: F.exists(types, lambda t: F.contains(t, F.lit(s)))
    return F.when(holds("HTA"), "hta").when(holds("BT"), "bt").otherwise("other")


def tag(kind: Column) -> Column:
    """``struct<class, text>`` of one type."""
    holds = lambda s: F.contains(kind, F.lit(s))
    return F.struct(F.when(holds("HTA"), "hta").when(holds("BT"), "bt").otherwise("other").alias("class"), F.regexp_replace(kind, "^(.*?)Incident ", "$1").alias("text"))


def geojson_features(streets: DataFrame, active_key: str = "") -> DataFrame:
    """``key, feature``: a MultiLineString where there are lines (``lines``: arrays of [lng, lat]), else a Point, else no row."""
    style = feature_style(F.col("types"), F.col("incident_ids"))
    properties = F.struct(F.col("key"), F.col("label"), style["color"].alias("color"), style["line_width"].alias("lineWidth"), style["radius"].alias("radius"), (F.col("key") == active_key).alias("selected"))
    head = {"type": F.lit("Feature"), "id": F.col("key"), "properties": properties}
    build = lambda kind, coordinates: F.to_json(F.struct(*[v.alias(k) for k, v in head.items()], F.struct(F.lit(kind).alias("type"), coordinates.alias("coordinates")).alias("geometry")))
    has_lines, has_point = F.coalesce(F.size("lines") > 0, F.lit(False)), F.coalesce(F.col("geocode.status") == "ok", F.lit(False))
    feature = F.when(has_lines, build("MultiLineString", F.col("lines"))).when(has_point, build("Point", F.array("geocode.lng", "geocode.lat")))
    return streets.select("key", feature.alias("feature")).where("feature is not null")


def feature_collection(features: DataFrame, order: str = "key") -> DataFrame:
    """All features as one GeoJSON text; for a page of streets, not for a corpus."""
    return features.agg(F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "feature"))), lambda x: x["feature"]), ","), F.lit("]}")).alias("collection"))


_POLYGON, _MULTI = "array<array<array<double>>>", "array<array<array<array<double>>>>"


def area_features(collections: DataFrame, text: str = "text", key: str = "key") -> DataFrame:
    """``key, pos, properties, polygons`` of GeoJSON area collections; a collection with one bad feature, down to a single number, gives nothing at all."""
    whole = F.from_json(F.col(text), "struct<type string, features array<string>>")
    rows = collections.select(key, whole.alias("c")).where("c.type = 'FeatureCollection' and c.features is not null")
    each = rows.select(key, F.posexplode_outer("c.features").alias("pos", "f"))
    kind = F.get_json_object("f", "$.geometry.type")
    raw = F.get_json_object("f", "$.geometry.coordinates")
    one, many = F.from_json(raw, _POLYGON), F.from_json(raw, _MULTI)
    polygons = F.when(kind == "Polygon", F.array(one)).when(kind == "MultiPolygon", many)

    def sound(polygon: Column) -> Column:
        """Every ring is one, every position of it, and every number of that."""
        real = lambda a, test: F.coalesce(F.forall(a, test), F.lit(False))
        return real(polygon, lambda ring: real(ring, lambda at: real(at, lambda v: v.isNotNull())))

    deep = F.when(kind == "Polygon", sound(one)).otherwise(F.coalesce(F.forall(many, sound), F.lit(False)))
    good = (F.get_json_object("f", "$.type") == "Feature") & polygons.isNotNull() & deep
    properties = F.get_json_object("f", "$.properties")
    each = each.select(key, "pos", F.when(F.rlike(properties, F.lit(r"^\{")), properties).otherwise(F.lit("{}")).alias("properties"), polygons.alias("polygons"), (F.col("pos").isNull() | F.coalesce(good, F.lit(False))).alias("good"))
    bad = each.where("not good").select(key).distinct()
    return each.where("pos is not null").join(bad, key, "left_anti").drop("good")


def layers(features: DataFrame) -> DataFrame:
    """``features`` with the drawing layer of their geometry: areas, lines or points."""
    kind = F.get_json_object("feature", "$.geometry.type")
    return features.withColumn("layer", F.when(kind.isin("Polygon", "MultiPolygon"), "areas").when(kind.isin("LineString", "MultiLineString"), "lines").when(kind == "Point", "points"))


def box_of_lines(lines: Column) -> Column:
    """The box of arrays of [lng, lat]."""
    return points_bounds(F.flatten(lines))


def headline(incidents: Column, works: Column) -> Column:
    """Medium-voltage incidents and works as one number."""
    return F.coalesce(incidents, F.lit(0)) + F.coalesce(works, F.lit(0))

