"""Bounds, distances and polygons as column expressions.

Bounds are structs of south, west, north, east; points are structs of lat, lng; rings are arrays of [lng, lat].
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridlume.functions.scalars import fixed, js_number, let
from gridlume.functions.text import trim

EARTH_RADIUS = 6_371_000.0
SIDES = ("south", "west", "north", "east")
MAX_SPAN, MAX_AREA = 1.0, 0.35


def bounds(south: Column, west: Column, north: Column, east: Column) -> Column:
    return F.struct(south.alias("south"), west.alias("west"), north.alias("north"), east.alias("east"))


def center(b: Column) -> Column:
    return F.struct(((b["south"] + b["north"]) / 2).alias("lat"), ((b["west"] + b["east"]) / 2).alias("lng"))


def height(b: Column) -> Column:
    return b["north"] - b["south"]


def width(b: Column) -> Column:
    return b["east"] - b["west"]


def area(b: Column) -> Column:
    return height(b) * width(b)


def _clamp(c: Column, most: float) -> Column:
    return F.greatest(F.lit(-most), F.least(F.lit(most), c))


def padded(b: Column, ratio: float) -> Column:
    """Grown by a share of its size on each side and clamped to the globe; no ratio, no change."""
    if ratio <= 0:
        return b
    return bounds(_clamp(b["south"] - height(b) * ratio, 90.0), _clamp(b["west"] - width(b) * ratio, 180.0), _clamp(b["north"] + height(b) * ratio, 90.0), _clamp(b["east"] + width(b) * ratio, 180.0))


def snapped(b: Column, grid: float, clamp: bool = True) -> Column:
    """Moved outward to a grid, so that nearly equal boxes share a key."""
    if grid <= 0:
        return b
    g = F.lit(float(grid))
    down, up = (lambda c: F.floor(c / g) * g), (lambda c: F.ceil(c / g) * g)
    out = [down(b["south"]), down(b["west"]), up(b["north"]), up(b["east"])]
    return bounds(*[_clamp(c, m) for c, m in zip(out, (90.0, 180.0, 90.0, 180.0), strict=True)] if clamp else out)


def bounds_key(b: Column, digits: int = 4) -> Column:
    """The four sides in fixed decimals, comma-joined."""
    return F.concat_ws(",", *[fixed(b[s], digits) for s in SIDES])


def cell(c: Column, grid: float) -> Column:
    """The whole-number cell of a coordinate, for equi-joins."""
    return F.floor(c / F.lit(float(grid))).cast("long")


def ring(b: Column) -> Column:
    """The closed five-vertex outline."""
    corner = lambda x, y: F.array(b[x], b[y])
    return F.array(corner("west", "south"), corner("east", "south"), corner("east", "north"), corner("west", "north"), corner("west", "south"))


def within_limits(b: Column) -> Column:
    """Positive height and width of at most one degree, and at most 0.35 square degrees."""
    h, w = height(b), width(b)
    return (h > 0) & (w > 0) & (h <= MAX_SPAN) & (w <= MAX_SPAN) & (h * w <= MAX_AREA)


def contains(outer: Column, inner: Column, epsilon: float = 1e-9) -> Column:
    e = F.lit(epsilon)
    return (outer["south"] <= inner["south"] + e) & (outer["west"] <= inner["west"] + e) & (outer["north"] >= inner["north"] - e) & (outer["east"] >= inner["east"] - e)


def parse_bounds(values: dict[str, Column]) -> Column:
    """``struct<present, error, bounds>`` from four texts: all missing is absent; the first fault in a fixed order is reported.

    South and north are swapped if need be; boxes over the antimeridian, beyond the globe or without area are errors.
    """
    number = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$|^0[xX][0-9a-fA-F]+$|^0[oO][0-7]+$|^0[bB][01]+$"
    # The texts of the faults below, in their order.
    read = [F.struct(values[s].alias("raw"), js_number(values[s]).alias("number"), F.rlike(trim(values[s]), F.lit(number)).alias("readable"), trim(values[s]).try_cast("double").alias("plain")).alias(s) for s in SIDES]

    def check(v: Column) -> Column:
        some = v["south"]["raw"].isNotNull()
        for s in SIDES[1:]:
            some = some | v[s]["raw"].isNotNull()
        missing = [F.when(v[s]["raw"].isNull(), F.lit(f"missing {s}")) for s in SIDES]
        # what can't be read is 0 as a number, but no coordinate; nor is an overflow
        good = lambda s: v[s]["readable"] & (F.coalesce(F.abs(v[s]["plain"]), F.lit(0.0)) < float("inf"))
        invalid = [F.when(~good(s), F.lit(f"invalid {s}")) for s in SIDES]
        south, north = F.least(v["south"]["number"], v["north"]["number"]), F.greatest(v["south"]["number"], v["north"]["number"])
        west, east = v["west"]["number"], v["east"]["number"]
        faults = [
            F.when(west > east, F.lit("bounds crossing the antimeridian are not supported")),
            F.when((south < -90) | (south > 90), F.lit("south must be between -90 and 90")),
            F.when((north < -90) | (north > 90), F.lit("north must be between -90 and 90")),
            F.when((west < -180) | (west > 180), F.lit("west must be between -180 and 180")),
            F.when((east < -180) | (east > 180), F.lit("east must be between -180 and 180")),
            F.when((north - south <= 0) | (east - west <= 0), F.lit("bounds must have a positive area")),
        ]
        error = F.when(some, F.coalesce(*missing, *invalid, *faults))
        return F.struct(some.alias("present"), error.alias("error"), bounds(south, west, north, east).alias("box"))

    done = let(F.struct(*read), check)
    return let(done, lambda r: F.struct(r["present"].alias("present"), r["error"].alias("error"), F.when(r["present"] & r["error"].isNull(), r["box"]).alias("bounds")))


def _lng_meters(delta: Column, latitude: Column) -> Column:
    return delta * F.lit(math.pi) * F.lit(EARTH_RADIUS) * F.cos(latitude * F.lit(math.pi) / F.lit(180.0)) / F.lit(180.0)


def _lat_meters(delta: Column) -> Column:
    return delta * F.lit(math.pi) * F.lit(EARTH_RADIUS) / F.lit(180.0)


def point_distance(a: Column, b: Column) -> Column:
    """Meters on a plane that is stretched by the mean latitude."""
    return F.hypot(_lng_meters(a["lng"] - b["lng"], (a["lat"] + b["lat"]) / 2), _lat_meters(a["lat"] - b["lat"]))


def segment_distance(p: Column, a: Column, b: Column) -> Column:
    """Meters from a point to a segment on a plane that is stretched by the point's latitude."""
    at = lambda q: (_lng_meters(q["lng"], p["lat"]), _lat_meters(q["lat"]))
    (px, py), (ax, ay), (bx, by) = at(p), at(a), at(b)
    dx, dy = bx - ax, by - ay
    square = dx * dx + dy * dy
    t = F.when(square == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - ax) * dx + (py - ay) * dy) / F.nullif(square, F.lit(0.0)))))
    return F.hypot(px - (ax + t * dx), py - (ay + t * dy))


def line_distance(line: Column, p: Column) -> Column:
    """Meters from a point to a polyline; to a lone vertex if it has one, null if it has none."""
    segments = F.transform(F.sequence(F.lit(0), F.size(line) - 2), lambda i: segment_distance(p, F.get(line, i), F.get(line, i + 1)))
    return F.when(F.size(line) > 1, F.array_min(segments)).when(F.size(line) == 1, point_distance(F.get(line, F.lit(0)), p))


def _usable(q: Column) -> Column:
    return F.coalesce((F.abs(F.get(q, F.lit(0))) < float("inf")) & (F.abs(F.get(q, F.lit(1))) < float("inf")), F.lit(False))


def point_in_ring(p: Column, r: Column) -> Column:
    """Even-odd rule over a ring of [lng, lat]; rings of under three vertices hold nothing, edges at bad vertices are skipped."""
    n = F.size(r)

    def crosses(i: Column) -> Column:
        here, before = F.get(r, i), F.get(r, F.pmod(i - 1 + n, n))
        lng, lat = (lambda q: F.get(q, F.lit(0))), (lambda q: F.get(q, F.lit(1)))
        spans = (lat(here) > p["lat"]) != (lat(before) > p["lat"])
        left = p["lng"] < (lng(before) - lng(here)) * (p["lat"] - lat(here)) / F.nullif(lat(before) - lat(here), F.lit(0.0)) + lng(here)
        return _usable(here) & _usable(before) & F.coalesce(spans & left, F.lit(False))

    count = F.size(F.filter(F.sequence(F.lit(0), n - 1), crosses))
    return F.when(n >= 3, count % 2 == 1).otherwise(F.lit(False))


def point_in_polygon(p: Column, rings: Column) -> Column:
    """Inside the first ring and in none of the others."""
    holes = F.slice(rings, 2, F.greatest(F.size(rings) - 1, F.lit(0)))
    return F.when(F.size(rings) > 0, point_in_ring(p, F.get(rings, F.lit(0))) & ~F.exists(holes, lambda h: point_in_ring(p, h))).otherwise(F.lit(False))


def point_in_multipolygon(p: Column, polygons: Column) -> Column:
    return F.exists(polygons, lambda rings: point_in_polygon(p, rings))


def sample_points(b: Column) -> Column:
    """The corners, edge middles and centre of a box."""
    mid = center(b)
    lats, lngs = (b["south"], mid["lat"], b["north"]), (b["west"], mid["lng"], b["east"])
    return F.array(*[F.struct(y.alias("lat"), x.alias("lng")) for y in lats for x in lngs])


def inside_contours(b: Column, polygons: Column) -> Column:
    """Whether each sample point of a box lies in some polygon; without polygons, no."""
    return F.when(F.size(polygons) > 0, F.forall(sample_points(b), lambda p: point_in_multipolygon(p, polygons))).otherwise(F.lit(False))


def coverage_contains(box: Column, polygons: Column, inner: Column) -> Column:
    """Whether an earlier answer covers a box: by its contours if it has any, else by its own box."""
    return F.when(F.size(polygons) > 0, inside_contours(inner, polygons)).otherwise(contains(box, inner))


def points_bounds(points: Column) -> Column:
    """The clamped box of an array of [lng, lat]; bad points are skipped; null without points or area."""
    good = F.filter(points, _usable)
    xs, ys = F.transform(good, lambda q: F.get(q, F.lit(0))), F.transform(good, lambda q: F.get(q, F.lit(1)))
    b = bounds(_clamp(F.array_min(ys), 90.0), _clamp(F.array_min(xs), 180.0), _clamp(F.array_max(ys), 90.0), _clamp(F.array_max(xs), 180.0))
    return F.when((F.size(good) > 0) & (height(b) > 0) & (width(b) > 0), b)


def geometry_bounds(polygons: Column) -> Column:
    """The box of polygons (arrays of rings of [lng, lat])."""
    return points_bounds(F.flatten(F.flatten(polygons)))


def street_bounds(lines: Column, point: Column) -> Column:
    """The box of a street's lines, else its point, else null."""
    flat = F.flatten(lines)
    lats, lngs = F.transform(flat, lambda q: q["lat"]), F.transform(flat, lambda q: q["lng"])
    return F.when(F.size(flat) > 0, bounds(F.array_min(lats), F.array_min(lngs), F.array_max(lats), F.array_max(lngs))).when(point.isNotNull(), bounds(point["lat"], point["lng"], point["lat"], point["lng"]))


def points_close(a: Column, b: Column, tolerance: float) -> Column:
    return (F.abs(a["lng"] - b["lng"]) <= tolerance) & (F.abs(a["lat"] - b["lat"]) <= tolerance)


def clean_line(line: Column, tolerance: float = 0.000001) -> Column:
    """Vertices without those close to the last one kept; bad vertices go first. A fold: ``lag`` would compare raw neighbours."""
    good = F.filter(line, lambda q: F.coalesce((F.abs(q["lat"]) < float("inf")) & (F.abs(q["lng"]) < float("inf")), F.lit(False)))

    def keep(acc: Column, q: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        return F.when(last.isNotNull() & points_close(last, q, tolerance), acc).otherwise(F.array_append(acc, q))

    return F.aggregate(good, F.slice(good, 1, 0), keep)
