"""Queries over bounds, polygons, segments and polylines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlume.functions import geo as G
from gridlume.operators import cover, spatial
from gridlume.sources import landing
from gridlume.sources.landing import tables


def _boxes(spark: SparkSession, d: str) -> DataFrame:
    c = tables(spark, d, "customer")[0]
    k = F.col("c_custkey")
    return c.select(k.alias("id"), G.bounds(47 + k * 37 % 1999 / 1000.0, 1 + k * 53 % 2003 / 1000.0, 47 + k * 37 % 1999 / 1000.0 + (k % 11) / 20.0, 1 + k * 53 % 2003 / 1000.0 + (k % 7 - 1) / 20.0).alias("b"))


_BOX = "(select c_custkey as id, 47 + c_custkey * 37 % 1999 / 1000.0::double as s, 1 + c_custkey * 53 % 2003 / 1000.0::double as w, 47 + c_custkey * 37 % 1999 / 1000.0::double + (c_custkey % 11) / 20.0::double as n, 1 + c_custkey * 53 % 2003 / 1000.0::double + (c_custkey % 7 - 1) / 20.0::double as e from customer)"


def snap_pad(spark: SparkSession, d: str) -> DataFrame:
    p = G.snapped(G.padded(F.col("b"), 0.08), 0.005)
    rows = _boxes(spark, d).select("id", p.alias("p"), G.bounds_key(G.snapped(F.col("b"), 0.01, clamp=False)).alias("key"), G.cell(F.col("b.west"), 0.01).alias("cell"))
    return rows.select("id", "key", "cell", *[F.round(F.col(f"p.{s}"), 9).alias(s) for s in G.SIDES])


SNAP_PAD = f"""
with p as (select *, n - s as h, e - w as x from {_BOX})
select id, printf('%.4f', floor(s / 0.01::double) * 0.01::double) || ',' || printf('%.4f', floor(w / 0.01::double) * 0.01::double) || ',' || printf('%.4f', ceil(n / 0.01::double) * 0.01::double) || ',' || printf('%.4f', ceil(e / 0.01::double) * 0.01::double) as key, floor(w / 0.01::double)::bigint as cell,
  round(floor((s - h * 0.08::double) / 0.005::double) * 0.005::double, 9) as south, round(floor((w - x * 0.08::double) / 0.005::double) * 0.005::double, 9) as west, round(ceil((n + h * 0.08::double) / 0.005::double) * 0.005::double, 9) as north, round(ceil((e + x * 0.08::double) / 0.005::double) * 0.005::double, 9) as east from p
"""


def viewport_limits(spark: SparkSession, d: str) -> DataFrame:
    big = G.bounds(F.col("b.south"), F.col("b.west"), F.col("b.north") + (F.col("id") % 13) / 10.0, F.col("b.east") + (F.col("id") % 5) / 10.0)
    c = G.center(F.col("b"))
    return _boxes(spark, d).select("id", G.within_limits(big).alias("ok"), G.contains(big, F.col("b")).alias("inside"), F.round(G.area(F.col("b")), 9).alias("area"), F.round(c["lat"], 9).alias("lat"), F.round(c["lng"], 9).alias("lng"), F.size(G.ring(F.col("b"))).alias("ring"))


VIEWPORT_LIMITS = f"""
with b as (select *, n + (id % 13) / 10.0::double as n2, e + (id % 5) / 10.0::double as e2 from {_BOX})
select id, n2 - s > 0 and e2 - w > 0 and n2 - s <= 1 and e2 - w <= 1 and (n2 - s) * (e2 - w) <= 0.35::double as ok, true as inside, round((n - s) * (e - w), 9) as area, round((s + n) / 2, 9) as lat, round((w + e) / 2, 9) as lng, 5 as ring from b
"""


def bounds_validate(spark: SparkSession, d: str) -> DataFrame:
    e = tables(spark, d, "events")[0]
    k = F.col("event_id")
    value = {"south": F.when(k % 9 == 0, F.lit(None).cast("string")).when(k % 10 == 1, "48oops").otherwise((k % 200 - 100).cast("string")), "west": F.when(k % 9 == 0, F.lit(None).cast("string")).when(k % 14 == 3, " ").otherwise(F.concat(F.lit(" "), (k % 400 - 200).cast("string"))), "north": F.when((k % 9 == 0) | (k % 15 == 2), F.lit(None).cast("string")).otherwise((k % 160 - 80).cast("string")), "east": F.when(k % 9 == 0, F.lit(None).cast("string")).otherwise((k % 390 - 195).cast("string"))}
    return e.select("event_id", G.parse_bounds(value).alias("p")).select("event_id", "p.present", "p.error", "p.bounds.south", "p.bounds.west", "p.bounds.north", "p.bounds.east")


BOUNDS_VALIDATE = """
with v as (select event_id as k, event_id % 9 > 0 as present, event_id % 200 - 100 as s0, event_id % 400 - 200 as w, event_id % 160 - 80 as n0, event_id % 390 - 195 as e from events),
f as (select *, least(s0, n0) as s, greatest(s0, n0) as n from v),
g as (select *, case when not present then null when k % 15 = 2 then 'missing north' when k % 10 = 1 then 'invalid south' when k % 14 = 3 then 'invalid west' when w > e then 'bounds crossing the antimeridian are not supported'
  when s < -90 or s > 90 then 'south must be between -90 and 90' when n < -90 or n > 90 then 'north must be between -90 and 90' when w < -180 or w > 180 then 'west must be between -180 and 180' when e < -180 or e > 180 then 'east must be between -180 and 180'
  when n - s <= 0 or e - w <= 0 then 'bounds must have a positive area' end as error from f)
select k as event_id, present, error, case when present and error is null then s::double end as south, case when present and error is null then w::double end as west, case when present and error is null then n::double end as north, case when present and error is null then e::double end as east from g
"""


def _tracks(spark: SparkSession, d: str) -> DataFrame:
    """Embeddings as tracks of 32 points."""
    e = tables(spark, d, "embeddings")[0]
    pts = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.array(F.get("embedding", i * 2).cast("double"), F.get("embedding", i * 2 + 1).cast("double")))
    return e.select("vec_id", pts.alias("pts"))


def bbox_agg(spark: SparkSession, d: str) -> DataFrame:
    b = G.geometry_bounds(F.array(F.array(F.col("pts"))))
    return _tracks(spark, d).select("vec_id", b.alias("b")).select("vec_id", "b.*")


BBOX_AGG = "with p as (select vec_id, unnest(range(32)) as i, embedding from embeddings), q as (select vec_id, embedding[2 * i + 1]::double as x, embedding[2 * i + 2]::double as y from p) select vec_id, min(y) as south, min(x) as west, max(y) as north, max(x) as east from q group by 1"


def _plots(spark: SparkSession, d: str, step: int) -> DataFrame:
    """Boxes of many sizes: most of some hundredths of a degree, a few of one or two degrees, some without any extent."""
    c = tables(spark, d, "customer")[0]
    k = F.col("c_custkey") + step
    south, west = 47 + k * 37 % 1999 / 1000.0, 1 + k * 53 % 2003 / 1000.0
    size = F.when(k % 499 == 0, 2.0).when(k % 97 == 0, 0.5).otherwise((k % 7) / 200.0)
    return c.select(F.col("c_custkey").alias("id"), G.bounds(south, west, south + size, west + size * 0.75).alias("b"))


def _plots_sql(step: int) -> str:
    k = f"(c_custkey + {step})"
    size = f"(case when {k} % 499 = 0 then 2.0::double when {k} % 97 = 0 then 0.5::double else ({k} % 7) / 200.0::double end)"
    s, w = f"(47 + {k} * 37 % 1999 / 1000.0::double)", f"(1 + {k} * 53 % 2003 / 1000.0::double)"
    return f"(select c_custkey as id, {s} as s, {w} as w, {s} + {size} as n, {w} + {size} * 0.75::double as e from customer)"


def bbox_join(spark: SparkSession, d: str) -> DataFrame:
    left = _plots(spark, d, 0).select(F.col("id").alias("a"), F.col("b").alias("ab"))
    right = _plots(spark, d, 250).select(F.col("id").alias("z"), F.col("b").alias("zb"))
    return spatial.bbox_join(left, right, "ab", "zb", "a", "z", 0.03)


BBOX_JOIN = f"select p.id as a, q.id as z from {_plots_sql(0)} p join {_plots_sql(250)} q on p.w <= q.e and q.w <= p.e and p.s <= q.n and q.s <= p.n"

_RINGS = [[[1.0, 47.2], [2.6, 47.0], [2.9, 48.6], [1.7, 48.9], [1.0, 47.2]], [[1.6, 47.6], [2.2, 47.6], [2.2, 48.1], [1.6, 48.1]]]


def _literal(v) -> F.Column:
    return F.array(*map(_literal, v)) if isinstance(v, list) else F.lit(v)


def point_in_polygon(spark: SparkSession, d: str) -> DataFrame:
    p = F.struct(F.col("b.south").alias("lat"), F.col("b.west").alias("lng"))
    return _boxes(spark, d).select("id", G.point_in_polygon(p, _literal(_RINGS)).alias("inside"))


def _duck_ring(x: str, y: str, ring: list) -> str:
    edges = zip(ring, ring[-1:] + ring[:-1], strict=True)
    return "(" + " + ".join(f"(case when ({a[1]}::double > {y}) <> ({b[1]}::double > {y}) and {x} < ({b[0]}::double - {a[0]}::double) * ({y} - {a[1]}::double) / nullif({b[1]}::double - {a[1]}::double, 0) + {a[0]}::double then 1 else 0 end)" for a, b in edges) + ") % 2 = 1"


POINT_IN_POLYGON = f"select id, {_duck_ring('w', 's', _RINGS[0])} and not {_duck_ring('w', 's', _RINGS[1])} as inside from {_BOX}"


def coverage_forall(spark: SparkSession, d: str) -> DataFrame:
    boxes = _boxes(spark, d).select("id", F.col("b").alias("bounds"))
    contours = boxes.select(F.expr("case when id % 4 = 0 then -1 - id else id end").alias("id"), F.array(_literal(_RINGS)).alias("polygons"))
    both = spatial.covered_boxes(boxes, contours, "id").join(boxes.select("id", G.inside_contours(F.col("bounds"), F.array(_literal(_RINGS))).alias("direct"), G.coverage_contains(F.col("bounds"), F.expr("array()").cast("array<array<array<array<double>>>>"), F.col("bounds")).alias("own")), "id")
    return both


_PTS = [(x, y) for y in ("s", "(s + n) / 2", "n") for x in ("w", "(w + e) / 2", "e")]
_ALLIN = " and ".join(f"({_duck_ring(x, y, _RINGS[0])} and not {_duck_ring(x, y, _RINGS[1])})" for x, y in _PTS)
COVERAGE_FORALL = f"select id, id % 4 > 0 and {_ALLIN} as covered, {_ALLIN} as direct, true as own from {_BOX}"


def _shape(x, k) -> list:
    """A slanted outline with a hole, moved and stretched by k; ``x`` writes a number."""
    at = lambda a, b: x(a, k, b)
    return [[[at(1.0, 0.04), at(47.2, 0.0)], [at(1.9, 0.04), at(47.0, 0.03)], [at(2.2, 0.04), at(48.0, 0.0)], [at(1.3, 0.04), at(48.4, 0.02)]], [[at(1.5, 0.04), at(47.5, 0.0)], [at(1.7, 0.04), at(47.5, 0.0)], [at(1.7, 0.04), at(47.8, 0.0)], [at(1.5, 0.04), at(47.8, 0.0)]]]


def contour_search(spark: SparkSession, d: str) -> DataFrame:
    """All boxes against all outlines, without a key in common: outlines around each box, and whether they cover it."""
    n = tables(spark, d, "nation")[0].select(F.col("n_nationkey").alias("contour"))
    rings = F.array(*(F.array(*(F.array(*p) for p in ring)) for ring in _shape(lambda a, k, b: F.lit(a) + k * F.lit(b), F.col("contour"))))
    # few bytes but much work a row: dealt to all cores, not by the file's splits
    boxes = _boxes(spark, d).select("id", F.col("b").alias("bounds")).repartition(2 * spark.sparkContext.defaultParallelism, "id")
    return cover.boxes_in_contours(boxes, n.select("contour", F.array(rings).alias("polygons")), "id", "contour")


_SHAPE = _shape(lambda a, k, b: f"({a}::double + {k} * {b}::double)", "k")
_HELD = ", ".join(f"({_duck_ring(x, y, _SHAPE[0])} and not {_duck_ring(x, y, _SHAPE[1])}) as h{i}" for i, (x, y) in enumerate(_PTS))
CONTOUR_SEARCH = f"""
with h as (select id, k, {_HELD} from {_BOX}, (select n_nationkey as k from nation))
select id, count(*) filter ({" or ".join(f"h{i}" for i in range(9))}) as contours, {" and ".join(f"bool_or(h{i})" for i in range(9))} as covered from h group by id
"""


def segment_distance(spark: SparkSession, d: str) -> DataFrame:
    b = F.col("b")
    p, a, z = F.struct(b["south"].alias("lat"), b["west"].alias("lng")), F.struct(F.lit(48.0).alias("lat"), F.lit(2.0).alias("lng")), F.struct(F.lit(48.1).alias("lat"), F.lit(2.2).alias("lng"))
    return _boxes(spark, d).select("id", F.round(G.segment_distance(p, a, z), 3).alias("to_segment"), F.round(G.point_distance(p, a), 3).alias("to_point"), F.round(G.segment_distance(p, a, a), 3).alias("to_same"))


_LM = "pi() * 6371000.0::double / 180.0::double"
SEGMENT_DISTANCE = f"""
with q as (select id, s, w, cos(s * pi() / 180) as c from {_BOX}),
m as (select id, s, w, w * {_LM} * c as px, s * {_LM} as py, 2.0::double * {_LM} * c as ax, 48.0::double * {_LM} as ay, 2.2::double * {_LM} * c as zx, 48.1::double * {_LM} as zy from q),
t as (select *, greatest(0, least(1, ((px - ax) * (zx - ax) + (py - ay) * (zy - ay)) / ((zx - ax) * (zx - ax) + (zy - ay) * (zy - ay)))) as t from m)
select id, round(sqrt(pow(px - ax - t * (zx - ax), 2) + pow(py - ay - t * (zy - ay), 2)), 3) as to_segment, round(sqrt(pow((w - 2) * {_LM} * cos((s + 48) / 2 * pi() / 180), 2) + pow((s - 48) * {_LM}, 2)), 3) as to_point, round(sqrt(pow(px - ax, 2) + pow(py - ay, 2)), 3) as to_same from t
"""


def _segments(spark: SparkSession, d: str) -> DataFrame:
    """Short lines around one point for each nation: suppliers and customers of the nation, in steps of some 30 m."""
    c = tables(spark, d, "customer")[0]
    k = F.col("c_custkey")
    lat, lng = 48 + k % 40 * 0.0004, 2 + k % 9 * 0.0005
    line = F.array(F.struct(lat.alias("lat"), lng.alias("lng")), F.struct((lat + 0.0002).alias("lat"), (lng + 0.0003).alias("lng")))
    return c.select(F.col("c_nationkey").alias("key"), k.alias("idx"), line.alias("line"))


def nearest_component(spark: SparkSession, d: str) -> DataFrame:
    lines = _segments(spark, d)
    points = tables(spark, d, "nation")[0].select(F.col("n_nationkey").cast("int").alias("key"), F.struct(F.when(F.col("n_nationkey") % 6 == 0, 49.0).otherwise(48 + F.col("n_nationkey") * 0.0003).alias("lat"), F.lit(2.001).alias("lng")).alias("point"))
    out = spatial.nearest_components(lines.withColumn("key", F.col("key").cast("int")), points, "key")
    return out.select("key", "idx", "component", F.round("distance", 3).alias("distance"), "kept")


NEAREST_COMPONENT = f"""
with recursive c as (select c_nationkey::int as key, c_custkey as idx, 48 + c_custkey % 40 * 0.0004::double as y0, 2 + c_custkey % 9 * 0.0005::double as x0 from customer),
l as (select *, y0 + 0.0002::double as y1, x0 + 0.0003::double as x1 from c),
p as (select key, idx, unnest([y0, y1]) as y, unnest([x0, x1]) as x from l),
e as (select distinct a.key, a.idx as u, b.idx as v from p a join p b on a.key = b.key where sqrt(pow((a.x - b.x) * {_LM} * cos((a.y + b.y) / 2 * pi() / 180), 2) + pow((a.y - b.y) * {_LM}, 2)) <= 35),
r as (select key, idx as u, idx as v from l union select r.key, r.u, e.v from r join e on e.key = r.key and e.u = r.v),
comp as (select key, u as idx, min(v) as component from r group by 1, 2),
pt as (select n_nationkey::int as key, case when n_nationkey % 6 = 0 then 49.0::double else 48 + n_nationkey * 0.0003::double end as py, 2.001::double as px from nation),
m as (select l.key, idx, px * {_LM} * cos(py * pi() / 180) as px, py * {_LM} as py, x0 * {_LM} * cos(py * pi() / 180) as ax, y0 * {_LM} as ay, x1 * {_LM} * cos(py * pi() / 180) as zx, y1 * {_LM} as zy from l join pt using (key)),
t as (select *, greatest(0, least(1, ((px - ax) * (zx - ax) + (py - ay) * (zy - ay)) / ((zx - ax) * (zx - ax) + (zy - ay) * (zy - ay)))) as t from m),
d as (select key, idx, sqrt(pow(px - ax - t * (zx - ax), 2) + pow(py - ay - t * (zy - ay), 2)) as d from t),
by_ as (select key, component, min(d) as distance from comp join d using (key, idx) group by 1, 2),
best as (select key, min(distance) as closest from by_ group by 1)
select comp.key, comp.idx, component, round(distance, 3) as distance, closest <= 1800 and distance <= least(1800, closest + 350) as kept from comp join by_ using (key, component) join best on best.key = comp.key
"""


def large_key_components(spark: SparkSession, d: str) -> DataFrame:
    """Components where all segments are one key's, dealt by place: the way that keys with very many ends go."""
    c = tables(spark, d, "customer")[0]
    k = F.col("c_custkey")
    lat, lng = 48 + k % 97 * 0.0004, 2 + k % 89 * 0.0005
    line = F.array(F.struct(lat.alias("lat"), lng.alias("lng")), F.struct((lat + 0.0002).alias("lat"), (lng + k % 3 * 0.0001).alias("lng")))
    return spatial.segment_components(c.select(F.translate("c_mktsegment", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "").alias("key"), k.alias("idx"), line.alias("line")), "key", most_ends=0)


LARGE_KEY_COMPONENTS = f"""
with recursive c as (select c_custkey as idx, 48 + c_custkey % 97 * 0.0004::double as y0, 2 + c_custkey % 89 * 0.0005::double as x0 from customer),
p as (select idx, unnest([y0, y0 + 0.0002::double]) as y, unnest([x0, x0 + idx % 3 * 0.0001::double]) as x from c),
q as (select idx, y, x, floor(y * 2000)::int as cy from p),
e as (select distinct a.idx as u, b.idx as v from (select *, unnest([cy - 1, cy, cy + 1]) as near from q) a join q b on b.cy = a.near where sqrt(pow((a.x - b.x) * {_LM} * cos((a.y + b.y) / 2 * pi() / 180), 2) + pow((a.y - b.y) * {_LM}, 2)) <= 35),
r as (select idx as u, idx as v from c union select r.u, e.v from r join e on e.u = r.v)
select '' as key, u as idx, min(v) as component from r group by u
"""


def clean_line(spark: SparkSession, d: str) -> DataFrame:
    pts = F.transform("pts", lambda p: F.struct(F.round(F.get(p, F.lit(1)), 1).alias("lat"), F.round(F.get(p, F.lit(0)) * 0.1, 1).alias("lng")))
    out = G.clean_line(pts, 0.11)
    return _tracks(spark, d).select("vec_id", F.size(out).cast("long").alias("n"), F.round(F.element_at(out, -1)["lat"], 1).alias("last"))


CLEAN_LINE = """
with recursive p as (select vec_id, i + 1 as i, round(embedding[2 * i + 2]::double, 1) as y, round(embedding[2 * i + 1]::double * 0.1::double, 1) as x from embeddings, range(32) t(i)),
f as (select vec_id, i, x, y, 1 as n from p where i = 1 union all
  select p.vec_id, p.i, case when abs(p.x - f.x) <= 0.11::double and abs(p.y - f.y) <= 0.11::double then f.x else p.x end, case when abs(p.x - f.x) <= 0.11::double and abs(p.y - f.y) <= 0.11::double then f.y else p.y end,
    f.n + case when abs(p.x - f.x) <= 0.11::double and abs(p.y - f.y) <= 0.11::double then 0 else 1 end from f join p on p.vec_id = f.vec_id and p.i = f.i + 1)
select vec_id, n::bigint as n, round(y, 1) as last from f where i = 32
"""


def line_merge(spark: SparkSession, d: str) -> DataFrame:
    """Greedy joins of polylines end to end: each nation's customers are steps of one path, some of them backwards."""
    return _merged(spark, d, 50_000)


def large_key_chains(spark: SparkSession, d: str) -> DataFrame:
    """The same joins with each component of touching ends as a task of its own: the way that keys with very many lines go."""
    return _merged(spark, d, 0)


def _merged(spark: SparkSession, d: str, most_lines: int) -> DataFrame:
    c = tables(spark, d, "customer")[0]
    k = F.col("c_custkey")

    def node(i):
        return F.struct((48 + i * i % 13 * 0.001).alias("lat"), (2 + i * 0.001).alias("lng"))

    step = k * 7 % 50
    line = F.when(k % 3 == 0, F.array(node(step + 1), node(step))).otherwise(F.array(node(step), node(step + 1)))
    out = spatial.merge_polylines(c.select(F.col("c_nationkey").alias("key"), k.alias("idx"), line.alias("line")), "key", most_lines)
    at = lambda i, j: F.round(F.get(F.get("line", i), F.lit(j)), 6)
    last = F.size("line") - 1
    return out.select("key", "pos", F.size("line").cast("long").alias("n"), at(F.lit(0), 0).alias("lng"), at(last, 0).alias("last_lng"), at(last, 1).alias("last_lat"))


_NEAR = "(abs({a}[1] - {b}[1]) <= 0.000035::double and abs({a}[2] - {b}[2]) <= 0.000035::double)"
LINE_MERGE = f"""
with recursive c as (select c_nationkey as key, c_custkey as k, c_custkey * 7 % 50 as i from customer),
l as (select key, k, [2 + i * 0.001::double, 48 + i * i % 13 * 0.001::double] as a, [2 + (i + 1) * 0.001::double, 48 + (i + 1) * (i + 1) % 13 * 0.001::double] as b from c),
s as (select key, list(case when k % 3 = 0 then [b, a] else [a, b] end order by k) as w from l group by key),
r as (
  select key, w[1] as now, w[2:] as waiting, []::double[][][] as done from s
  union all
  select key, case kind when 0 then waiting[1] when 1 then now || o[2:] when 2 then now || list_reverse(o)[2:] when 3 then o || now[2:] else list_reverse(o) || now[2:] end,
    case when kind = 0 then waiting[2:] else waiting[:j - 1] || waiting[j + 1:] end, case when kind = 0 then list_append(done, now) else done end
  from (select *, coalesce(kinds[j], 0) as kind, waiting[j] as o from (select *, list_position(list_transform(kinds, lambda x: x > 0), true) as j from (
    select *, list_transform(waiting, lambda w: case when {_NEAR.format(a="now[-1]", b="w[1]")} then 1 when {_NEAR.format(a="now[-1]", b="w[-1]")} then 2 when {_NEAR.format(a="now[1]", b="w[-1]")} then 3 when {_NEAR.format(a="now[1]", b="w[1]")} then 4 else 0 end) as kinds
    from r where now is not null)))),
f as (select key, unnest(done) as line, unnest(range(len(done))) as i from r where now is null)
select key, row_number() over (partition by key order by -len(line), i) - 1 as pos, len(line) as n, round(line[1][1], 6) as lng, round(line[-1][1], 6) as last_lng, round(line[-1][2], 6) as last_lat from f
"""


LARGE_KEY_CHAINS = LINE_MERGE


def hit_test(spark: SparkSession, d: str) -> DataFrame:
    c = tables(spark, d, "customer")[0]
    k = F.col("c_custkey")
    shapes = c.select(k.alias("seq"), k.alias("feature"), (k * 37 % 1000).cast("double").alias("x"), (k * 91 % 700).cast("double").alias("y"))
    probes = tables(spark, d, "supplier")[0].select(F.col("s_suppkey").alias("probe"), (F.col("s_suppkey") * 13 % 1000).cast("double").alias("x"), (F.col("s_suppkey") * 7 % 700).cast("double").alias("y"))
    return spatial.hit_test(shapes, probes, 10.0, "probe")


HIT_TEST = "select s_suppkey as probe, min(c_custkey) as feature from supplier, customer where abs(s_suppkey * 13 % 1000 - c_custkey * 37 % 1000) <= 10 and abs(s_suppkey * 7 % 700 - c_custkey * 91 % 700) <= 10 group by 1"


def street_boxes(spark: SparkSession, d: str) -> DataFrame:
    lines = _segments(spark, d).groupBy("key").agg(F.collect_list("line").alias("lines"))
    n = tables(spark, d, "nation")[0].select(F.col("n_nationkey").alias("key"))
    point = F.when(F.col("key") % 2 == 0, F.struct(F.lit(1.0).alias("lat"), F.lit(2.0).alias("lng")))
    rows = n.join(lines.withColumn("key", F.expr("case when key % 3 = 0 then -1 - key else key end")), "key", "left").select("key", G.street_bounds(F.coalesce("lines", F.expr("array()").cast("array<array<struct<lat:double,lng:double>>>")), point).alias("b"))
    return rows.select("key", *[F.round(F.col(f"b.{s}"), 9).alias(s) for s in G.SIDES])


STREET_BOXES = """
with l as (select c_nationkey as key, round(min(48 + c_custkey % 40 * 0.0004::double), 9) as s, round(min(2 + c_custkey % 9 * 0.0005::double), 9) as w, round(max(48 + c_custkey % 40 * 0.0004::double + 0.0002::double), 9) as n, round(max(2 + c_custkey % 9 * 0.0005::double + 0.0003::double), 9) as e from customer where c_nationkey % 3 > 0 group by 1)
select n_nationkey as key, coalesce(s, case when n_nationkey % 2 = 0 then 1.0::double end) as south, coalesce(w, case when n_nationkey % 2 = 0 then 2.0::double end) as west, coalesce(n, case when n_nationkey % 2 = 0 then 1.0::double end) as north, coalesce(e, case when n_nationkey % 2 = 0 then 2.0::double end) as east from nation left join l on l.key = n_nationkey
"""


def places_in(spark: SparkSession, d: str) -> DataFrame:
    """Places of a viewport, and the guard's verdict in a row of its own."""
    rows = _plots(spark, d, 3).select((F.col("id") % 400).alias("code"), F.col("id").alias("seq"), "b.*")
    own, guard = landing.places_in(rows, G.bounds(F.lit(48.0), F.lit(2.0), F.lit(48.4), F.lit(2.4)), 20)
    none = F.lit(None)
    verdict = guard.select(none.cast("long").alias("code"), none.cast("long").alias("seq"), none.cast("double").alias("lat"), "too_many")
    return own.select("code", "seq", F.round("center.lat", 9).alias("lat"), none.cast("boolean").alias("too_many")).unionByName(verdict)


PLACES_IN = f"""
with h as (select id % 400 as code, * from {_plots_sql(3)} where w <= 2.4001::double and e >= 1.9999::double and s <= 48.4001::double and n >= 47.9999::double)
select code, min(id) as seq, round(arg_min((s + n) / 2, id), 9) as lat, null::boolean as too_many from h group by 1 union all select null, null, null, count(*) > 20 from h
"""

_ALL = (snap_pad, viewport_limits, bounds_validate, bbox_agg, bbox_join, point_in_polygon, coverage_forall, contour_search, segment_distance, nearest_component, large_key_components, clean_line, line_merge, large_key_chains, hit_test, street_boxes, places_in)
QUERIES = {f.__name__: f for f in _ALL}
ORACLE_SQL = {f.__name__: globals()[f.__name__.upper()] for f in _ALL}
