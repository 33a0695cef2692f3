"""Points and contours without a key in common: contours are covered by grid cells.

A contour's cover is made of cells that lie inside it as a whole and of cells on its border; the smaller the cell, the nearer to
the border. Cells of one contour do not overlap, so a point meets a contour at most once, in an equi-join on level and place. In an inner
cell it is inside without a look at the contour; on the border the exact test decides. So the exact test runs for points near a
border only, and no point is compared with a contour that is far away.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlume.functions.geo import point_in_multipolygon, sample_points
from gridlume.runtime import Written, ship

#: Degrees of a cell of level 0 (a power of two, so that places are exact); a level halves it. Levels that a cover goes down, and its cells at most.
BASE, DEPTH, MOST_CELLS = 512.0, 8, 400


def _ring_edges(ring: list) -> np.ndarray:
    """Edges (x0, y0, x1, y1) of a ring of at least three vertices; those at vertices that are no numbers are left out."""
    if ring is None or len(ring) < 3:
        return np.zeros((0, 4))
    at = np.array([[v if v is not None else np.nan for v in (*(p or []), None, None)[:2]] for p in ring], float)
    edges = np.concatenate([np.roll(at, 1, axis=0), at], axis=1)
    return edges[np.isfinite(edges).all(axis=1)]


def _inside(x: float, y: float, polygons: list[list[np.ndarray]]) -> bool:
    """The even-odd rule of the exact test, for one point: in the first ring of a polygon and in none of its others."""

    def odd(e: np.ndarray) -> bool:
        spans = e[(e[:, 1] > y) != (e[:, 3] > y)]
        return bool(np.count_nonzero(x < (spans[:, 0] - spans[:, 2]) * (y - spans[:, 3]) / (spans[:, 1] - spans[:, 3]) + spans[:, 2]) % 2)

    return any(rings and odd(rings[0]) and not any(map(odd, rings[1:])) for rings in polygons)


def _touches(edges: np.ndarray, x: float, y: float, side: float) -> np.ndarray:
    """Which edges meet the square (x, y, side), a little room around it included."""
    room = side * 1e-6 + 1e-12
    lo_x, hi_x, lo_y, hi_y = x - room, x + side + room, y - room, y + side + room
    x0, y0, x1, y1 = edges.T
    near = (np.minimum(x0, x1) <= hi_x) & (np.maximum(x0, x1) >= lo_x) & (np.minimum(y0, y1) <= hi_y) & (np.maximum(y0, y1) >= lo_y)
    dx, dy = x1 - x0, y1 - y0
    turns = [dx * (cy - y0) - dy * (cx - x0) for cx in (lo_x, hi_x) for cy in (lo_y, hi_y)]
    apart = np.all([t > 0 for t in turns], axis=0) | np.all([t < 0 for t in turns], axis=0)
    return near & ~apart


def cover(polygons: list, depth: int = DEPTH, most_cells: int = MOST_CELLS) -> list[tuple[int, int, int, bool]]:
    """(level, x, y, inner) of cells that hold every point inside ``polygons`` (lists of rings of [lng, lat])."""
    shapes = [[_ring_edges(r) for r in rings or []] for rings in polygons or []]
    edges = np.concatenate([e for rings in shapes for e in rings] or [np.zeros((0, 4))])
    if not len(edges):
        return []
    lo, hi = np.minimum(edges[:, :2], edges[:, 2:]).min(axis=0), np.maximum(edges[:, :2], edges[:, 2:]).max(axis=0)
    level = int(np.clip(np.floor(np.log2(BASE / max((hi - lo).max(), 1e-9))), 0, 30))
    side = BASE / 2**level
    first, last = np.floor(lo / side).astype(int), np.floor(hi / side).astype(int)
    open_ = [(x, y, edges) for x in range(first[0], last[0] + 1) for y in range(first[1], last[1] + 1)]
    done: list[tuple[int, int, int, bool]] = []
    for step in range(depth + 1):
        side, border = BASE / 2**level, []
        for x, y, near in open_:
            near = near[_touches(near, x * side, y * side, side)]
            if len(near):
                border.append((x, y, near))
            elif _inside((x + 0.5) * side, (y + 0.5) * side, shapes):
                done.append((level, x, y, True))
        if step == depth or len(done) + 4 * len(border) > most_cells:
            return done + [(level, x, y, False) for x, y, _ in border]
        open_ = [(2 * x + i, 2 * y + j, near) for x, y, near in border for i in (0, 1) for j in (0, 1)]
        level += 1
    return done


def contour_cells(contours: DataFrame, key: str, depth: int = DEPTH, most_cells: int = MOST_CELLS) -> DataFrame:
    """``key, level, x, y, inner``: the cover of each row of ``contours`` (``key``, ``polygons``); rows without an edge have none."""
    kind = dict(contours.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(i, *c) for i, p in enumerate(batch.column(1)) for c in cover(p.as_py(), depth, most_cells)]
            columns = list(zip(*found, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(columns[0], pa.int64())), pa.array(columns[1], pa.int32()), *(pa.array(c, pa.int64()) for c in columns[2:4]), pa.array(columns[4], pa.bool_())], [key, "level", "x", "y", "inner"])

    ship(contours.sparkSession)
    return contours.select(F.col(f"`{key}`"), "polygons").mapInArrow(run, f"`{key}` {kind}, level int, x long, y long, inner boolean")


def points_in_contours(points: DataFrame, contours: DataFrame, point_key: str, contour_key: str, depth: int = DEPTH, most_cells: int = MOST_CELLS) -> DataFrame:
    """``point_key, contour_key`` of every point (``point``: struct of lat, lng) and contour (``polygons``) that holds it.

    Keys name rows and have different names. Null points and contours meet nothing. Cells that very many points share are split by
    the adaptive skew join.
    """
    written = Written(points.sparkSession, "cover")
    p, c = F.col(f"`{point_key}`"), F.col(f"`{contour_key}`")
    cells = written.save(contour_cells(contours, contour_key, depth, most_cells))
    levels = sorted(r["level"] for r in cells.select("level").distinct().collect())  # some thirty at most
    lng, lat = F.col("point")["lng"], F.col("point")["lat"]
    at = F.array(*(F.struct(F.lit(v).alias("level"), F.floor(lng * (2.0**v / BASE)).alias("x"), F.floor(lat * (2.0**v / BASE)).alias("y")) for v in levels or [0]))
    real = (F.abs(lng) < float("inf")) & (F.abs(lat) < float("inf"))
    probes = points.where(real).select(p, "point", F.explode(at).alias("_at")).select(p, "point", "_at.*")
    met = probes.join(cells, ["level", "x", "y"])
    inner = met.where("inner").select(p, c)
    border = met.where("not inner").select(p, "point", c).join(contours.select(c, "polygons"), contour_key)
    return inner.unionByName(border.where(point_in_multipolygon(F.col("point"), F.col("polygons"))).select(p, c))


def boxes_in_contours(boxes: DataFrame, contours: DataFrame, key: str, contour_key: str) -> DataFrame:
    """``key, contours, covered``: how many contours hold one of a box's nine sample points, and whether each of the points lies in some contour."""
    k = F.col(f"`{key}`")
    points = boxes.select(k, F.posexplode(sample_points(F.col("bounds"))).alias("_i", "point")).withColumn("_point", F.struct(k, "_i"))
    hit = points_in_contours(points, contours, "_point", contour_key)
    # nine bits a box instead of distinct counts
    found = hit.groupBy(F.col(f"_point.`{key}`").alias(key), F.col(f"`{contour_key}`")).agg(F.bit_or(F.expr("shiftleft(1, _point._i)")).alias("_bits"))
    found = found.groupBy(k).agg(F.count("*").alias("contours"), F.bit_or("_bits").alias("_bits"))
    return boxes.select(k).join(found, key, "left").select(k, F.coalesce("contours", F.lit(0)).alias("contours"), (F.coalesce("_bits", F.lit(0)) == 511).alias("covered"))
