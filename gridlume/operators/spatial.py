"""Spatial joins, segment components and polylines."""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlume.functions.geo import point_in_multipolygon, sample_points
from gridlume.operators.nearness import MOST_ENDS, Earth, Flat, label_lines, line_components
from gridlume.operators.order import global_rank
from gridlume.runtime import Written, ship

JOIN_METERS, MATCH_METERS, SLACK_METERS = 35.0, 1800.0, 350.0
CHAIN_DEGREES = 0.000035
_ENDS = ["y0", "x0", "y1", "x1"]


#: Levels of the grid pyramid: cells grow by a factor of four, so eight levels reach from 0.1 degrees around the earth.
LEVELS = 8

#: Tasks at most that the smaller boxes of a coarse cell are dealt to; the larger ones, few, go to all of them.
_DEALT = 32

#: Boxes of a block at most.
_BLOCK = 128

_SIDES, _REACHED, _LISTS = ("w", "s", "e", "n"), ("w1", "s1", "e0", "n0"), ("ws", "ss", "es", "ns")


def _own_level(grid: float) -> Column:
    """The finest level whose cells are no smaller than the box (w, s, e, n)."""
    size = F.greatest(F.col("e") - F.col("w"), F.col("n") - F.col("s"))
    return sum((F.when(size > grid * 4**k, 1).otherwise(0) for k in range(LEVELS - 1)), F.lit(0))


def _blocks(boxes: DataFrame, grid: float) -> DataFrame:
    """``boxes`` (k, w, s, e, n, own) that begin in the same cell of their own level, neighbours together, in rows of at most ``_BLOCK``.

    A row has the boxes' keys and sides as lists, the bounds that hold all of them (w, s, e, n) and those that each of them reaches (w1, s1, e0, n0).
    """
    cell = F.lit(grid) * F.pow(F.lit(4.0), F.col("own"))
    bits = F.array(*map(F.lit, (0, 1, 4, 5, 16, 17, 20, 21)))
    eighth = lambda c: F.get(bits, F.pmod(F.floor(F.col(c) / cell * 8), F.lit(8)).cast("int"))
    at = boxes.withColumns({"cx": F.floor(F.col("w") / cell).cast("long"), "cy": F.floor(F.col("s") / cell).cast("long"), "z": eighth("w") + eighth("s") * 2})
    place = F.row_number().over(Window.partitionBy("own", "cx", "cy").orderBy("z", "k", *_SIDES))
    each = at.withColumn("part", F.floor((place - 1) / _BLOCK)).groupBy("own", "cx", "cy", "part")
    held = each.agg(
        *(F.min(c).alias(c) for c in "ws"), *(F.max(c).alias(c) for c in "en"), *(F.max(c).alias(f"{c}1") for c in "ws"), *(F.min(c).alias(f"{c}0") for c in "en"),
        F.collect_list(F.struct("k", *_SIDES)).alias("rows"),
    )
    lists = (F.col(f"rows.{c}").alias(f"{c}s") for c in ("k", *_SIDES))
    return held.select("own", *_SIDES, *_REACHED, *lists, F.hash("cx", "cy", "part").alias("salt"))


def _in_cells(blocks: DataFrame, grid: float) -> DataFrame:
    """``blocks`` a row for each cell (level, x, y) that they touch on their own level and all coarser ones, with whether it is their first in each direction.

    Cells to meet in are four times as wide as those that blocks begin in, so most blocks touch one of a level and none more than four.
    """
    cell = F.lit(grid) * F.pow(F.lit(4.0), F.col("level") + 1)
    lo = lambda c: F.floor(F.col(c) / cell).cast("long")
    at = blocks.withColumn("level", F.explode(F.sequence("own", F.lit(LEVELS - 1))))
    at = at.withColumns({"x0": lo("w"), "y0": lo("s"), "x1": lo("e"), "y1": lo("n")})
    at = at.withColumn("x", F.explode(F.sequence("x0", "x1"))).withColumn("y", F.explode(F.sequence("y0", "y1")))
    return at.withColumns({"fx": F.col("x") == F.col("x0"), "fy": F.col("y") == F.col("y0")})


def _overlap(p: str, q: str) -> Column:
    return F.expr(f"{p}w <= {q}e and {q}w <= {p}e and {p}s <= {q}n and {q}s <= {p}n")


def bbox_join(left: DataFrame, right: DataFrame, left_box: str, right_box: str, left_key: str, right_key: str, grid: float = 0.1) -> DataFrame:
    """Pairs of keys whose boxes overlap: an equi-join of blocks of neighbouring boxes on cells of a grid pyramid, then the exact test.

    Blocks meet on the level of the larger boxes, so a box of any size makes few rows and small boxes do not meet in large cells. Two
    blocks share one first cell there (the greater of both lower corners, so the first one of either), so a pair comes out once without a distinct.
    Boxes with null or reversed sides overlap nothing. A box that overlaps all of a block is paired with its keys as they stand; only at its edges are boxes tested
    one by one. So little is shuffled for each box, and the result, however many pairs it has, repeats the same keys in the same order, which files hold in few bytes.

    Blocks of the finest level meet in a join of their own, whose crowded cells the adaptive skew join splits. On coarser levels the smaller boxes of a cell are
    dealt to several tasks. Both sides are shuffled, none is sent whole to every executor. ``grid``: near the usual size.
    """

    def rows(df: DataFrame, key: str, box: str) -> DataFrame:
        b = F.col(box)
        named = df.select(F.col(key).alias("k"), *(b[c].alias(c[0]) for c in ("west", "south", "east", "north")))
        return named.where((F.col("w") <= F.col("e")) & (F.col("s") <= F.col("n"))).withColumn("own", _own_level(grid))

    def met(p: DataFrame, q: DataFrame, cell: list[str]) -> DataFrame:
        """Pairs of blocks, the larger boxes' first."""
        p, q = (x.select(*cell, *(F.col(c).alias(f"{k}_{c}") for c in [*_SIDES, "fx", "fy", *more, *_LISTS, "a", "z"])) for k, x, more in (("p", p, ()), ("q", q, _REACHED)))
        both = q.join(p.hint("merge"), cell).where(_overlap("p_", "q_") & F.expr("(p_fx or q_fx) and (p_fy or q_fy)"))
        keys = (F.coalesce(f"p_{c}", f"q_{c}").alias(c) for c in "az")
        return both.select("of_left", *(f"p_{c}" for c in _LISTS), *(f"q_{c}" for c in (*_LISTS, *_SIDES, *_REACHED)), *keys)

    def larger(blocks: DataFrame, of_left: bool) -> DataFrame:
        own = blocks.where("level > 0 and level <= own")
        return own.withColumns({"salt": F.explode(F.sequence(F.lit(0), dealt - 1)), "of_left": F.lit(of_left)})

    def smaller(blocks: DataFrame, others: DataFrame, of_left: bool) -> DataFrame:
        """Blocks in the cells of the coarser levels that the other side has boxes of; of one level, those of the left count as larger."""
        found = F.array_contains(others.agg(F.collect_set("own")).scalar(), F.col("level"))
        return blocks.where(F.expr("level > 0" if of_left else "level > own") & found).withColumns({"salt": F.pmod("salt", dealt), "of_left": F.lit(of_left)})

    # a cell holds sixteen cells of the level below
    dealt = F.least(F.lit(_DEALT), F.pow(F.lit(4), F.col("level")).cast("int"))
    a, b = rows(left, left_key, left_box), rows(right, right_key, right_box)
    none_a, none_z = (F.lit(None).cast(f"array<{x.schema['k'].dataType.simpleString()}>") for x in (a, b))
    ab = _in_cells(_blocks(a, grid).withColumnRenamed("ks", "a").withColumn("z", none_z), grid)
    zb = _in_cells(_blocks(b, grid).withColumnRenamed("ks", "z").withColumn("a", none_a), grid)
    spark, cell = left.sparkSession, ["of_left", "level", "x", "y", "salt"]
    # the bytes of blocks don't tell their pairs, so these tasks are not put together by size
    n = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    coarse = (larger(ab, True).unionByName(larger(zb, False)), smaller(zb, a, True).unionByName(smaller(ab, b, False)))
    finest = (x.where("level = 0").withColumn("of_left", F.lit(True)) for x in (ab, zb))
    blocks = met(*finest, ["of_left", "level", "x", "y"]).unionByName(met(*(x.repartition(n, *cell) for x in coarse), cell))
    # behind the union, so a block's pairs are made one pair of blocks at a time
    one = blocks.select("*", F.posexplode("p_ws").alias("i", "pw")).withColumns({f"p{c}": F.get(f"p_{c}s", "i") for c in "sen"}).where(_overlap("p", "q_"))
    whole = F.expr("pw <= q_e0 and q_w1 <= pe and ps <= q_n0 and q_s1 <= pn")
    each = one.withColumn("whole", whole).select("*", F.posexplode("q_ws").alias("j", "qw"))
    each = each.where("whole or pw <= get(q_es, j) and qw <= pe and ps <= get(q_ns, j) and get(q_ss, j) <= pn")
    return each.select(F.expr("get(a, if(of_left, i, j))").alias(left_key), F.expr("get(z, if(of_left, j, i))").alias(right_key))


def covered_boxes(boxes: DataFrame, contours: DataFrame, key: str) -> DataFrame:
    """``key, covered``: whether each of a box's nine sample points lies in some contour (``polygons``) of its key.

    A division without a cross join: boxes and contours meet on the key, each pair tells the points it holds as nine bits, and bits are put
    together by key; a key without contours is not covered.
    """
    places = F.array(*(F.lit(1 << i) for i in range(9)))
    held = F.transform(sample_points(F.col("bounds")), lambda p, i: F.when(point_in_multipolygon(p, F.col("polygons")), F.get(places, i)).otherwise(0))
    met = boxes.select(key, "bounds").join(contours.select(key, "polygons"), key).select(key, F.aggregate(held, F.lit(0), lambda a, b: a + b).alias("bits"))
    hit = met.groupBy(key).agg(F.bit_or("bits").alias("bits"))
    return boxes.select(key).join(hit, key, "left").select(key, (F.coalesce("bits", F.lit(0)) == 511).alias("covered"))


def label_segments(ends: np.ndarray, meters: float = JOIN_METERS) -> np.ndarray:
    """Component (least index) of each segment; ``ends``: lat, lng of both ends. Segments join where ends are near."""
    return label_lines(np.asarray(ends, float).reshape(-1, 2, 2), Earth(meters))


def segment_components(lines: DataFrame, key: str, meters: float = JOIN_METERS, most_ends: int = MOST_ENDS) -> DataFrame:
    """``key, idx, component`` of lines (``key``, ``idx``, ``line``) by nearness of their ends within each key.

    Lines of a key with few ends meet in one task; those of a larger key are dealt by place, over all tasks.
    """
    ends = lines.where(F.size("line") > 0).select(F.col(f"`{key}`"), "idx", *[F.element_at("line", i)[c].alias(f"{a}{k}") for k, i in enumerate((1, -1)) for a, c in (("y", "lat"), ("x", "lng"))])
    return line_components(ends, key, Earth(meters), most_ends)


def nearest_components(lines: DataFrame, points: DataFrame, key: str) -> DataFrame:
    """Lines of the components near the key's point: ``key, idx, component, distance, kept``; nothing is kept where the
    nearest is beyond 1800 m, else all within 350 m of it and 1800 m."""
    from gridlume.functions.geo import line_distance

    comp = segment_components(lines, key)
    near = lines.join(points, key).select(key, F.col("idx").cast("long").alias("idx"), line_distance(F.col("line"), F.col("point")).alias("d"))
    each = comp.join(near, [key, "idx"]).select(key, "idx", "component", "d")
    by = each.groupBy(key, "component").agg(F.min("d").alias("distance"))
    best = by.groupBy(key).agg(F.min("distance").alias("closest"))
    limit = F.least(F.lit(MATCH_METERS), F.col("closest") + SLACK_METERS)
    kept = by.join(best, key).select(key, "component", "distance", ((F.col("closest") <= MATCH_METERS) & (F.col("distance") <= limit)).alias("kept"))
    return each.drop("d").join(kept, [key, "component"])


def chain_lines(lines: list[np.ndarray], tolerance: float = CHAIN_DEGREES) -> list[np.ndarray]:
    """Polylines (rows of lng, lat, thinned) joined greedily end to end, in order, and sorted by vertex count, longest first."""
    return sorted((x for _, x in chains(lines, tolerance)), key=lambda x: -len(x))


def chains(lines: list[np.ndarray], tolerance: float = CHAIN_DEGREES) -> list[tuple[int, np.ndarray]]:
    """The same in the order of the lines that begin them, with these lines' places.

    Ends are found by cells of the tolerance. Each place where lines end keeps its lines in order, so however many lines end there, the first one that
    is left is at hand; a chain is kept as its pieces. So the work grows with the vertices.
    """
    lines, step = [np.asarray(x, float) for x in lines], tolerance * 1.001
    ends: dict[tuple[float, float], deque[int]] = {}
    cells: dict[tuple[int, int], list[tuple[float, float]]] = {}
    for i, x in enumerate(lines):
        for p in ((x[0, 0], x[0, 1]), (x[-1, 0], x[-1, 1])) if len(x) else ():
            p = (float(p[0]), float(p[1]))
            if p not in ends:
                ends[p] = deque()
                cells.setdefault((math.floor(p[0] / step), math.floor(p[1] / step)), []).append(p)
            ends[p].append(i)
    free = [True] * len(lines)

    def near(p: tuple[float, float] | np.ndarray, q: tuple[float, float] | np.ndarray, most: float = tolerance) -> bool:
        return bool(abs(p[0] - q[0]) <= most and abs(p[1] - q[1]) <= most)

    def waits(q: tuple[float, float]) -> bool:
        """Whether a free line ends at ``q``; the first one is then its queue's first."""
        own = ends[q]
        while own and not free[own[0]]:
            own.popleft()
        return bool(own)

    def around(p: tuple[float, float]) -> list[int]:
        """The first free line of each place near ``p``."""
        x, y = math.floor(p[0] / step), math.floor(p[1] / step)
        found = []
        for c in ((x + a, y + b) for a in (-1, 0, 1) for b in (-1, 0, 1)):
            if c in cells:
                cells[c] = [q for q in cells[c] if waits(q)]
                found += [ends[q][0] for q in cells[c] if near(p, q)]
        return found

    def joined(head: deque, tail: deque) -> deque:
        """``tail`` behind ``head``: without its first vertex, and without those that then repeat the head's last."""
        last, rest = head[-1][-1], tail
        rest[0] = rest[0][1:]
        while rest and (not len(rest[0]) or near(rest[0][0], last, 0.000001)):
            if len(rest[0]):
                rest[0] = rest[0][1:]
            else:
                rest.popleft()
        if len(rest) > len(head):
            rest.extendleft(reversed(head))
            return rest
        head.extend(rest)
        return head

    done = []
    for k, line in enumerate(lines):
        if not free[k]:
            continue
        free[k] = False
        now = deque([line])
        while len(line):
            first, last = tuple(now[0][0].tolist()), tuple(now[-1][-1].tolist())
            # the first line in order that has an end at one of ours
            best = min((*around(first), *around(last)), default=None)
            if best is None:
                break
            free[best] = False
            other = lines[best]
            if near(last, other[0]):
                now = joined(now, deque([other]))
            elif near(last, other[-1]):
                now = joined(now, deque([other[::-1]]))
            else:
                now = joined(deque([other if near(first, other[-1]) else other[::-1]]), now)
        done.append((k, np.concatenate(list(now)) if len(now) > 1 else now[0]))
    return done


def thin_line(line: np.ndarray, tolerance: float = 0.000001) -> np.ndarray:
    """Vertices that differ from the last one kept."""
    kept: list[int] = []
    for i in range(len(line)):
        if not kept or (np.abs(line[i] - line[kept[-1]]) > tolerance).any():
            kept.append(i)
    return line[kept]


def _clean(line: list | np.ndarray) -> np.ndarray:
    """Vertices (rows of lng, lat) of an array of lat/lng structs that are numbers and differ from the one before."""
    a = np.array([[p["lng"], p["lat"]] for p in line if p["lng"] is not None and p["lat"] is not None], float).reshape(-1, 2)
    return thin_line(a[np.isfinite(a).all(axis=1)])


_CHAIN = "_n long, _first long, line array<array<double>>"


def merge_polylines(lines: DataFrame, key: str, most_lines: int = 50_000) -> DataFrame:
    """``key, pos, line`` (arrays of [lng, lat]) of cleaned lines (``key``, ``idx``, ``line`` of lat/lng structs) joined per key.

    Joining is greedy in order of ``idx``, but only lines that hang together by their ends can ever be joined. So of a key with more than
    ``most_lines`` lines (counted first) each such component is a task of its own, and ``pos`` (longest chain first, then by the line that began
    it) is ranked over ranges; the lines of other keys meet in one task. Null lines and those of under two vertices are left out.
    """
    kind, k = dict(lines.dtypes)[key], F.col(f"`{key}`")
    lines = lines.where("line is not null").select(k, F.col("idx").cast("long").alias("idx"), "line")

    def whole(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("idx")
        out = chain_lines([a for a in map(_clean, f["line"]) if len(a) > 1])
        return pd.DataFrame({key: [f[key].iloc[0]] * len(out), "pos": range(len(out)), "line": [x.tolist() for x in out]})

    def cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_clean(x) for x in batch.column(2).to_pylist()]
            keep = [i for i, a in enumerate(found) if len(a) > 1]
            ends = np.array([[*found[i][0, ::-1], *found[i][-1, ::-1]] for i in keep]).reshape(-1, 4)
            shape = pa.list_(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), batch.column(1).take(pa.array(keep, pa.int64())), *map(pa.array, ends.T.copy()), pa.array([found[i].tolist() for i in keep], shape)], [key, "idx", *_ENDS, "line"])

    def component(table: pa.Table) -> pa.Table:
        table = table.sort_by("idx")
        out = chains([np.array(x) for x in table["line"].to_pylist()])
        first = table["idx"].combine_chunks().take(pa.array([i for i, _ in out], pa.int64()))
        return pa.table([table[key].combine_chunks().take(pa.array([0] * len(out), pa.int64())), pa.array([len(x) for _, x in out], pa.int64()), first, pa.array([x.tolist() for _, x in out], pa.list_(pa.list_(pa.float64())))], [key, "_n", "_first", "line"])

    ship(lines.sparkSession)
    written = Written(lines.sparkSession, "polylines")
    large = written.save(lines.groupBy(k).count().where(F.col("count") > most_lines).select(k.alias("_large")))
    schema = f"`{key}` {kind}, pos long, line array<array<double>>"
    if not large.limit(1).count():
        return lines.groupBy(k).applyInPandas(whole, schema)
    same = k.eqNullSafe(F.col("_large"))
    rest = lines.join(large, same, "left_anti").groupBy(k).applyInPandas(whole, schema)
    own = written.save(lines.join(large, same, "left_semi").mapInArrow(cleaned, f"`{key}` {kind}, idx long, " + ", ".join(f"{c} double" for c in _ENDS) + ", line array<array<double>>"))
    comp = line_components(own, key, Flat(CHAIN_DEGREES), 2 * most_lines).withColumnRenamed("idx", "_idx").withColumnRenamed(key, "_key")
    placed = own.join(comp, k.eqNullSafe(F.col("_key")) & (F.col("idx") == F.col("_idx"))).select(k, "idx", "component", "line")
    chained = written.save(placed.groupBy(k, "component").applyInArrow(component, f"`{key}` {kind}, {_CHAIN}"))
    ranked = global_rank(chained, [F.desc("_n"), F.col("_first")], "pos", [key])
    return rest.unionByName(ranked.select(k, (F.col("pos") - 1).alias("pos"), "line"))


def hit_test(features: DataFrame, probes: DataFrame, reach: float, probe_key: str) -> DataFrame:
    """The first feature (least ``seq``) whose point lies in the box of ``reach`` around each probe; grid cells, then the exact test."""
    cell = lambda c: F.floor(c / F.lit(reach)).cast("long")
    f = features.select("seq", "feature", F.col("x").alias("fx"), F.col("y").alias("fy"), cell(F.col("x")).alias("cx"), cell(F.col("y")).alias("cy"))
    around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    p = probes.select(probe_key, "x", "y", around.alias("d")).select(probe_key, "x", "y", (cell(F.col("x")) + F.col("d.i")).alias("cx"), (cell(F.col("y")) + F.col("d.j")).alias("cy"))
    near = p.join(f, ["cx", "cy"]).where((F.abs(F.col("x") - F.col("fx")) <= reach) & (F.abs(F.col("y") - F.col("fy")) <= reach))
    return near.groupBy(probe_key).agg(F.min_by("feature", "seq").alias("feature"))
