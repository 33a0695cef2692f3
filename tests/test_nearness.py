"""Components of lines by near ends, chains of large keys, and ranks over ranges: brute force and odd inputs."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridlume.operators import graph, nearness, order, spatial

LINE = "key string, idx long, line array<struct<lat:double,lng:double>>"
EARTH, FLAT = nearness.Earth(35.0), nearness.Flat(0.000035)


def by_hand(ends, metric):
    """The least line reachable from each by ends that are near, compared one by one."""
    n = len(ends)
    p = ends.reshape(n, 2, 1, 1, 2)
    link = metric.near(p, ends.reshape(1, 1, n, 2, 2)).any(axis=(1, 3))
    label = np.arange(n)
    while True:
        now = np.where(link, label[None, :], n).min(axis=1)
        now = np.minimum(now, label)
        if (now == label).all():
            return label
        label = now


def ends_around(rng, n, spread, lat=48.0):
    return np.array([[[lat + rng.uniform(0, spread), 2 + rng.uniform(0, spread)] for _ in range(2)] for _ in range(n)])


@pytest.mark.parametrize("lat", [-0.001, 48.0, 75.0, -75.0])
def test_labels_by_hand(lat):
    rng = random.Random(4)
    for spread in (0.0005, 0.003, 0.008):
        for n in (1, 2, 30, 120):
            ends = ends_around(rng, n, spread, lat)
            assert nearness.label_lines(ends, EARTH).tolist() == by_hand(ends, EARTH).tolist()
    for spread in (0.0001, 0.0005):
        ends = ends_around(rng, 100, spread, lat)
        assert nearness.label_lines(ends, FLAT).tolist() == by_hand(ends, FLAT).tolist()
    assert nearness.label_lines(np.zeros((0, 2, 2)), EARTH).tolist() == []


def test_points_at_the_limit_itself():
    x = 0.000035
    ends = np.array([[[0, 0], [5, 5]], [[x, x], [6, 6]], [[2 * x, 2.1 * x], [7, 7]]], float)
    assert nearness.label_lines(ends, FLAT).tolist() == by_hand(ends, FLAT).tolist()


def test_many_ends_in_one_place_are_linear():
    rng = np.random.default_rng(2)
    took = []
    for n in (25_000, 100_000):
        # two crowds that nearly touch, cell against cell, and never do
        ends = rng.uniform(0, 0.00015, (n, 2, 2)) + np.array([48.0, 2.0])
        ends[: n // 2, :, 0] += 0.00015 + 35.5 / nearness.Earth.scale
        t = time.perf_counter()
        own = nearness.label_lines(ends, EARTH)
        took.append(time.perf_counter() - t)
        assert len(set(own.tolist())) == 2
    assert took[1] < 12 * took[0] + 1


def lines_of(spark, keyed):
    rows = [(k, i, [tuple(map(float, p)) for p in line]) for k, ends in keyed.items() for i, line in enumerate(ends)]
    return spark.createDataFrame(rows, LINE)


def test_large_keys_are_dealt_by_cell(spark):
    rng = random.Random(9)
    keyed = {"a": ends_around(rng, 150, 0.006), "b": ends_around(rng, 90, 0.002), "small": ends_around(rng, 5, 0.002)}
    keyed["crowd"] = np.concatenate([ends_around(rng, 60, 0.0001), ends_around(rng, 60, 0.0001, 48.0001 + 35.2 / nearness.Earth.scale)])
    df = lines_of(spark, keyed)
    odd = spark.createDataFrame([("a", 500, [(None, 2.0), (48.0, None)]), ("a", 501, []), ("a", 502, None)], LINE)
    got = {(r.key, r.idx): r.component for r in spatial.segment_components(df.unionByName(odd), "key", most_ends=40).collect()}
    want = {(k, i): int(c) for k, ends in keyed.items() for i, c in enumerate(by_hand(ends, EARTH))}
    assert got == want | {("a", 500): 500}


def test_boxes_that_cannot_tell_ask_the_points(spark, monkeypatch):
    """Sub-cells as large as cells: whatever boxes say must be settled by points."""
    monkeypatch.setattr(nearness, "SUB", 1)
    rng = random.Random(12)
    keyed = {"a": ends_around(rng, 200, 0.004)}
    got = {r.idx: r.component for r in spatial.segment_components(lines_of(spark, keyed), "key", most_ends=10).collect()}
    assert got == dict(enumerate(by_hand(keyed["a"], EARTH).tolist()))


def test_chains_of_a_large_key(spark):
    rng = random.Random(6)
    nodes = [(48 + i // 6 * 0.001, 2 + i % 6 * 0.001) for i in range(36)]
    rows = [("k", i, rng.sample(nodes, rng.choice([2, 2, 3]))) for i in range(14)] + [("far", 0, nodes[:2]), ("k", 90, [(1.0, 1.0)]), ("k", 91, [(None, 2.0), (3.0, 3.0)]), ("k", 92, None), (None, 1, nodes[2:4])]
    df = spark.createDataFrame(rows, LINE)
    plain = sorted(map(str, spatial.merge_polylines(df, "key").collect()))
    dealt = sorted(map(str, spatial.merge_polylines(df, "key", most_lines=3).collect()))
    assert plain == dealt and len(plain) > 4


def test_components_of_edges(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, x) for x in range(101, 140)] + [(rng.randrange(200, 230), rng.randrange(200, 230)) for _ in range(20)] + [(7, 7), (None, 3), (2**62, -(2**62))]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in graph.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in parent}
    assert graph.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("group", [None, ["g"]])
def test_ranks_and_totals_over_ranges(spark, group):
    rng = random.Random(3)
    rows = [(rng.choice(["x", "y", None]) if i % 3 else "x", rng.choice(["Éa", "eb", "Eb", "é", None]), i, rng.choice([1, 5, None])) for i in range(300)]
    df = spark.createDataFrame(rows, "g string, label string, id long, v long").repartition(5)
    got = {r.id: r for r in order.running_total(order.global_rank(df, [F.desc("id")], "rank", group), F.col("v"), [F.col("id")], "sum", group).collect()}
    for g, _, i, _v in rows:
        own = [r for r in rows if group is None or r[0] == g]
        assert got[i]["rank"] == sum(r[2] >= i for r in own)
        assert got[i]["sum"] == sum(r[3] or 0 for r in own if r[2] <= i)
    assert order.global_rank(df.limit(0), [F.col("id")]).count() == 0


def test_no_rank_is_one_task(spark):
    df = spark.range(0, 20_000, 1, 8).withColumn("x", F.xxhash64("id"))
    ranked = order.global_rank(df, [F.col("x")])
    assert [r["rank"] for r in ranked.orderBy("x").limit(5).collect()] == [1, 2, 3, 4, 5]
    # the one window without a key is over the ranges' totals
    above = ranked._jdf.queryExecution().optimizedPlan().toString()
    assert above.count("windowspecdefinition") == 2 and "_total" in above


def plain_cover(spark, points, contours):
    from gridlume.functions.geo import point_in_multipolygon

    met = points.crossJoin(contours).where(point_in_multipolygon(F.col("point"), F.col("polygons")))
    return {(r.id, r.c) for r in met.select("id", "c").collect()}


@pytest.mark.parametrize(("depth", "most"), [(8, 400), (3, 10), (0, 1)])
def test_points_in_contours_against_all_pairs(spark, depth, most):
    from gridlume.operators import cover

    rng = random.Random(depth)

    def ring(n, size):
        x, y = rng.uniform(-3, 3), rng.uniform(-3, 3)
        return [[x + size * rng.uniform(-1, 1), y + size * rng.uniform(-1, 1)] for _ in range(n)]

    shapes = [(i, [[ring(rng.randrange(3, 9), rng.choice([0.01, 0.3, 2.0])) for _ in range(rng.choice([1, 1, 2]))] for _ in range(rng.choice([1, 2]))]) for i in range(30)]
    shapes += [(90, None), (91, []), (92, [[]]), (93, [[[[0.0, 0.0], [1.0, 1.0]]]]), (94, [[[[0.0, 0.0], [None, 1.0], [2.0, float("inf")], [1.0, 0.0]]]]), (95, [[[[-1.0, -1.0], [1.0, -1.0], [1.0, 1.0], [-1.0, 1.0]]]])]
    contours = spark.createDataFrame(shapes, "c long, polygons array<array<array<array<double>>>>")
    corners = [(float(x), float(y)) for s in shapes[:5] for x, y in s[1][0][0]] + [(-1.0, -1.0), (1.0, 1.0), (0.0, 0.0), (-1.0, 0.5), (1.0, 0.5)]
    spots = corners + [(rng.uniform(-4, 4), rng.uniform(-4, 4)) for _ in range(200)]
    points = spark.createDataFrame([(i, (y, x)) for i, (x, y) in enumerate(spots)] + [(900, None), (901, (None, 1.0)), (902, (float("nan"), 1.0))], "id long, point struct<lat:double,lng:double>")
    got = [(r.id, r.c) for r in cover.points_in_contours(points, contours, "id", "c", depth, most).collect()]
    assert len(got) == len(set(got)) and set(got) == plain_cover(spark, points, contours) and len(got) > 50
    assert cover.points_in_contours(points, contours.limit(0), "id", "c").count() == 0


def test_most_points_inside_need_no_exact_test():
    from gridlume.operators import cover

    square = [[[[0.1, 0.1], [9.3, 0.4], [8.9, 9.2], [0.3, 8.7]]]]
    cells = cover.cover(square)
    inner = sum(4.0**-level for level, _, _, inside in cells if inside)
    border = sum(4.0**-level for level, _, _, inside in cells if not inside)
    assert border < 0.25 * inner and len(cells) <= 400
