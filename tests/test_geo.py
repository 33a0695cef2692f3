"""Bounds, polygons, components and polylines."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridlume.functions import geo as G
from gridlume.operators import spatial


def box(*v):
    return G.bounds(*map(F.lit, map(float, v)))


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def test_keys(spark):
    assert one(spark, G.bounds_key(G.snapped(box(48.8151, 2.2241, 48.901, 2.469), 0.01))) == "48.8100,2.2200,48.9100,2.4700"
    b = one(spark, G.padded(box(48, 2, 49, 3), 0.04))
    assert [round(x, 6) for x in b] == [47.96, 1.96, 49.04, 3.04]
    assert one(spark, G.bounds_key(G.snapped(G.padded(box(48.8, 2.2, 48.9, 2.4), 0.08), 0.005))) == "48.7900,2.1800,48.9100,2.4200"


def test_limits(spark):
    got = [one(spark, G.within_limits(box(*b))) for b in ((48.7, 2.0, 49.1, 2.7), (48.5, 2.0, 49.1, 2.6), (48.7, 1.5, 48.9, 2.6))]
    assert got == [True, False, False]  # the second is too large by its area alone


def test_parse(spark):
    rows = [("48oops", "1", "2", "3"), ("48", "2", None, None), ("49", "2", "48", "3"), (None,) * 4, ("48", "2", "48", "3"), ("48", "3", "49", "2"), ("-91", "2", "48", "3")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, s string, w string, n string, e string").orderBy("i")
    got = [r.p for r in df.select(G.parse_bounds({"south": F.col("s"), "west": F.col("w"), "north": F.col("n"), "east": F.col("e")}).alias("p")).collect()]
    assert [g.error for g in got] == ["invalid south", "missing north", None, None, "bounds must have a positive area", "bounds crossing the antimeridian are not supported", "south must be between -90 and 90"]
    assert tuple(got[2].bounds) == (48, 2, 49, 3) and not got[3].present


def test_hole(spark):
    rings = F.expr("array(array(array(0D,0D),array(4D,0D),array(4D,4D),array(0D,4D)), array(array(1D,1D),array(3D,1D),array(3D,3D),array(1D,3D)))")
    at = lambda y, x: F.struct(F.lit(float(y)).alias("lat"), F.lit(float(x)).alias("lng"))
    assert [one(spark, G.point_in_polygon(at(y, x), rings)) for y, x in ((0.5, 0.5), (2, 2), (5, 5))] == [True, False, False]


def test_coverage(spark):
    ring = F.expr("array(array(array(array(2.3D,48.8D),array(2.4D,48.8D),array(2.4D,48.9D),array(2.3D,48.9D),array(2.3D,48.8D))))")
    assert one(spark, G.inside_contours(box(48.82, 2.32, 48.88, 2.38), ring))
    assert not one(spark, G.inside_contours(box(48.82, 2.32, 48.92, 2.38), ring))


def test_nearest_component(spark):
    line = lambda a, b: [(48.85, a), (48.85, b)]
    rows = [("s", 0, line(2.35, 2.351)), ("s", 1, line(2.3512, 2.352)), ("s", 2, line(2.36, 2.361))]
    lines = spark.createDataFrame(rows, "key string, idx int, line array<struct<lat:double,lng:double>>")
    for point, kept in (((48.85, 2.35), {0, 1}), ((49.0, 3.0), set())):
        points = spark.createDataFrame([("s", point)], "key string, point struct<lat:double,lng:double>")
        got = {r.idx for r in spatial.nearest_components(lines, points, "key").collect() if r.kept}
        assert got == kept


def test_chain():
    got = spatial.chain_lines([np.array([[2, 48], [2.1, 48.1]]), np.array([[2.2, 48.2], [2.1, 48.1]]), np.array([[3, 49], [3.1, 49.1]])])
    assert len(got) == 2 and got[0].tolist() == [[2, 48], [2.1, 48.1], [2.2, 48.2]]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(*[st.floats(48, 48.003), st.floats(2, 2.003)] * 2), min_size=1, max_size=25))
def test_components_by_brute_force(ends):
    ends = np.array(ends)
    n = len(ends)
    label = list(range(n))
    scale = np.pi * 6_371_000 / 180
    for _ in range(n):
        for i in range(n):
            for j in range(n):
                for a in (0, 2):
                    for b in (0, 2):
                        mid = np.radians((ends[i, a] + ends[j, b]) / 2)
                        if np.hypot((ends[i, a + 1] - ends[j, b + 1]) * scale * np.cos(mid), (ends[i, a] - ends[j, b]) * scale) <= 35:
                            label[i] = label[j] = min(label[i], label[j])
    assert spatial.label_segments(ends).tolist() == label


def test_merge_frame(spark):
    rows = [("k", 0, [(48.0, 2.0), (48.1, 2.1)]), ("k", 1, [(48.2, 2.2), (48.1, 2.1)]), ("k", 2, [(49.0, 3.0)]), ("k", 3, [])]
    df = spark.createDataFrame(rows, "key string, idx int, line array<struct<lat:double,lng:double>>")
    assert [r.line for r in spatial.merge_polylines(df, "key").collect()] == [[[2.0, 48.0], [2.1, 48.1], [2.2, 48.2]]]


def test_boxes_of_all_sizes(spark):
    """Every pair that overlaps, once; reversed and null boxes overlap nothing."""
    import random

    from gridlume.functions import geo
    from gridlume.operators import spatial

    rng = random.Random(3)

    def box():
        size = rng.choice([0, 0.001, 0.05, 0.2, 3, 40, 200])
        s, w = rng.uniform(-80, 60), rng.uniform(-170, 100)
        return (s, w, s + size * rng.random(), w + size * rng.random())

    a, b = [(i, *box()) for i in range(150)], [(i, *box()) for i in range(150)]
    a += [(900, 10.0, 10.0, 5.0, 12.0), (901, None, 1.0, 2.0, 3.0), (902, -90.0, -180.0, 90.0, 180.0)]
    b += [(900, -90.0, -180.0, 90.0, 180.0), *[(1000 + i, 1.0, 1.0, 1.0, 1.0) for i in range(20)]]
    make = lambda rows, k, c: spark.createDataFrame(rows, f"{k} long, s double, w double, n double, e double").select(k, geo.bounds(F.col("s"), F.col("w"), F.col("n"), F.col("e")).alias(c))
    got = [(r.a, r.b) for r in spatial.bbox_join(make(a, "a", "ab"), make(b, "b", "bb"), "ab", "bb", "a", "b", 0.1).collect()]
    want = {(p[0], q[0]) for p in a for q in b if p[1] is not None and p[1] <= p[3] and p[2] <= p[4] and p[1] <= q[3] and q[1] <= p[3] and p[2] <= q[4] and q[2] <= p[4]}
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 300


def test_one_null_feature_spoils_a_collection(spark):
    from gridlume.operators import features

    one = '{"type":"Feature","geometry":{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1],[0,0]]]}}'
    rows = [("a", f'{{"type":"FeatureCollection","features":[{one}]}}'), ("b", f'{{"type":"FeatureCollection","features":[null,{one}]}}'), ("c", '{"type":"FeatureCollection","features":[]}')]
    got = features.area_features(spark.createDataFrame(rows, "key string, text string")).collect()
    assert [r.key for r in got] == ["a"]


def test_chains_against_brute_force():
    """The greedy rule written plainly: take the first line, and again and again the first of the others that fits."""
    import random

    from gridlume.operators.spatial import chain_lines, thin_line

    def plainly(lines):
        waiting, done = list(lines), []
        near = lambda p, q: max(abs(p - q)) <= 0.000035
        while waiting:
            now, again = waiting.pop(0), True
            while again:
                again = False
                for i, o in enumerate(waiting):
                    if not len(now) or not len(o):
                        continue
                    pair = (now, o) if near(now[-1], o[0]) else (now, o[::-1]) if near(now[-1], o[-1]) else (o, now) if near(now[0], o[-1]) else (o[::-1], now) if near(now[0], o[0]) else None
                    if pair:
                        now, again = thin_line(np.concatenate([pair[0], pair[1][1:]])), True
                        del waiting[i]
                        break
            done.append(now)
        return sorted(done, key=lambda x: -len(x))

    rng = random.Random(5)
    for _ in range(60):
        nodes = [(rng.randrange(4) * 0.001 + rng.choice([0, 0.00002, 0.0000005]), rng.randrange(4) * 0.001) for _ in range(30)]
        lines = [thin_line(np.array([rng.choice(nodes) for _ in range(rng.choice([0, 2, 2, 3, 5]))], float).reshape(-1, 2)) for _ in range(rng.randrange(14))]
        got, want = chain_lines(lines), plainly(lines)
        assert [x.tolist() for x in got] == [x.tolist() for x in want]
    long_ = [np.array([[i * 0.001, 0.0], [(i + 1) * 0.001, 0.0]]) for i in range(20_000)]
    rng.shuffle(long_)
    assert sum(len(x) for x in chain_lines(long_)) >= 20_001
