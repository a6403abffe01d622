from math import cos, pi, sin, tau

import pytest
from pyspark.sql import functions as F

from ringforge.functions import geometry as g
from ringforge.operators import features, joins, rings


def value(spark, *cols):
    return [float(v) if v is not None else None for v in spark.range(1).select(*cols).first()]


def pt(x, y):
    return g.lit_pt(x, y)


def line(x1, y1, x2, y2):
    return g.Ln(*[F.lit(float(v)) for v in (x1, y1, x2, y2)])


def track(spark, rows, names="track_id long, idx long, x1 double, y1 double, x2 double, y2 double"):
    return spark.createDataFrame([(1, i, *[float(v) for v in r]) for i, r in enumerate(rows)], names)


def points(spark, rows):
    return spark.createDataFrame([(1, i, float(x), float(y)) for i, (x, y) in enumerate(rows)], "track_id long, idx long, x double, y double")


def xy(df, *names):
    return [tuple(round(r[n], 6) + 0.0 for n in names) for r in df.orderBy("idx").collect()]


def test_angles(spark):
    a = value(spark, g.angle_between(pt(0, 0), pt(0, 1), pt(-1, 1)), g.angle3(pt(0, 0), pt(0, 1), pt(1, 1)), g.angle3(pt(0, 0), pt(0, 1), pt(-1, 1)), g.angle3(pt(0, 0), pt(0, 1), pt(0, 2)))
    assert a[0] == pytest.approx(1.5 * pi) and abs(a[1]) == pytest.approx(pi / 2) and a[1] == pytest.approx(-a[2]) and a[3] == pytest.approx(0)
    b = value(spark, g.angle_between_lines(line(0, 0, 1, 0), line(0, 0, 2, 0)), g.angle_between_lines(line(0, 0, 1, 0), line(0, 0, -1, 0)), g.angle_between_lines(line(0, 0, 1, 0), line(0, 0, 1, 1)), g.angle_between_lines(line(0, 0, 0, 0), line(0, 0, 1, 1)))
    assert b == pytest.approx([0, pi, pi / 4, 0])
    r = g.rotate(pt(1, 0), F.lit(pi / 2))
    assert value(spark, r.x, r.y) == pytest.approx([0, 1], abs=1e-9)


def test_lines(spark):
    e = g.extend(line(0, 0, 10, 0), F.lit(2.0))
    assert value(spark, *e) == pytest.approx([-2, 0, 12, 0])
    e = g.extend(line(0, 0, 10, 0), F.lit(20.0))  # growth is capped at half the line
    assert value(spark, *e) == pytest.approx([-5, 0, 15, 0])
    e = g.extend(line(0, 0, 10, 0), F.lit(-1.0), 0.1)
    assert value(spark, *e) == pytest.approx([1, 0, 9, 0])
    s = g.set_length(line(0, 0, 10, 0), F.lit(4.0))
    assert value(spark, *s) == pytest.approx([3, 0, 7, 0])
    z = g.direction(line(1, 1, 1, 1))
    assert value(spark, *z) == [None, None]
    n = g.normalise_point(pt(0, 0))
    assert value(spark, *n) == [0, 0]


def test_crossing(spark):
    hit, p = g.crossing(line(0, 0, 2, 2), line(0, 2, 2, 0))
    assert spark.range(1).select(hit).first()[0] and value(spark, p.x, p.y) == pytest.approx([1, 1])
    for other in (line(0, 1, 2, 3), line(0, 0, 0, 0), line(3, 0, 4, 0)):  # parallel, no length, apart
        assert not spark.range(1).select(g.crossing(line(0, 0, 2, 2), other)[0]).first()[0]


def test_resample(spark):
    short = points(spark, [(0, 0), (0, 10)])
    long_ = points(spark, [(0, i) for i in range(11)])
    for p in (short, long_):
        assert xy(rings.resample(p, 2.0, False), "x", "y") == [(0, y) for y in (0, 2, 4, 6, 8, 10)]
        assert xy(rings.resample(p, 3.0, False), "x", "y")[:4] == [(0, 0), (0, 3), (0, 6), (0, 9)]
    assert xy(rings.resample(short, 2.0, True), "x", "y") == [(0, y) for y in (0, 2, 4, 6, 8, 10, 8, 6, 4, 2)]


def test_normals_of_diamond(spark):
    got = rings.normals(points(spark, [(0, -2), (-2, 0), (0, 2), (2, 0)]), 1.0)
    assert got.count() == 4
    for r in got.collect():
        assert ((r.x1 - r.x2) ** 2 + (r.y1 - r.y2) ** 2) ** 0.5 == pytest.approx(1)
        x, y = (r.x1 + r.x2) / 2, (r.y1 + r.y2) / 2
        assert abs((r.x1 - r.x2) * y - (r.y1 - r.y2) * x) == pytest.approx(0, abs=1e-9)  # along the radius
    assert rings.normals(points(spark, [(0, 0), (1, 1)])).count() == 0


def test_spline(spark):
    p = points(spark, [(-5, 0), (0, 5), (5, 0), (0, -5)])
    loop = rings.catmull_rom(p, 4, True)
    assert loop.count() == 16 and rings.catmull_rom(p, 4, False).count() == 4
    assert xy(loop.where("idx % 4 = 0"), "x", "y") == [(-5, 0), (0, 5), (5, 0), (0, -5)]  # goes through its points


TOY = [(1, 1, 4, -1), (1, 2, 4, 2), (0, 3, 0, 6), (-1, 2, -4, 2), (-1, 2, -4, -2), (-1, -2, -4, -2), (0, -3, 0, -6), (1, -2, 4, -2)]


def test_features(spark):
    octagon = [(cos(k * tau / 8), sin(k * tau / 8), 0, 0) for k in range(8)]
    f = features.features(track(spark, octagon)).collect()
    assert all(r.width == pytest.approx(1) and abs(r.angle) == pytest.approx(tau / 8) and r.offset == pytest.approx(0) for r in f)
    back = features.features(track(spark, octagon[::-1])).collect()
    assert back[0].angle == pytest.approx(-f[0].angle)
    toy = {r.idx: r.offset for r in features.features(track(spark, TOY)).collect()}
    assert toy[0] == pytest.approx(0.588, abs=1e-3) and toy[4] == pytest.approx(-0.9273, abs=1e-3)


def test_mirror_negates_turns(spark):
    t = track(spark, TOY)
    a = {r.idx: r for r in features.features(t).collect()}
    b = {r.idx: r for r in features.features(features.mirror(t)).collect()}
    for i in a:
        assert b[i].angle == pytest.approx(-a[i].angle) and b[i].offset == pytest.approx(-a[i].offset) and b[i].width == pytest.approx(a[i].width)


def test_lap_time(spark):
    t = spark.createDataFrame([(1, 0, 0.0, 0.0, 1.0, 0.0, 0.0, 5.0), (1, 1, 0.0, 10.0, 1.0, 10.0, 0.0, 5.0)], "track_id long, idx long, x1 double, y1 double, x2 double, y2 double, pos double, vel double")
    assert features.lap_time(t).first().lap_time == pytest.approx(4)


def test_missing_values_are_coded(spark):
    t = spark.createDataFrame([(1, i, *r, p, v) for i, (r, p, v) in enumerate(zip([tuple(float(x) for x in y) for y in TOY], [None, 0.0, 0.5] * 3, [1.0, None, 0.0] * 3, strict=False))], "track_id long, idx long, x1 double, y1 double, x2 double, y2 double, pos double, vel double")
    e = {r.idx: r for r in features.encode(t).collect()}
    assert (e[0].position, e[1].position, e[2].position) == (-1, -1, 0.5) and (e[0].velocity, e[1].velocity, e[2].velocity) == (1, -1, -1)
    assert features.encode(t, zero_is_missing=False).where("idx = 1").first().position == 0


def test_growing_lines_meet_the_box(spark):
    box = points(spark, [(0, 0), (0, 10), (2, 10), (2, 0)])
    halves = spark.createDataFrame([(1, i, float(x), 5.0, float(x) + 1, 5.0) for i, x in enumerate([-3, -1, -7, -5, -23])], "track_id long, idx long, x1 double, y1 double, x2 double, y2 double")
    hits = joins.extend_until_hit(halves, joins.boundary_segments(box), 5)
    got = {r.idx: (r.hx, r.hy, r.ext) for r in hits.collect()}
    assert got == {0: (0, 5, 2), 1: (0, 5, 0), 3: (0, 5, 4)}
    assert [r.idx for r in joins.missed(halves, hits).orderBy("idx").collect()] == [2, 4]


def test_nearest_and_roll(spark):
    o, p = points(spark, [(0, 0), (5, 5)]), points(spark, [(1, 0), (-1, 0), (5, 6)])
    got = {r.idx: r.near_idx for r in joins.nearest(o, p).collect()}
    assert got == {0: 0, 1: 2}  # the first of equals
    for shift in (-100, -1, 0, 1, 100):
        r = xy(rings.roll(points(spark, [(k, 0) for k in range(7)]), shift), "x")
        assert [int(v[0]) for v in r] == [(k - shift) % 7 for k in range(7)]
