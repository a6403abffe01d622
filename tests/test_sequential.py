import functools

import numpy as np
import pytest
from pyspark.sql import functions as F

from ringforge.operators import evaluation, joins, model, rings, sequential, splice, sweep
from ringforge.plans import pipelines, synth

SF = "/root/testdata/sf0.001"


def test_circular_nearest():
    assert sequential.circular_nearest(10, [5, 20, 100], 100) == 5
    assert sequential.circular_nearest(99, [5, 20, 90], 100) == 5
    assert sequential.circular_nearest(2, [30, 20, 99], 100) == 99


def test_collapse_follows_the_boundary():
    hits = [[(0, 0.0, 0.0), (4, 9.0, 9.0)], [(2, 1.0, 0.0)], [(4, 2.0, 0.0), (7, 9.0, 9.0)], [(6, 3.0, 0.0), (1, 9.0, 9.0)]]
    assert sequential.collapse(hits, np.zeros((4, 2)), 8) == [(0, 0), (1, 0), (2, 0), (3, 0)]
    double = [[(i, float(i), 0.0), ((i + 4) % 8, float(i), 9.0)] for i in range(4)]
    got = sequential.collapse(double, np.array([[i, 0.5] for i in range(4)], float), 8)
    assert got in ([(i, 0) for i in range(4)], [(i, 9) for i in range(4)]) or len(got) == 4
    with pytest.raises(ValueError):
        sequential.collapse([[], [(1, 0.0, 0.0)]], np.zeros((2, 2)), 8)


def valley(costs, start):
    """The local minimum that a descent from start ends in: onward (not to the last place), then back."""
    last = len(costs) - 1
    top = next(f for f in range(start, last + 1) if f + 1 >= last or costs[f + 1] >= costs[f])
    return next(b for b in range(top, -1, -1) if b == 0 or costs[b - 1] >= costs[b])


def recurrence(lines, steps):
    """T(0, s) = 0 and T(i, s) = |P(i, s) - P(i - 1, c)| + T(i - 1, c), c being the valley of that sum from s: places of the least T of the last line."""
    point = lambda i, s: lines[i, :2] + (lines[i, 2:] - lines[i, :2]) * s / steps

    @functools.cache
    def least(i, s):
        if i == 0:
            return 0.0, None
        sums = [np.linalg.norm(point(i, s) - point(i - 1, c)) + least(i - 1, c)[0] for c in range(steps + 1)]
        c = valley(sums, s)
        return sums[c], c

    s = min(range(steps + 1), key=lambda s: least(len(lines) - 1, s)[0])
    places = []
    for i in reversed(range(len(lines))):
        places.append(s / steps)
        s = least(i, s)[1]
    return places[::-1]


def ring(n=24, seed=4):
    rng = np.random.default_rng(seed)
    th = np.arange(n) / n * 2 * np.pi
    r, w = 100 + 8 * np.sin(3 * th), 5 + rng.random(n)
    return np.stack([(r - w) * np.cos(th), (r - w) * np.sin(th), (r + w) * np.cos(th), (r + w) * np.sin(th)], 1)


@pytest.mark.parametrize("seed", [4, 5, 6])
def test_walk_follows_the_recurrence(seed):
    lines = ring(seed=seed)
    assert np.allclose(sequential.walk_path(lines, 20), recurrence(lines, 20))


def test_shortest_is_shorter_than_the_middle():
    lines = ring(60)
    inset, t = sequential.shortest(lines)
    length = lambda p: np.hypot(*(np.roll(p, -1, axis=0) - p).T).sum()
    assert length(inset[:, :2] + (inset[:, 2:] - inset[:, :2]) * t[:, None]) < length((lines[:, :2] + lines[:, 2:]) / 2)
    assert ((t >= 0) & (t <= 1 + 1e-9)).all()


def test_shortest_path_query_settles(spark, monkeypatch):
    from ringforge.plans import queries

    th = 2 * np.pi * np.arange(100) / 100
    r = 300 + 40 * np.sin(3 * th)
    lines = np.stack([(r - 100) * np.cos(th), (r - 100) * np.sin(th), (r + 100) * np.cos(th), (r + 100) * np.sin(th)], 1)
    want = sequential.shortest(lines)[1]
    assert abs(sequential.shortest(lines, most=200)[1] - want).max() > 4e-4  # a wide ring takes 257 sweeps
    wide = spark.createDataFrame([(1, i, *x) for i, x in enumerate(lines.tolist())], "track_id long, idx long, x1 double, y1 double, x2 double, y2 double")
    monkeypatch.setattr(queries, "tracks", lambda *_: wide)
    got = [r.interpolation for r in queries.QUERIES["shortest_path"](spark, SF).orderBy("idx").collect()]
    assert np.allclose(got, want, atol=1e-4)


def test_smoothing_keeps_centres_and_width():
    lines = ring()
    out = sequential.smooth_lines(lines, 50, 12.0)
    assert np.allclose((out[:, :2] + out[:, 2:]) / 2, (lines[:, :2] + lines[:, 2:]) / 2)
    assert np.allclose(np.hypot(*(out[:, :2] - out[:, 2:]).T), 12)
    assert (((out[:, :2] - out[:, 2:]) * (lines[:, :2] - lines[:, 2:])).sum(1) > 0).all()  # left stays left


def test_tracks_smoothed_together_are_as_alone(spark, monkeypatch):
    import pandas as pd

    sizes, parts = (5, 24, 60, 7, 40, 3), []
    for t, n in enumerate(sizes):
        x = ring(n, t)
        parts.append(pd.DataFrame({"track_id": t, "idx": np.arange(n), "x1": x[:, 0], "y1": x[:, 1], "x2": x[:, 2], "y2": x[:, 3], "width": 10.0 + t}))
    df = spark.createDataFrame(pd.concat(parts).sample(frac=1, random_state=1))
    for most in (30, 50_000):
        monkeypatch.setattr(sequential, "SMOOTHED", most)
        got = sequential.smooth_normals(df.repartition(3), 20).toPandas().sort_values(["track_id", "idx"])
        want = np.concatenate([sequential.smooth_lines(ring(n, t), 20, 10.0 + t) for t, n in enumerate(sizes)])
        assert np.allclose(got[["x1", "y1", "x2", "y2"]].to_numpy(), want)


def test_bad_tracks_give_errors(spark):
    t = synth.tracks(spark, SF).where("track_id in (1, 2)")
    broken = t.withColumn("x2", t.x1).withColumn("y2", t.y1).where("track_id = 1").unionByName(t.where("track_id = 2"))
    out = sequential.shortest_path(broken, most=20)
    assert [r.track_id for r in sequential.errors(out).collect()] == [1]
    assert sequential.good(out).select("track_id").distinct().first()[0] == 2


def test_cut_and_smooth(spark):
    t = synth.tracks(spark, SF).where("track_id = 3")
    out = sequential.smooth_track(t, 60.0, 20).collect()
    assert out and all(r.error is None for r in out)
    widths = [np.hypot(r.x1 - r.x2, r.y1 - r.y2) for r in out]
    assert 5 < min(widths) and max(widths) < 60
    x = sequential.to_xyrl(t, 60.0).collect()
    assert x and all(r.l > 0 and r.r > 0 for r in x)


LINE = "track_id long, idx long, x1 double, y1 double, x2 double, y2 double"
POINT = "track_id long, idx long, x double, y double"


def wavy(t, seed, n=30):
    """Lines across a ring, and its boundaries: wavy, with stretches that lines cross several times, and beyond what some lines reach."""
    rng = np.random.default_rng(seed)
    lines = ring(n, seed)
    th = np.arange(4 * n) / (4 * n) * 2 * np.pi + rng.normal(0, 0.08, 4 * n)  # back and forth
    sides = [(100 + 8 * np.sin(3 * th) + w * (8 + 4 * np.sin(5 * th)) + rng.normal(0, 2, len(th)))[:, None] * np.stack([np.cos(th), np.sin(th)], 1) for w in (-1, 1)]
    return [(t, i, *x) for i, x in enumerate(lines.tolist())], *[[(t, i, *x) for i, x in enumerate(s.tolist())] for s in sides]


@pytest.mark.parametrize("pairs", [7, 1_000_000])
@pytest.mark.parametrize("cell", [None, 0.01, 1000.0])
def test_first_hits_are_those_of_the_join(spark, monkeypatch, pairs, cell):
    monkeypatch.setattr(sequential, "PAIRS", pairs)
    all_ = [wavy(t, t) for t in range(3)]
    lines, left, _ = [spark.createDataFrame(sum((a[k] for a in all_), []), POINT if k else LINE) for k in range(3)]
    half, seg = joins.split_halves(lines)[0], joins.boundary_segments(left)
    want = sorted((r.track_id, r.idx, r.seg_idx, round(r.hx, 9), round(r.hy, 9)) for r in joins.extend_until_hit(half, seg).collect())
    h, s = [x.toPandas().sort_values(["track_id", "idx"]).reset_index(drop=True) for x in (half, seg)]
    box = ["x1", "y1", "x2", "y2"]
    i, j, at = sequential.first_hits(h[box].to_numpy(), h.track_id.to_numpy(), s[box].to_numpy(), s.track_id.to_numpy(), np.full(3, cell or 12.0))
    assert sorted((h.track_id[a], h.idx[a], s.idx[b], round(x, 9), round(y, 9)) for a, b, (x, y) in zip(i, j, at.tolist(), strict=True)) == want
    assert len(want) > len({w[:2] for w in want})  # some meet it more than once


@pytest.mark.parametrize("most", [30, 50_000])
def test_cut_joins_nothing_and_loses_nothing(spark, monkeypatch, most):
    """A plan with joins let the planner broadcast tables by the size of the files they come from."""
    monkeypatch.setattr(sequential, "SMOOTHED", most)
    all_ = [wavy(t, t) for t in range(5)]
    lines, left, right = [sum((a[k] for a in all_), []) for k in range(3)]
    lines[40] = (1, 10, 0.0, 0.0, 1e-3, 0.0)  # meets nothing
    left = [p for p in left if p[0] != 2]  # no boundary
    left[3] = (*left[3][:2], None, None)
    frames = [spark.createDataFrame(x, s).repartition(3) for x, s in ((lines, LINE), (left, POINT), (right, POINT))]
    cut = sequential.cut_to_boundaries(*frames)
    assert "Join" not in cut._jdf.queryExecution().executedPlan().toString()
    got = cut.collect()
    assert [(r.track_id, r.idx, r.error) for r in got if r.error] == [(1, None, "ValueError: a line does not meet the boundary")]
    ends = {(r.track_id, r.idx): ((r.x1, r.y1), (r.x2, r.y2)) for r in got if not r.error}
    assert set(ends) == {x[:2] for x in lines if x[0] in (0, 3, 4)}
    hits = {}
    for k, (half, points) in enumerate(zip(joins.split_halves(frames[0]), frames[1:], strict=True)):
        for r in joins.extend_until_hit(half, joins.boundary_segments(points)).collect():
            hits.setdefault((r.track_id, r.idx, k), []).append((r.seg_idx, r.hx, r.hy))
    for t in (0, 3, 4):
        own = np.array([x[2:] for x in lines if x[0] == t])
        for k, points in enumerate((left, right)):
            mine = [sorted(hits[t, i, k]) for i in range(len(own))]
            centre = (own[:, :2] + own[:, 2:]) / 2
            want = sequential.collapse(mine, (centre + own[:, 2 * k : 2 * k + 2]) / 2, sum(p[0] == t for p in points))
            assert np.allclose([ends[t, i][k] for i in range(len(own))], want)


@pytest.mark.parametrize("spacing", [None, 30.0])
def test_smooth_track_deals_once(spark, monkeypatch, spacing):
    """The same as by its parts, without writing smoothed lines down and without boundary curves that are dealt point by point."""
    t = synth.tracks(spark, SF).where("track_id in (1, 3, 5)")
    lines = t.select("track_id", "idx", "x1", "y1", "x2", "y2")
    width = lines.groupBy("track_id").agg((F.max(F.hypot(F.col("x1") - F.col("x2"), F.col("y1") - F.col("y2"))) * 2).alias("width"))
    if spacing:
        mid = rings.lines_to_points(lines, "mid")
        steps = rings.path_length(mid).withColumn("step", F.col("length") / F.floor(F.col("length") / spacing))
        lines = rings.normals_on_path_by(rings.catmull_rom(mid, 5), 80.0, steps)
    smooth = sequential.good(sequential.smooth_normals(lines.join(width, "track_id"), 20))
    want = sequential.cut_to_boundaries(smooth, *[rings.catmull_rom(rings.lines_to_points(t, s), 5) for s in ("left", "right")]).toPandas()
    monkeypatch.setattr(type(t), "checkpoint", lambda self, *a: pytest.fail("it writes rows between steps"))
    out = sequential.smooth_track(t, spacing, 20)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInPandas") == 1 and "Broadcast" not in plan
    got, want = [x.sort_values(["track_id", "idx"]).drop(columns="error").to_numpy(float) for x in (out.toPandas(), want)]
    assert len(got) and np.allclose(got, want, atol=1e-9)


def test_to_xyrl_broadcasts_no_lines(spark):
    x = sequential.to_xyrl(synth.tracks(spark, SF).where("track_id = 3"), 60.0)
    plan = x._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_nearest_broadcasts_no_points(spark):
    t = synth.tracks(spark, SF)
    n = joins.nearest(rings.lines_to_points(t, "mid"), synth.path(spark, SF))
    plan = n._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and n.count() == t.count()


def test_curve_is_the_spline(spark):
    rng = np.random.default_rng(2)
    rows = [(t, i, *x) for t, n in enumerate((1, 2, 3, 9)) for i, x in enumerate(rng.random((n, 2)).tolist())]
    rows[-3] = (*rows[-3][:2], *rows[-4][2:])  # a repeated point
    want = rings.catmull_rom(spark.createDataFrame(rows, POINT), 5).toPandas().sort_values(["track_id", "idx"])
    xy, of, idx = sequential.curve(np.array([r[2:] for r in rows]), np.array([r[0] for r in rows]), 5)
    assert (of == want.track_id).all() and (idx == want.idx).all()
    assert np.allclose(xy, want[["x", "y"]], equal_nan=True) and np.isnan(xy).any()


def test_splice(spark):
    t, p = synth.tracks(spark, SF), synth.path(spark, SF)
    whole, failed = splice.whole_tracks(splice.splice(t, p))
    n = t.select("track_id").distinct().count()
    assert whole.select("track_id").distinct().count() + failed.count() == n
    assert whole.where("pos < 0 or pos > 1").count() == 0
    r = splice.splice(t, p, precision=0).where("error is null").select("pos").distinct().collect()
    assert {x.pos for x in r} <= {0.0, 1.0}
    mid = splice.splice(t).where("error is null").agg({"pos": "avg", "vel": "max"}).first()
    assert mid[0] == pytest.approx(0.5, abs=0.01) or mid[1] == pytest.approx(0.5, abs=0.01)


def test_null_apexes_are_kept_null(spark):
    t = synth.tracks(spark, SF).where("track_id < 5").withColumn("pos", F.lit(0.5))
    e = evaluation.evaluate(t, t).collect()
    assert all(r.position_apex_mean is None and r.apexes == [] and r.position_max == 0 for r in e)


def test_model_heads():
    x = np.zeros((2, 3))
    w = {"hidden": [(np.zeros((3, 4)), np.zeros(4))], "heads": [(np.ones((4, 2)), np.zeros(2)), (np.full((4, 2), 10.0), np.zeros(2))]}
    a, b = model.forward(x, w)
    assert np.allclose(a, (2 + 2.5) / 5) and np.allclose(b, 1)


def test_sweep(spark):
    runs = spark.createDataFrame([("a", 1.0, 9.0, 5.0), ("a", 2.0, 8.0, 6.0), ("a", 3.0, 8.0, 7.0)], "run string, param_1 double, lap_time double, predicted double")
    r = sweep.optimum(runs, "run").first()
    assert (r.param_1, r.pred_param_1, r.lap_delta) == (2, 1, 1)
    assert [round(x.value, 3) for x in sweep.grid(spark, 0, 1, 5).orderBy("step").collect()] == [0, 0.25, 0.5, 0.75, 1]


def test_partitions(spark):
    names = spark.createDataFrame([(f"t{k}",) for k in range(10)], "name string")
    p = pipelines.assign_partitions(pipelines.enumerate_tracks(names, flip=True), 3)
    n = {r.partition_id: r["count"] for r in p.groupBy("partition_id").count().collect()}
    assert n == {0: 7, 1: 7, 2: 6}
