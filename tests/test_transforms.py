import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ringforge.operators import bounds, transforms
from ringforge.operators.transforms import Transform

SCHEMA = "track_id long, idx long, width double, angle double, offset double, position double, velocity double"


def encoded(spark, *sizes, seed=1):
    rng = random.Random(seed)
    return spark.createDataFrame([(t, i, *[rng.random() for _ in range(5)]) for t, n in enumerate(sizes) for i in range(n)], SCHEMA)


def arrays(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.track_id, r.idx)):
        out.setdefault(r.track_id, []).append((r.width, r.angle, r.offset, r.position, r.velocity))
    return {k: np.array(v) for k, v in out.items()}


CASES = [
    Transform("window", foresight=9, sampling=2), Transform("flat-window", foresight=2, sampling=7), Transform("bidirectional", patch_size=3, sampling=1), Transform("bidirectional"),
    Transform("lag", lag=2, sampling=1, patch_size=3), Transform("lag", lag=5, patch_size=10), Transform("lag", lag=3, sampling=2, time_to_vec=True),
    Transform("stateful-lag", lag=2, sampling=1, patch_size=3), Transform("stateful-lag", lag=1, sampling=3, patch_size=5, time_to_vec=True),
]


@pytest.mark.parametrize("t", CASES, ids=lambda t: f"{t.method}-{t.lag}-{t.sampling}-{t.patch_size}")
def test_inverse(spark, t):
    e = encoded(spark, 6, 13, 4)
    x = t.transform(e)
    for c in ("position", "velocity"):
        got = {(r.track_id, r.idx): r[f"y_{c}"] for r in t.detransform(x, f"y_{c}").collect()}
        want = {(r.track_id, r.idx): r[c] for r in e.collect()}
        assert got.keys() == want.keys()
        assert all(got[k] == pytest.approx(want[k]) for k in want)


def shape(x):
    return np.array(x).shape


@pytest.mark.parametrize(
    ("t", "want"),
    [
        (Transform("bidirectional"), (6, 6)), (Transform("bidirectional", patch_size=7), (1, 42)), (Transform("bidirectional", patch_size=3), (2, 18)), (Transform("bidirectional", patch_size=5), (2, 30)),
        (Transform("lag"), (12, 3)), (Transform("lag", patch_size=3), (4, 9)), (Transform("lag", patch_size=3, time_to_vec=True), (4, 10)), (Transform("lag", patch_size=10), (2, 30)), (Transform("lag", patch_size=10, time_to_vec=True), (2, 31)),
    ],
)
def test_shapes(spark, t, want):
    rows = t.transform(encoded(spark, 6)).collect()
    assert len(rows) == 6 and all(shape(r.x) == want for r in rows)


def patchify(x, p):
    missing = -len(x) % p
    x = np.vstack([np.full((missing, x.shape[1]), -1.0), x]) if missing else x
    return x.reshape(len(x) // p, -1)


def left_pad(x, n):
    return np.vstack([np.full((n - len(x), x.shape[1]), -1.0), x])


def test_lag_values(spark):
    e = encoded(spark, 7, 11)
    tracks, longest, p = arrays(e), 11, 4
    for r in Transform("lag", patch_size=p).transform(e).collect():
        a = tracks[r.track_id][:, :3]
        want = left_pad(patchify(np.vstack([a, a[: r.idx + 1]]), p), -(-longest // p) * 2)
        assert np.allclose(np.array(r.x), want, atol=1e-6)


def test_bidirectional_values(spark):
    e = encoded(spark, 7, 11)
    tracks, p = arrays(e), 4
    for r in Transform("bidirectional", patch_size=p).transform(e).collect():
        a = tracks[r.track_id][:, :3]
        both = np.hstack([np.roll(a, -r.idx - 1, axis=0), np.roll(a[::-1], r.idx, axis=0)])
        assert np.allclose(np.array(r.x), left_pad(patchify(both, p), -(-11 // p)), atol=1e-6)


def test_window_values(spark):
    e = encoded(spark, 5)
    a = arrays(e)[0]
    for r in Transform("flat-window", foresight=4).transform(e).collect():
        want = np.concatenate([[a[(r.idx + k) % 5, c] for k in range(-4, 5)] for c in range(3)])
        assert np.allclose(r.x, want, atol=1e-6)


def test_refused():
    for bad in ({"method": "none"}, {"method": "window", "lag": 1}, {"method": "flat-window", "patch_size": 2}, {"method": "bidirectional", "lag": 1}):
        with pytest.raises(ValueError):
            Transform(**bad)


def test_bounds_and_scaling(spark):
    e = encoded(spark, 6, 9).withColumn("velocity", F.when(F.col("idx") == 0, -1.0).otherwise(F.col("velocity") * 50))
    b = bounds.bounds(e)
    r, a = b.first(), np.vstack(list(arrays(e).values()))
    assert r.max_width == pytest.approx(a[:, 0].max()) and r.min_velocity == pytest.approx(np.abs(a[:, 4]).min())
    halves = bounds.merge(bounds.bounds(e.where("track_id = 0")), bounds.bounds(e.where("track_id = 1"))).first()
    assert all(halves[c] == pytest.approx(r[c]) for c in bounds.SCALARS)
    n = bounds.normalise(e, b).collect()
    assert max(x.width for x in n) == pytest.approx(1) and min(x.width for x in n) == pytest.approx(0) and max(abs(x.angle) for x in n) == pytest.approx(1)
    flat = bounds.normalise(e.withColumn("width", F.lit(3.0)), bounds.bounds(e.withColumn("width", F.lit(3.0)))).first()
    assert flat.width == 0  # a range of 0


def test_vehicles(spark):
    v = spark.createDataFrame([(1, {"Mass": 2.0, "trackFront": 1.0}), (2, {"mass": 4.0, "track_front": 1.0})], "track_id long, vehicle map<string,double>")
    vec = bounds.vehicle_vector(v, ("mass", "track_front"))
    assert [r.vehicle for r in vec.orderBy("track_id").collect()] == [[2, 1], [4, 1]]
    scaled = bounds.normalise_vehicles(vec, bounds.vehicle_bounds(vec))
    assert [r.vehicle for r in scaled.orderBy("track_id").collect()] == [[0, 0], [1, 0]]
    with pytest.raises(Exception, match="vehicle lacks yaw_inertia"):
        bounds.vehicle_vector(v, ("yaw_inertia",)).collect()


def test_patchify_sizes(spark):
    for n, p in ((13, 5), (6, 3), (6, 10), (4, 1)):
        a = np.arange(n * 2.0).reshape(n, 2)
        df = spark.createDataFrame([(a.tolist(), n)], "v array<array<double>>, n int")
        got = df.select(transforms.patchify(F.col("v"), F.col("n"), p, 2).alias("x")).first().x
        assert np.allclose(np.array(got), patchify(a, p))
