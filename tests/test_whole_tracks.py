"""Lagged, stateful and bidirectional queries against brute force, over every line of every track."""

import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

from ringforge.operators import features, transforms
from ringforge.plans.queries import QUERIES, _long2
from ringforge.plans.synth import tracks

P = 5


@pytest.fixture(scope="module")
def rings(spark):
    rows = features.encode(tracks(spark, SF)).toPandas().sort_values(["track_id", "idx"])
    out = {int(t): (d[["width", "angle", "offset"]].to_numpy(float), d["velocity"].to_numpy(float)) for t, d in rows.groupby("track_id")}
    assert len({len(v) for _, v in out.values()}) > 1 and sum(len(v) for _, v in out.values()) == spark.read.parquet(f"{SF}/events.parquet").where(F.col("user_id").isNotNull()).count()
    return out


def patched(x):
    x = np.vstack([np.full((-len(x) % P, x.shape[1]), -1.0), x])
    return x.reshape(len(x) // P, -1)


def places(n):
    m = -(-n // P)
    return np.arange(m) / max(1, m - 1)


def timed(x, head, tail):
    t = np.zeros((len(x), 1))
    t[: len(head), 0] = head
    t[len(x) - len(tail) :, 0] = tail
    return np.hstack([x, t])


def left_pad(x, n):
    return np.vstack([np.full((n - len(x), x.shape[1]), -1.0), x])


def lag(a, i, longest):
    t = places(len(a))
    return left_pad(timed(patched(np.vstack([a, a[: i + 1]])), t, t[: i // P + 1]), -(-longest // P) * 2)


def bidirectional(a, i, longest):
    return left_pad(patched(np.hstack([np.roll(a, -i - 1, axis=0), np.roll(a[::-1], i, axis=0)])), -(-longest // P))


def long_form(df, *keys):
    return df.toPandas().sort_values([*keys, "j", "k"])


@pytest.mark.parametrize("brute", [lag, bidirectional], ids=lambda f: f.__name__)
def test_examples_of_each_line(spark, rings, brute):
    longest = max(len(v) for _, v in rings.values())
    t = transforms.Transform(brute.__name__, patch_size=P, time_to_vec=brute is lag)
    got = long_form(_long2(t.transform(features.encode(tracks(spark, SF))), places=3), "track_id", "idx")
    want = [brute(a, i, longest) for _, (a, _) in sorted(rings.items()) for i in range(len(a))]
    assert [tuple(k) for k in got[["track_id", "idx"]].drop_duplicates().to_numpy()] == [(t, i) for t, (a, _) in sorted(rings.items()) for i in range(len(a))]
    assert np.allclose(got["v"], np.concatenate([w.ravel() for w in want]), atol=2e-3)


def test_stateful_sequences(spark, rings):
    got = long_form(QUERIES["stateful_lag"](spark, SF), "track_id")
    want = [timed(patched(np.vstack([a, a])), places(len(a)), places(len(a))).ravel() for _, (a, _) in sorted(rings.items())]
    assert got.groupby("track_id").size().tolist() == [len(w) for w in want]
    assert np.allclose(got["v"], np.concatenate(want), atol=2e-3)


def test_stateful_targets(spark, rings):
    got = long_form(QUERIES["stateful_targets"](spark, SF), "track_id")
    want = []
    for _, (_, v) in sorted(rings.items()):
        n, late = len(v), np.roll(v, 2)
        m = -(-n // P)
        want.append(np.concatenate([[late[(n - P * (m - i + 1) + k) % n] for k in range(3 * P)] for i in range(m)]))
    assert got.groupby("track_id").size().tolist() == [len(w) for w in want]
    assert np.allclose(got["v"], np.concatenate(want), atol=1e-3)


@pytest.mark.parametrize("name", ["detransform_lag", "detransform_stateful", "detransform_bidirectional"])
def test_every_line_comes_back(spark, rings, name):
    got = QUERIES[name](spark, SF).toPandas().sort_values(["track_id", "idx"])
    assert got.groupby("track_id").size().tolist() == [len(v) for _, (_, v) in sorted(rings.items())]
    assert np.allclose(got["y_velocity"], np.concatenate([v for _, (_, v) in sorted(rings.items())]), atol=1e-3)
