"""One query per operator group, over ring tracks derived from the driver's tables (see synth), and its SQL for comparison.

Arrays are compared in long form (track_id, idx, k, value); floating results are rounded in both."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..operators import bounds, evaluation, features, joins, rings, sequential, splice, sweep, transforms
from ..operators.model import predict
from ..sources import readers
from . import pipelines
from .oracles import SQL, fixed_weights
from .synth import path, predicted, tracks

KEY = ("track_id", "idx")
QUERIES: dict[str, Callable] = {}


def query(f: Callable) -> Callable:
    QUERIES[f.__name__] = f
    return f


def rnd(c: Column | str, name: str | None = None, places: int = 4) -> Column:
    c = F.col(c) if isinstance(c, str) and (name := name or c) else c
    v = F.round(c, places)
    return F.when(v == 0, 0.0).otherwise(v).alias(name)


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- scalar geometry ---


@query
def geometry_points(spark, sf_dir):
    """Rotation, interpolation, unit vectors, distance of neighbouring points."""
    t = tracks(spark, sf_dir)
    a, b = g.ln().start, g.ln().end
    r, m, u = g.rotate(a, F.lit(0.5), b), g.lerp(a, b, F.lit(0.25)), g.normalise_point(g.sub(b, a))
    return t.select(*KEY, rnd(r.x, "rx"), rnd(r.y, "ry"), rnd(m.x, "mx"), rnd(m.y, "my"), rnd(u.x, "ux"), rnd(u.y, "uy"), rnd(g.distance(a, b), "d"), rnd(g.line_angle(g.ln()), "la"))


@query
def geometry_lines(spark, sf_dir):
    """Centres, lengths, directions, resizing and extension of lines."""
    t, line = tracks(spark, sf_dir), g.ln()
    c, d, s, e, cap = g.center(line), g.direction(line), g.set_length(line, F.lit(3.0)), g.extend(line, F.lit(2.0)), g.extend(line, F.lit(20.0))
    cols = {"cx": c.x, "cy": c.y, "len": g.length(line), "dx": d.x, "dy": d.y, "sx": s.x1, "sy": s.y2, "ex": e.x1, "ey": e.y2, "capx": cap.x2, "capy": cap.y1}
    return t.select(*KEY, *[rnd(v, k) for k, v in cols.items()])


@query
def geometry_angles(spark, sf_dir):
    """Turns between neighbouring centres, and the angle between neighbouring lines."""
    t = tracks(spark, sf_dir)
    nxt = rings.neighbour(F.struct("x1", "y1", "x2", "y2"), 1)
    t = t.withColumn("_n", nxt)
    other = g.Ln(*[F.col(f"_n.{c}") for c in ("x1", "y1", "x2", "y2")])
    a = g.angle_between(g.ln().start, g.ln().end, other.end)
    return t.select(*KEY, rnd(a, "turn"), rnd(a - g.pi, "turn3"), rnd(g.angle_between_lines(g.ln(), other), "between"))


@query
def interpolated_points(spark, sf_dir):
    t = rings.interpolate_between(tracks(spark, sf_dir), g.ln().start, g.ln().end, 3)
    return t.select(*KEY, F.col("k").cast("long").alias("k"), rnd("x"), rnd("y"))


@query
def midline(spark, sf_dir):
    """Middle, left and right line."""
    t = tracks(spark, sf_dir)
    sides = {s: rings.lines_to_points(t, s) for s in ("mid", "left", "right")}
    out = None
    for name, df in sides.items():
        df = df.select(*KEY, F.lit(name).alias("side"), rnd("x"), rnd("y"))
        out = df if out is None else out.union(df)
    return out


@query
def optimal_positions(spark, sf_dir):
    return features.optimal_positions(tracks(spark, sf_dir)).select(*KEY, rnd("x"), rnd("y"))


@query
def half_lines(spark, sf_dir):
    a, b = joins.split_halves(tracks(spark, sf_dir))
    a, b = [d.select(*KEY, F.lit(s).alias("side"), *[rnd(c) for c in ("x1", "y1", "x2", "y2")]) for d, s in ((a, "L"), (b, "R"))]
    return a.union(b)


# --- rings ---


@query
def track_length(spark, sf_dir):
    return rings.path_length(rings.lines_to_points(tracks(spark, sf_dir), "mid")).select("track_id", rnd("length"))


@query
def ring_roll(spark, sf_dir):
    return rings.roll(tracks(spark, sf_dir), -7).select(*KEY, rnd("vel"))


@query
def ring_segments(spark, sf_dir):
    return rings.points_to_lines(rings.lines_to_points(tracks(spark, sf_dir), "left")).select(*KEY, *[rnd(c) for c in ("x1", "y1", "x2", "y2")])


@query
def ring_normals(spark, sf_dir):
    return rings.normals(rings.lines_to_points(tracks(spark, sf_dir), "mid"), 10).select(*KEY, *[rnd(c) for c in ("x1", "y1", "x2", "y2")])


@query
def resample_loop(spark, sf_dir):
    return rings.resample(rings.lines_to_points(tracks(spark, sf_dir), "mid"), 97.0, True).select(*KEY, rnd("x", places=3), rnd("y", places=3))


@query
def resample_open(spark, sf_dir):
    return rings.resample(rings.lines_to_points(tracks(spark, sf_dir), "mid"), 97.0, False).select(*KEY, rnd("x", places=3), rnd("y", places=3))


@query
def catmull_loop(spark, sf_dir):
    return rings.catmull_rom(rings.lines_to_points(tracks(spark, sf_dir), "mid"), 4, True).select(*KEY, rnd("x", places=3), rnd("y", places=3))


@query
def catmull_open(spark, sf_dir):
    return rings.catmull_rom(rings.lines_to_points(tracks(spark, sf_dir), "mid"), 4, False).select(*KEY, rnd("x", places=3), rnd("y", places=3))


@query
def b_spline(spark, sf_dir):
    return rings.b_spline(rings.lines_to_points(tracks(spark, sf_dir), "mid"), 4).select(*KEY, rnd("x", places=3), rnd("y", places=3))


# --- features ---


def _features(df):
    return df.select(*KEY, rnd("width"), rnd("angle"), rnd("offset"))


@query
def track_features(spark, sf_dir):
    return _features(features.features(tracks(spark, sf_dir)))


@query
def track_features_flipped(spark, sf_dir):
    t = features.features(features.mirror(tracks(spark, sf_dir)))
    return t.select(*KEY, rnd("width"), rnd("angle"), rnd("offset"), rnd("pos"))


@query
def encode(spark, sf_dir):
    return features.encode(tracks(spark, sf_dir)).select(*KEY, *[rnd(c) for c in ("width", "angle", "offset", "position", "velocity")])


@query
def lap_time(spark, sf_dir):
    return features.lap_time(tracks(spark, sf_dir)).select("track_id", rnd("lap_time"))


@query
def lap_summary(spark, sf_dir):
    """The flagship: lap time, length, sharpest turn and widest line of each track."""
    f = features.features(tracks(spark, sf_dir))
    s = f.groupBy("track_id").agg(F.count("*").alias("n_lines"), rnd(F.max(F.abs("angle")), "max_turn"), rnd(F.max("width"), "max_width"))
    return s.join(features.lap_time(tracks(spark, sf_dir)).select("track_id", rnd("lap_time")), "track_id")


@query
def apexes(spark, sf_dir):
    return features.apexes(tracks(spark, sf_dir)).select(*KEY, rnd("edge"), "run_length")


@query
def lateral_deviation(spark, sf_dir):
    return features.deviation(tracks(spark, sf_dir), 5.0).select(*KEY, rnd("distance"), rnd("deviation"), rnd("vel"))


# --- bounds and scaling ---


def _encoded(spark, sf_dir):
    return features.encode(tracks(spark, sf_dir))


@query
def encoded_bounds(spark, sf_dir):
    return bounds.bounds(_encoded(spark, sf_dir)).select(*[rnd(c) for c in bounds.SCALARS])


@query
def bounds_merge(spark, sf_dir):
    """Bounds of two halves merged are the bounds of all."""
    e = _encoded(spark, sf_dir)
    a, b = [bounds.bounds(e.where(F.col("track_id") % 2 == k)) for k in (0, 1)]
    return bounds.merge(a, b).select(*[rnd(c) for c in bounds.SCALARS])


@query
def normalised(spark, sf_dir):
    e = _encoded(spark, sf_dir)
    return bounds.normalise(e, bounds.bounds(e)).select(*KEY, *[rnd(c) for c in ("width", "angle", "offset", "position", "velocity")])


def _vehicles(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    items = F.map_from_arrays(F.array(F.lit("Mass"), F.lit("trackFront"), F.lit("k_roll")), F.array((k % 13).cast("double"), F.col("s_acctbal").cast("double"), (k % 3).cast("double")))
    return s.select(k.alias("track_id"), items.alias("vehicle"))


VEHICLE = ("mass", "track_front", "k_roll")


@query
def vehicle_vectors(spark, sf_dir):
    v = bounds.vehicle_vector(_vehicles(spark, sf_dir), VEHICLE)
    return v.select("track_id", F.posexplode("vehicle").alias("dim", "value")).select("track_id", F.col("dim").cast("long").alias("dim"), rnd("value"))


@query
def vehicle_scaled(spark, sf_dir):
    v = bounds.vehicle_vector(_vehicles(spark, sf_dir), VEHICLE)
    v = bounds.normalise_vehicles(v, bounds.vehicle_bounds(v))
    return v.select("track_id", F.posexplode("vehicle").alias("dim", "value")).select("track_id", F.col("dim").cast("long").alias("dim"), rnd("value"))


# --- training examples ---


def _long(df, col="x", places=4):
    return df.select(*KEY, F.posexplode(col).alias("k", "v")).select(*KEY, F.col("k").cast("long").alias("k"), rnd(F.col("v").cast("double"), "v", places))


def _long2(df, col="x", places=4, keys=KEY):
    d = df.select(*keys, F.posexplode(col).alias("j", "r")).select(*keys, "j", F.posexplode("r").alias("k", "v"))
    return d.select(*keys, F.col("j").cast("long").alias("j"), F.col("k").cast("long").alias("k"), rnd(F.col("v").cast("double"), "v", places))


def _sums(vector: Column) -> list[Column]:
    """Two sums that stand for a vector where its values are too many to list: plain, and weighted by place (from 1)."""
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y)
    plain, weighted = F.transform(vector, lambda c: c.cast("double")), F.transform(vector, lambda c, k: c.cast("double") * (k + 1))
    return [rnd(total(plain), "total", 2), rnd(total(weighted), "weighted", 2)]


def _by_vector(df):
    """One row for each vector of x."""
    return df.select(*KEY, F.posexplode("x").alias("j", "r")).select(*KEY, F.col("j").cast("long").alias("j"), *_sums(F.col("r")))


@query
def flat_window(spark, sf_dir):
    """Windows of production width, 3 x 241 values, by channel."""
    x = transforms.Transform("flat-window", foresight=120).transform(_encoded(spark, sf_dir))
    return _by_vector(x.withColumn("x", F.array(*[F.slice("x", 241 * k + 1, 241) for k in range(3)])))


@query
def window(spark, sf_dir):
    return _by_vector(transforms.Transform("window", foresight=120).transform(_encoded(spark, sf_dir)))


@query
def narrow_window(spark, sf_dir):
    """Windows of 5 lines, value by value."""
    return _long2(transforms.Transform("window", foresight=2).transform(_encoded(spark, sf_dir)), places=3)


@query
def targets(spark, sf_dir):
    """Outputs around each row, with lag, sampling and patches."""
    t = transforms.Transform("lag", sampling=2, lag=2, patch_size=3)
    df = transforms.per_track(_encoded(spark, sf_dir), ("velocity",))
    df = transforms._rows(df).withColumn("x", transforms.targets("velocity", F.col("idx"), F.col("n"), t))
    return _long(df)


@query
def detransform_window(spark, sf_dir):
    """The mean of overlapping outputs gives back what went in."""
    t = transforms.Transform("flat-window", foresight=1, sampling=3)
    return t.detransform(t.transform(_encoded(spark, sf_dir)), "y_velocity").select(*KEY, rnd("y_velocity"))


@query
def lag(spark, sf_dir):
    return _by_vector(transforms.Transform("lag", patch_size=5, time_to_vec=True).transform(_encoded(spark, sf_dir)))


@query
def detransform_lag(spark, sf_dir):
    t = transforms.Transform("lag", sampling=1, lag=2, patch_size=3)
    return t.detransform(t.transform(_encoded(spark, sf_dir)), "y_velocity").select(*KEY, rnd("y_velocity"))


@query
def stateful_lag(spark, sf_dir):
    return _long2(transforms.Transform("stateful-lag", patch_size=5, time_to_vec=True).transform(_encoded(spark, sf_dir)), places=3, keys=("track_id",))


@query
def stateful_targets(spark, sf_dir):
    return _long2(transforms.Transform("stateful-lag", patch_size=5, sampling=1, lag=2).transform(_encoded(spark, sf_dir)), "y_velocity", keys=("track_id",))


@query
def detransform_stateful(spark, sf_dir):
    t = transforms.Transform("stateful-lag", sampling=1, lag=2, patch_size=3)
    return t.detransform(t.transform(_encoded(spark, sf_dir)), "y_velocity").select(*KEY, rnd("y_velocity"))


@query
def bidirectional(spark, sf_dir):
    return _by_vector(transforms.Transform("bidirectional", patch_size=5).transform(_encoded(spark, sf_dir)))


@query
def detransform_bidirectional(spark, sf_dir):
    t = transforms.Transform("bidirectional", sampling=1, patch_size=3)
    return t.detransform(t.transform(_encoded(spark, sf_dir)), "y_velocity").select(*KEY, rnd("y_velocity"))


@query
def model_inference(spark, sf_dir):
    """A fixed small network over flat windows, back to one value for each line."""
    weights = fixed_weights((17, 8, 5), 3)
    t = transforms.Transform("flat-window", foresight=2, sampling=1)
    e = _encoded(spark, sf_dir)
    b = bounds.bounds(e)
    x = t.transform(bounds.normalise(e, b)).withColumn("vehicle", F.array(F.lit(0.5), F.lit(0.25)))
    y = predict(x, weights)
    v = t.detransform(y, "y_velocity").crossJoin(F.broadcast(b))
    v = v.select(*KEY, rnd(bounds.range_unscale(F.col("y_velocity"), F.col("max_velocity"), F.col("min_velocity")), "velocity"))
    return v.join(t.detransform(y, "y_position").select(*KEY, rnd("y_position", "position")), list(KEY))


# --- evaluation ---


def _rounded(df, *keys):
    # means of hundredths over 64 or 80 lines end in a 5: moved off the tie by a billionth, so that no order of summation decides
    return df.select(*keys, *[rnd(F.col(c) + 1e-9, c, 6) for c in df.columns if c not in (*keys, "apexes", "n_tracks")], *[c for c in df.columns if c == "n_tracks"])


def _evaluated(spark, sf_dir):
    return evaluation.evaluate(tracks(spark, sf_dir), predicted(spark, sf_dir))


@query
def evaluate(spark, sf_dir):
    return _rounded(_evaluated(spark, sf_dir), "track_id")


def _named(spark, sf_dir):
    return _evaluated(spark, sf_dir).withColumns({"vehicle": F.concat(F.lit("v"), (F.col("track_id") % 3).cast("string")), "track": F.concat(F.lit("t"), (F.col("track_id") % 7).cast("string"))})


@query
def evaluate_by_vehicle(spark, sf_dir):
    return _rounded(evaluation.combine(_named(spark, sf_dir), "vehicle"), "vehicle")


@query
def evaluate_by_track(spark, sf_dir):
    return _rounded(evaluation.combine(_named(spark, sf_dir), "track"), "track")


@query
def evaluate_both(spark, sf_dir):
    """Grouping sets: by vehicle and by track at once."""
    return _rounded(evaluation.combine_both(_named(spark, sf_dir)), "vehicle", "track")


@query
def unsmoothed_errors(spark, sf_dir):
    return evaluation.unsmoothed_errors(tracks(spark, sf_dir), predicted(spark, sf_dir)).select(*KEY, rnd("delta", places=3), rnd("ratio", places=3))


@query
def evaluate_unsmoothed(spark, sf_dir):
    return _rounded(evaluation.evaluate_unsmoothed(tracks(spark, sf_dir), predicted(spark, sf_dir)), "track_id")


@query
def training_history(spark, sf_dir):
    e = table(spark, sf_dir, "events").select((F.col("event_id") % 50).alias("epoch"), F.when(F.col("event_id") % 2 == 0, "train").otherwise("val").alias("label"), F.col("value").alias("loss"))
    e = e.withColumn("epoch", F.col("epoch") - F.col("epoch") % 2)
    return evaluation.training_history(e).select("epoch", rnd("train", places=7), rnd("val", places=7), "best")


# --- joins ---


def _path_segments(spark, sf_dir):
    return rings.points_to_lines(path(spark, sf_dir).select(*KEY, "x", "y"))


@query
def intersections(spark, sf_dir):
    i = joins.intersections(tracks(spark, sf_dir), _path_segments(spark, sf_dir))
    return i.select(*KEY, "seg_idx", rnd("hx", places=3), rnd("hy", places=3))


@query
def grid_intersections(spark, sf_dir):
    """The same through grid cells: nothing is lost."""
    i = joins.grid_intersections(tracks(spark, sf_dir), _path_segments(spark, sf_dir), 60.0)
    return i.select(*KEY, "seg_idx", rnd("hx", places=3), rnd("hy", places=3))


@query
def extend_until_hit(spark, sf_dir):
    halves, _ = joins.split_halves(tracks(spark, sf_dir))
    outer = rings.lines_to_points(tracks(spark, sf_dir), "mid").select(*KEY, (F.col("x") * 0.985).alias("x"), (F.col("y") * 0.985).alias("y"))
    h = joins.extend_until_hit(halves, joins.boundary_segments(outer), 5, 60.0)
    return h.select(*KEY, F.col("ext").cast("long").alias("ext"), "seg_idx", rnd("hx", places=3), rnd("hy", places=3))


@query
def nearest_point(spark, sf_dir):
    n = joins.nearest(features.optimal_positions(tracks(spark, sf_dir)).select(*KEY, "x", "y"), path(spark, sf_dir))
    return n.select(*KEY, "near_idx", rnd("distance", places=3))


@query
def trim_normals(spark, sf_dir):
    t = tracks(spark, sf_dir)
    wide = g.extend(g.ln(), F.lit(4.0))
    long_ = t.select(*KEY, *[c.alias(n) for n, c in zip(("x1", "y1", "x2", "y2"), wide, strict=True)])
    left, right = [rings.points_to_lines(rings.lines_to_points(t, s)) for s in ("left", "right")]
    return joins.trim_to_boundary(long_, left, right).select(*KEY, *[rnd(c, places=3) for c in ("x1", "y1", "x2", "y2")])


@query
def splice_path(spark, sf_dir):
    s = splice.splice(tracks(spark, sf_dir), path(spark, sf_dir))
    return s.select(*KEY, rnd("pos", places=3), rnd("vel", places=3), rnd("acc", places=3), F.col("error").isNotNull().alias("failed"))


# --- sequential ---


@query
def from_xyrl(spark, sf_dir):
    p = path(spark, sf_dir).select(*KEY, "x", "y", (F.col("idx") % 5 + 2).cast("double").alias("r"), (F.col("idx") % 3 + 1).cast("double").alias("l"))
    return sequential.from_xyrl(p).select(*KEY, *[rnd(c, places=3) for c in ("x1", "y1", "x2", "y2")])


@query
def smooth_normals(spark, sf_dir):
    return sequential.smooth_normals(tracks(spark, sf_dir).select(*KEY, "x1", "y1", "x2", "y2"), width=80.0).select(*KEY, *[rnd(c) for c in ("x1", "y1", "x2", "y2")])


@query
def smooth_track(spark, sf_dir):
    return sequential.smooth_track(tracks(spark, sf_dir), 40.0).select(*KEY, *[rnd(c) for c in ("x1", "y1", "x2", "y2")], "error")


@query
def cut_to_boundaries(spark, sf_dir):
    t = tracks(spark, sf_dir)
    left, right = [rings.lines_to_points(t, s) for s in ("left", "right")]
    return sequential.cut_to_boundaries(t.select(*KEY, "x1", "y1", "x2", "y2"), left, right).select(*KEY, *[rnd(c) for c in ("x1", "y1", "x2", "y2")], "error")


@query
def shortest_path(spark, sf_dir):
    return sequential.shortest_path(tracks(spark, sf_dir)).select(*KEY, rnd("x"), rnd("y"), rnd("interpolation"), "error")


@query
def to_xyrl(spark, sf_dir):
    return sequential.to_xyrl(tracks(spark, sf_dir), 40.0).select(*KEY, *[rnd(c) for c in ("x", "y", "r", "l")])


# --- the rest: results, sources there and back, further geometry ---


@query
def results_by_vehicle(spark, sf_dir):
    """Evaluations with an apex, combined as the published tables are."""
    names = tracks(spark, sf_dir).select("track_id").distinct().select("track_id", F.concat(F.lit("v"), (F.col("track_id") % 3).cast("string"), F.lit(" - t"), (F.col("track_id") % 7).cast("string")).alias("name"))
    return _table(evaluation.results(tracks(spark, sf_dir), predicted(spark, sf_dir), names)[0])


@query
def results_by_track(spark, sf_dir):
    names = tracks(spark, sf_dir).select("track_id").distinct().select("track_id", F.concat(F.lit("v"), (F.col("track_id") % 3).cast("string"), F.lit(" - t"), (F.col("track_id") % 7).cast("string")).alias("name"))
    return _table(evaluation.results(tracks(spark, sf_dir), predicted(spark, sf_dir), names)[1])


def _table(df):
    return df.select(F.col("Type").alias("kind"), *[rnd(F.col(c) + 1e-9, evaluation.TABLE[c], 6) for c in evaluation.TABLE])


@query
def sweep_files(spark, sf_dir):
    """Files of one vehicle and track."""
    k = F.col("s_suppkey")
    names = table(spark, sf_dir, "supplier").select(F.concat(F.lit("t"), k % 5, F.lit(" - car"), k % 3, F.lit(" - mass - "), k).alias("path"))
    return sweep.files_for(names, "car1", "t2")


@query
def at_indexes(spark, sf_dir):
    """Every third line, from the end."""
    t = tracks(spark, sf_dir)
    n = F.count("*").over(Window.partitionBy("track_id"))
    wanted = t.withColumn("_n", n).where("idx * 3 < _n").select("track_id", "idx", (F.col("_n") - 1 - F.col("idx") * 3).alias("at"))
    return rings.at_indexes(t.select(*KEY, "vel"), wanted).select(*KEY, rnd("vel"))


@query
def sum_points(spark, sf_dir):
    t = tracks(spark, sf_dir)
    return rings.sum_points(*[rings.lines_to_points(t, s) for s in ("left", "mid", "right")]).select(*KEY, rnd("x"), rnd("y"))


@query
def splice_rounded(spark, sf_dir):
    """Spliced lines rounded half to even."""
    s = splice.splice(tracks(spark, sf_dir), path(spark, sf_dir), precision=1)
    return s.select(*KEY, *[rnd(c) for c in ("x1", "y1", "x2", "y2")])


@query
def splice_errors(spark, sf_dir):
    """Tracks that can't be spliced whole."""
    return splice.whole_tracks(splice.splice(tracks(spark, sf_dir), path(spark, sf_dir)))[1].select("track_id")


@query
def normals_on_path(spark, sf_dir):
    """Lines across the path at equal distances."""
    n = rings.normals_on_path(rings.lines_to_points(tracks(spark, sf_dir), "mid"), 20.0, 97.0)
    return n.select(*KEY, *[rnd(c, places=3) for c in ("x1", "y1", "x2", "y2")])


@query
def b_spline_loop(spark, sf_dir):
    """The published closed spline: its samples' number, its length, and its first point."""
    s = rings.b_spline_loop(rings.lines_to_points(tracks(spark, sf_dir), "mid"), 400)
    first = s.where("idx = 0").select("track_id", rnd("x", places=3), rnd("y", places=3))
    return s.groupBy("track_id").agg(F.count("*").alias("samples")).join(rings.path_length(s).select("track_id", rnd("length", places=3)), "track_id").join(first, "track_id")


@query
def rolled_copies(spark, sf_dir):
    return _long(transforms.rolled_copies(_encoded(spark, sf_dir), ("width", "velocity"), 2), places=3)


@query
def vehicle_join(spark, sf_dir):
    """Each example with its track's vehicle."""
    x = transforms.with_vehicles(_encoded(spark, sf_dir).withColumnRenamed("track_id", "_t").withColumn("track_id", F.col("_t") % 10 + 1), bounds.vehicle_vector(_vehicles(spark, sf_dir), VEHICLE))
    return x.select(F.col("_t").alias("track_id"), "idx", rnd(F.get("vehicle", F.lit(0)), "mass"), rnd(F.get("vehicle", F.lit(1)), "front"))


@query
def normalise_and_transform(spark, sf_dir):
    """Encoded rows scaled by their bounds and made into windows, with vehicles; outputs scaled back."""
    e = _encoded(spark, sf_dir)
    v = _vehicles(spark, sf_dir).where("track_id <= 10").select((F.col("track_id") - 1).alias("_v"), "vehicle")
    v = e.select("track_id").distinct().withColumn("_v", F.col("track_id") % 10).join(v, "_v").select("track_id", "vehicle")
    x, b = pipelines.training_examples(e, v, transforms.Transform("flat-window", foresight=1, sampling=1, vehicle_encoding=VEHICLE))
    back = transforms.Transform("flat-window", foresight=1, sampling=1).detransform(x, "y_velocity").crossJoin(F.broadcast(b))
    back = back.select(*KEY, rnd(bounds.range_unscale(F.col("y_velocity"), F.col("max_velocity"), F.col("min_velocity")), "velocity"))
    x = x.select(*KEY, rnd(F.get("x", F.lit(0)).cast("double"), "first", 3), rnd(F.get("x", F.lit(8)).cast("double"), "last", 3), rnd(F.get("vehicle", F.lit(0)), "mass", 3))
    return x.join(back, list(KEY))


def _there_and_back(spark, name: str) -> str:
    from ..operators.staging import shared_folder

    return f"{shared_folder(spark)}/ringforge-{name}-{uuid.uuid4().hex}"


@query
def xyrl_text(spark, sf_dir):
    """The text format of reference lines, written and parsed."""
    p = path(spark, sf_dir).select("track_id", "idx", F.concat_ws(",", F.round("x", 3), F.round("y", 3), F.col("idx") % 5 + 2, F.col("idx") % 3 + 1).alias("line"))
    raw = p.groupBy("track_id").agg(F.array_sort(F.collect_list(F.struct("idx", "line"))).alias("r"))
    raw = raw.select("track_id", F.concat(F.lit("x_m,y_m,w_tr_right_m,w_tr_left_m\n"), F.array_join("r.line", "\n"), F.lit("\n\n")).alias("raw"))
    return readers.parse_xyrl(raw).select(*KEY, *[rnd(c, places=3) for c in "xyrl"])


@query
def xyrl_files(spark, sf_dir):
    """One file of points for each track, written and read."""
    p = path(spark, sf_dir).select(F.concat(F.lit("t"), F.col("track_id")).alias("name"), "idx", "x", "y", (F.col("idx") % 5 + 2).cast("double").alias("r"), (F.col("idx") % 3 + 1).cast("double").alias("l"))
    dest = _there_and_back(spark, "xyrl")
    readers.write_xyrl(p, dest)
    back = readers._line_number(spark.read.schema(f"{readers.TRACK_SCHEMA}, name string").option("header", True).csv(dest), "name")
    return back.select("name", "idx", rnd("x_m", "x", 3), rnd("y_m", "y", 3), rnd("w_tr_right_m", "r"), rnd("w_tr_left_m", "l"))


@query
def spliced_files(spark, sf_dir):
    """Spliced documents with their vehicles, written twice, and read."""
    t = tracks(spark, sf_dir).withColumn("name", F.concat(F.lit("t "), F.col("track_id"))).withColumn("acc", F.lit(0.5))
    v = t.select("name", "track_id").distinct().select("name", F.create_map(F.lit("mass"), F.col("track_id").cast("double")).alias("vehicle"))
    dest = _there_and_back(spark, "spliced")
    for _ in range(2):
        readers.write_spliced(t, v, dest)
    return readers.read_spliced(spark, dest).select("name", "idx", *[rnd(c) for c in ("x1", "y1", "x2", "y2", "pos", "vel", "acc")], rnd(F.col("vehicle")["mass"], "mass"))


@query
def tracks_not_done(spark, sf_dir):
    """What a second run still has to do."""
    names = tracks(spark, sf_dir).select(F.concat(F.lit("t"), F.col("track_id")).alias("name")).distinct()
    return readers.not_done(names, names.where("length(name) = 2"))


@query
def partition_files(spark, sf_dir):
    """Encoded partitions as documents of lists, written and read, one after another."""
    e = _encoded(spark, sf_dir).withColumn("partition_id", (F.col("track_id") % 2).cast("int"))
    v = e.select("track_id").distinct().withColumn("vehicle", F.create_map(F.lit("mass"), F.col("track_id").cast("double")))
    dest = _there_and_back(spark, "partitions")
    readers.save_partition(e, v, dest)
    back = readers.load_partition(spark, dest)
    both = readers.combine_partitions(*[back.where(F.col("partition_id") == k) for k in (0, 1)])
    return both.select(F.col("vehicle")["mass"].cast("long").alias("track_id"), "track_no", "idx", rnd("width"), rnd("position"), rnd("velocity"))


@query
def bounds_files(spark, sf_dir):
    """Bounds written without those of velocities, read with their defaults."""
    dest = _there_and_back(spark, "bounds")
    readers.save_bounds(bounds.bounds(_encoded(spark, sf_dir)).drop("max_velocity", "min_velocity"), {"method": "window", "foresight": 120}, dest)
    b = readers.load_bounds(spark, dest)
    return b.select(*[rnd(c) for c in ("max_width", "min_width", "max_angle", "max_offset")], (F.col("max_velocity") < 0).alias("no_max"), (F.col("min_velocity") > 0).alias("no_min"))


def _layers(spark, sf_dir):
    layer = F.when(F.col("track_id") % 4 == 0, "Karting").when(F.col("idx") % 4 == 0, "Left 2").when(F.col("idx") % 4 == 1, "Left").when(F.col("idx") % 4 == 2, "Right").otherwise("Reference")
    return path(spark, sf_dir).select(F.concat(F.lit("GB "), F.col("track_id")).alias("name"), layer.alias("layer"), "idx", (F.col("x") / 5000.0).alias("lon"), (50 + F.col("y") / 5000.0).alias("lat"))


@query
def project_files(spark, sf_dir):
    """Curves of a survey: kart tracks left out, sides in two parts joined, written as offsets and read."""
    dest = _there_and_back(spark, "project")
    readers.write_project(readers.curve_offsets(readers.joined_sides(readers.valid_layers(_layers(spark, sf_dir)))), dest)
    return readers.read_project(spark, dest).select("name", "layer", F.col("idx").cast("long").alias("idx"), rnd("lon", places=6), rnd("lat", places=6))


# --- sweeps, partitions, layouts ---


@query
def sweep_optimum(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    r = o.select(F.col("o_custkey").alias("run"), F.col("o_orderkey").alias("param_1"), F.col("o_totalprice").alias("lap_time"), (F.col("o_totalprice") * ((F.col("o_orderkey") % 7) + 1)).alias("predicted"))
    return sweep.optimum(r, "run").select("run", "param_1", "pred_param_1", rnd("lap_delta", places=2))


@query
def sweep_names(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    names = s.select(F.concat(F.lit("car"), k % 3, F.lit(" - track"), k % 5, F.lit(" - mass - "), k, F.when(k % 2 == 0, F.concat(F.lit(" - "), k % 9)).otherwise(F.lit(""))).alias("path"))
    return sweep.parse_name(names).groupBy("pair", "vehicle", "track").agg(F.count("*").alias("n"), F.min("param_1").alias("p1"), F.max("param_2").alias("p2"))


@query
def sweep_grid(spark, sf_dir):
    return sweep.grid(spark, 0.5, 2.5, 41).select("step", rnd("value"))


@query
def partition_tracks(spark, sf_dir):
    """How many tracks each partition has (the order is a hash, so only counts are compared)."""
    names = tracks(spark, sf_dir).select(F.concat(F.lit("t"), F.col("track_id")).alias("name")).distinct()
    p = pipelines.assign_partitions(pipelines.enumerate_tracks(names, flip=True), 7)
    return p.groupBy("partition_id").agg(F.count("*").alias("n_tracks"))


@query
def swap_left_right(spark, sf_dir):
    from ..sources.readers import swap_sides

    p = path(spark, sf_dir).select(*KEY, F.col("x").alias("left"), F.col("y").alias("right"))
    return swap_sides(p).select(*KEY, rnd("left"), rnd("right"))


@query
def projected(spark, sf_dir):
    """Azimuthal equidistant projection about the mean position, and back."""
    from ..sources.readers import curve_offsets, project, unproject

    p = path(spark, sf_dir).select(F.col("track_id").cast("string").alias("name"), F.lit("Reference").alias("layer"), "idx", (F.col("x") / 5000.0).alias("lon"), (50 + F.col("y") / 5000.0).alias("lat"))
    o = p.join(curve_offsets(p).select("name", "idx", "lat0", "lon0"), ["name", "idx"])
    xy = project(o, F.col("lon0"), F.col("lat0"))
    back = unproject(xy.withColumnsRenamed({"lon": "lon_in", "lat": "lat_in"}), F.col("lon0"), F.col("lat0"))
    return back.select("name", "idx", rnd("x", places=2), rnd("y", places=2), rnd("lon", places=5), rnd("lat", places=5))


@query
def count_helpers(spark, sf_dir):
    return features.longest(tracks(spark, sf_dir))


@query
def track_pairs(spark, sf_dir):
    """Positional pairing of a track with its prediction."""
    t, p = tracks(spark, sf_dir), predicted(spark, sf_dir)
    d = t.select(*KEY, "pos", "vel").join(p.select(*KEY, F.col("pos").alias("p_pos"), F.col("vel").alias("p_vel")), list(KEY))
    w = Window.partitionBy("track_id")
    return d.select(*KEY, rnd(F.col("pos") - F.col("p_pos"), "pos_delta"), rnd(F.col("vel") - F.max("p_vel").over(w), "vel_gap"))


__all__ = ["QUERIES", "SQL"]
