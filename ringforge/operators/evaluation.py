"""Predicted against true runs: errors per track, and their combination by vehicle or by track.

Tracks to compare are joined on (track_id, idx); both sides carry pos and vel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from . import features as ft
from . import rings
from .joins import grid_intersections
from .rings import IDX, TRACK

STATS = ("max", "mean", "mean_absolute", "rmse", "ci95", "percentage_mean", "percentage_max", "percentage_ci95", "apex_mean", "apex_mean_absolute", "apex_max")
LAPTIME = ("truth", "predicted", "error", "abs_error", "percentage", "error_per_minute")


def ci95(c: Column) -> Column:
    """The value at place int(0.95 n) of the sorted values: a rule by index, not an interpolated percentile."""
    s = F.array_sort(F.collect_list(c))
    return F.get(s, F.floor(F.size(s) * F.lit(0.95)).cast("int"))


def _stats(prefix: str) -> list[Column]:
    d, p, apex = F.col(f"{prefix}_delta"), F.col(f"{prefix}_pct"), F.col("is_apex")
    at = F.when(apex, d)
    values = (F.max(F.abs(d)), F.avg(d), F.avg(F.abs(d)), F.sqrt(F.avg(d * d)), ci95(F.abs(d)), F.avg(p), F.max(p), ci95(p), F.avg(at), F.avg(F.abs(at)), F.max(F.abs(at)))
    return [v.alias(f"{prefix}_{s}") for v, s in zip(values, STATS, strict=True)]


def _paired(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """One row for each line of the truth, with velocity errors and the apex mark."""
    t, p = ft.optimal_positions(ft.features(truth)), ft.optimal_positions(predicted)
    marks = ft.apexes(t).select(TRACK, IDX, F.lit(True).alias("is_apex"))
    df = t.join(p.select(TRACK, IDX, F.col("pos").alias("p_pos"), F.col("vel").alias("p_vel"), F.col("x").alias("px"), F.col("y").alias("py")), [TRACK, IDX])
    df = df.join(marks, [TRACK, IDX], "left").withColumn("is_apex", F.coalesce("is_apex", F.lit(False)))
    w = Window.partitionBy(TRACK)
    span = F.max(F.greatest("vel", "p_vel")).over(w) - F.min(F.least("vel", "p_vel")).over(w)
    return df.withColumn("velocity_delta", F.col("vel") - F.col("p_vel")).withColumn("velocity_pct", F.try_divide(F.abs("velocity_delta"), span) * 100)


def lap_times(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    df = ft.lap_time(truth, "truth").join(ft.lap_time(predicted, "predicted"), TRACK)
    err = F.abs(F.col("truth") - F.col("predicted"))
    return df.select(
        TRACK, F.col("truth").alias("laptime_truth"), F.col("predicted").alias("laptime_predicted"), (F.col("truth") - F.col("predicted")).alias("laptime_error"), err.alias("laptime_abs_error"),
        (F.try_divide(err, F.col("truth")) * 100).alias("laptime_percentage"), (F.try_divide(err, F.col("truth")) * 60).alias("laptime_error_per_minute"),
    )


def _evaluated(df: DataFrame, truth: DataFrame, predicted: DataFrame) -> DataFrame:
    stats = df.groupBy(TRACK).agg(*_stats("position"), *_stats("velocity"), F.array_sort(F.collect_list(F.when(F.col("is_apex"), F.col(IDX)))).alias("apexes"))
    return lap_times(truth, predicted).join(stats, TRACK)


def evaluate(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """One row per track.  Position errors are negative where the prediction lies left of the truth."""
    df = _paired(truth, predicted)
    d = F.hypot(F.col("x") - F.col("px"), F.col("y") - F.col("py"))
    df = df.withColumn("position_delta", F.when(F.col("p_pos") < F.col("pos"), -d).otherwise(d)).withColumn("position_pct", F.abs(F.col("p_pos") - F.col("pos")) * 100)
    return _evaluated(df, truth, predicted)


def unsmoothed_errors(truth: DataFrame, predicted: DataFrame, width: float = 10.0, samples: int = 5) -> DataFrame:
    """(track_id, idx, delta, ratio): how far the true line is from the predicted line's spline, along the normals of the true
    line; null where they don't meet.  The ratio is of the segmentation line's length."""
    line = ft.optimal_positions(truth).select(TRACK, IDX, "x", "y", g.length(g.ln()).alias("len"))
    across = rings.normals(line.select(TRACK, IDX, "x", "y"), width).join(line, [TRACK, IDX])
    spline = rings.points_to_lines(rings.catmull_rom(ft.optimal_positions(predicted).select(TRACK, IDX, "x", "y"), samples, True))
    hits = grid_intersections(across, spline, keep=("x", "y"))
    delta = hits.groupBy(TRACK, IDX).agg(F.min(F.hypot(F.col("hx") - F.col("x"), F.col("hy") - F.col("y"))).alias("delta"))
    return across.select(TRACK, IDX, "len").join(delta, [TRACK, IDX], "left").select(TRACK, IDX, "delta", F.try_divide(F.col("delta"), F.col("len")).alias("ratio"))


def evaluate_unsmoothed(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """evaluate(), with position errors that don't depend on how lines were smoothed.  Lines that miss are left out of means."""
    e = unsmoothed_errors(truth, predicted).select(TRACK, IDX, F.col("delta").alias("position_delta"), F.col("ratio").alias("position_pct"))
    return _evaluated(_paired(truth, predicted).join(e, [TRACK, IDX]), truth, predicted)


def combine(evaluations: DataFrame, *keys: str) -> DataFrame:
    """Means of the tracks' figures (nulls skipped, each track counting the same); maxima of maxima."""
    aggs = [F.avg(f"laptime_{c}").alias(f"laptime_{c}") for c in LAPTIME]
    for prefix in ("position", "velocity"):
        aggs += [(F.max if s in ("max", "percentage_max", "apex_max") else F.avg)(f"{prefix}_{s}").alias(f"{prefix}_{s}") for s in STATS]
    return evaluations.groupBy(*keys).agg(*aggs, F.count("*").alias("n_tracks"))


def split_name(df: DataFrame, col: str = "name") -> DataFrame:
    """'vehicle - track - part' to vehicle and track."""
    parts = F.split(F.col(col), " - ")
    return df.withColumns({"vehicle": parts[0], "track": F.concat_ws(" - ", F.slice(parts, 2, 1000))})


def combine_both(evaluations: DataFrame) -> DataFrame:
    """By vehicle and by track in one pass: the other key is null."""
    base = combine(evaluations, "vehicle", "track")
    view = [F.avg(c).alias(c) if not c.endswith(("_max",)) else F.max(c).alias(c) for c in base.columns if c not in ("vehicle", "track", "n_tracks")]
    return evaluations.groupingSets([["vehicle"], ["track"]], "vehicle", "track").agg(*view, F.count("*").alias("n_tracks"))


def with_apex_only(evaluations: DataFrame) -> DataFrame:
    return evaluations.where("position_apex_mean is not null")


#: The columns of the published tables, and the figures that they show.
TABLE = {
    "LapTime Error": "laptime_abs_error", "LapTime Percentage": "laptime_percentage", "LapTime Error Per Minute": "laptime_error_per_minute", "Position Error": "position_mean_absolute", "Position ci95": "position_ci95",
    "Velocity Error": "velocity_mean_absolute", "Velocity ci95": "velocity_ci95",
}


def results(truth: DataFrame, predicted: DataFrame, names: DataFrame, swapped: bool = False) -> tuple[DataFrame, DataFrame]:
    """Every track evaluated, and combined by vehicle and by track, as tables with a column Type; tracks without an apex are left out.

    names: track_id, name ("vehicle - track").  swapped: the prediction takes the place of the truth, as in the published tables (signs turn round, and
    percentages are of the predicted lap time)."""
    each = evaluate(predicted, truth) if swapped else evaluate(truth, predicted)
    each = with_apex_only(split_name(each.join(names, TRACK)))
    table = [F.col(v).alias(k) for k, v in TABLE.items()]
    return tuple(combine(each, k).select(F.col(k).alias("Type"), *table) for k in ("vehicle", "track"))


def training_history(losses: DataFrame) -> DataFrame:
    """losses: epoch, label, loss.  Means per epoch and label; best marks a new least total."""
    means = losses.groupBy("epoch").pivot("label", ["train", "val"]).agg(F.avg("loss"))
    before = F.min("val").over(Window.orderBy("epoch").rowsBetween(Window.unboundedPreceding, -1))
    return means.withColumn("best", F.coalesce(F.col("val") < before, F.col("val").isNotNull()))
