"""What a model sees of a track: width, turn and skew of each segmentation line, apexes, lap time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from .rings import IDX, TRACK, neighbour, ordered

APEX_EDGE, APEX_TURN = 0.02, 0.01


def mirror(tracks: DataFrame) -> DataFrame:
    """The track seen from the other side: y negated, ends swapped, pos counted from the other end (null stays null)."""
    m = g.flip(g.ln())
    out = tracks
    out = out.withColumns({"x1": m.x1, "y1": m.y1, "x2": m.x2, "y2": m.y2})
    return out.withColumn("pos", 1 - F.col("pos")) if "pos" in tracks.columns else out


def optimal_positions(tracks: DataFrame) -> DataFrame:
    p = g.lerp_line(g.ln(), F.col("pos"))
    return tracks.withColumns({"x": p.x, "y": p.y})


def features(tracks: DataFrame) -> DataFrame:
    """Adds width, angle and offset."""
    line = g.ln()
    c = g.center(line)
    centre = F.struct(c.x.alias("x"), c.y.alias("y"))
    df = tracks.withColumns({"_p": neighbour(centre, -1), "_n": neighbour(centre, 1)})
    prev, nxt = g.Pt(F.col("_p.x"), F.col("_p.y")), g.Pt(F.col("_n.x"), F.col("_n.y"))
    after, before = g.angle3(nxt, c, line.start), g.angle3(line.start, c, prev)
    return df.withColumns({"width": g.length(line), "angle": g.angle3(nxt, c, prev), "offset": before - (after + before) / 2}).drop("_p", "_n")


def encode(tracks: DataFrame, flip: bool = False, zero_is_missing: bool = True) -> DataFrame:
    """Feature rows of a track: missing positions and velocities are -1 (and so are zeros, unless told otherwise)."""
    df = features(mirror(tracks) if flip else tracks)

    def coded(c: str):
        missing = F.col(c).isNull() | (F.col(c) == 0) if zero_is_missing else F.col(c).isNull()
        return F.when(missing, -1.0).otherwise(F.col(c)).cast("double")

    return df.select(TRACK, IDX, "width", "angle", "offset", coded("pos").alias("position"), coded("vel").alias("velocity"))


def lap_time(tracks: DataFrame, name: str = "lap_time") -> DataFrame:
    """Sum of 2 s / (u + v) between neighbouring points on the line driven; pairs that stand still add nothing."""
    df = optimal_positions(tracks).withColumn("_p", neighbour(F.struct("x", "y", "vel"), -1))
    s = F.hypot(F.col("x") - F.col("_p.x"), F.col("y") - F.col("_p.y"))
    return df.groupBy(TRACK).agg(F.sum(F.try_divide(2 * s, F.col("vel") + F.col("_p.vel"))).alias(name))


def apexes(tracks: DataFrame) -> DataFrame:
    """Rows of the apexes: in each run of lines where the path touches an edge in a turn, the one closest to it (the first if equal)."""
    near = ((F.col("pos") < APEX_EDGE) | (F.col("pos") > 1 - APEX_EDGE)) & (F.abs("angle") > APEX_TURN)
    df = (tracks if "angle" in tracks.columns else features(tracks)).where(near)
    df = df.withColumn("_run", F.col(IDX) - F.row_number().over(ordered())).withColumn("edge", F.when(F.col("pos") < 0.5, F.col("pos")).otherwise(1 - F.col("pos")))
    return df.groupBy(TRACK, "_run").agg(F.min(F.struct("edge", IDX)).alias("m"), F.count("*").alias("run_length")).select(TRACK, F.col(f"m.{IDX}").alias(IDX), F.col("m.edge").alias("edge"), "run_length")


def deviation(tracks: DataFrame, spacing: float) -> DataFrame:
    """The data of the lateral plots: distance along the track, and metres from its middle."""
    return features(tracks).select(TRACK, IDX, (F.col(IDX) * F.lit(float(spacing))).alias("distance"), (F.col("pos") * F.col("width") - F.col("width") / 2).alias("deviation"), "vel")


def track_index(df: DataFrame) -> DataFrame:
    """0, 1, 2, ... along each track, whatever numbers idx has."""
    return df.withColumn(IDX, (F.row_number().over(ordered()) - 1).cast("long"))


def longest(df: DataFrame) -> DataFrame:
    """Counts that the transforms ask for: tracks, lines, lines of the longest track."""
    n = df.groupBy(TRACK).agg(F.count("*").alias("n"))
    return n.agg(F.count("*").alias("tracks"), F.sum("n").alias("lines"), F.max("n").alias("longest"))


