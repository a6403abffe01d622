"""Where a driven path crosses each segmentation line, and how fast it was there."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from .joins import grid_intersections
from .rings import IDX, TRACK, lines_to_points, neighbour

#: Metres by which lines are extended, one after another, until the path crosses them once or twice.
EXTENSIONS = (0.0, 0.2, 0.4, 0.6, 0.8, 1.0)
LEG = ("x1_b", "y1_b", "x2_b", "y2_b", "vel0", "acc0", "vel1", "acc1")


def path_data(tracks: DataFrame, path: DataFrame | None) -> DataFrame:
    """(track_id, idx, x, y, vel, acc): the path with missing velocities -1 and accelerations 0, or the midline at rest."""
    if path is None:
        return lines_to_points(tracks, "mid").withColumns({"vel": F.lit(0.0), "acc": F.lit(0.0)})
    return path.select(TRACK, IDX, "x", "y", F.coalesce("vel", F.lit(-1.0)).cast("double").alias("vel"), F.coalesce("acc", F.lit(0.0)).cast("double").alias("acc"))


def splice(tracks: DataFrame, path: DataFrame | None = None, precision: int | None = None) -> DataFrame:
    """(track_id, idx, x1..y2, pos, vel, acc, error).  Lines the path doesn't cross once or twice at any extension have an error."""
    lines = tracks.select(TRACK, IDX, "x1", "y1", "x2", "y2")
    here = F.struct("x", "y", "vel", "acc")
    prev = neighbour(here, -1)
    legs = path_data(tracks, path).select(
        TRACK, IDX, prev["x"].alias("x1"), prev["y"].alias("y1"), F.col("x").alias("x2"), F.col("y").alias("y2"),
        F.struct(prev["x"].alias("x1_b"), prev["y"].alias("y1_b"), F.col("x").alias("x2_b"), F.col("y").alias("y2_b"), prev["vel"].alias("vel0"), prev["acc"].alias("acc0"), F.col("vel").alias("vel1"), F.col("acc").alias("acc1")).alias("leg"),
    )
    # a longer line crosses all that a shorter one does: one join for the longest, then each extension on what that has met
    names = ("x1", "y1", "x2", "y2")
    unit = g.direction(g.ln())
    own = F.struct(*[F.col(n).alias(f"{n}_l") for n in names], unit.x.alias("ux"), unit.y.alias("uy"), (g.length(g.ln()) / 2).alias("half"))
    longest = lines.select(TRACK, IDX, own.alias("line"), *[c.alias(n) for n, c in zip(names, g.extend(g.ln(), F.lit(max(EXTENSIONS))), strict=True)])
    met = grid_intersections(longest, legs, keep=("line",), keep_b=("leg",)).select(TRACK, IDX, F.col("seg_idx").alias("seg"), "line.*", "leg.*")

    def grown(e: float) -> Column:
        # without extension the line is taken as it is, also if it has no length
        by = F.least(F.lit(e), F.col("half")) if e else F.lit(0.0)
        ends = [F.col(f"{n}_l") + (-1 if n[1] == "1" else 1) * F.col(f"u{n[0]}") * by if e else F.col(f"{n}_l") for n in names]
        return F.struct(F.lit(e).alias("ext"), *[c.alias(n) for n, c in zip(names, ends, strict=True)])

    # exploded lines are made once, before the test that needs their ends many times
    tried = met.withColumn("e", F.explode(F.array(*[grown(e) for e in EXTENSIONS])))
    hits = g.with_meeting(tried, g.Ln(*[F.col(f"e.{n}") for n in names]), g.ln("_b")).select(TRACK, IDX, F.col("e.ext").alias("ext"), F.struct("seg", "hx", "hy", *LEG).alias("h"))
    by = hits.groupBy(TRACK, IDX, "ext").agg(F.array_sort(F.collect_list("h")).alias("hs")).where(F.size("hs").isin(1, 2))
    best = by.groupBy(TRACK, IDX).agg(F.min_by("hs", "ext").alias("hs"))
    a, b = F.get("hs", F.lit(0)), F.get("hs", F.lit(1))

    def same(i: str, j: str):
        return (a[f"x{i}_b"] == b[f"x{j}_b"]) & (a[f"y{i}_b"] == b[f"y{j}_b"])

    def shared(c: str):
        # two legs: the point they share, or else where the first begins
        two = F.when(same("1", "1") | same("1", "2"), a[f"{c}1_b"]).when(same("2", "1") | same("2", "2"), a[f"{c}2_b"]).otherwise(a[f"{c}1_b"])
        return F.when(F.size("hs") == 1, a[f"h{c}"]).otherwise(two)

    # below the join, so that each is made once
    best = best.select(TRACK, IDX, a.alias("a"), shared("x").alias("_x"), shared("y").alias("_y"))
    df = lines.join(best, [TRACK, IDX], "left")
    a = F.col("a")
    at, line = g.pt("_x", "_y"), g.ln()
    d1, d2, size = g.distance(at, line.start), g.distance(at, line.end), g.length(line)
    pos = F.when(d1 > size, 1.0).when(d2 > size, 0.0).otherwise(F.try_divide(d1, size))
    leg = g.Ln(a["x1_b"], a["y1_b"], a["x2_b"], a["y2_b"])
    part = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(g.distance(leg.start, at), g.length(leg))))
    out = {c: F.col(c) for c in ("x1", "y1", "x2", "y2")} | {"pos": pos, "vel": a["vel0"] * (1 - part) + a["vel1"] * part, "acc": a["acc0"] * (1 - part) + a["acc1"] * part}
    if precision is not None:
        out = {k: g.round_half_even(c, precision) for k, c in out.items()}
    return df.select(TRACK, IDX, *[c.alias(k) for k, c in out.items()], F.when(a.isNull(), F.lit("the path does not cross this line")).alias("error"))


def whole_tracks(spliced: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of tracks without an error, one row (track_id, error) for each other track)."""
    bad = F.max("error").over(Window.partitionBy(TRACK))
    df = spliced.withColumn("_bad", bad)
    return df.where("_bad is null").drop("_bad", "error"), df.where("_bad is not null").groupBy(TRACK).agg(F.first("_bad").alias("error"))
