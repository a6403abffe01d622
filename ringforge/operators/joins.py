"""Joins that geometry implies: crossings, grid lookups, nearest points, first hits of growing lines.

All are equi-joins on the track (and on grid cells where a track is long) with the exact test as residual condition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from .rings import IDX, TRACK, neighbour

BOX = ("x1", "y1", "x2", "y2")


def _other(segments: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    return segments.select(F.col(TRACK).alias("_t"), F.col(IDX).alias("seg_idx"), *[F.col(c).alias(f"{c}_b") for c in BOX], *keep)


def intersections(lines: DataFrame, segments: DataFrame, keep: tuple[str, ...] = (), how: str = "inner") -> DataFrame:
    """All crossings: (track_id, idx, seg_idx, hx, hy).  Every pair of a track is tried: for short tracks; see grid_intersections()."""
    hit, p = g.crossing(g.ln(), g.ln("_b"))
    met = lines.join(_other(segments), (F.col(TRACK) == F.col("_t")) & hit, how)
    on = F.col("_t").isNotNull()
    return met.select(TRACK, IDX, *keep, "seg_idx", F.when(on, p.x).alias("hx"), F.when(on, p.y).alias("hy"))


def cell_sizes(*lines: DataFrame) -> DataFrame:
    """(_t, _size): a grid cell for each track, as long as its longest line, so that a line covers four cells at most."""
    each = [x.select(F.col(TRACK).alias("_t"), g.length(g.ln()).alias("_size")) for x in lines]
    out = each[0]
    for x in each[1:]:
        out = out.union(x)
    return out.groupBy("_t").agg(F.greatest(F.max("_size"), F.lit(1e-6)).alias("_size"))


def grid_intersections(lines: DataFrame, segments: DataFrame, cell: float | str | None = None, keep: tuple[str, ...] = (), keep_b: tuple[str, ...] = ()) -> DataFrame:
    """The same through a grid: both sides are dealt to every cell their box covers, so nothing is missed, and work
    grows with what is near rather than with the product.  The cell that holds a crossing owns it, so that it counts once.  cell: a size, or
    the column of lines that has it for each track; without it, a track's cells are as long as its longest line.  keep, keep_b: further columns of lines and of
    segments."""

    def cells(c1: str, c2: str, size: str = "_size"):
        lo, hi = F.floor((F.least(c1, c2) - g.EPS) / F.col(size)), F.floor((F.greatest(c1, c2) + g.EPS) / F.col(size))
        return F.sequence(lo, hi)

    if cell is None:
        sizes = cell_sizes(lines, segments)
        a, b = lines.join(sizes, F.col(TRACK) == F.col("_t")).drop("_t"), _other(segments, keep_b).join(sizes, "_t")
    elif isinstance(cell, str):
        a = lines.withColumn("_size", F.col(cell))
        b = _other(segments, keep_b).join(lines.groupBy(F.col(TRACK).alias("_t")).agg(F.first(cell).alias("_size")), "_t")
    else:
        a, b = lines.withColumn("_size", F.lit(float(cell))), _other(segments, keep_b).withColumn("_size", F.lit(float(cell)))
    a = a.withColumn("_cx", F.explode(cells("x1", "x2"))).withColumn("_cy", F.explode(cells("y1", "y2")))
    b = b.withColumn("_bx", F.explode(cells("x1_b", "x2_b"))).withColumn("_by", F.explode(cells("y1_b", "y2_b"))).drop("_size")
    met = g.with_meeting(a.join(b, (F.col(TRACK) == F.col("_t")) & (F.col("_cx") == F.col("_bx")) & (F.col("_cy") == F.col("_by"))), g.ln(), g.ln("_b"))
    met = met.where((F.floor(F.col("hx") / F.col("_size")) == F.col("_cx")) & (F.floor(F.col("hy") / F.col("_size")) == F.col("_cy")))
    return met.select(TRACK, IDX, *keep, "seg_idx", "hx", "hy", *keep_b)


def extend_until_hit(halves: DataFrame, boundary: DataFrame, most: int = 5, cell: float | None = None) -> DataFrame:
    """Half lines grow by their own length, 0 to most - 1 times, until they meet the boundary: the crossings at the first length that has any.

    Half lines without a crossing have no row; see missed().  Without ``cell``, a track's cells are twice its longest half line."""
    if cell is None:
        size = halves.groupBy(F.col(TRACK).alias("_t")).agg((F.greatest(F.max(g.length(g.ln())), F.lit(1e-6)) * 2).alias("_cell"))
        halves = halves.join(size, F.col(TRACK) == F.col("_t")).drop("_t")
    grown = halves.withColumn("ext", F.explode(F.sequence(F.lit(0), F.lit(most - 1))))
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    grown = grown.withColumns({"x2": F.col("x2") + dx * F.col("ext"), "y2": F.col("y2") + dy * F.col("ext")})
    hits = grid_intersections(grown, boundary, cell or "_cell", ("ext",))
    first = F.min("ext").over(Window.partitionBy(TRACK, IDX))
    return hits.withColumn("_first", first).where("ext = _first").drop("_first")


def missed(halves: DataFrame, hits: DataFrame) -> DataFrame:
    return halves.join(hits.select(TRACK, IDX).distinct(), [TRACK, IDX], "left_anti")


def nearest(origins: DataFrame, points: DataFrame) -> DataFrame:
    """The nearest point of the same track (the first if equal); null where the track has none.

    Points are first looked for in the four grid cells that reach half a cell's length around an origin; what is found within that is the nearest.  The other origins, far from all
    points, are compared with every point of their track.

    All joins are merge joins: the planner would take these tables for as small as the files they are derived from, and broadcast them."""
    p = points.select(F.col(TRACK).alias("_t"), F.col(IDX).alias("near_idx"), F.col("x").alias("nx"), F.col("y").alias("ny"))
    around = (F.max("nx") - F.min("nx") + F.max("ny") - F.min("ny")) * 2
    sizes = p.groupBy("_t").agg(F.greatest(F.try_divide(around * 2, F.count("*")), F.lit(1e-6)).alias("_size"))
    d = F.hypot(F.col("x") - F.col("nx"), F.col("y") - F.col("ny"))
    best = F.min(F.struct(d.alias("distance"), "near_idx", "nx", "ny")).alias("m")

    def cell(c: Column | str) -> Column:
        return F.floor((F.col(c) if isinstance(c, str) else c) / (F.col("_size") * 2))

    sizes = sizes.hint("merge")
    p = p.join(sizes, "_t")
    o = origins.select(TRACK, IDX, "x", "y").join(sizes, F.col(TRACK) == F.col("_t")).drop("_t")
    for c in "xy":
        o = o.withColumn(f"_c{c}", F.explode(F.sequence(cell(F.col(c) - F.col("_size")), cell(F.col(c) + F.col("_size")))))
    q = p.select("_t", "near_idx", "nx", "ny", cell("nx").alias("_bx"), cell("ny").alias("_by"))
    near = o.join(q.hint("merge"), (F.col(TRACK) == F.col("_t")) & (F.col("_cx") == F.col("_bx")) & (F.col("_cy") == F.col("_by")))
    near = near.groupBy(TRACK, IDX).agg(best, F.first("_size").alias("_size")).where("m.distance <= 0.999 * _size").select(TRACK, IDX, "m")
    far = origins.select(TRACK, IDX, "x", "y").join(near.select(TRACK, IDX).hint("merge"), [TRACK, IDX], "left_anti")
    rest = far.join(p.hint("merge"), F.col(TRACK) == F.col("_t")).groupBy(TRACK, IDX).agg(best)
    out = origins.select(TRACK, IDX).join(near.union(rest).hint("merge"), [TRACK, IDX], "left")
    return out.select(TRACK, IDX, "m.near_idx", "m.nx", "m.ny", "m.distance")


def trim_to_boundary(lines: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """Each line cut where it first meets its boundaries, counted from its centre; an end that meets nothing stays."""
    c = g.center(g.ln())
    base = lines.select(TRACK, IDX, *BOX, c.x.alias("cx"), c.y.alias("cy"))

    def cut(a: str, boundary: DataFrame) -> DataFrame:
        half = base.select(TRACK, IDX, F.col(f"x{a}").alias("x1"), F.col(f"y{a}").alias("y1"), F.col("cx").alias("x2"), F.col("cy").alias("y2"))
        hits = grid_intersections(half, boundary, keep=("x2", "y2"))
        d = F.hypot(F.col("hx") - F.col("x2"), F.col("hy") - F.col("y2"))
        return hits.groupBy(TRACK, IDX).agg(F.min(F.struct(d.alias("d"), "seg_idx", "hx", "hy")).alias(f"h{a}"))

    df = base.join(cut("1", left), [TRACK, IDX], "left").join(cut("2", right), [TRACK, IDX], "left")
    return df.select(TRACK, IDX, *[F.coalesce(f"h{k}.h{c}", f"{c}{k}").alias(f"{c}{k}") for k in "12" for c in "xy"])


def split_halves(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From the centre to the left end, and to the right end."""
    c = g.center(g.ln())
    left, right = [lines.select(TRACK, IDX, c.x.alias("x1"), c.y.alias("y1"), F.col(f"x{k}").alias("x2"), F.col(f"y{k}").alias("y2")) for k in "12"]
    return left, right


def boundary_segments(points: DataFrame) -> DataFrame:
    """Segment i leads to point i (from the last point for i = 0)."""
    prev = neighbour(F.struct("x", "y"), -1)
    return points.select(TRACK, IDX, prev["x"].alias("x1"), prev["y"].alias("y1"), F.col("x").alias("x2"), F.col("y").alias("y2"))
