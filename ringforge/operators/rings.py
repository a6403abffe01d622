"""Closed rings: rows (track_id, idx, ...) where the last row's neighbour is the first.

Every window is partitioned by track, so a ring never meets another and tracks spread over the cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g

TRACK, IDX = "track_id", "idx"


def ordered():
    return Window.partitionBy(TRACK).orderBy(IDX)


def whole():
    return ordered().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def neighbour(c: Column, step: int) -> Column:
    """The value ``step`` rows on (-1, 1 or 2) around the ring; c must not be null.  Rows never carry the whole ring."""
    o, w = ordered(), whole()
    if step == -1:
        return F.coalesce(F.lag(c).over(o), F.last(c).over(w))
    if step == 1:
        return F.coalesce(F.lead(c).over(o), F.first(c).over(w))
    if step == 2:
        to_end = F.count(F.lit(1)).over(w) - F.row_number().over(o)
        second = F.coalesce(F.nth_value(c, 2).over(w), F.first(c).over(w))
        return F.coalesce(F.lead(c, 2).over(o), F.when(to_end == 1, F.first(c).over(w)).otherwise(second))
    raise ValueError("neighbours are one row back, or one or two rows on")


def size() -> Column:
    return F.count(F.lit(1)).over(Window.partitionBy(TRACK))


def roll(df: DataFrame, shift: int) -> DataFrame:
    """Circular shift: what stood at i stands at i + shift."""
    return df.withColumn(IDX, F.pmod(F.col(IDX) + F.lit(shift), size()).cast("long"))


def points_to_lines(points: DataFrame) -> DataFrame:
    """(track_id, idx, x, y) to the ring's segments idx -> idx + 1: (track_id, idx, x1, y1, x2, y2)."""
    nxt = neighbour(F.struct("x", "y"), 1)
    return points.select(TRACK, IDX, F.col("x").alias("x1"), F.col("y").alias("y1"), nxt["x"].alias("x2"), nxt["y"].alias("y2"))


def lines_to_points(lines: DataFrame, side: str) -> DataFrame:
    line = g.ln()
    p = {"left": line.start, "right": line.end, "mid": g.center(line)}[side]
    return lines.select(TRACK, IDX, p.x.alias("x"), p.y.alias("y"))


def normals(points: DataFrame, length: float = 10.0) -> DataFrame:
    """A line of ``length`` across the path at each point, at half the turn between its neighbours.  Rings of under three points give none."""
    df = points.withColumn("_p", neighbour(F.struct("x", "y"), -1)).withColumn("_n", neighbour(F.struct("x", "y"), 1)).withColumn("_c", size())
    p, here, n = g.Pt(F.col("_p.x"), F.col("_p.y")), g.pt("x", "y"), g.Pt(F.col("_n.x"), F.col("_n.y"))
    a = g.angle_to(here, p) + g.angle3(p, here, n) / 2
    df = df.where("_c >= 3").withColumn("_a", a)
    h = length / 2
    return df.select(
        TRACK, IDX, (F.col("x") + F.sin("_a") * h).alias("x1"), (F.col("y") - F.cos("_a") * h).alias("y1"), (F.col("x") - F.sin("_a") * h).alias("x2"), (F.col("y") + F.cos("_a") * h).alias("y2")
    )


def resample(points: DataFrame, spacing: Column | float, loop: bool = True) -> DataFrame:
    """Points at equal distances along the path; each segment emits its own, so there is no join."""
    s = spacing if isinstance(spacing, Column) else F.lit(float(spacing))
    return _resample(points_to_lines(points).withColumn("_s", s), loop)


def _resample(seg: DataFrame, loop: bool) -> DataFrame:
    """seg: the ring's segments, and the spacing in _s."""
    if not loop:
        seg = seg.withColumn("_last", F.max(IDX).over(Window.partitionBy(TRACK))).where(F.col(IDX) < F.col("_last"))
    seg = seg.withColumn("_len", g.length(g.ln()))
    seg = seg.withColumn("_hi", F.sum("_len").over(ordered().rowsBetween(Window.unboundedPreceding, 0)))
    seg = seg.withColumn("_lo", F.coalesce(F.lag("_hi").over(ordered()), F.lit(0.0))).withColumn("_total", F.max("_hi").over(Window.partitionBy(TRACK)))
    limit = F.col("_total") + F.col("_s") * (-0.5 if loop else 0.5)
    first = F.when(F.col("_lo") == 0, F.lit(0)).otherwise(F.floor(F.col("_lo") / F.col("_s")) + 1).cast("long")
    last = F.floor(F.col("_hi") / F.col("_s")).cast("long")
    last = last - (last * F.col("_s") >= limit).cast("long")
    out = seg.withColumn("_k0", first).withColumn("_k1", last).where("_len > 0 and _k1 >= _k0").withColumn("_k", F.explode(F.sequence("_k0", "_k1")))
    out = out.where(F.col("_k") * F.col("_s") < limit)
    p = g.lerp_line(g.ln(), (F.col("_k") * F.col("_s") - F.col("_lo")) / F.col("_len"))
    return out.select(TRACK, F.col("_k").alias(IDX), p.x.alias("x"), p.y.alias("y"))


def normals_on_path(points: DataFrame, width: float, spacing: Column | float) -> DataFrame:
    return normals(resample(points, spacing), width)


def normals_on_path_by(points: DataFrame, width: float, steps: DataFrame) -> DataFrame:
    """The same with each track's own spacing: steps has track_id and step."""
    seg = points_to_lines(points).join(steps.select(TRACK, F.col("step").alias("_s")).hint("merge"), TRACK)
    return normals(_resample(seg, True), width)


def interpolate_between(df: DataFrame, a: g.Pt, b: g.Pt, n: int) -> DataFrame:
    """n points strictly between a and b for each row: adds k, x, y."""
    df = df.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(n))))
    p = g.lerp(a, b, F.col("k") / F.lit(float(n + 1)))
    return df.withColumn("x", p.x).withColumn("y", p.y)


def _four(points: DataFrame) -> DataFrame:
    """Adds the places of a span's four control points p0 .. p3, and _at, _n."""
    c = F.struct("x", "y")
    at = (F.row_number().over(ordered()) - 1).cast("int")
    return points.select(TRACK, IDX, neighbour(c, -1).alias("p0"), c.alias("p1"), neighbour(c, 1).alias("p2"), neighbour(c, 2).alias("p3"), at.alias("_at"), size().alias("_n"))


def catmull_rom(points: DataFrame, samples: int = 10, loop: bool = True) -> DataFrame:
    """Centripetal Catmull-Rom spline; each span gives ``samples`` points.  Spans with repeated points give null coordinates."""
    df = _four(points)
    if not loop:
        df = df.where((F.col("_at") >= 1) & (F.col("_at") < F.col("_n") - 2))
    p = [g.Pt(F.col(f"p{i}.x"), F.col(f"p{i}.y")) for i in range(4)]
    df = df.withColumn("t1", F.sqrt(g.distance(p[0], p[1])))
    df = df.withColumn("t2", F.col("t1") + F.sqrt(g.distance(p[1], p[2])))
    df = df.withColumn("t3", F.col("t2") + F.sqrt(g.distance(p[2], p[3])))
    df = df.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))
    df = df.withColumn("t", F.col("t1") + (F.col("t2") - F.col("t1")) * F.col("s") / F.lit(float(samples)))
    t0, t1, t2, t3, t = F.lit(0.0), *[F.col(k) for k in ("t1", "t2", "t3", "t")]

    def mixed(a: g.Pt, b: g.Pt, lo, hi) -> g.Pt:
        u, v = F.try_divide(hi - t, hi - lo), F.try_divide(t - lo, hi - lo)
        return g.Pt(u * a.x + v * b.x, u * a.y + v * b.y)

    a1, a2, a3 = mixed(p[0], p[1], t0, t1), mixed(p[1], p[2], t1, t2), mixed(p[2], p[3], t2, t3)
    out = mixed(mixed(a1, a2, t0, t2), mixed(a2, a3, t1, t3), t1, t2)
    base = F.col("_at") if loop else F.col("_at") - 1
    return df.select(TRACK, (base * samples + F.col("s")).cast("long").alias(IDX), out.x.alias("x"), out.y.alias("y"))


def b_spline(points: DataFrame, samples: int = 10) -> DataFrame:
    """Closed uniform cubic B-spline with the points as coefficients, ``samples`` points to a span."""
    df = _four(points)
    df = df.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(samples - 1)))).withColumn("t", F.col("s") / F.lit(float(samples)))
    t = F.col("t")
    w = ((1 - t) * (1 - t) * (1 - t) / 6, (3 * t * t * t - 6 * t * t + 4) / 6, (-3 * t * t * t + 3 * t * t + 3 * t + 1) / 6, t * t * t / 6)
    x, y = [sum((w[i] * F.col(f"p{i}.{c}") for i in range(1, 4)), w[0] * F.col(f"p0.{c}")) for c in "xy"]
    return df.select(TRACK, (F.col("_at") * samples + F.col("s")).cast("long").alias(IDX), x.alias("x"), y.alias("y"))


def b_spline_loop(points: DataFrame, interpolations: int = 5000) -> DataFrame:
    """Closed uniform cubic B-spline with the points as coefficients, sampled as published: 2 * ``interpolations`` equal steps over two rounds, from a quarter of them
    to the sample of the last two quarters that comes nearest to the first (less two), and begun anew at the sample nearest to the ring's first point."""
    df = _four(points)
    most, half = 2 * interpolations - 1, interpolations // 2
    step = F.lit(float(most)) / (2 * F.col("_n") - 1)  # samples to one span
    df = df.withColumn("_r", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("_base", F.col("_at") + F.col("_r") * F.col("_n"))
    lo, hi = F.ceil(F.col("_base") * step).cast("long"), (F.ceil((F.col("_base") + 1) * step) - 1).cast("long")
    df = df.withColumns({"_lo": F.greatest(lo, F.lit(half).cast("long")), "_hi": F.least(hi, F.lit(most).cast("long"))}).where("_lo <= _hi")
    df = df.withColumn("_k", F.explode(F.sequence("_lo", "_hi"))).withColumn("t", F.col("_k") / step - F.col("_base"))
    t = F.col("t")
    w = ((1 - t) * (1 - t) * (1 - t) / 6, (3 * t * t * t - 6 * t * t + 4) / 6, (-3 * t * t * t + 3 * t * t + 3 * t + 1) / 6, t * t * t / 6)
    x, y = [sum((w[i] * F.col(f"p{i}.{c}") for i in range(1, 4)), w[0] * F.col(f"p0.{c}")) for c in "xy"]
    df = df.select(TRACK, "_k", x.alias("x"), y.alias("y"))
    track = Window.partitionBy(TRACK)
    begin = F.min(F.when(F.col("_k") == half, F.struct("x", "y"))).over(track)
    df = df.withColumn("_d", F.hypot(F.col("x") - begin["x"], F.col("y") - begin["y"]))
    end = F.min(F.when(F.col("_k") >= interpolations, F.struct("_d", "_k"))).over(track)["_k"]
    df = df.withColumn("_end", end).where("_k < _end - 1").drop("_d", "_end")
    first = points.where(F.col(IDX) == 0).select(F.col(TRACK).alias("_t"), F.col("x").alias("_x"), F.col("y").alias("_y"))
    df = df.join(first, F.col(TRACK) == F.col("_t")).withColumn("_d", F.hypot(F.col("x") - F.col("_x"), F.col("y") - F.col("_y")))
    start = F.min(F.struct("_d", "_k")).over(track)["_k"]
    return df.select(TRACK, F.pmod(F.col("_k") - start, F.count(F.lit(1)).over(track)).cast("long").alias(IDX), "x", "y")


def path_length(points: DataFrame) -> DataFrame:
    return points_to_lines(points).groupBy(TRACK).agg(F.sum(g.length(g.ln())).alias("length"))


def sum_points(*lists: DataFrame) -> DataFrame:
    """Element-wise sum of point lists of equal length; a place that one of them lacks, or has twice, is an error."""
    if not lists:
        raise ValueError("no lists to add")
    out = None
    for k, df in enumerate(lists):
        df = df.select(TRACK, IDX, "x", "y", F.lit(k).alias("_k"))
        out = df if out is None else out.unionByName(df)
    sums = out.groupBy(TRACK, IDX).agg(F.sum("x").alias("x"), F.sum("y").alias("y"), F.count("*").alias("_c"), F.countDistinct("_k").alias("_d"))
    ok = (F.col("_c") == len(lists)) & (F.col("_d") == len(lists))
    return sums.where(F.when(ok, F.lit(True)).otherwise(F.raise_error(F.lit("point lists differ in length")).cast("boolean"))).select(TRACK, IDX, "x", "y")


def at_indexes(df: DataFrame, wanted: DataFrame, key: str = "at") -> DataFrame:
    """The rows at the wanted places: wanted has track_id, idx (the place in the result) and ``key`` (the place in df)."""
    return wanted.select(TRACK, F.col(IDX).alias("_to"), F.col(key).alias(IDX)).join(df, [TRACK, IDX]).drop(IDX).withColumnRenamed("_to", IDX)
