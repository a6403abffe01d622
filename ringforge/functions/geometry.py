"""Point and line algebra as Column expressions.

Points are Pt(x, y), lines Ln(x1, y1, x2, y2); end 1 is the left end of a segmentation line.  Everything is in double
precision and stays inside generated code.  Divisions use try_divide: under ANSI rules a filter before a division doesn't
protect it, since the optimizer may move either."""

from __future__ import annotations

from math import pi
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TAU = 2 * pi
#: How far outside a segment's box a crossing point may lie.
EPS = 1e-9


class Pt(NamedTuple):
    x: Column
    y: Column


class Ln(NamedTuple):
    x1: Column
    y1: Column
    x2: Column
    y2: Column

    @property
    def start(self) -> Pt:
        return Pt(self.x1, self.y1)

    @property
    def end(self) -> Pt:
        return Pt(self.x2, self.y2)


def pt(x: str | Column, y: str | Column) -> Pt:
    return Pt(*[F.col(c) if isinstance(c, str) else c for c in (x, y)])


def ln(suffix: str = "") -> Ln:
    return Ln(*[F.col(c + suffix) for c in ("x1", "y1", "x2", "y2")])


def lit_pt(x: float, y: float) -> Pt:
    return Pt(F.lit(float(x)), F.lit(float(y)))


# --- points ---


def sub(a: Pt, b: Pt) -> Pt:
    return Pt(a.x - b.x, a.y - b.y)


def distance(a: Pt, b: Pt) -> Column:
    return F.hypot(a.x - b.x, a.y - b.y)


def lerp(a: Pt, b: Pt, t: Column) -> Pt:
    return Pt(a.x + (b.x - a.x) * t, a.y + (b.y - a.y) * t)


def normalise_point(p: Pt) -> Pt:
    """The unit vector; the zero vector stays zero."""
    d = F.hypot(p.x, p.y)
    return Pt(*[F.when(d == 0, 0.0).otherwise(F.try_divide(c, d)) for c in p])


def rotate(p: Pt, angle: Column, around: Pt | None = None) -> Pt:
    o = around or lit_pt(0, 0)
    dx, dy = p.x - o.x, p.y - o.y
    return Pt(o.x + dx * F.cos(angle) - dy * F.sin(angle), o.y + dx * F.sin(angle) + dy * F.cos(angle))


# --- angles ---


def angle_to(a: Pt, b: Pt) -> Column:
    return F.atan2(b.y - a.y, b.x - a.x)


def angle_between(a: Pt, b: Pt, c: Pt) -> Column:
    """The turn at b from a to c, in [0, tau)."""
    return F.pmod(angle_to(b, c) - angle_to(b, a) + F.lit(TAU), F.lit(TAU))


def angle3(a: Pt, b: Pt, c: Pt) -> Column:
    """The same less pi: straight on is 0."""
    return angle_between(a, b, c) - F.lit(pi)


def line_angle(line: Ln) -> Column:
    return angle_to(line.start, line.end)


def angle_between_lines(a: Ln, b: Ln) -> Column:
    """The unsigned angle in [0, pi]; 0 if a line has no length."""
    ax, ay, bx, by = a.x2 - a.x1, a.y2 - a.y1, b.x2 - b.x1, b.y2 - b.y1
    norm = F.hypot(ax, ay) * F.hypot(bx, by)
    cos = F.try_divide(ax * bx + ay * by, norm)
    return F.when(norm == 0, 0.0).when(F.bround(cos, 8) == 1, 0.0).otherwise(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cos))))


# --- lines ---


def length(line: Ln) -> Column:
    return distance(line.start, line.end)


def center(line: Ln) -> Pt:
    return Pt((line.x1 + line.x2) / 2, (line.y1 + line.y2) / 2)


def direction(line: Ln) -> Pt:
    """The unit direction; null if the line has no length."""
    d = length(line)
    return Pt(F.try_divide(line.x2 - line.x1, d), F.try_divide(line.y2 - line.y1, d))


def set_length(line: Ln, width: Column) -> Ln:
    """Resized about its centre; null if the line has no length."""
    c, u = center(line), direction(line)
    return Ln(c.x - u.x * width / 2, c.y - u.y * width / 2, c.x + u.x * width / 2, c.y + u.y * width / 2)


def extend(line: Ln, amount: Column, least: Column | float = 0.0) -> Ln:
    """Both ends moved out by ``amount``, half of what the line has above ``least`` at most; a negative amount shortens."""
    d = length(line)
    grow = F.least(amount, (d - least) / 2)
    u = direction(line)
    return Ln(line.x1 - u.x * grow, line.y1 - u.y * grow, line.x2 + u.x * grow, line.y2 + u.y * grow)


def lerp_line(line: Ln, t: Column) -> Pt:
    return lerp(line.start, line.end, t)


def flip(line: Ln) -> Ln:
    """Mirrored at the x axis with its ends swapped, so that left stays left."""
    return Ln(line.x2, -line.y2, line.x1, -line.y1)


def meeting(a: Ln, b: Ln) -> Pt:
    """Where the lines through two segments cross; null where they are parallel."""
    adx, ady = a.x1 - a.x2, a.y1 - a.y2
    bdx, bdy = b.x1 - b.x2, b.y1 - b.y2
    delta = adx * bdy - ady * bdx
    da, db = a.x1 * a.y2 - a.y1 * a.x2, b.x1 * b.y2 - b.y1 * b.x2
    return Pt(F.try_divide(da * bdx - adx * db, delta), F.try_divide(da * bdy - ady * db, delta))


def lies_on(p: Pt, *segments: Ln) -> Column:
    """Is a point of the segments' lines within all of them?  False where it is null."""
    ok = F.lit(True)
    for s in segments:
        ok = ok & p.x.between(F.least(s.x1, s.x2) - EPS, F.greatest(s.x1, s.x2) + EPS) & p.y.between(F.least(s.y1, s.y2) - EPS, F.greatest(s.y1, s.y2) + EPS)
    return F.coalesce(ok, F.lit(False))


def with_meeting(df: DataFrame, a: Ln, b: Ln) -> DataFrame:
    """Adds hx, hy, and leaves rows whose segments cross there.

    The point passes through an explode of one, so that it is made once: put into each of the eight comparisons instead, the generated method grows too large
    for the JVM to compile."""
    p = meeting(a, b)
    df = df.withColumn("_h", F.explode(F.array(F.struct(p.x.alias("x"), p.y.alias("y")))))
    return df.where(lies_on(Pt(F.col("_h.x"), F.col("_h.y")), a, b)).withColumns({"hx": F.col("_h.x"), "hy": F.col("_h.y")}).drop("_h")


def crossing(a: Ln, b: Ln) -> tuple[Column, Pt]:
    """(do the segments cross, the crossing point of their lines).  Parallel ones never do."""
    p = meeting(a, b)
    return lies_on(p, a, b), p


def round_half_even(c: Column, places: int) -> Column:
    return F.bround(c, places)
