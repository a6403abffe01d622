"""Algorithms that walk a track line by line: smoothing, choosing among crossings, shortest path.

Each runs as one numpy function for whole tracks, one (applyInPandas) or many at a time (mapInPandas): state is carried from line to line, or hundreds of sweeps
depend on each other.  A failing track gives a row with its error instead of failing the job."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from . import joins, rings
from .rings import IDX, TRACK
from .staging import settle

BOX = ["x1", "y1", "x2", "y2"]
LINES = "track_id long, idx long, x1 double, y1 double, x2 double, y2 double, error string"


def _each_track(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """fn for each track, rows in order of idx; an exception becomes a row (track_id, null..., error)."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        try:
            out = fn(pdf.sort_values(IDX, kind="stable").reset_index(drop=True))
            out[TRACK], out["error"] = key[0], None
        except Exception as e:  # noqa: BLE001  one bad track must not end the others
            out = pd.DataFrame({TRACK: [key[0]], "error": [f"{type(e).__name__}: {e}"]})
        return out.reindex(columns=names)

    return df.groupBy(TRACK).applyInPandas(run, schema)


def good(df: DataFrame) -> DataFrame:
    return df.where("error is null").drop("error")


def errors(df: DataFrame) -> DataFrame:
    return df.where("error is not null").select(TRACK, "error")


# --- smoothing ---


def smooth_lines(lines: np.ndarray, sweeps: int, width: float | np.ndarray, starts: np.ndarray | None = None) -> np.ndarray:
    """Directions become means of their neighbours' sweep by sweep, unless that would turn them more than 60 degrees from the
    original line; centres stay, and all lines get the same width.  starts: where each of several rings begins (width: of each line then)."""
    n = len(lines)
    before, after = np.arange(n) - 1, np.arange(n) + 1
    starts = np.zeros(1, np.int64) if starts is None else starts
    ends = np.append(starts[1:], n) - 1
    before[starts], after[ends] = ends, starts
    centre = (lines[:, :2] + lines[:, 2:]) / 2
    v = lines[:, :2] - centre
    first = lines[:, 2:] - lines[:, :2]
    norm = np.hypot(first[:, 0], first[:, 1])
    for _ in range(sweeps):
        new = v[before] + v + v[after]
        # the turn of new (which points to end 1) against the line, as if it pointed to end 2
        size = np.hypot(new[:, 0], new[:, 1]) * norm
        cos = np.divide(-(new * first).sum(1), size, out=np.ones(len(v)), where=size > 0)
        turn = np.where(np.round(cos, 8) == 1, 0.0, np.arccos(np.clip(cos, -1, 1)))
        new = np.where((turn > np.pi / 3)[:, None], v, new)
        d = np.hypot(new[:, 0], new[:, 1])[:, None]
        v = np.divide(new, d, out=np.zeros_like(new), where=d > 0)
    v = v * (np.asarray(width, float).reshape(-1, 1) / 2)
    return np.hstack([centre + v, centre - v])


#: Rows of whole tracks that one step of smoothing or cutting takes together.
SMOOTHED = 50_000


def _together(fn: Callable[[pd.DataFrame], pd.DataFrame]) -> Callable:
    """fn for whole tracks, many at a time, where batches come sorted by track."""

    def run(parts):
        held, n = [], 0
        for p in parts:
            if not len(p):
                continue
            held.append(p)
            n += len(p)
            last = p[TRACK].iloc[-1]
            if n >= SMOOTHED and held[0][TRACK].iloc[0] != last:
                whole = pd.concat(held)
                going_on = whole[TRACK].to_numpy() == last  # its rows may go on in the next batch
                yield fn(whole[~going_on])
                held, n = [whole[going_on]], int(going_on.sum())
        if n:
            yield fn(pd.concat(held))

    return run


def smooth_normals(normals: DataFrame, sweeps: int = 400, width: float | None = None) -> DataFrame:
    """normals: track_id, idx, x1..y2, and width if it differs by track.  Tracks are dealt and sorted by Spark and smoothed many at a time."""
    cols = [TRACK, IDX, *BOX] + (["width"] if width is None else [])

    def smoothed(p: pd.DataFrame) -> pd.DataFrame:
        track = p[TRACK].to_numpy()
        starts = np.flatnonzero(np.append(True, track[1:] != track[:-1]))
        w = np.repeat(p["width"].to_numpy(float)[starts], np.diff(np.append(starts, len(p)))) if width is None else np.full(len(p), float(width))
        out = pd.DataFrame(smooth_lines(p[BOX].to_numpy(float), sweeps, w, starts), columns=BOX)
        return out.assign(**{TRACK: track, IDX: p[IDX].to_numpy(), "error": None})[[TRACK, IDX, *BOX, "error"]]

    return normals.select(*cols).repartition(TRACK).sortWithinPartitions(TRACK, IDX).mapInPandas(_together(smoothed), LINES)


# --- one crossing for each half line ---


def circular_nearest(at: int, candidates: list[int], n: int) -> int:
    """The candidate least far from ``at`` around a ring of n (the first if equal)."""
    at %= n
    return min(candidates, key=lambda c: min(abs(at - c), n - abs(at - c)))


def walk(hits: list[list[tuple[int, float, float]]], start: int, boundary: int, n: int) -> list[tuple[float, float]]:
    """From the line after ``start`` around: of each line's crossings the one nearest along the boundary to the one before (the last if several)."""
    out: list = [None] * len(hits)
    for k in range(start + 1, start + 1 + len(hits)):
        mine = hits[k % len(hits)]
        boundary = circular_nearest(boundary, [h[0] for h in mine], n)
        out[k % len(hits)] = [h for h in mine if h[0] == boundary][-1][1:]
    return out


def collapse(hits: list[list[tuple[int, float, float]]], centres: np.ndarray, n: int) -> list[tuple[float, float]]:
    """One crossing per line.  Starts at a line with a single crossing; without any, walks from two opposite lines and starts where they agree."""
    if any(not h for h in hits):
        raise ValueError("a line does not meet the boundary")
    single = next((i for i, h in enumerate(hits) if len(h) == 1), None)
    if single is not None:
        return walk(hits, single, hits[single][0][0], n)
    runs = []
    for i in (0, len(hits) // 2):
        near = min(hits[i], key=lambda h: np.hypot(h[1] - centres[i][0], h[2] - centres[i][1]))
        runs.append(walk(hits, i, near[0], n))
    start, boundary = 0, hits[0][0][0]
    for i, (a, b) in enumerate(zip(*runs, strict=True)):
        if a == b:
            start, boundary = i, next(h[0] for h in hits[i] if h[1:] == a)
            break
    return walk(hits, start, boundary, n)


#: Pairs of a line and a segment that are tested at once.
PAIRS = 1_000_000


def _cells(lines: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, x, y) of every grid cell that a line's box covers."""
    lo, hi = [np.floor((f(lines[:, :2], lines[:, 2:]) + e) / size[:, None]) for f, e in ((np.minimum, -g.EPS), (np.maximum, g.EPS))]
    n = (hi - lo + 1).astype(np.int64)
    count = n[:, 0] * n[:, 1]
    row = np.repeat(np.arange(len(lines)), count)
    k = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    return row, lo[row, 0] + k // n[row, 1], lo[row, 1] + k % n[row, 1]


def _key(track: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Equal for equal cells; others are told apart by what comes after."""
    a = [v.astype(np.int64).astype(np.uint64) for v in (track, x, y)]
    return a[0] * np.uint64(0x9E3779B97F4A7C15) + a[1] * np.uint64(0xC2B2AE3D27D4EB4F) + a[2] * np.uint64(0x165667B19E3779F9)


def first_hits(half: np.ndarray, of: np.ndarray, seg: np.ndarray, seg_of: np.ndarray, size: np.ndarray, most: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """joins.extend_until_hit() on arrays: places of line and segment, and the points where they cross, at the first length at which a half line meets anything.

    of, seg_of: numbers of the tracks; size: grid cells of each track.  A track's cells are doubled until what covers them is in proportion to its lines."""
    open_, real = np.flatnonzero(np.isfinite(half).all(1)), np.flatnonzero(np.isfinite(seg).all(1))
    on = np.append(of[open_], seg_of[real])
    span = np.abs(np.vstack([(half[open_, 2:] - half[open_, :2]) * most, seg[real, 2:] - seg[real, :2]]))
    rows = np.bincount(on, minlength=len(size))
    while (wide := np.bincount(on, (np.floor(span / size[on][:, None]) + 2).prod(1), len(size)) > 16 * rows + 1024).any():
        size = np.where(wide, size * 2, size)
    r, bx, by = _cells(seg[real], size[seg_of[real]])
    r = real[r]
    keys = _key(seg_of[r], bx, by)
    order = np.argsort(keys, kind="stable")
    r, bx, by, keys = r[order], bx[order], by[order], keys[order]
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, 2)))]
    for ext in range(most):
        line, cx, cy = _cells(a := np.hstack([half[open_, :2], half[open_, 2:] + (half[open_, 2:] - half[open_, :2]) * ext]), size[of[open_]])
        k = _key(of[open_[line]], cx, cy)
        lo = np.searchsorted(keys, k)
        count = np.searchsorted(keys, k, "right") - lo
        line, cx, cy, lo, count = [v[count > 0] for v in (line, cx, cy, lo, count)]
        met = []
        for part in np.split(np.arange(len(line)), np.flatnonzero(np.diff(np.cumsum(count) // PAIRS)) + 1):
            c = np.repeat(part, count[part])
            j = lo[c] + np.arange(len(c)) - np.repeat(np.cumsum(count[part]) - count[part], count[part])
            same = (of[open_[line[c]]] == seg_of[r[j]]) & (cx[c] == bx[j]) & (cy[c] == by[j])
            c, j = c[same], r[j[same]]
            u, v = a[line[c]], seg[j]
            h = _meeting(u, v)
            ok = (np.floor(h / size[seg_of[j]][:, None]) == np.stack([cx[c], cy[c]], 1)).all(1)  # the cell that holds the crossing owns it
            for s in (u, v):
                ok &= ((h >= np.minimum(s[:, :2], s[:, 2:]) - g.EPS) & (h <= np.maximum(s[:, :2], s[:, 2:]) + g.EPS)).all(1)
            met.append(line[c[ok]])
            out.append((open_[line[c[ok]]], j[ok], h[ok]))
        open_ = np.delete(open_, np.unique(np.concatenate(met)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _meeting(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Where the lines through two segments cross; nan where they are parallel."""
    ax, ay = (a[:, :2] - a[:, 2:]).T
    bx, by = (b[:, :2] - b[:, 2:]).T
    delta = ax * by - ay * bx
    da, db = a[:, 0] * a[:, 3] - a[:, 1] * a[:, 2], b[:, 0] * b[:, 3] - b[:, 1] * b[:, 2]
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        return np.where((delta != 0)[:, None], np.stack([(da * bx - ax * db) / delta, (da * by - ay * db) / delta], 1), np.nan)


def _ends(half: np.ndarray, of: np.ndarray, points: np.ndarray, points_of: np.ndarray, points_idx: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[str | None]]:
    """(one crossing for each half line, is the track without a boundary, its error) of rings that are sorted by track and idx."""
    starts = np.flatnonzero(np.append(True, points_of[1:] != points_of[:-1])) if len(points) else np.zeros(0, np.int64)
    before = np.arange(len(points)) - 1
    before[starts] = np.append(starts[1:], len(points))[: len(starts)] - 1
    line, j, h = first_hits(half, of, np.hstack([points[before], points]), points_of, size)
    order = np.lexsort((h[:, 1], h[:, 0], points_idx[j], line))
    line, at, h = line[order], points_idx[j[order]], h[order]
    count, n = np.bincount(line, minlength=len(half)), np.bincount(points_of, minlength=len(size))
    first = np.cumsum(count) - count
    out = np.full((len(half), 2), np.nan)
    out[count == 1] = h[first[count == 1]]
    error: list[str | None] = [None] * len(size)
    for t in np.unique(of[(count != 1) & (n[of] > 0)]):
        rows = np.arange(np.searchsorted(of, t), np.searchsorted(of, t, "right"))
        try:
            hits = [[(int(at[k]), float(h[k, 0]), float(h[k, 1])) for k in range(first[i], first[i] + count[i])] for i in rows]
            out[rows] = collapse(hits, (half[rows, :2] + half[rows, 2:]) / 2, int(n[t]))
        except Exception as e:  # noqa: BLE001  one bad track must not end the others
            error[t] = f"{type(e).__name__}: {e}"
    return out, n == 0, error


def _cut(names: np.ndarray, lines: np.ndarray, of: np.ndarray, idx: np.ndarray, sides: list[tuple[np.ndarray, np.ndarray, np.ndarray]], cell: float | None = None) -> pd.DataFrame:
    """Lines of whole tracks between their boundaries; one row with an error for each other track.  of: places of the tracks in names; sides: points, of and idx of
    the left and of the right boundary."""
    centre = (lines[:, :2] + lines[:, 2:]) / 2
    out, none, errors_ = [], np.zeros(len(names), bool), [None] * len(names)
    for k, side in enumerate(sides):
        half = np.hstack([centre, lines[:, 2 * k : 2 * k + 2]])
        size = np.zeros(len(names))
        np.fmax.at(size, of, np.hypot(*(half[:, 2:] - half[:, :2]).T))
        ends, without, error = _ends(half, of, *side, np.maximum(size, 1e-6) * 2 if cell is None else np.full(len(names), float(cell)))
        out.append(ends)
        none |= without
        errors_ = [a or b for a, b in zip(errors_, error, strict=True)]
    bad = np.array([e is not None for e in errors_])
    keep = ~(none | bad)[of]
    good_ = pd.DataFrame(np.hstack(out)[keep], columns=BOX).assign(**{TRACK: names[of[keep]], IDX: idx[keep], "error": None})
    failed = pd.DataFrame({TRACK: names[bad], "error": [e for e in errors_ if e is not None]}).reindex(columns=[TRACK, IDX, *BOX, "error"])
    both = [x for x in (good_[failed.columns], failed) if len(x)]
    return pd.concat([x.astype({IDX: "Int64"}) for x in both]) if both else failed.astype({IDX: "Int64"})


def _kinds(p: pd.DataFrame) -> tuple:
    """(tracks; rows, places of their tracks, and idx of the kinds 0, 1 and 2) of rows sorted by track, kind, idx."""
    names, of = np.unique(p[TRACK].to_numpy(), return_inverse=True)
    kind, box = p["kind"].to_numpy(), p[BOX].to_numpy(float)
    box[(kind == 0) & p[IDX].isna().to_numpy()] = np.nan  # a line without a place meets nothing
    idx = p[IDX].fillna(-1).to_numpy(np.int64)
    return names, *[(box[kind == k], of[kind == k], idx[kind == k]) for k in range(3)]


def cut_to_boundaries(lines: DataFrame, left: DataFrame, right: DataFrame, cell: float | None = None) -> DataFrame:
    """Each line between its crossings with the left and the right boundary (points), whatever else it crosses.

    A half line that meets nothing grows by its own length up to four times.  Lines and points are dealt and sorted by Spark once, and whole tracks cut many at a time: no
    join, so no table that a planner could take for a small one.  A line that meets nothing is an error of its track; tracks without a boundary give no row."""
    nothing = F.lit(None).cast("double")
    points = [side.select(TRACK, IDX, F.col("x").alias("x1"), F.col("y").alias("y1"), nothing.alias("x2"), nothing.alias("y2")) for side in (left, right)]

    def cut(p: pd.DataFrame) -> pd.DataFrame:
        names, line, *sides = _kinds(p)
        return _cut(names, *line, [(box[:, :2], of, idx) for box, of, idx in sides], cell)

    return _dealt(lines, *points).mapInPandas(_together(cut), LINES)


def _dealt(*frames: DataFrame) -> DataFrame:
    """The rows of all with their kind (the place of their table), each track's together and sorted by kind and idx."""
    rows = [df.select(TRACK, F.lit(kind).alias("kind"), IDX, *[F.col(c).cast("double").alias(c) for c in BOX]) for kind, df in enumerate(frames)]
    return reduce(DataFrame.unionByName, rows).where(F.col(TRACK).isNotNull()).repartition(TRACK).sortWithinPartitions(TRACK, "kind", IDX)


def curve(points: np.ndarray, of: np.ndarray, samples: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """rings.catmull_rom() on arrays of closed rings, sorted by track: points, places of their tracks, and idx."""
    starts = np.flatnonzero(np.append(True, of[1:] != of[:-1])) if len(of) else np.zeros(0, np.int64)
    ends = np.append(starts[1:], len(of))[: len(starts)] - 1
    before, after = np.arange(len(of)) - 1, np.arange(len(of)) + 1
    before[starts], after[ends] = ends, starts
    p = [points[before], points, points[after], points[after[after]]]
    t = [np.zeros((len(of), 1, 1))]
    for a, b in zip(p, p[1:], strict=False):
        t.append(t[-1] + np.sqrt(np.hypot(*(b - a).T))[:, None, None])
    at = t[1] + (t[2] - t[1]) * np.arange(samples)[None, :, None] / samples

    def mixed(a: np.ndarray, b: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return (hi - at) / (hi - lo) * a + (at - lo) / (hi - lo) * b

    with np.errstate(divide="ignore", invalid="ignore"):
        a1, a2, a3 = [mixed(p[k][:, None, :], p[k + 1][:, None, :], t[k], t[k + 1]) for k in range(3)]
        out = mixed(mixed(a1, a2, t[0], t[2]), mixed(a2, a3, t[1], t[3]), t[1], t[2])
    first = np.repeat(starts, ends - starts + 1)
    idx = ((np.arange(len(of)) - first) * samples)[:, None] + np.arange(samples)
    return out.reshape(-1, 2), np.repeat(of, samples), idx.ravel()


def smooth_track(tracks: DataFrame, spacing: float | None = None, sweeps: int = 400) -> DataFrame:
    """New lines across the track at equal distances (near ``spacing``, so that start and finish fit; None keeps the lines), smoothed, and cut at the boundaries.

    Old and new lines are dealt once; widths, boundary curves, smoothing and cuts are made where they meet."""
    lines = old = tracks.select(TRACK, IDX, *BOX)
    if spacing:
        mid = rings.lines_to_points(old, "mid")
        steps = rings.path_length(mid).select(TRACK, (F.col("length") / F.floor(F.col("length") / F.lit(float(spacing)))).alias("step"))
        lines = rings.normals_on_path_by(rings.catmull_rom(mid, 5, True), 80.0, steps)

    def smoothed(p: pd.DataFrame) -> pd.DataFrame:
        names, (new, of, idx), (box, box_of, _), _ = _kinds(p)
        width = np.full(len(names), np.nan)
        np.fmax.at(width, box_of, np.hypot(*(box[:, 2:] - box[:, :2]).T) * 2)
        if len(new):
            new = smooth_lines(new, sweeps, width[of], np.flatnonzero(np.append(True, of[1:] != of[:-1])))
        return _cut(names, new, of, idx, [curve(box[:, side], box_of, 5) for side in (slice(0, 2), slice(2, 4))])

    return _dealt(lines, old).mapInPandas(_together(smoothed), LINES)


# --- shortest path ---


def walk_path(lines: np.ndarray, steps: int = 70) -> np.ndarray:
    """Where a short open path meets each line: dynamic programming over steps + 1 stations of each line, with local search.

    For each station the search starts at the same station of the line before, goes forward while the distance falls (the last
    station is never tried), then back from the best one; back-pointers give the path."""
    at = np.arange(steps + 1) / steps
    stations = lines[:, None, :2] + (lines[:, None, 2:] - lines[:, None, :2]) * at[None, :, None]
    own, total = np.arange(steps + 1), np.zeros(steps + 1)
    back = np.zeros((len(lines), steps + 1), np.int64)
    for i in range(1, len(lines)):
        d = np.hypot(*(stations[i][:, None, :] - stations[i - 1][None, :, :]).transpose(2, 0, 1)) + total[None, :]
        # forward to the first station that isn't nearer than the one before, then back in the same way
        falls = np.zeros(d.shape, bool)
        falls[:, : steps - 1] = d[:, 1:steps] < d[:, : steps - 1]
        ahead = np.minimum.accumulate(np.where(falls, steps, own)[:, ::-1], axis=1)[:, ::-1][own, own]
        rises = np.zeros(d.shape, bool)
        rises[:, 1:] = d[:, :-1] < d[:, 1:]
        best = np.maximum.accumulate(np.where(rises, 0, own), axis=1)[own, ahead]
        back[i] = best
        total = d[own, best]
    k = int(np.argmin(total))
    out = np.empty(len(lines))
    for i in range(len(lines) - 1, -1, -1):
        out[i] = at[k]
        k = back[i][k]
    return out


def relax(lines: np.ndarray, t: np.ndarray, most: int = 10_000, stop: float = 10e-6) -> np.ndarray:
    """Each point moves to where the chord of its neighbours (of the sweep before) meets its line, or to the nearer end; only
    lines beside a change are looked at again.  Ends when the last improvements are small on average."""
    t = t.copy()
    n = len(lines)
    a, b = lines[:, :2], lines[:, 2:]
    size = np.hypot(*(b - a).T)
    points = a + (b - a) * t[:, None]

    def total() -> float:
        return float(np.hypot(*(np.roll(points, -1, axis=0) - points).T).sum())

    length, open_, gains = total(), np.ones(n, bool), []
    for _ in range(most):
        gains = gains[-5:]
        p, q = np.roll(points, 1, axis=0), np.roll(points, -1, axis=0)
        new = _chord(a, b, p, q, size)
        ends = (np.hypot(*(p - a).T) + np.hypot(*(q - a).T) > np.hypot(*(p - b).T) + np.hypot(*(q - b).T)).astype(float)
        new = np.where(np.isnan(new), ends, new)
        moved = open_ & (new != t)
        t = np.where(open_, new, t)
        open_ = moved | np.roll(moved, 1) | np.roll(moved, -1)
        points = a + (b - a) * t[:, None]
        now = total()
        gains.append(abs(length - now))
        if len(gains) > 3 and np.mean(gains) < stop:
            break
        length = now
    return t


def _chord(a, b, p, q, size) -> np.ndarray:
    """Where segment p-q crosses line a-b, as a part of its length; nan where it doesn't."""
    ax, ay = (a - b).T
    bx, by = (p - q).T
    delta = ax * by - ay * bx
    da, db = a[:, 0] * b[:, 1] - a[:, 1] * b[:, 0], p[:, 0] * q[:, 1] - p[:, 1] * q[:, 0]
    with np.errstate(divide="ignore", invalid="ignore"):
        h = np.stack([(da * bx - ax * db) / delta, (da * by - ay * db) / delta], 1)
        ok = delta != 0
        for u, v in ((a, b), (p, q)):
            ok &= ((h >= np.minimum(u, v) - g.EPS) & (h <= np.maximum(u, v) + g.EPS)).all(1)
        return np.where(ok, np.hypot(*(h - a).T) / size, np.nan)


def shortest(lines: np.ndarray, padding: float = 1.0, most: int = 10_000, stop: float = 10e-6) -> tuple[np.ndarray, np.ndarray]:
    """(lines inset by padding, place of the path on each)."""
    d = lines[:, 2:] - lines[:, :2]
    size = np.hypot(*d.T)[:, None]
    grow = np.minimum(-padding, (size - 0.1) / 2)
    u = np.divide(d, size, out=np.full_like(d, np.nan), where=size > 0)
    inset = np.hstack([lines[:, :2] - u * grow, lines[:, 2:] + u * grow])
    if np.isnan(inset).any():
        raise ValueError("a line has no length")
    return inset, relax(inset, walk_path(inset), most, stop)


def shortest_path(tracks: DataFrame, padding: float = 1.0, most: int = 10_000, stop: float = 10e-6) -> DataFrame:
    """(track_id, idx, x, y, interpolation, x1..y2 of the inset line, error)."""

    def fn(p: pd.DataFrame) -> pd.DataFrame:
        inset, t = shortest(p[BOX].to_numpy(float), padding, most, stop)
        xy = inset[:, :2] + (inset[:, 2:] - inset[:, :2]) * t[:, None]
        return pd.DataFrame(np.column_stack([xy, t, inset]), columns=["x", "y", "interpolation", *BOX]).assign(**{IDX: p[IDX]})

    return _each_track(tracks.select(TRACK, IDX, *BOX), fn, "track_id long, idx long, x double, y double, interpolation double, x1 double, y1 double, x2 double, y2 double, error string")


# --- the reference-line format: a point, and the distances to the right and the left edge ---


def from_xyrl(points: DataFrame) -> DataFrame:
    """(track_id, idx, x, y, r, l) to segmentation lines."""
    across = rings.normals(points.select(TRACK, IDX, "x", "y")).join(points, [TRACK, IDX])
    u = [g.normalise_point(g.Pt(F.col(f"x{k}") - F.col("x"), F.col(f"y{k}") - F.col("y"))) for k in "12"]
    cols = [(F.col(c) + getattr(p, c) * F.col(w)).alias(f"{c}{k}") for p, w, k in zip(u, ("l", "r"), "12", strict=True) for c in "xy"]
    return across.select(TRACK, IDX, *cols)


def to_xyrl(tracks: DataFrame, spacing: float = 2.0) -> DataFrame:
    """Segmentation lines to (track_id, idx, x, y, r, l) along the shortest path."""
    left, right = [rings.lines_to_points(tracks, side) for side in ("left", "right")]
    first = settle(good(shortest_path(tracks)).select(TRACK, IDX, "x", "y"))
    cut = good(cut_to_boundaries(rings.normals_on_path(first, 80.0, spacing), left, right))
    path = settle(good(shortest_path(cut)).select(TRACK, IDX, "x", "y"))
    ends = good(cut_to_boundaries(rings.normals(path, 80.0), left, right))
    d = [F.hypot(F.col("x") - F.col(f"x{k}"), F.col("y") - F.col(f"y{k}")) for k in "12"]
    # the planner would take either side for as small as the files that the tracks come from, and broadcast it
    return path.join(ends.hint("merge"), [TRACK, IDX]).select(TRACK, IDX, "x", "y", d[1].alias("r"), d[0].alias("l"))
