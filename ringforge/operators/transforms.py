"""Training examples from rings, and their inverses.

Channels are collected once per track (a track is a bounded row) and every example is cut from them with array functions.
Targets, lags and patches all come down to circular indexes, so windows longer than the ring need nothing special."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rings import IDX, TRACK

INPUTS = ("width", "angle", "offset")
OUTPUTS = ("position", "velocity")


@dataclass(frozen=True)
class Transform:
    """What a model was trained with.  Window methods take no lag and no patches, bidirectional no lag: other values are refused."""

    method: str = "flat-window"
    inputs: tuple[str, ...] = INPUTS
    outputs: tuple[str, ...] = OUTPUTS
    foresight: int = 0
    sampling: int = 0
    lag: int = 0
    patch_size: int = 1
    time_to_vec: bool = False
    vehicle_encoding: str | tuple[str, ...] = "V1"

    def __post_init__(self):
        if self.method not in METHODS:
            raise ValueError(f"unknown transform method: {self.method}")
        if self.method in ("window", "flat-window") and (self.lag or self.patch_size != 1):
            raise ValueError("window methods take neither lag nor patches")
        if self.method == "bidirectional" and self.lag:
            raise ValueError("the bidirectional method takes no lag")

    def transform(self, encoded: DataFrame) -> DataFrame:
        return METHODS[self.method][0](encoded, self)

    def detransform(self, examples: DataFrame, col: str) -> DataFrame:
        return METHODS[self.method][1](examples, self, col)


def per_track(encoded: DataFrame, channels: Sequence[str]) -> DataFrame:
    """One row per track: n and an array of each channel, in order of idx."""
    rows = encoded.groupBy(TRACK).agg(F.array_sort(F.collect_list(F.struct(IDX, *channels))).alias("_r"))
    return rows.select(TRACK, F.size("_r").alias("n"), *[F.col(f"_r.{c}").alias(c) for c in channels])


def _gather(a: Column, start: Column, count: Column | int, n: Column) -> Column:
    """count elements of the ring a from start on."""
    count = count if isinstance(count, Column) else F.lit(count)
    return F.transform(F.sequence(F.lit(0), count - 1), lambda k: F.get(a, F.pmod(start + k, n).cast("int")))


def _rows(df: DataFrame) -> DataFrame:
    return df.withColumn(IDX, F.explode(F.sequence(F.lit(0).cast("long"), F.col("n").cast("long") - 1)))


def targets(a: str, idx: Column, n: Column, t: Transform) -> Column:
    """The outputs around a row: patch_size * (2 sampling + 1) values, ``lag`` rows late."""
    p, s = t.patch_size, t.sampling
    return _gather(F.col(a), idx + 1 - p - s * p - t.lag, p * (2 * s + 1), n)


def rolled_copies(encoded: DataFrame, channels: Sequence[str], sampling: int) -> DataFrame:
    """x: the channels of the rows ``sampling`` before to ``sampling`` after each row, side by side."""
    df = _rows(per_track(encoded, channels))
    parts = [F.get(F.col(c), F.pmod(F.col(IDX) + k, F.col("n")).cast("int")).cast("double") for k in range(-sampling, sampling + 1) for c in channels]
    return df.select(TRACK, IDX, F.array(*parts).alias("x"))


def padded(a: str, f: int) -> Column:
    """The ring with its last f values before and its first f after: windows are slices of it."""
    n = F.col("n")
    return F.transform(F.sequence(F.lit(-f), n - 1 + f), lambda i: F.get(F.col(a), F.pmod(i, n).cast("int")))


def _with_targets(df: DataFrame, t: Transform) -> DataFrame:
    return df.withColumns({f"y_{c}": targets(c, F.col(IDX), F.col("n"), t) for c in t.outputs}).drop(*t.outputs)


def window(encoded: DataFrame, t: Transform, flat: bool = False) -> DataFrame:
    """x: for each channel the 2 * foresight + 1 values around the row."""
    f = t.foresight
    df = per_track(encoded, (*t.inputs, *t.outputs))
    df = _rows(df.withColumns({c: padded(c, f) for c in t.inputs}))
    parts = [F.slice(c, F.col(IDX).cast("int") + 1, 2 * f + 1) for c in t.inputs]
    x = F.concat(*parts) if flat else F.array(*parts)
    return _with_targets(df.withColumn("x", x.cast("array<float>" if flat else "array<array<float>>")).drop(*t.inputs), t)


def _zipped(cols: Sequence[str]) -> Column:
    """Channels as an array of vectors."""
    first, *rest = cols
    out = F.transform(F.col(first), lambda v: F.array(v.cast("double")))
    for c in rest:
        out = F.zip_with(out, F.col(c), lambda v, w: F.concat(v, F.array(w.cast("double"))))
    return out


def patches(vector: Callable[[Column], Column], count: Column, p: int, width: int, to: Column | None = None, mark: Callable[[Column, Column], Column] | None = None) -> Column:
    """``count`` vectors in groups of p, joined into one each; filled up with -1 in front, and with whole groups of -1 up to ``to`` groups.

    vector: the vector at a place; mark: a value to add to a group, from its place and the number of groups.  Each value is taken from its place
    alone, so that the work is in proportion to the output (an array that is put together first would be made anew for each group)."""
    missing = F.pmod(-count, F.lit(p))
    m = ((count + missing) / p).cast("int")
    blank = F.array(*[F.lit(-1.0)] * width)
    before = F.lit(0) if to is None else to.cast("int") - m

    def group(j: Column) -> Column:
        at = lambda q: j * p + q - missing
        flat = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(p - 1)), lambda q: F.when(at(q) < 0, blank).otherwise(vector(at(q)))))
        return F.concat(flat, F.array(mark(j, m))) if mark else flat

    empty = F.array(*[F.lit(-1.0)] * (width * p + bool(mark)))
    return F.transform(F.sequence(F.lit(0), before + m - 1), lambda j: F.when(j < before, empty).otherwise(group(j - before)))


def patchify(vectors: Column, n: Column, p: int, width: int) -> Column:
    """An array of n vectors in groups of p, joined into one vector each; filled up with -1 in front."""
    return patches(lambda s: F.get(vectors, s.cast("int")), n, p, width)


def time_mark(n: Column, p: int, tail: Column) -> Callable[[Column, Column], Column]:
    """Places along the track in [0, 1]: one for each patch of the first round, and again for the last ``tail`` groups; 0 between."""
    most = F.ceil(n / F.lit(p)).cast("int")
    step = F.greatest(F.lit(1), most - 1)
    return lambda j, m: F.when(j >= m - tail, (j - (m - tail)) / step).when(j < most, j / step).otherwise(0.0)


def _longest(df: DataFrame) -> DataFrame:
    return df.crossJoin(F.broadcast(df.agg(F.max("n").alias("longest"))))


def _vectors(encoded: DataFrame, t: Transform) -> DataFrame:
    """One row per track: n, an array of input vectors _v, and the outputs' arrays."""
    return per_track(encoded, (*t.inputs, *t.outputs)).withColumn("_v", _zipped(t.inputs)).drop(*t.inputs)


def _at(place: Column) -> Column:
    return F.get(F.col("_v"), F.pmod(place, F.col("n")).cast("int"))


def lag(encoded: DataFrame, t: Transform) -> DataFrame:
    """x: the whole track, then the track up to the row, in patches, filled up with -1 in front.  Grows with the square of a track."""
    p, n, i = t.patch_size, F.col("n"), F.col(IDX).cast("int")
    df = _rows(_longest(_vectors(encoded, t)))
    mark = time_mark(n, p, F.floor(i / p).cast("int") + 1) if t.time_to_vec else None
    x = patches(_at, n + i + 1, p, len(t.inputs), F.ceil(F.col("longest") / F.lit(p)) * 2, mark)
    return _with_targets(df.withColumn("x", x.cast("array<array<float>>")).drop("_v", "longest"), t)


def stateful_lag(encoded: DataFrame, t: Transform) -> DataFrame:
    """One sequence per track: the track twice, in patches; outputs for each patch (arrays of arrays)."""
    p, s, n = t.patch_size, t.sampling, F.col("n")
    # the rows pass through an explode of one, so that the vectors are made once and not for each value
    df = _vectors(encoded, t).withColumn("_one", F.explode(F.array_repeat(F.lit(1), F.least(n, F.lit(1))))).drop("_one")
    m = F.ceil(n / F.lit(p)).cast("int")
    mark = time_mark(n, p, m) if t.time_to_vec else None

    def outputs(c: str) -> Column:
        return F.transform(F.sequence(F.lit(0), m - 1), lambda i: _gather(F.col(c), n - p * (1 + (m - i - 1) + s) - t.lag, p * (2 * s + 1), n))

    x = patches(_at, n * 2, p, len(t.inputs), None, mark)
    return df.withColumns({f"y_{c}": outputs(c) for c in t.outputs} | {"x": x.cast("array<array<float>>")}).drop("_v", *t.outputs)


def bidirectional(encoded: DataFrame, t: Transform) -> DataFrame:
    """x: the ring onward and the ring backward, both ending on the row, side by side; in patches, filled up with -1 in front."""
    p, k, n, i = t.patch_size, len(t.inputs), F.col("n"), F.col(IDX).cast("int")
    df = _rows(_longest(_vectors(encoded, t)))
    x = patches(lambda s: F.concat(_at(i + 1 + s), _at(i - 1 - s)), n, p, 2 * k, F.ceil(F.col("longest") / F.lit(p)))
    return _with_targets(df.withColumn("x", x.cast("array<array<float>>")).drop("_v", "longest"), t)


def _averaged(df: DataFrame, at: Column, col: str) -> DataFrame:
    """Overlapping outputs back to one value for each line."""
    return df.withColumn("_at", at).groupBy(TRACK, F.col("_at").cast("long").alias(IDX)).agg(F.avg("_y").alias(col))


def undo_window(examples: DataFrame, t: Transform, col: str) -> DataFrame:
    df = examples.select(TRACK, IDX, "n", F.posexplode(col).alias("_k", "_y"))
    return _averaged(df, F.pmod(F.col(IDX) + F.col("_k") - t.sampling, F.col("n")), col)


def undo_lag(examples: DataFrame, t: Transform, col: str) -> DataFrame:
    df = examples.select(TRACK, IDX, "n", F.posexplode(col).alias("_k", "_y"))
    return _averaged(df, F.pmod(F.col(IDX) + F.col("_k") - t.patch_size * (t.sampling + 1) + 1 - t.lag, F.col("n")), col)


def undo_stateful(examples: DataFrame, t: Transform, col: str) -> DataFrame:
    df = examples.select(TRACK, "n", F.size(col).alias("_m"), F.posexplode(col).alias("_i", "_f")).select(TRACK, "n", "_m", "_i", F.posexplode("_f").alias("_k", "_y"))
    start = F.col("n") - t.patch_size * (F.col("_m") - F.col("_i") + t.sampling)
    return _averaged(df, F.pmod(start + F.col("_k") - t.lag, F.col("n")), col)


def undo_bidirectional(examples: DataFrame, t: Transform, col: str) -> DataFrame:
    return undo_lag(examples, t, col)


METHODS: dict[str, tuple[Callable, Callable]] = {
    "window": (window, undo_window),
    "flat-window": (lambda e, t: window(e, t, flat=True), undo_window),
    "lag": (lag, undo_lag),
    "stateful-lag": (stateful_lag, undo_stateful),
    "bidirectional": (bidirectional, undo_bidirectional),
}


def register(name: str, transform: Callable, detransform: Callable) -> None:
    """Add a method: two functions of (DataFrame, Transform) and (DataFrame, Transform, column)."""
    METHODS[name] = (transform, detransform)


def with_vehicles(examples: DataFrame, vehicles: DataFrame) -> DataFrame:
    """Each example with its track's vehicle vector."""
    return examples.join(vehicles.select(TRACK, "vehicle"), TRACK)
