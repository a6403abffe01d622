"""Parameter sweeps: the setting with the least lap time, true and as predicted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def optimum(runs: DataFrame, *keys: str, params: tuple[str, ...] = ("param_1",)) -> DataFrame:
    """runs: keys, params, lap_time, predicted.  The first least setting by true and by predicted time, and what the
    predicted choice costs: the true time there less the true least."""
    order = F.struct(*params)
    best = runs.groupBy(*keys).agg(
        F.min_by(F.struct(*params, "lap_time"), F.struct(F.col("lap_time"), order)).alias("t"), F.min_by(F.struct(*params, "lap_time"), F.struct(F.col("predicted"), order)).alias("p")
    )
    cols = [F.col(f"{a}.{c}").alias(f"{n}{c}") for a, n in (("t", ""), ("p", "pred_")) for c in params]
    return best.select(*keys, *cols, F.bround(F.abs(F.col("t.lap_time") - F.col("p.lap_time")), 3).alias("lap_delta"))


def parse_name(df: DataFrame, col: str = "path") -> DataFrame:
    """'vehicle - track - kind - p1 - p2' to its parts; a missing parameter is -1."""
    parts = F.split(F.col(col), " - ")

    def number(k: int) -> Column:
        return F.coalesce(F.expr(f"try_cast(get(split({col}, ' - '), {k}) as double)"), F.lit(-1.0))

    return df.withColumns({"pair": F.concat_ws(" - ", F.slice(parts, 1, 3)), "vehicle": F.get(parts, F.lit(0)), "track": F.get(parts, F.lit(1)), "param_1": number(3), "param_2": number(4)})


def grid(spark, start: float, end: float, steps: int) -> DataFrame:
    """steps values from start to end, both included."""
    return spark.range(steps).select(F.col("id").alias("step"), (F.lit(float(start)) + F.col("id") * F.lit((end - start) / max(1, steps - 1))).alias("value"))


def files_for(df: DataFrame, vehicle: str, track: str, col: str = "path") -> DataFrame:
    """The files whose name has "track - vehicle" in it."""
    return df.where(F.col(col).contains(f"{track} - {vehicle}"))
