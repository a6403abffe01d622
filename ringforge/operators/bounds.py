"""Bounds over all encoded tracks, scaling into them, and vehicle vectors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The key order of the published vehicle encoding, which must equal the reference's.
VEHICLE_KEYS = {
    "V1": (
        "track_front", "track_rear", "wheel_base_front", "wheel_base_rear", "mass", "k_drive_front", "k_roll", "tyre_friction",
        "max_power", "cog_height", "lift_coeff_front", "lift_coeff_rear", "v_max", "drag_coeff", "yaw_inertia", "k_brake_front",
    )
}
SCALARS = ("max_width", "min_width", "max_angle", "max_offset", "max_velocity", "min_velocity")


def bounds(encoded: DataFrame) -> DataFrame:
    """One row.  Widths and velocities are bounded by their absolute values, so a missing velocity (-1) counts as 1."""
    a = {c: F.abs(c) for c in ("width", "angle", "offset", "velocity")}
    return encoded.agg(
        F.max(a["width"]).alias("max_width"), F.min(a["width"]).alias("min_width"), F.max(a["angle"]).alias("max_angle"),
        F.max(a["offset"]).alias("max_offset"), F.max(a["velocity"]).alias("max_velocity"), F.min(a["velocity"]).alias("min_velocity"),
    )


def merge(old: DataFrame, new: DataFrame) -> DataFrame:
    """Bounds of both: bounds stay incremental.  Nulls are bounds not yet known."""
    return old.unionByName(new).agg(*[(F.max if c.startswith("max") else F.min)(c).alias(c) for c in SCALARS])


def vehicle_bounds(vectors: DataFrame, col: str = "vehicle") -> DataFrame:
    """(dim, min_value, max_value) of vehicle vectors."""
    return vectors.select(F.posexplode(col).alias("dim", "value")).groupBy("dim").agg(F.min("value").alias("min_value"), F.max("value").alias("max_value"))


def range_scale(v: Column, high: Column, low: Column) -> Column:
    """(v - low) / (high - low); 0 where the range is 0."""
    return F.when(high == low, 0.0).otherwise(F.try_divide(v - low, high - low))


def range_unscale(v: Column, high: Column, low: Column) -> Column:
    return v * (high - low) + low


def scale(v: Column, by: Column) -> Column:
    return F.when(by == 0, 0.0).otherwise(F.try_divide(v, by))


def normalise(encoded: DataFrame, b: DataFrame) -> DataFrame:
    """Encoded rows with widths, angles, offsets and velocities scaled; b has one row."""
    c = F.col
    df = encoded.crossJoin(F.broadcast(b))
    return df.withColumns({
        "width": range_scale(c("width"), c("max_width"), c("min_width")), "angle": scale(c("angle"), c("max_angle")),
        "offset": scale(c("offset"), c("max_offset")), "velocity": range_scale(c("velocity"), c("max_velocity"), c("min_velocity")),
    }).drop(*SCALARS)


def vehicle_vector(vehicles: DataFrame, keys: str | Sequence[str] = "V1", col: str = "vehicle") -> DataFrame:
    """The map column as a vector in the order of keys.  A key matches whatever its case, with or without underscores; a missing one fails."""
    if isinstance(keys, str):
        keys = VEHICLE_KEYS[keys]
    low = F.transform_keys(col, lambda k, _: F.lower(k))
    items = []
    for k in keys:
        found = F.coalesce(F.try_element_at(low, F.lit(k)), F.try_element_at(low, F.lit(k.replace("_", "").lower())))
        items.append(F.coalesce(found, F.raise_error(F.lit(f"vehicle lacks {k}")).cast("double")))
    return vehicles.withColumn(col, F.array(*items))


def normalise_vehicles(vectors: DataFrame, b: DataFrame, col: str = "vehicle") -> DataFrame:
    """Each dimension to (v - min) / range, a range of 0 counting as 1.  b: from vehicle_bounds (as many rows as dimensions)."""
    one = b.agg(F.array_sort(F.collect_list(F.struct("dim", "min_value", "max_value"))).alias("_b"))
    df = vectors.crossJoin(F.broadcast(one))
    scaled = F.zip_with(col, "_b", lambda v, x: F.when(x["max_value"] == x["min_value"], v - x["min_value"]).otherwise(F.try_divide(v - x["min_value"], x["max_value"] - x["min_value"])))
    return df.withColumn(col, scaled).drop("_b")
