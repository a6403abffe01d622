"""The two end-to-end jobs, as functions and on the command line: splice track folders, encode spliced tracks."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import bounds, features, rings, sequential, transforms
from ..operators import splice as sp
from ..sources import readers


def splice_folders(spark: SparkSession, src: str, spacing: float = 10.0, done: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(spliced rows by name, (name, error) of folders that failed).  Folders in ``done`` are left out."""
    ref, paths = readers.read_tracks(spark, src), readers.read_paths(spark, src)
    every = readers.folder_names(spark, src)
    if done is not None:
        every = readers.not_done(every, done)
    names = ref.select("name").distinct().join(every, "name", "left_semi")
    no_track = every.join(names, "name", "left_anti").select("name", F.lit("no track.csv").alias("error"))
    # a stable number for each name: operators work on numbered tracks
    ids = names.withColumn("track_id", F.xxhash64("name"))
    ref = ref.join(ids, "name").select("track_id", "idx", "x", "y", "r", "l")
    smooth = sequential.smooth_track(sequential.from_xyrl(ref), spacing)
    lines = sequential.good(smooth)
    with_path = paths.join(ids, "name").select("track_id", "idx", "x", "y", "vel", "acc")
    spliced = sp.splice(lines.join(with_path.select("track_id").distinct(), "track_id", "left_semi"), with_path)
    whole, failed = sp.whole_tracks(spliced)
    lacking = ids.join(with_path.select("track_id").distinct(), "track_id", "left_anti").select("track_id", F.lit("no optimal_path.csv").alias("error"))
    bad = sequential.errors(smooth).union(failed).union(lacking)
    return whole.join(ids, "track_id"), bad.join(ids, "track_id").select("name", "error").union(no_track)


def enumerate_tracks(names: DataFrame, flip: bool = False) -> DataFrame:
    """(name, source, flipped), with a second row <name>.flipped for each if flip."""
    both = F.array(F.lit(False), F.lit(True)) if flip else F.array(F.lit(False))
    df = names.select(F.col("name").alias("source"), F.explode(both).alias("flipped"))
    return df.select(F.when(F.col("flipped"), F.concat("source", F.lit(".flipped"))).otherwise(F.col("source")).alias("name"), "source", "flipped")


def assign_partitions(names: DataFrame, n_partitions: int, seed: int = 0) -> DataFrame:
    """Adds partition_id: ceil(tracks / n_partitions) tracks each, in an order that the seed decides.

    A track's place is counted in two steps, by leading bits of its hash and within them, so no task orders all tracks."""
    h = names.withColumn("_h", F.xxhash64("name", F.lit(seed))).withColumn("_b", F.shiftrightunsigned("_h", 52))
    counts = h.groupBy("_b").agg(F.count("*").alias("_c"))
    up = Window.orderBy("_b")
    starts = counts.select("_b", (F.sum("_c").over(up) - F.col("_c")).alias("_start"), F.sum("_c").over(Window.partitionBy()).alias("_total"))
    at = F.col("_start") + F.row_number().over(Window.partitionBy("_b").orderBy("_h", "name")) - 1
    size = F.ceil(F.col("_total") / F.lit(float(max(1, n_partitions))))
    return h.join(starts, "_b").withColumn("partition_id", F.floor(at / size).cast("int")).drop("_h", "_b", "_start", "_total")


def encode_tracks(spliced: DataFrame, flip: bool = False) -> DataFrame:
    """Feature rows of tracks (track_id, idx, x1 .. vel), and those of their mirror images if flip; flipped tells which."""
    out = features.encode(spliced).withColumn("flipped", F.lit(False))
    return out.unionByName(features.encode(spliced, flip=True).withColumn("flipped", F.lit(True))) if flip else out


def reference_recipe(reference: DataFrame, left: DataFrame, right: DataFrame, spacing: float = 2.0, sweeps: int = 50) -> DataFrame:
    """Points of a surveyed reference line and both edges to segmentation lines across the track."""
    lines = rings.normals_on_path(reference, 50.0, spacing)
    return sequential.cut_to_boundaries(sequential.good(sequential.smooth_normals(lines, sweeps, 80.0)), left, right)


def project_recipe(reference: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """Sparse curves of a project to the reference-line format: splined, cut, and taken along the shortest path."""
    curves = [rings.catmull_rom(p, 20, True) for p in (reference, left, right)]
    lines = rings.normals_on_path(curves[0], 80.0, 2.0)
    cut = sequential.cut_to_boundaries(sequential.good(sequential.smooth_normals(lines, 50, 80.0)), *curves[1:])
    return sequential.to_xyrl(sequential.good(cut), 0.5)


def training_examples(encoded: DataFrame, vehicles: DataFrame, transform: transforms.Transform, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(examples with vehicle vectors, bounds): bounds of these rows, merged with those known."""
    b = bounds.bounds(encoded)
    if known is not None:
        b = bounds.merge(known, b)
    vectors = bounds.vehicle_vector(vehicles, transform.vehicle_encoding)
    scaled = bounds.normalise_vehicles(vectors, bounds.vehicle_bounds(vectors))
    return transforms.with_vehicles(transform.transform(bounds.normalise(encoded, b)), scaled), b


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="ringforge")
    p.add_argument("function", choices=["splice", "encode"])
    p.add_argument("--src", required=True)
    p.add_argument("--dest", required=True)
    p.add_argument("--spacing", type=float, default=10.0)
    p.add_argument("--partitions", type=int, default=0, help="0: one output for each track")
    p.add_argument("--flip", action="store_true")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName(f"ringforge-{a.function}").getOrCreate()
    for kind, folder in (("Source", a.src), ("Destination", a.dest)):
        if not readers.exists(spark, folder):
            raise FileNotFoundError(f"{kind} directory {folder} does not exist")
    if a.function == "splice":
        # tracks that have a result already are not taken again: a run that was broken off goes on
        good, bad = splice_folders(spark, a.src, a.spacing, readers.done_names(spark, f"{a.dest}/spliced"))
        readers.write_spliced(good, readers.read_vehicles(spark, a.src), f"{a.dest}/spliced")
        bad.write.mode("overwrite").json(f"{a.dest}/errors")
        return
    rows = readers.read_spliced(spark, a.src).withColumn("track_id", F.xxhash64("name"))
    names = assign_partitions(enumerate_tracks(rows.select("name").distinct(), a.flip), a.partitions)
    ids = names.select(F.xxhash64("source").alias("track_id"), "flipped", "name", "partition_id")
    encode_tracks(rows, a.flip).join(ids, ["track_id", "flipped"]).write.mode("overwrite").partitionBy("partition_id" if a.partitions else "name").parquet(a.dest)


if __name__ == "__main__":
    main()
