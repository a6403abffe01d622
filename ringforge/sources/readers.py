"""Track folders, spliced and encoded files, bounds, vehicles, KML: in and out of DataFrames.

A track is a folder with track.csv (x_m, y_m, w_tr_right_m, w_tr_left_m), optimal_path.csv (s_m; x_m; y_m; vx_mps; ax_mps2)
and vehicle.csv (param, value).  Files are read by Spark's readers only, so any store works; the folder's name is the track's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TRACK_SCHEMA = "x_m double, y_m double, w_tr_right_m double, w_tr_left_m double"
SEGMENT = "struct<x1:double,y1:double,x2:double,y2:double,pos:double,vel:double,acc:double>"
SPLICED = f"track struct<segmentations:array<{SEGMENT}>>, vehicle map<string,double>"
ENCODED_LISTS = ("widths", "angles", "offsets", "positions", "velocities")
PARTITION = "vehicles array<map<string,double>>, " + ", ".join(f"{c} array<array<double>>" for c in ENCODED_LISTS)
BOUNDS = "max_width double, min_width double, max_angle double, max_offset double, max_velocity double, min_velocity double, max_vehicle array<double>, min_vehicle array<double>"


def _folder() -> Column:
    return F.element_at(F.split(F.input_file_name(), "/"), -2)


def _line_number(df: DataFrame, key: str) -> DataFrame:
    """idx in the order of the file: a file of a track is one split, and ids grow within it."""
    return df.withColumn("_at", F.monotonically_increasing_id()).withColumn("idx", (F.row_number().over(Window.partitionBy(key).orderBy("_at")) - 1).cast("long")).drop("_at")


def read_csv(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """All columns as trimmed strings; names are trimmed too."""
    df = spark.read.option("header", True).option("sep", sep).option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path)
    return df.toDF(*[c.strip() for c in df.columns])


def read_tracks(spark: SparkSession, root: str) -> DataFrame:
    """(name, idx, x, y, r, l) of every folder's track.csv."""
    df = spark.read.schema(TRACK_SCHEMA).option("header", True).csv(f"{root}/*/track.csv").withColumn("name", _folder())
    return _line_number(df.where("x_m is not null"), "name").select("name", "idx", F.col("x_m").alias("x"), F.col("y_m").alias("y"), F.col("w_tr_right_m").alias("r"), F.col("w_tr_left_m").alias("l"))


def read_paths(spark: SparkSession, root: str) -> DataFrame:
    """(name, idx, s, x, y, vel, acc) of every folder's optimal_path.csv."""
    df = read_csv(spark, f"{root}/*/optimal_path.csv", ";").withColumn("name", _folder())
    num = {"s": "s_m", "x": "x_m", "y": "y_m", "vel": "vx_mps", "acc": "ax_mps2"}
    return _line_number(df, "name").select("name", "idx", *[F.expr(f"try_cast({c} as double)").alias(k) for k, c in num.items()])


def read_vehicles(spark: SparkSession, root: str) -> DataFrame:
    """(name, vehicle map) of every folder's vehicle.csv."""
    df = read_csv(spark, f"{root}/*/vehicle.csv").withColumn("name", _folder())
    return df.groupBy("name").agg(F.map_from_entries(F.collect_list(F.struct("param", F.expr("try_cast(value as double)")))).alias("vehicle"))


def read_times(spark: SparkSession, root: str) -> DataFrame:
    """(name, compute_time, lap_time) of every folder's times.txt."""
    df = spark.read.text(f"{root}/*/times.txt").withColumn("name", _folder())
    value = F.expr("try_cast(trim(split(value, ':')[1]) as double)")
    return df.groupBy("name").agg(F.max(F.when(F.col("value").startswith("Compute"), value)).alias("compute_time"), F.max(F.when(F.col("value").startswith("Lap"), value)).alias("lap_time"))


def parse_xyrl(df: DataFrame, col: str = "raw", skip_first: bool = True) -> DataFrame:
    """Texts of comma-separated lines x, y, right, left to rows (.., idx, x, y, r, l); lines with two tokens or fewer are left out."""
    lines = df.select(*[c for c in df.columns if c != col], F.posexplode(F.split(col, "\n")).alias("_k", "_l")).where(F.col("_k") >= int(skip_first))
    t = lines.withColumn("_t", F.split("_l", ",")).where("size(_t) > 2")
    keys = [c for c in df.columns if c != col]
    cols = [F.expr(f"try_cast(trim(_t[{i}]) as double)").alias(c) for i, c in enumerate("xyrl")]
    return t.select(*keys, (F.col("_k") - int(skip_first)).cast("long").alias("idx"), *cols)


def not_done(names: DataFrame, done: DataFrame) -> DataFrame:
    """Names without a result yet: a run can be taken up again."""
    return names.join(done.select("name").distinct(), "name", "left_anti")


def folder_names(spark: SparkSession, root: str) -> DataFrame:
    """(name) of all folders in root, those without files too; names that begin with a dot are left out."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    names = [x.getPath().getName() for x in found if x.isDirectory()]
    return spark.createDataFrame([(x,) for x in sorted(names) if not x.startswith(".")], "name string")


def exists(spark: SparkSession, root: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def done_names(spark: SparkSession, dest: str) -> DataFrame:
    """(name) of tracks that a folder written by write_spliced already has."""
    if not exists(spark, dest):
        return spark.createDataFrame([], "name string")
    return folder_names(spark, dest).where(F.col("name").startswith("name=")).select(F.url_decode(F.expr("substring(name, 6)")).alias("name"))


def write_spliced(segments: DataFrame, vehicles: DataFrame | None, dest: str, mode: str = "overwrite") -> None:
    """One JSON document per track, in a folder name=...: {"track": {"segmentations": [...]}, "vehicle": {...}}.

    Tracks that are written again take the place of what they had; other tracks' folders stay."""
    row = F.struct(*[F.col(c).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2", "pos", "vel", "acc")])
    lists = segments.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("idx", row.alias("s")))).alias("r")).select("name", F.struct(F.col("r.s").alias("segmentations")).alias("track"))
    if vehicles is not None:
        lists = lists.join(vehicles.select("name", "vehicle"), "name", "left")
    else:
        lists = lists.withColumn("vehicle", F.lit(None).cast("map<string,double>"))
    lists.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("name").json(dest)


def read_spliced(spark: SparkSession, path: str) -> DataFrame:
    """(name, vehicle, idx, x1 .. acc) of spliced documents, written by write_spliced or single files <name>.json."""
    df = spark.read.schema(SPLICED).option("multiLine", True).json(path) if path.endswith(".json") else spark.read.schema(SPLICED + ", name string").json(path)
    if path.endswith(".json"):
        df = df.withColumn("name", F.regexp_replace(F.element_at(F.split(F.input_file_name(), "/"), -1), r"\.json$", ""))
    return df.select("name", "vehicle", F.posexplode("track.segmentations").alias("idx", "s")).select("name", "vehicle", F.col("idx").cast("long").alias("idx"), "s.*")


def save_partition(encoded: DataFrame, vehicles: DataFrame, dest: str) -> None:
    """Encoded rows (partition_id, track_id, idx, width ..) as documents of lists of lists, one per partition."""
    cols = ("width", "angle", "offset", "position", "velocity")
    tracks = encoded.groupBy("partition_id", "track_id").agg(F.array_sort(F.collect_list(F.struct("idx", *cols))).alias("r")).join(vehicles.select("track_id", "vehicle"), "track_id", "left")
    # maps can't be sorted, so vehicles pass as JSON
    whole = tracks.groupBy("partition_id").agg(F.array_sort(F.collect_list(F.struct("track_id", F.to_json("vehicle").alias("v"), "r"))).alias("t"))

    def channel(c: str) -> Column:
        return F.transform("t", lambda x: F.transform(x["r"], lambda y: y[c]))

    lists = [channel(c).alias(n) for c, n in zip(cols, ENCODED_LISTS, strict=True)]
    whole.select("partition_id", F.transform("t", lambda x: F.from_json(x["v"], "map<string,double>")).alias("vehicles"), *lists).write.mode("overwrite").partitionBy("partition_id").json(dest)


def load_partition(spark: SparkSession, path: str) -> DataFrame:
    """(partition_id, track_no, vehicle, idx, width, angle, offset, position, velocity)."""
    df = spark.read.schema(PARTITION + ", partition_id int").json(path)
    z = F.posexplode(F.arrays_zip("vehicles", *ENCODED_LISTS)).alias("track_no", "t")
    t = df.select("partition_id", z)
    rows = t.select("partition_id", "track_no", F.col("t.vehicles").alias("vehicle"), F.posexplode(F.arrays_zip(*[F.col(f"t.{c}").alias(c) for c in ENCODED_LISTS])).alias("idx", "r"))
    names = ("width", "angle", "offset", "position", "velocity")
    return rows.select("partition_id", "track_no", "vehicle", F.col("idx").cast("long").alias("idx"), *[F.col(f"r.{c}").alias(n) for c, n in zip(ENCODED_LISTS, names, strict=True)])


def save_bounds(bounds: DataFrame, transform: dict, dest: str) -> None:
    """{"transform": {...}, "bounds": {...}}; bounds that are null are left out."""
    t = F.struct(*[F.lit(v).alias(k) for k, v in transform.items()])
    bounds.select(t.alias("transform"), F.struct(*bounds.columns).alias("bounds")).coalesce(1).write.mode("overwrite").json(dest)


def load_bounds(spark: SparkSession, path: str) -> DataFrame:
    """One row.  Bounds that the document lacks, or has as null, are those of nothing seen: the least maxima and the greatest minima; vehicle bounds stay null."""
    df = spark.read.schema(f"transform map<string,string>, bounds struct<{', '.join(x.replace(' ', ':', 1) for x in BOUNDS.split(', '))}>").option("multiLine", True).json(path)
    return df.select(*[F.coalesce(f"bounds.{c}", F.lit(v)).alias(c) for c, v in NOTHING_SEEN.items()], "bounds.max_vehicle", "bounds.min_vehicle")


#: The bounds before any track is seen.
NOTHING_SEEN = {"max_width": float("-inf"), "min_width": float("inf"), "max_angle": 0.0, "max_offset": 0.0, "max_velocity": float("-inf"), "min_velocity": float("inf")}


# --- KML and projection ---


def read_kml(spark: SparkSession, path: str) -> DataFrame:
    """(name, layer, idx, lon, lat) of the line placemarks of KML files.  name: of the folder that the placemark is in, or else of the file."""
    mark = "struct<name:string,LineString:struct<coordinates:string>>"
    df = spark.read.format("xml").option("rowTag", "Folder").schema(f"name string, Placemark array<{mark}>").load(path)
    file = F.regexp_replace(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1), r"\.kml$", "")
    # the file's name is asked for beneath the XML reader's own columns
    df = df.select(file.alias("file"), "name", "Placemark").select(F.coalesce(F.trim("name"), "file").alias("name"), F.explode("Placemark").alias("m"))
    df = df.select("name", F.trim(F.regexp_replace("m.name", r"\n", "")).alias("layer"), F.split(F.trim("m.LineString.coordinates"), r"\s+").alias("c"))
    pts = df.where("c is not null").select("name", "layer", F.posexplode("c").alias("idx", "p")).withColumn("p", F.split("p", ","))
    return pts.select("name", "layer", F.col("idx").cast("long").alias("idx"), F.expr("try_cast(p[0] as double)").alias("lon"), F.expr("try_cast(p[1] as double)").alias("lat"))


def joined_sides(points: DataFrame) -> DataFrame:
    """Curves that come in two parts as one: "Left 2" goes on where "Left" ends, and "Right 2" where "Right" does."""
    part = F.when(F.col("layer").isin("Left 2", "Right 2"), 1).otherwise(0)
    df = points.withColumn("_part", part).withColumn("layer", F.when(F.col("_part") == 1, F.regexp_replace("layer", " 2$", "")).otherwise(F.col("layer")))
    place = F.row_number().over(Window.partitionBy("name", "layer").orderBy("_part", "idx")) - 1
    return df.withColumn("idx", place.cast("long")).drop("_part")


#: The WGS 84 ellipsoid: half axis in metres, and flattening.
HALF_AXIS, FLATTENING = 6_378_137.0, 1 / 298.257223563
_E2 = FLATTENING * (2 - FLATTENING)


def _n(lat: Column) -> Column:
    return F.lit(HALF_AXIS) / F.sqrt(1 - _E2 * F.sin(lat) * F.sin(lat))


def project(points: DataFrame, lon0: Column, lat0: Column) -> DataFrame:
    """Azimuthal equidistant projection on the ellipsoid (Snyder 1987, pp. 199 f.: good to a millimetre within 100 km): adds x, y in metres from (lon0, lat0)."""
    df = points.withColumns({"_a": F.radians(lat0), "_b": F.radians("lat"), "_d": F.radians(F.col("lon") - lon0)})
    a, b, d = F.col("_a"), F.col("_b"), F.col("_d")
    df = df.withColumn("_p", F.atan((1 - _E2) * F.tan(b) + _E2 * _n(a) * F.sin(a) / (_n(b) * F.cos(b))))
    p = F.col("_p")
    df = df.withColumns({"_e": F.sin(d) * F.cos(p), "_w": F.cos(a) * F.sin(p) - F.sin(a) * F.cos(p) * F.cos(d)})
    df = df.withColumns({"_z": F.atan2("_e", "_w"), "_s": F.atan2(F.hypot("_e", "_w"), F.sin(a) * F.sin(p) + F.cos(a) * F.cos(p) * F.cos(d))})
    root = (_E2 / (1 - _E2)) ** 0.5
    df = df.withColumns({"_g": root * F.sin(a), "_h": root * F.cos(a) * F.cos("_z")})
    s, gg, h = F.col("_s"), F.col("_g"), F.col("_h")
    h2, g2 = h * h, gg * gg
    c = _n(a) * s * (1 - s * s * h2 * (1 - h2) / 6 + s * s * s / 8 * gg * h * (1 - 2 * h2) + s * s * s * s / 120 * (h2 * (4 - 7 * h2) - 3 * g2 * (1 - 7 * h2)) - s * s * s * s * s / 48 * gg * h)
    df = df.withColumn("_c", c)
    return df.withColumns({"x": F.col("_c") * F.sin("_z"), "y": F.col("_c") * F.cos("_z")}).drop("_a", "_b", "_d", "_p", "_e", "_w", "_z", "_s", "_g", "_h", "_c")


def unproject(points: DataFrame, lon0: Column, lat0: Column) -> DataFrame:
    """The inverse: adds lon, lat."""
    df = points.withColumns({"_a": F.radians(lat0), "_o": lon0, "_z": F.atan2("x", "y")})
    a, z = F.col("_a"), F.col("_z")
    df = df.withColumn("_q", -_E2 * F.cos(a) * F.cos(a) * F.cos(z) * F.cos(z) / (1 - _E2)).withColumn("_d", F.hypot("x", "y") / _n(a))
    q, d = F.col("_q"), F.col("_d")
    df = df.withColumn("_b", 3 * _E2 * (1 - q) * F.sin(a) * F.cos(a) * F.cos(z) / (1 - _E2))
    b = F.col("_b")
    df = df.withColumn("_e", d - q * (1 + q) * d * d * d / 6 - b * (1 + 3 * q) * d * d * d * d / 24)
    e = F.col("_e")
    df = df.withColumn("_f", 1 - q * e * e / 2 - b * e * e * e / 6).withColumn("_p", F.asin(F.sin(a) * F.cos(e) + F.cos(a) * F.sin(e) * F.cos(z)))
    p = F.col("_p")
    # where the point is the origin, or lies on the equator, the quotient of sines has no value
    lat = F.atan2((1 - _E2 * F.col("_f") * F.coalesce(F.try_divide(F.sin(a), F.sin(p)), F.lit(0.0))) * F.sin(p), (1 - _E2) * F.cos(p))
    lon = F.col("_o") + F.degrees(F.asin(F.sin(z) * F.sin(e) / F.cos(p)))
    return df.withColumns({"lon": lon, "lat": F.degrees(lat)}).drop("_a", "_o", "_z", "_q", "_d", "_b", "_e", "_f", "_p")


def curve_offsets(points: DataFrame) -> DataFrame:
    """Curves as offsets from the mean position of their project: (name, layer, idx, lat0, lon0, dlat, dlon)."""
    origin = points.groupBy("name").agg(F.avg("lat").alias("lat0"), F.avg("lon").alias("lon0"))
    return points.join(origin, "name").select("name", "layer", "idx", "lat0", "lon0", (F.col("lat") - F.col("lat0")).alias("dlat"), (F.col("lon") - F.col("lon0")).alias("dlon"))


def write_project(offsets: DataFrame, dest: str) -> None:
    """curve_offsets as one JSON document per project: {"origin": {lat, lon}, "layers": {layer: [{lat, lon}]}}."""
    point = F.struct("idx", F.struct(F.col("dlat").alias("lat"), F.col("dlon").alias("lon")).alias("p"))
    curves = offsets.groupBy("name", "layer", "lat0", "lon0").agg(F.array_sort(F.collect_list(point)).alias("c"))
    whole = curves.groupBy("name").agg(F.first(F.struct(F.col("lat0").alias("lat"), F.col("lon0").alias("lon"))).alias("origin"), F.map_from_entries(F.collect_list(F.struct("layer", F.col("c.p")))).alias("layers"))
    whole.write.mode("overwrite").partitionBy("name").json(dest)


def read_project(spark: SparkSession, path: str) -> DataFrame:
    """(name, layer, idx, lon, lat) of such documents."""
    schema = "origin struct<lat:double,lon:double>, layers map<string,array<struct<lat:double,lon:double>>>, name string"
    df = spark.read.schema(schema).json(path).select("name", "origin", F.explode("layers").alias("layer", "c"))
    df = df.select("name", "origin", "layer", F.posexplode("c").alias("idx", "p"))
    return df.select("name", "layer", F.col("idx").cast("long").alias("idx"), (F.col("p.lon") + F.col("origin.lon")).alias("lon"), (F.col("p.lat") + F.col("origin.lat")).alias("lat"))


#: Layers that are left out, the layer that only two circuits may have, and the signs of a name.
DROPPED, GUARDED, GUARDED_MAY = "Karting", "GP Circuit", ("DE Nurburgring", "Nordschleife")
NAME_SIGNS = "^[A-Za-z0-9 +_'-]*$"


def valid_layers(df: DataFrame) -> DataFrame:
    """Layers without those of kart tracks.  A layer whose full name "name - layer" is a GP circuit of another course, or has other signs than letters, digits, blanks and
    - + _ ', is an error."""
    full = F.concat("name", F.lit(" - "), "layer")
    kept = df.where(~full.contains(DROPPED))
    may = F.lit(False)
    for x in GUARDED_MAY:
        may = may | full.contains(x)
    fault = F.when(full.contains(GUARDED) & ~may, full).when(~full.rlike(NAME_SIGNS), F.concat(F.lit("Invalid track name: "), full))
    return kept.where(F.when(fault.isNull(), F.lit(True)).otherwise(F.raise_error(fault).cast("boolean")))


def swap_sides(df: DataFrame, left: str = "left", right: str = "right") -> DataFrame:
    return df.withColumns({left: F.col(right), right: F.col(left)})


def write_xyrl(points: DataFrame, dest: str) -> None:
    """One file for each track, its lines in order: rows are dealt by track and sorted within."""
    cols = {"x_m": "x", "y_m": "y", "w_tr_right_m": "r", "w_tr_left_m": "l"}
    points.repartition("name").sortWithinPartitions("name", "idx").select("name", *[F.col(c).alias(n) for n, c in cols.items()]).write.mode("overwrite").option("header", True).partitionBy("name").csv(dest)


def combine_partitions(*parts: DataFrame) -> DataFrame:
    """Track lists one after another: tracks are numbered on from one partition to the next.  parts: from load_partition, with partition_id and track_no."""
    out, before = None, F.lit(0)
    for p in parts:
        shifted = p.crossJoin(F.broadcast(out.agg((F.coalesce(F.max("track_no"), F.lit(-1)) + 1).alias("_n")))) if out is not None else p.withColumn("_n", before)
        shifted = shifted.withColumn("track_no", (F.col("track_no") + F.col("_n")).cast("int")).drop("_n")
        out = shifted if out is None else out.unionByName(shifted)
    return out
