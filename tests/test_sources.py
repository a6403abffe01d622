import json
import math

import pytest
from pyspark.sql import functions as F

from ringforge.operators import features
from ringforge.plans import pipelines
from ringforge.sources import readers


@pytest.fixture(scope="module")
def folders(tmp_path_factory):
    root = tmp_path_factory.mktemp("tracks")
    for name in ("alpha", "beta"):
        d = root / name
        d.mkdir()
        ring = [(100 * math.cos(k / 60 * math.tau), 100 * math.sin(k / 60 * math.tau)) for k in range(60)]
        (d / "track.csv").write_text("x_m,y_m,w_tr_right_m,w_tr_left_m\n" + "".join(f"{x},{y},6,5\n" for x, y in ring))
        if name == "alpha":
            (d / "optimal_path.csv").write_text("s_m; x_m; y_m; vx_mps; ax_mps2\n" + "".join(f"{k}; {x * 1.01}; {y * 1.01}; {30 + k % 5}; 0.5\n" for k, (x, y) in enumerate(ring)))
        (d / "vehicle.csv").write_text("param,value\nmass, 700\ntrack_front,1.5\n")
        (d / "times.txt").write_text("Compute Time: 12.5\nLap Time: 88.25\n")
    (root / "empty").mkdir()
    return str(root)


def test_readers(spark, folders):
    t = readers.read_tracks(spark, folders)
    assert {r.name: r["count"] for r in t.groupBy("name").count().collect()} == {"alpha": 60, "beta": 60}
    assert t.where("idx = 0 and name = 'alpha'").first().x == pytest.approx(100)
    p = readers.read_paths(spark, folders)
    assert p.count() == 60 and p.where("idx = 3").first().vel == 33
    assert readers.read_vehicles(spark, folders).where("name = 'beta'").first().vehicle == {"mass": 700, "track_front": 1.5}
    assert readers.read_times(spark, folders).first().lap_time == 88.25
    raw = spark.createDataFrame([("k", "x,y,r,l\n1,2,3,4\n5,6,7,8\n\n")], "name string, raw string")
    assert [tuple(r) for r in readers.parse_xyrl(raw).orderBy("idx").collect()] == [("k", 0, 1, 2, 3, 4), ("k", 1, 5, 6, 7, 8)]


def test_splice_folders_and_round_trip(spark, folders, tmp_path):
    good, bad = pipelines.splice_folders(spark, folders, spacing=20.0)
    good = good.persist()
    assert [r.name for r in good.select("name").distinct().collect()] == ["alpha"]
    assert sorted((r.name, r.error) for r in bad.collect()) == [("beta", "no optimal_path.csv"), ("empty", "no track.csv")]
    readers.write_spliced(good, readers.read_vehicles(spark, folders), f"{tmp_path}/spliced")
    back = readers.read_spliced(spark, f"{tmp_path}/spliced")
    assert back.count() == good.count() and back.first().vehicle["mass"] == 700
    a = {r.idx: (r.x1, r.pos, r.vel) for r in good.collect()}
    b = {r.idx: (r.x1, r.pos, r.vel) for r in back.collect()}
    assert all(a[k] == pytest.approx(b[k]) for k in a)
    done = readers.not_done(spark.createDataFrame([("alpha",), ("beta",)], "name string"), back)
    assert [r.name for r in done.collect()] == ["beta"]
    one = tmp_path / "gamma.json"
    one.write_text(json.dumps({"track": {"segmentations": [{"x1": 0, "y1": 0, "x2": 1, "y2": 0, "pos": None, "vel": 3, "acc": None}]}, "vehicle": {"mass": 1}}))
    r = readers.read_spliced(spark, str(one)).first()
    assert r.name == "gamma" and r.pos is None and r.vel == 3


def test_partition_round_trip(spark, tmp_path):
    rows = [(0, t, i, float(i), 0.5, -0.5, None if i == 1 else 0.2, 9.0) for t in (5, 6) for i in range(4)]
    e = spark.createDataFrame(rows, "partition_id int, track_id long, idx long, width double, angle double, offset double, position double, velocity double")
    v = spark.createDataFrame([(5, {"mass": 1.0}), (6, {"mass": 2.0})], "track_id long, vehicle map<string,double>")
    readers.save_partition(e, v, f"{tmp_path}/p")
    back = readers.load_partition(spark, f"{tmp_path}/p").orderBy("track_no", "idx").collect()
    assert [(r.track_no, r.idx, r.width, r.position) for r in back] == [(t, i, float(i), None if i == 1 else 0.2) for t in (0, 1) for i in range(4)]
    assert back[-1].vehicle == {"mass": 2.0}


def test_bounds_round_trip(spark, tmp_path):
    b = spark.createDataFrame([(4.0, 1.0, 2.0, 3.0, None, None)], "max_width double, min_width double, max_angle double, max_offset double, max_velocity double, min_velocity double")
    readers.save_bounds(b, {"method": "window", "foresight": 120}, f"{tmp_path}/b")
    r = readers.load_bounds(spark, f"{tmp_path}/b").first()
    assert r.max_width == 4 and r.max_velocity == -math.inf and r.min_velocity == math.inf and r.max_vehicle is None
    readers.save_bounds(spark.createDataFrame([(1.5,)], "max_angle double"), {"method": "lag"}, f"{tmp_path}/c")
    r = readers.load_bounds(spark, f"{tmp_path}/c").first()
    assert (r.max_angle, r.max_offset, r.max_width, r.min_width) == (1.5, 0.0, -math.inf, math.inf)


def test_kml_and_projection(spark, tmp_path):
    place = lambda n, c: f"<Placemark><name>{n}</name><LineString><coordinates>{c}</coordinates></LineString></Placemark>"
    (tmp_path / "spa.kml").write_text("<?xml version='1.0'?><kml><Document><Folder>" + place("Reference", "5.97,50.43,0 5.98,50.44,0") + place("Left", "5.96,50.43,0") + place("Karting", "1,2,0") + "</Folder></Document></kml>")
    k = readers.read_kml(spark, f"{tmp_path}/spa.kml")
    assert {(r.name, r.layer, r.idx, r.lon) for r in k.collect()} == {("spa", "Reference", 0, 5.97), ("spa", "Reference", 1, 5.98), ("spa", "Left", 0, 5.96), ("spa", "Karting", 0, 1.0)}
    k = readers.valid_layers(k)
    assert k.count() == 3
    xy = readers.project(k, F.lit(5.97), F.lit(50.43))
    zero = xy.where("layer = 'Reference' and idx = 0").first()
    assert abs(zero.x) < 1e-6 and abs(zero.y) < 1e-6
    back = readers.unproject(xy.withColumnsRenamed({"lon": "a", "lat": "b"}), F.lit(5.97), F.lit(50.43))
    assert all(r.lon == pytest.approx(r.a, abs=1e-11) and r.lat == pytest.approx(r.b, abs=1e-11) for r in back.collect())


def test_projection_is_ellipsoidal(spark):
    """Along the meridian distances are those of the meridian arc, and along the equator those of the circle; there and back agree to a millimetre."""
    a, f = 6378137.0, 1 / 298.257223563
    e2 = f * (2 - f)
    steps = 20_000
    arc = sum(a * (1 - e2) / (1 - e2 * math.sin(p) ** 2) ** 1.5 for p in (math.radians(50 + 0.5 * (k + 0.5) / steps) for k in range(steps))) * math.radians(0.5) / steps
    df = spark.createDataFrame([(7.0, 50.5, 50.0), (7.4, 0.0, 0.0), (7.3, 50.2, 50.0), (6.5, 49.7, 50.0), (7.0, 50.0, 50.0), (7.2, 0.1, 0.0)], "lon double, lat double, lat0 double")
    xy = readers.project(df, F.lit(7.0), F.col("lat0"))
    got = xy.collect()
    assert got[0].y == pytest.approx(arc, abs=1e-3) and abs(got[0].x) < 1e-6
    assert got[1].x == pytest.approx(a * math.radians(0.4), abs=1e-3) and abs(got[1].y) < 1e-6
    for r in readers.unproject(xy.withColumnsRenamed({"lon": "a", "lat": "b"}), F.lit(7.0), F.col("lat0")).collect():
        assert r.lon == pytest.approx(r.a, abs=1e-8) and r.lat == pytest.approx(r.b, abs=1e-8)


def test_kml_folders_and_sides_in_two_parts(spark, tmp_path):
    place = lambda n, c: f"<Placemark><name>{n}</name><LineString><coordinates>\n {c}\n</coordinates></LineString></Placemark>"
    body = "<Folder><name>GB One</name>" + place("Left 2", "3,3,0\n4,4,0") + place("Left", "1,1,0\n2,2,0") + place("Right", "9,9,0") + "</Folder><Folder><name>GB Two</name>" + place("Reference", "5,5,0") + "</Folder>"
    (tmp_path / "all.kml").write_text(f"<?xml version='1.0'?><kml><Document>{body}</Document></kml>")
    k = readers.joined_sides(readers.read_kml(spark, f"{tmp_path}/all.kml"))
    assert sorted((r.name, r.layer, r.idx, r.lon) for r in k.collect()) == [("GB One", "Left", i, i + 1.0) for i in range(4)] + [("GB One", "Right", 0, 9.0), ("GB Two", "Reference", 0, 5.0)]


@pytest.mark.parametrize("name, layer, fault", [("DE Nurburgring", "GP Circuit", ""), ("GB Here", "GP Circuit", "GP Circuit"), ("GB Here", "Été", "Invalid track name"), ("GB Here", "Short-1_a'+b", ""), ("GB Here", "(old)", "Invalid track name")])
def test_names_of_layers(spark, name, layer, fault):
    df = spark.createDataFrame([(name, layer), ("X", "Karting é"), ("Y", "Ok")], "name string, layer string")
    if fault:
        with pytest.raises(Exception, match=fault):
            readers.valid_layers(df).collect()
    else:
        assert [tuple(r) for r in readers.valid_layers(df).collect()] == [(name, layer), ("Y", "Ok")]


def test_a_run_is_taken_up_again(spark, folders, tmp_path):
    src = tmp_path / "src"
    import shutil

    shutil.copytree(folders, src)
    dest = tmp_path / "dest"
    with pytest.raises(FileNotFoundError):
        pipelines.main(["splice", "--src", str(src), "--dest", str(dest), "--spacing", "20"])
    dest.mkdir()
    go = lambda: pipelines.main(["splice", "--src", str(src), "--dest", str(dest), "--spacing", "20"])
    counts = lambda: {r.name: r["count"] for r in readers.read_spliced(spark, f"{dest}/spliced").groupBy("name").count().collect()}
    go()
    first = counts()
    assert set(first) == {"alpha"} and {r.name for r in spark.read.json(f"{dest}/errors").collect()} == {"beta", "empty"}
    shutil.copy(src / "alpha" / "optimal_path.csv", src / "beta" / "optimal_path.csv")
    go()
    assert counts() == first | {"beta": counts()["beta"]} and counts()["beta"] > 0
    # written twice, tracks don't double
    rows = readers.read_spliced(spark, f"{dest}/spliced").where("name = 'alpha'").persist()
    rows.count()
    readers.write_spliced(rows, None, f"{dest}/spliced")
    assert counts()["alpha"] == first["alpha"] and "beta" in counts()
    with pytest.raises(FileNotFoundError):
        pipelines.main(["encode", "--src", f"{tmp_path}/nowhere", "--dest", str(dest)])


def test_partitions_one_after_another(spark):
    row = lambda t, i: (0, t, {"mass": 1.0}, i, 1.0 * t)
    a, b = [spark.createDataFrame([row(t, i) for t in range(n) for i in range(2)], "partition_id int, track_no int, vehicle map<string,double>, idx long, width double") for n in (2, 3)]
    got = readers.combine_partitions(a, b).collect()
    assert sorted((r.track_no, r.idx, r.width) for r in got) == [(t, i, 1.0 * (t if t < 2 else t - 2)) for t in range(5) for i in range(2)]


def test_training_examples(spark, folders):
    good, _ = pipelines.splice_folders(spark, folders, spacing=20.0)
    from ringforge.operators.transforms import Transform

    e = features.encode(good)
    v = good.select("track_id").distinct().withColumn("vehicle", F.create_map(F.lit("mass"), F.lit(3.0)))
    x, b = pipelines.training_examples(e, v, Transform("flat-window", foresight=2, vehicle_encoding=("mass",)))
    r = x.first()
    assert len(r.x) == 15 and r.vehicle == [0.0] and b.count() == 1


def test_project_round_trip(spark, tmp_path):
    k = spark.createDataFrame([("spa", "Left", 0, 5.0, 50.0), ("spa", "Left", 1, 5.5, 50.5), ("spa", "Right", 0, 6.0, 51.0)], "name string, layer string, idx long, lon double, lat double")
    readers.write_project(readers.curve_offsets(k), f"{tmp_path}/project")
    back = readers.read_project(spark, f"{tmp_path}/project")
    assert {tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in back.collect()} == {tuple(r) for r in k.collect()}


def test_command_line(spark, folders, tmp_path):
    (tmp_path / "out").mkdir()
    (tmp_path / "enc").mkdir()
    pipelines.main(["splice", "--src", folders, "--dest", f"{tmp_path}/out", "--spacing", "20"])
    assert {r.name for r in spark.read.json(f"{tmp_path}/out/errors").collect()} == {"beta", "empty"}
    pipelines.main(["encode", "--src", f"{tmp_path}/out/spliced", "--dest", f"{tmp_path}/enc", "--partitions", "2", "--flip"])
    e = spark.read.parquet(f"{tmp_path}/enc")
    assert {r.name: r["count"] for r in e.groupBy("name").count().collect()}.keys() == {"alpha", "alpha.flipped"}
    assert e.select("partition_id").distinct().count() == 2


def test_recipes(spark):
    from ringforge.operators import rings

    circle = lambda r, n: spark.createDataFrame([(1, k, r * math.cos(k / n * math.tau), r * math.sin(k / n * math.tau)) for k in range(n)], "track_id long, idx long, x double, y double")
    out = pipelines.reference_recipe(circle(100.0, 40), circle(95.0, 60), circle(106.0, 60), 10.0)
    w = [math.hypot(r.x1 - r.x2, r.y1 - r.y2) for r in out.collect()]
    assert len(w) == 63 and all(10 < x < 12 for x in w)
    x = pipelines.project_recipe(circle(60.0, 24), circle(57.0, 24), circle(64.0, 24)).collect()
    assert len(x) > 100 and all(5 < r.l + r.r < 9 for r in x)
    s = rings.sum_points(circle(1.0, 4), circle(2.0, 4)).where("idx = 0").first()
    assert s.x == pytest.approx(3)
    with pytest.raises(Exception, match="differ in length"):
        rings.sum_points(circle(1.0, 4), circle(2.0, 5)).collect()
    picked = rings.at_indexes(circle(1.0, 4), spark.createDataFrame([(1, 0, 2), (1, 1, 0)], "track_id long, idx long, at long"))
    assert {r.idx: round(r.x) for r in picked.collect()} == {0: -1, 1: 1}
