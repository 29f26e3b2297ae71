"""Readers, writers and streams, by round trips."""

import datetime as dt
import struct

import numpy as np
import pytest

from skyfuse.config import Config
from skyfuse.functions import tables
from skyfuse.operators import grid
from skyfuse.sources import files, scenes
from skyfuse.streaming import online


def test_point_clouds(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(files.encode_points([35.1, 35.2], [-123.0, -123.1], [0.5, 0.25]))
    (tmp_path / "b.bin").write_bytes(files.encode_points([], [], []))
    (tmp_path / "c.bin").write_bytes(files.encode_points([35.1], [-123.0], [0.5])[:-3])
    (tmp_path / "list.txt").write_text("1\tx/a.bin\n\n 2  x/b.bin \n3\tx/c.bin\n")
    listed = files.read_manifest(spark, str(tmp_path / "list.txt"))
    assert sorted((r["t"], r["path"]) for r in listed.collect()) == [(1, "x/a.bin"), (2, "x/b.bin"), (3, "x/c.bin")]
    got = files.read_points(spark, f"{tmp_path}/*.bin", listed).collect()
    assert sorted((r["t"], r["lat"], r["lon"], r["aod"]) for r in got) == [(1, 35.1, -123.0, 0.5), (1, 35.2, -123.1, 0.25)]


def test_point_cloud_source(spark, tmp_path):
    spark.dataSource.register(files.PointCloudSource)
    df = spark.createDataFrame([(35.5, -122.0, 1.5)], "lat double, lon double, aod double")
    df.write.format("pointcloud").mode("append").save(str(tmp_path / "out"))
    made = ",".join(str(p) for p in (tmp_path / "out").glob("*.bin"))
    back = spark.read.format("pointcloud").option("paths", made).load().collect()
    assert [(r["lat"], r["lon"], r["aod"]) for r in back] == [(35.5, -122.0, 1.5)]


def test_matrix_files(spark, tmp_path):
    (tmp_path / "m.csv").write_text('"V1","V2","V3"\r\n1.5,NaN,x\r\n2,"3"\n')
    got = {(r["i"], r["j"]): r["v"] for r in files.read_matrix(spark, str(tmp_path / "m.csv"), 3).collect()}
    assert got == {(1, 1): 1.5, (1, 2): None, (1, 3): None, (2, 1): 2.0, (2, 2): 3.0, (2, 3): None}
    assert [r["value"] for r in files.read_column(spark, str(tmp_path / "m.csv")).collect()] == [1.5, 2.0]
    long = spark.createDataFrame([(i, j, 1 / (1 + i + 3 * j) if i != j else None) for i in range(3) for j in range(3)], "r int, c int, v double")
    files.write_matrix(grid.wide(long, "r", "c", "v", 3), "r", str(tmp_path / "w"))
    (part,) = (tmp_path / "w").glob("part-*")
    back = files.read_matrix(spark, str(part), 3)
    for r in back.collect():
        want = 1 / (1 + (r["i"] - 1) + 3 * (r["j"] - 1)) if r["i"] != r["j"] else None
        assert r["v"] == want


def test_long_files_and_coords(spark, tmp_path):
    (tmp_path / "l.csv").write_text("long,lat,AOD,time_index\n-123.98,35.02,0.5,1\n-123.94,35.02,NA,1\n-123.98,35.02,nan,2\n")
    names = {"long": "double", "lat": "double", "AOD": "double", "time_index": "int"}
    assert [r["AOD"] for r in files.read_long(spark, str(tmp_path / "l.csv"), names, 1).orderBy("long").collect()] == [0.5, None]
    (tmp_path / "c.txt").write_text("1.25 nan\n2.50 3.75\n")
    got = {(r["y"], r["x"]): r["lat"] for r in files.read_coords(spark, str(tmp_path / "c.txt"), "lat").collect()}
    assert got == {(0, 0): 1.25, (0, 1): None, (1, 0): 2.5, (1, 1): 3.75}


def test_writers(spark, tmp_path):
    g = spark.createDataFrame([(0, 1, -123.94, 35.02, None), (0, 0, -123.98, 35.02, 0.1 + 0.2)], "lat_i int, lon_i int, lon double, lat double, aod double")
    files.write_grid(g, str(tmp_path / "g"))
    (part,) = (tmp_path / "g").glob("part-*")
    assert part.read_text().split() == ["long,lat,AOD", "-123.98000000,35.02000000,0.30000000000000004", "-123.94000000,35.02000000,NaN"]
    m = spark.createDataFrame([(1, "a"), (2, "b")], "t int, path string")
    files.write_manifest(m, str(tmp_path / "m"))
    assert sorted((r["t"], r["path"]) for r in files.read_manifest(spark, str(tmp_path / "m")).collect()) == [(1, "a"), (2, "b")]


def test_align(spark):
    s = spark.createDataFrame([(0, 2, 1.0)], "y int, x int, aod double")
    assert files.align(s, 2, 3, 2, 3) is s
    assert files.align(s, 3, 2, 2, 3).head().asDict() == {"y": 2, "x": 0, "aod": 1.0}
    assert files.align(s, 5, 5, 2, 3) is None


UNIT = Config(nr=2, lon_min=0.0, lon_max=2.0, lat_min=0.0, lat_max=2.0, resolution=1.0)


def _stream(spark, tmp_path, schema, *steps):
    for i, rows in enumerate(steps):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/{i}"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))


def _run(df, name, mode):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()


def test_windowed_regrid_and_last_known(spark, tmp_path):
    at = lambda m: dt.datetime(2024, 1, 1, 0, m)
    schema = "ts timestamp, lat double, lon double, aod double"
    points = _stream(spark, tmp_path, schema, [(at(1), 0.5, 0.5, 1.0), (at(2), 0.5, 0.5, 3.0)], [(at(30), 0.5, 0.5, 5.0)], [(at(59), 1.5, 0.5, 7.0)])
    _run(online.windowed_regrid(points, cfg=UNIT), "windows", "append")
    assert [(r["n"], r["aod"]) for r in spark.table("windows").orderBy("window").collect()][:1] == [(2, 2.0)]
    _run(online.last_known(points, UNIT), "latest", "update")
    newest = {}
    for r in spark.table("latest").orderBy("ts").collect():
        newest[r["lat_i"], r["lon_i"]] = r["aod"]
    assert newest == {(0, 0): 5.0, (1, 0): 7.0}


def test_online_filter_equals_batch(spark, tmp_path):
    from skyfuse.operators import dense

    rng = np.random.default_rng(1)
    f, g, w, m0, c0 = rng.normal(size=(4, 2)), 0.9 * np.eye(2), 0.1 * np.eye(2), np.zeros(2), np.eye(2)
    ys = [rng.normal(size=4) for _ in range(3)]
    steps = [[(1, t + 1, i + 1, float(y[i])) for i in range(4)] for t, y in enumerate(ys)]
    obs = _stream(spark, tmp_path, "domain int, t int, site int, y double", *steps)
    _run(online.online_filter(obs, f, g, w, 0.3, m0, c0), "online", "append")
    want = dense.kalman([f] * 3, ys, [np.full(4, 0.3)] * 3, g, w, m0, c0)[-1][2]
    got = [r["value"] for r in spark.table("online").where("t = 3").orderBy("coef_idx").collect()]
    assert got == pytest.approx(list(want))


def test_online_filter_after_gaps_and_late_steps(spark, tmp_path):
    from skyfuse.operators import dense

    rng = np.random.default_rng(2)
    f, g, w, m0, c0 = rng.normal(size=(4, 2)), np.array([[0.9, 0.2], [0.0, 0.7]]), 0.1 * np.eye(2), np.ones(2), np.eye(2)
    ys, variance = {t: rng.normal(size=4) for t in (2, 3, 5, 6)}, {0: 0.3, 1: 0.9}
    # the second source sees the same sites as the first; step 3 comes too late
    steps = [[(1, t, s, i + 1, float(ys[t][i] + s)) for s in (0, 1) for i in range(4)] for t in (2, 5, 3, 6)]
    obs = _stream(spark, tmp_path, "domain int, t int, sat int, site int, y double", *steps)
    _run(online.online_filter(obs, f, g, w, variance, m0, c0), "gaps", "append")
    none, both = (np.zeros((0, 2)), np.zeros(0), np.zeros(0)), lambda t: (np.vstack([f, f]), np.concatenate([ys[t], ys[t] + 1]), np.repeat([0.3, 0.9], 4))
    seen = [none, both(2), none, none, both(5), both(6)]
    want = dense.kalman(*zip(*[(a, b) for a, b, _ in seen], strict=True), [v for *_, v in seen], g, w, m0, c0)
    got = {(r["t"], r["coef_idx"]): r["value"] for r in spark.table("gaps").collect()}
    assert len(got) == 12
    for t in range(1, 7):
        assert [got[t, 1], got[t, 2]] == pytest.approx(list(want[t - 1][2]))


# scenes in the classic format


def pad(b):
    return b + b"\0" * (-len(b) % 4)


def text(t):
    return struct.pack(">i", len(t)) + pad(t.encode())


def scene_bytes(values, name="AOD", **attributes):
    """A file with one 16-bit variable, written by the format's description."""
    kinds = {float: (5, ">f4"), int: (3, ">i2")}
    parts = b""
    for k, v in attributes.items():
        if isinstance(v, str):
            parts += text(k) + struct.pack(">ii", 2, len(v)) + pad(v.encode())
        else:
            code, kind = kinds[type(v)]
            parts += text(k) + struct.pack(">ii", code, 1) + pad(np.array([v], kind).tobytes())
    h, w = values.shape
    head = b"CDF\x01" + struct.pack(">i", 0) + struct.pack(">ii", 10, 2) + text("y") + struct.pack(">i", h) + text("x") + struct.pack(">i", w)
    head += struct.pack(">ii", 0, 0) + struct.pack(">ii", 11, 1) + text(name) + struct.pack(">iii", 2, 0, 1)
    head += (struct.pack(">ii", 12, len(attributes)) + parts) if attributes else struct.pack(">ii", 0, 0)
    data = values.astype(">i2").tobytes()
    head += struct.pack(">ii", 3, len(data))
    return head + struct.pack(">i", len(head) + 4) + pad(data)


def test_scenes(spark, tmp_path):
    v = np.array([[0, 100, -1], [250, -999, 7]])
    (tmp_path / "a.nc").write_bytes(scene_bytes(v, _FillValue=-999, scale_factor=0.5, add_offset=1.0))
    (tmp_path / "u.nc").write_bytes(scene_bytes(v, _FillValue=-1, _Unsigned="true"))
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "b.nc").write_bytes(scene_bytes(v, name="other"))
    (tmp_path / "cut.nc").write_bytes(scene_bytes(v)[:60])
    (tmp_path / "x.nc").write_bytes(b"")
    (tmp_path / "note.txt").write_text("no scene")
    got = {(r["path"].rsplit("/", 1)[1], r["y"], r["x"]): r["aod"] for r in scenes.read_scenes(spark, str(tmp_path)).collect()}
    assert [got["a.nc", y, x] for y in (0, 1) for x in (0, 1, 2)] == [1.0, 51.0, 0.5, 126.0, None, 4.5]
    assert got["u.nc", 0, 2] is None and got["u.nc", 1, 1] == 65536 - 999 and len(got) == 12
    bad = {r["path"].rsplit("/", 1)[1]: r["error"] for r in scenes.bad_scenes(spark, str(tmp_path)).collect()}
    assert set(bad) == {"b.nc", "cut.nc"} and "other" not in str(got)
    lat = spark.createDataFrame([(0, 0, 35.5), (0, 1, None)], "y int, x int, lat double")
    lon = spark.createDataFrame([(0, 0, -123.5), (0, 1, -123.0)], "y int, x int, lon double")
    assert {tuple(r)[1:] for r in scenes.points_of(scenes.read_scenes(spark, str(tmp_path)).where("path LIKE '%a.nc'"), lat, lon).collect()} == {(35.5, -123.5, 1.0)}


def lines_of(path):
    return [line for f in sorted(path.glob("part-*")) for line in f.read_text().splitlines()]


def test_text_writers(spark, tmp_path):
    c = spark.createDataFrame([(1, 0, 1.005), (0, 1, None), (0, 0, 35.126), (1, 1, -3.0)], "y int, x int, lat double")
    files.write_coords(c, "lat", str(tmp_path / "c"))
    assert [line.split()[1] for line in lines_of(tmp_path / "c")] == ["nan", "-3.00"] and lines_of(tmp_path / "c")[0].startswith("35.13 ")
    m = spark.createDataFrame([(2, 1234567.0, None), (1, 0.5, 1e-9)], "i int, V1 double, V2 double")
    files.write_short(m, "i", str(tmp_path / "m"))
    found = [x for x in lines_of(tmp_path / "m") if x != "V1,V2"]
    assert [[float(v) for v in x.split(",")][0] for x in found] == [0.5, 1234570.0] and found[1].endswith("nan")
    e = spark.createDataFrame([(2, 0.123456789, None), (1, 1.0, 2.0)], "time_step int, a double, b double")
    files.write_errors(e, str(tmp_path / "e"))
    assert [x for x in lines_of(tmp_path / "e") if not x.startswith("time")] == ["1,1.00000000,2.00000000", "2,0.12345679,NA"]
    files.write_timings(spark.createDataFrame([("one", "sec", 1.5)], "section string, unit string, value double"), str(tmp_path / "t"))
    assert lines_of(tmp_path / "t") == ["section,unit,value", "one,sec,1.5"]
    files.write_counts(spark.createDataFrame([(2, 5, 6), (1, 3, 4)], "t int, n1 int, n2 int"), str(tmp_path / "n"))
    assert [x for x in lines_of(tmp_path / "n") if not x.startswith("t")] == ["1,3,4", "2,5,6"]


def test_flat_images(spark, tmp_path):
    (tmp_path / "d.csv").write_text("1,2,x\n3,4\n5\n6\n")
    got = sorted(map(tuple, files.read_flat(spark, str(tmp_path / "d.csv"), 3).collect()))
    assert got == [(1, 1, 1.0), (1, 2, 2.0), (1, 3, 3.0), (2, 1, 4.0), (2, 2, 5.0), (2, 3, 6.0)]


def test_copies_of_new_files(spark, tmp_path):
    source, target = tmp_path / "from", tmp_path / "to"
    (source / "d").mkdir(parents=True)
    (target / "d").mkdir(parents=True)
    for name, n in (("d/a.nc", 300), ("d/b.nc", 300), ("d/c.nc", 300)):
        (source / name).write_bytes(b"x" * n)
    (target / "d/a.nc").write_bytes(b"y" * 300)
    (target / "d/b.nc").write_bytes(b"y" * 5)
    listed = files.list_objects(spark, str(source))
    assert listed.count() == 3 and {r["length"] for r in listed.collect()} == {300}
    rows = spark.createDataFrame([(x,) for x in ("d/a.nc", "d/b.nc", "d/c.nc", "d/lost.nc")], "path string")
    assert files.copy_files(spark, str(source), rows, str(target), 100) == {"copied": 2, "present": 1, "failed": 1}
    assert (target / "d/b.nc").read_bytes() == b"x" * 300 and (target / "d/a.nc").read_bytes() == b"y" * 300
    assert files.copy_files(spark, str(source), rows, str(target), 100) == {"copied": 0, "present": 3, "failed": 1}


def test_table_functions(spark):
    tables.register(spark)
    assert spark.sql("SELECT count(*) FROM omega(20)").head()[0] == 202
    g = spark.sql("SELECT * FROM grid(60, 0.04, 35.0, -124.0)")
    assert g.count() == 3600 and tuple(g.where("site = 61").head()) == (61, 1, 1, pytest.approx(35.06), pytest.approx(-123.94))
    assert [r["idx"] for r in spark.sql("SELECT * FROM lattice(60, 20) ORDER BY idx").collect()] == list(range(2, 60, 3))


def test_command_line(spark, tmp_path):
    from skyfuse import __main__ as cli

    cli.main(["/root/testdata/sf0.001", str(tmp_path / "out"), "-k", "5", "--save"])
    assert len([x for x in lines_of(tmp_path / "out/G") if not x.startswith("V1")]) == 400
    assert len([x for x in lines_of(tmp_path / "out/v_a") if not x.startswith("long")]) == 3600
    assert spark.read.parquet(str(tmp_path / "out/images")).count() == 5 * 3600
    assert any(x.startswith("transition matrix,sec,") for x in lines_of(tmp_path / "out/timing"))
