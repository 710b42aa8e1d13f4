"""Operators without SQL against numpy, closed forms and hand-made cases."""

import json
import math
import struct
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrawing.operators import align, fusion, keyframes, masks, mesh, quantiles, report, scorecard, sync, views
from terrawing.sources import files, sinks, telemetry
from terrawing.streaming import bus


def turned(yaw):
    c, s = math.cos(yaw), math.sin(yaw)
    return np.array([[c, -s, 0], [s, c, 0], [0, 0, 1.0]])


def test_similarity_recovers_a_known_transform_and_rejects_a_reflection():
    rng = np.random.default_rng(0)
    p = rng.normal(size=(30, 3))
    s, r, t = align.similarity(p, 1.7 * p @ turned(0.4).T + [1, 2, 3])
    assert s == pytest.approx(1.7) and np.allclose(r, turned(0.4)) and np.allclose(t, [1, 2, 3])
    _, r, _ = align.similarity(p, p * [1, 1, -1])
    assert np.linalg.det(r) == pytest.approx(1.0)


PAIRS = "chunk_idx int, sx double, sy double, sz double, dx double, dy double, dz double, w double"


@pytest.mark.parametrize("rows_per_block", [7, 20_000])
def test_consensus_ignores_gross_outliers(spark, monkeypatch, rows_per_block):
    rng = np.random.default_rng(1)
    rows = []
    for c in (0, 1):
        p = rng.normal(size=(60, 3)) * 10
        q = (1 + c) * p @ turned(1.0 + c).T + [5, 0, 1]
        q[:15] += np.sign(rng.normal(size=(15, 3))) * 80  # each far beyond the bound of inliers
        rows += [(c, *map(float, a), *map(float, b), 1.0) for a, b in zip(p, q)]
    rows += [(2, *map(float, rng.normal(size=6)), 1.0) for _ in range(9)]
    monkeypatch.setattr(align.consensus, "__defaults__", (False, 0, rows_per_block))
    got = {r["chunk_idx"]: r for r in align.fit_chunks(spark.createDataFrame(rows, PAIRS), robust=True).collect()}
    assert set(got) == {0, 1}
    for c in (0, 1):
        assert got[c]["scale"] == pytest.approx(1 + c, abs=1e-6) and got[c]["n"] >= 45 and np.allclose(got[c]["r"], turned(1.0 + c).ravel(), atol=1e-6)


def test_fits_of_moments_are_those_of_the_points(spark):
    rng = np.random.default_rng(10)
    p, noise = rng.normal(size=(40, 3)) * 5 + 100, rng.normal(size=(40, 3)) * 0.05
    cases = {0: 1.7 * p @ turned(0.4).T + [1, 2, 3] + noise, 1: p @ turned(2.0).T + noise, 2: p * [1, 1, -1]}
    rows = [(c, *map(float, a), *map(float, b), 1.0) for c, q in cases.items() for a, b in zip(p, q)] + [(3, *[0.0] * 6, 1.0)] * 2
    got = {r["chunk_idx"]: r for r in align.fit_chunks(spark.createDataFrame(rows, PAIRS)).collect()}
    assert {c: r["mode"] for c, r in got.items()} == {0: "sim3", 1: "rigid", 2: "rigid"}
    for c, q in cases.items():
        s, r, t = align.similarity(p, q, scaled=got[c]["mode"] == "sim3")
        assert np.allclose([got[c]["scale"], *got[c]["r"], *got[c]["t"]], [s, *r.ravel(), *t], atol=1e-6)
        assert got[c]["rmse"] == pytest.approx(np.sqrt((align.residual(p, q, s, r, t) ** 2).mean()), abs=1e-5)


def test_gravity_fixed_fit_recovers_a_tilted_chunk(spark):
    rng = np.random.default_rng(11)
    rows, ups, true = [], [], {}
    for c, up in enumerate([[0.2, -0.1, 0.9], [0, 0, -2.0], [0, 0, 1.0], [1.0, 0, 0]]):
        up = np.array(up, float)
        u = up / np.linalg.norm(up)
        v, k = np.cross(u, [0, 0, 1]), u[2]
        x = np.array([[0, -v[2], v[1]], [v[2], 0, -v[0]], [-v[1], v[0], 0]])
        g = np.diag([1.0, -1.0, -1.0]) if k < -1 + 1e-9 else np.eye(3) + x + x @ x / (1 + k)
        p = rng.normal(size=(30, 3)) * 10
        true[c] = turned(0.3 + c) @ g
        q = 1.5 * p @ true[c].T + [c, 1, 2]
        rows += [(c, *map(float, a), *map(float, b), 1.0) for a, b in zip(p, q)]
        ups.append((c, *map(float, up)))
    got = {r["chunk_idx"]: r for r in align.gravity_fixed(spark.createDataFrame(rows, PAIRS), spark.createDataFrame(ups + [(9, 0.0, 0.0, 0.0)], "chunk_idx int, ux double, uy double, uz double")).collect()}
    assert set(got) == set(true)
    for c, r in true.items():
        assert got[c]["scale"] == pytest.approx(1.5) and np.allclose(np.array(got[c]["r"]).reshape(3, 3), r, atol=1e-6) and np.allclose(got[c]["t"], [c, 1, 2], atol=1e-5) and got[c]["rmse"] < 1e-5
    seed = align.identity_seed(spark.createDataFrame(rows, PAIRS)).collect()
    assert len(seed) == 1 and seed[0]["scale"] == 1.0 and seed[0]["r"] == [1, 0, 0, 0, 1, 0, 0, 0, 1]


def test_plane_and_graph(spark):
    rng = np.random.default_rng(2)
    ground = np.column_stack([rng.uniform(-5, 5, 200), rng.uniform(-5, 5, 200), rng.normal(0, 0.01, 200)])
    cloud = np.vstack([ground, rng.uniform(-5, 5, (40, 3))])
    rows = [(1, *map(float, x)) for x in cloud] + [(2, *map(float, x)) for x in cloud[:49]] + [(3, *map(float, x)) for x in rng.uniform(-50, 50, (300, 3))]
    (got,) = align.planes(spark.createDataFrame(rows, "chunk_idx int, x double, y double, z double")).collect()
    assert got["chunk_idx"] == 1 and got["nz"] > 0.99 and got["share"] > 0.7
    p = rng.normal(size=(8, 3))
    true = np.array([[0.0, 0, 0, 0, 0], [0.2, 0.3, 4, 1, 0.5]])
    world = lambda f, q: math.exp(f[0]) * q @ turned(f[1]).T + f[2:]
    places = [(i, q, world(true[i], q), 1.0) for i in (0, 1) for q in p]
    got = align.refine_graph(true + rng.normal(0, 0.05, true.shape), [(0, 1, p, (p @ turned(-0.3).T - [0, 0, 0]) * 0)][:0], places)
    assert np.allclose(got, true, atol=1e-4)


def test_grid_fit_meets_images_of_two_sizes(spark):
    """The same slope as seen in images of two sizes; the model's is half as large and turned."""
    place = lambda r, c, h, w: np.array([10 * (c + 0.5) / w, 8 * (r + 0.5) / h, 20 + 5 * (r + 0.5) / h])
    ref = [(f, r, c, 64, 96, *map(float, place(r, c, 64, 96))) for f in (0, 1) for r in range(64) for c in range(96)]
    model = [(f, r, c, 32, 32, *map(float, 0.5 * turned(0.3) @ place(r, c, 32, 32))) for f in (0, 1) for r in range(32) for c in range(32)]
    cols = "frame_index int, row int, col int, height int, width int, x double, y double, z double"
    got = align.grid_fit(spark.createDataFrame(model, cols), spark.createDataFrame(ref, cols)).collect()
    assert len(got) == 2 and all(r["n"] == 1024 and r["scale"] == pytest.approx(2.0, rel=0.01) and r["residual_pct"] < 1 for r in got)


def test_colours_come_from_the_most_frontal_view(spark):
    cam = spark.createDataFrame([(k, [1.0, 0.0, 0.0, x, 0.0, -1.0, 0.0, 0.0, 0.0, 0.0, -1.0, 10.0, 0.0, 0.0, 0.0, 1.0], 10.0, 10.0, 16.0, 16.0, 32, 32) for k, x in ((0, 0.0), (1, 4.0))], "camera_id int, pose array<double>, fx double, fy double, cx double, cy double, width int, height int")
    rows = [(0, 2.0, 0.0, 0.0, -0.6, 0.0, 0.8), (1, 2.0, 0.0, 0.0, 0.6, 0.0, 0.8), (2, 2.0, 0.0, 0.0, 0.0, 0.0, 1.0), (3, 500.0, 0.0, 0.0, 0.0, 0.0, 1.0), (4, 2.0, 0.0, 20.0, 0.0, 0.0, 1.0), (5, float("nan"), 0.0, 0.0, 0.0, 0.0, 1.0)]
    v = spark.createDataFrame([(*r, 0.25, 0.5, 0.75) for r in rows], "id long, x double, y double, z double, nx double, ny double, nz double, r double, g double, b double")
    pixels = spark.range(32 * 32 * 2).select((F.col("id") % 2).cast("int").alias("camera_id"), (F.col("id") / 2 % 32).cast("int").alias("row"), (F.col("id") / 64).cast("int").alias("col"), (F.col("id") % 2 * 255).alias("r"), F.lit(0).alias("g"), F.lit(300).alias("b"))
    got = {r["id"]: (r["camera_id"], r["r"], r["b"]) for r in views.baked(v, cam, pixels, "id").collect()}
    assert got == {0: (0, 0.0, 1.0), 1: (1, 1.0, 1.0), 2: (0, 0.0, 1.0), 3: (None, 0.25, 0.75), 4: (None, 0.25, 0.75), 5: (None, 0.25, 0.75)}


def test_fit_4dof_resists_an_outlier(spark):
    rng = np.random.default_rng(3)
    rows = []
    for c in (0, 1):
        p = rng.normal(size=(20, 3)) * 20
        q = 1.2 * p @ turned(0.5 + c).T + [c, 2, 3]
        q[0] += 100
        rows += [(c, *map(float, a), *map(float, b), 1.0) for a, b in zip(p, q)]
    rows.append((9, *[0.0] * 6, 1.0))
    cols = "chunk_idx int, sx double, sy double, sz double, dx double, dy double, dz double, w double"
    got = {r["chunk_idx"]: r for r in align.fit_4dof(spark.createDataFrame(rows, cols), rounds=12).collect()}
    assert set(got) == {0, 1} and got[0]["scale"] == pytest.approx(1.2, abs=0.02) and got[1]["yaw"] == pytest.approx(1.5, abs=0.02)


def test_greedy_spacing_and_thinning(spark):
    rows = [(1, i, float(x), 0.0, 0.0) for i, x in enumerate([0, 1.9, 2.0, 3.9, 4.0, 4.1, 7])] + [(2, 0, None, None, None), (2, 1, 5.0, 5.0, 5.0)]
    df = spark.createDataFrame(rows, "track_id long, frame_index int, e double, n double, u double")
    got = {(r["track_id"], r["frame_index"]): r["kept"] for r in keyframes.spacing_gate(df).collect()}
    assert [got[(1, i)] for i in range(7)] == [True, False, True, False, True, False, True] and not got[(2, 0)] and got[(2, 1)]
    for n in (0, 1, 7, 10, 11, 25, 99):
        d = spark.range(n).select(F.lit(1).alias("track_id"), F.col("id").alias("frame_index"))
        want = list(range(n)) if n <= 10 else [int(i * (n / 10)) for i in range(10)]
        assert sorted(r["frame_index"] for r in keyframes.thin_even(d, 10).collect()) == want


@pytest.mark.parametrize("spread", [0.5, 3.0, 0.02])
def test_spacing_of_long_tracks_in_blocks(spark, spread):
    """Blocks of twenty frames keep what one stream keeps, also where a block keeps nothing at all."""
    rng = np.random.default_rng(13)
    p = np.cumsum(rng.normal(size=(700, 3)) * spread, axis=0)
    rows = [("a", i, *(map(float, x) if rng.random() > 0.1 else [None] * 3)) for i, x in enumerate(p)] + [(None, i, float(i), 0.0, 0.0) for i in range(100)] + [("b", 0, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "track_id string, frame_index int, e double, n double, u double")
    one, many = ({tuple(r) for r in keyframes.spacing_gate(df, rows_per_block=k).collect()} for k in (100_000, 20))
    assert one == many and len(one) == len(rows) and sum(r[2] for r in one) > 50


def test_sharpness_of_flat_and_rough_images():
    assert keyframes.laplacian_variance(np.full((16, 16), 3.0)) == 0
    assert keyframes.laplacian_variance(np.kron(np.indices((4, 4)).sum(0) % 2, np.ones((4, 4)))) > 1
    a = np.random.default_rng(0).random((20, 20))
    assert scorecard.ssim_of(a, a, np.ones_like(a, bool)) == pytest.approx(1.0)
    assert scorecard.ssim_of(a, a, np.zeros_like(a, bool)) is None


def test_nearest_points_against_brute_force(spark):
    p = np.random.default_rng(4).normal(size=(120, 3))
    p[5] = p[6]
    p[7] = 50
    df = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(p)], "id long, x double, y double, z double")
    got = {}
    for r in fusion.nearest_points(df, df, 4, "id", "id", 0.3).collect():
        got.setdefault(r["query"], {})[r["rank"]] = r["point"]
    d = np.linalg.norm(p[:, None] - p[None], axis=2)
    for i in range(len(p)):
        assert [got[i][k] for k in (1, 2, 3, 4)] == sorted(range(len(p)), key=lambda j: (d[i, j], j))[:4]
    kept = {r["id"] for r in fusion.without_outliers(df, "id", 0.3).collect()}
    assert 7 not in kept and len(kept) > 100


def test_unusable_points(spark):
    rows = [(1.0, 1.0, 1.0, 0.1, None), (1.0, 1.0, 1.0, 0.09, False), (float("nan"), 1.0, 1.0, 1.0, False), (1.0, float("inf"), 1.0, 1.0, False), (1.0, 1.0, 1.0, 1.0, True), (None, 1.0, 1.0, 1.0, False)]
    df = spark.createDataFrame(rows, "x double, y double, z double, conf double, masked boolean")
    assert fusion.usable(df).count() == 1
    keys = spark.createDataFrame([(-0.1,), (1e9,), (-1e9,)], "x double").select(fusion.voxel_key(F.col("x"), F.lit(0.0), F.lit(0.0), 1.0).alias("k")).collect()
    assert [r["k"] >> 42 for r in keys] == [(1 << 20) - 1, (1 << 21) - 1, 0]


def test_components_and_faces(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a long, b long")
    labels = {r["node"]: r["component"] for r in mesh.components(edges).collect()}
    assert set(labels.values()) == {0, 100} and mesh.large_components(edges).count() == 61


def test_normals_of_a_slope(spark):
    rng = np.random.default_rng(7)
    xy = rng.uniform(0, 5, (80, 2))
    rows = [(i, float(x), float(y), float(0.5 * x)) for i, (x, y) in enumerate(xy)]
    df = spark.createDataFrame(rows, "id long, x double, y double, z double")
    got = mesh.normals(df, fusion.nearest_points(df, df, 8, "id", "id", 1.0), "id").collect()
    assert len(got) == 80 and all(abs(abs(r["nz"]) - 1 / math.sqrt(1.25)) < 1e-6 and abs(r["ny"]) < 1e-6 for r in got)
    p = np.array([r[1:] for r in rows])
    d = np.linalg.norm(p[:, None] - p[None], axis=2)
    near = {}
    for r in mesh.hybrid_neighbours(df, "id", 0.8, 5).collect():
        near.setdefault(r["query"], set()).add(r["point"])
    assert all(near[i] == {j for j in sorted(range(80), key=lambda j: (d[i, j], j))[:5] if d[i, j] <= 0.8} for i in range(80))


def test_visible_without_cameras(spark):
    points = spark.createDataFrame([(0.0, 0.0, 0.0)], "x double, y double, z double")
    none = spark.createDataFrame([], "camera_id int, pose array<double>, fx double, fy double, cx double, cy double, width int, height int")
    assert views.visible(points, none).count() == 0


def test_interpolation_at_the_edges(spark):
    s = [(1, i, t, v, 0.0, None, y) for i, (t, v, y) in enumerate([(1.0, 10.0, 350.0), (2.0, 20.0, None), (2.0, 30.0, 10.0), (4.0, 50.0, 20.0)])] + [(2, 0, 5.0, 1.0, 0.0, None, None)]
    samples = spark.createDataFrame(s, "track_id long, source_index int, t double, lat double, lon double, alt double, yaw double")
    frames = spark.createDataFrame([(1, 0, 0.0), (1, 1, 1.5), (1, 2, 2.0), (1, 3, 3.0), (1, 4, 9.0), (2, 0, 1.0), (3, 0, 1.0), (1, 9, None)], "track_id long, frame_index int, timestamp_s double")
    got = {(r["track_id"], r["frame_index"]): (r["lat"], r["yaw"]) for r in sync.interpolate(samples, frames, values=["lat", "yaw"]).collect()}
    assert got == {(1, 0): (10.0, 350.0), (1, 1): (15.0, 350.0), (1, 2): (30.0, 10.0), (1, 3): (40.0, 15.0), (1, 4): (50.0, 20.0), (2, 0): (1.0, None), (3, 0): (None, None)}


def test_parsers_on_odd_input(spark):
    text = lambda t: spark.createDataFrame([(1, t)], "track_id long, text string")
    srt = "1\r\n00:00:01,5 --> 00:00:02,0\r\n[latitude: 1.5] [longitude: -2] [rel_alt: 3 abs_alt: 4]\r\n\r\n2\nno place\n\n3\nGPS(7.5, 8.5, 9)\n\n4\n00:00:03,05 --> x\n[latitude: 1] [longitude: 2] [rel_alt: 3]"
    assert [tuple(r)[1:7] for r in telemetry.srt(text(srt)).orderBy("source_index").collect()] == [(0, 1.5, 1.5, -2.0, 4.0, False), (2, 2.0, 8.5, 7.5, 9.0, False), (3, 3.05, 1.0, 2.0, 3.0, True)]
    csv = 'LAT, Longitude ,rel_alt,time\n1,2,3,2024-01-01T00:00:00Z\nx,2,3,4\n5,6,"n,a",7\n8,9'
    assert [tuple(r)[1:7] for r in telemetry.csv(text(csv)).orderBy("source_index").collect()] == [(0, 1704067200.0, 1.0, 2.0, 3.0, True), (2, 7.0, 5.0, 6.0, None, True), (3, 3.0, 8.0, 9.0, None, True)]
    assert telemetry.csv(text("a,b\n1,2")).count() == 0 and telemetry.gpx(text("<gpx><trkpt")).count() == 0 and telemetry.json_records(text('{"a": 1}')).count() == 0
    assert [r["lat"] for r in telemetry.gpx(text('<gpx><wpt lat="1" lon="2"/></gpx>')).collect()] == [1.0]
    assert telemetry.read(text(csv).withColumn("kind", F.lit("csv"))).count() == 3


def test_inputs_of_a_run(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "v.srt").write_text("x")
    assert [r["length"] for r in files.listing(spark, str(tmp_path)).collect()] == [1]
    folders = spark.createDataFrame([("/x/my_cache", []), ("/x/y", ["a.whl"]), ("/x/z", ["q"])], "path string, children array<string>")
    assert {r["path"] for r in files.cache_folders(folders).collect()} == {"/x/my_cache", "/x/y"}
    runs = spark.createDataFrame([("a", True, None, ""), ("b", False, '{"status": "ok"}', ""), ("c", False, None, "boom")], "model string, timed_out boolean, status_json string, log string")
    assert [r["state"] for r in files.run_status(runs).orderBy("model").collect()] == ["timeout", "ok", "crash_no_status"]


def test_sinks(spark, tmp_path):
    points = spark.createDataFrame([(i, 1.0 * i, 2.0, 3.0, 300.0, -5.0, 7.4, 0.5, 70_000) for i in range(3)], "id long, x double, y double, z double, r double, g double, b double, confidence double, view_count long")
    assert sinks.write_ply(points, str(tmp_path / "p.ply")) == 3
    raw = (tmp_path / "p.ply").read_bytes()
    body = raw[raw.index(b"end_header\n") + 11 :]
    assert b"element vertex 3\n" in raw and len(body) == 3 * 21 and struct.unpack("<fffBBBfH", body[:21])[3:] == (255, 0, 7, 0.5, 65535)
    sinks.viewer_html(points, "id", str(tmp_path / "v.html"), 2)
    sinks.report_html("t", {"<a>": points}, str(tmp_path / "r.html"))
    assert "DATA" in (tmp_path / "v.html").read_text() and "&lt;a&gt;" in (tmp_path / "r.html").read_text()


def test_las_as_a_reader_sees_it(spark, tmp_path):
    rows = [(i, -5.25 + i, 1e5 + i / 8, 7.001 * i, 300.0 * i, 10.0, 255.0, 0.25 * i, 60_000 + 9_000 * i) for i in range(4)]
    points = spark.createDataFrame(rows, "id long, x double, y double, z double, r double, g double, b double, confidence double, view_count long").repartition(3, "id")
    assert sinks.write_las(points, str(tmp_path / "p.las"), 32632) == 4
    raw = (tmp_path / "p.las").read_bytes()
    assert raw[:4] == b"LASF" and raw[24:26] == bytes([1, 2]) and struct.unpack_from("<H", raw, 94) == (227,) and raw[104] == 3
    start, n_vlr = struct.unpack_from("<II", raw, 96)
    length, n = struct.unpack_from("<HI", raw, 105)
    scale, offset = struct.unpack_from("<3d", raw, 131), struct.unpack_from("<3d", raw, 155)
    assert (n_vlr, length, n) == (2, 40, 4) and len(raw) == start + 4 * 40 and struct.unpack_from("<6d", raw, 179)[:2] == (-2.25, -5.25)
    keys = raw[227 + 54 : 227 + 54 + 32]
    assert struct.unpack("<16H", keys)[-1] == 32632 and raw[229:244] == b"LASF_Projection" and start == 227 + 54 + 32 + 54 + 2 * 192
    got = sorted((*[round(v * s + o, 6) for v, s, o in zip(r[:3], scale, offset)], *r[10:]) for r in struct.iter_unpack("<iiiHBBbBHdHHHfH", raw[start:]))
    assert got == [(-5.25 + i, 1e5 + i / 8, round(7.001 * i, 6), min(300 * i, 255) * 257, 2570, 65535, 0.25 * i, min(65535, 60_000 + 9_000 * i)) for i in range(4)]
    assert sinks.write_las(points.limit(0), str(tmp_path / "none.las")) == 0


def test_meshes_as_a_reader_sees_them(spark, tmp_path):
    v = spark.createDataFrame([(10 * i, float(i), 2.0, 3.0, 1.0, 0.5, 0.0) for i in range(4)], "vertex_id long, x double, y double, z double, r double, g double, b double").repartition(4)
    f = spark.createDataFrame([(7, 0, 10, 20), (3, 10, 20, 30), (9, 0, 10, 999)], "face_id long, a long, b long, c long")
    assert sinks.write_mesh_ply(v, f, str(tmp_path / "m.ply")) == (4, 2)
    raw = (tmp_path / "m.ply").read_bytes()
    body = raw[raw.index(b"end_header\n") + 11 :]
    assert [struct.unpack_from("<fffBBB", body, 15 * i) for i in range(4)] == [(i, 2, 3, 255, 127, 0) for i in range(4)]
    assert [struct.unpack_from("<Biii", body, 60 + 13 * i) for i in range(2)] == [(3, 1, 2, 3), (3, 0, 1, 2)] and len(body) == 60 + 26
    assert sinks.write_glb(v, f, str(tmp_path / "m.glb")) == (4, 2)
    raw = (tmp_path / "m.glb").read_bytes()
    kind, version, size, length, what = struct.unpack_from("<4sIII4s", raw)
    doc = json.loads(raw[20 : 20 + length])
    data = raw[20 + length + 8 :]
    assert (kind, version, size, what) == (b"glTF", 2, len(raw), b"JSON") and len(data) == doc["buffers"][0]["byteLength"]
    at = {i: doc["bufferViews"][i]["byteOffset"] for i in range(3)}
    assert struct.unpack_from("<12f", data, at[0])[::3] == (0, 1, 2, 3) and struct.unpack_from("<4B", data, at[1]) == (255, 127, 0, 255) and struct.unpack_from("<6I", data, at[2]) == (1, 2, 3, 0, 1, 2)
    corners = spark.createDataFrame([(face, c, 0.25 * c, 0.5) for face in (3, 7) for c in range(3)], "face_id long, corner int, u double, v double")
    sinks.write_obj(sinks.obj_lines(v, f, corners), str(tmp_path / "m.obj"), "t.png")
    lines = (tmp_path / "m.obj").read_text().split("\n")
    assert lines[:3] == ["mtllib m.mtl", "usemtl material0", "v 0.000000 2.000000 3.000000"] and lines[6:9] == ["vt 0.000000 0.500000", "vt 0.250000 0.500000", "vt 0.500000 0.500000"] and lines[12:14] == ["f 2/1 3/2 4/3", "f 1/4 2/5 3/6"]
    assert "map_Kd t.png" in (tmp_path / "m.mtl").read_text()


def test_rasters_as_a_reader_sees_them(spark, tmp_path):
    cells = spark.createDataFrame([(0, 1, 2.5, 1.0), (130, 0, -1.0, None), (131, 2, 7.0, 3.0)], "row int, col int, h double, n double")
    sinks.write_geotiff(cells, ["h", "n"], 3, 132, 500_000.0, 4_000_000.0, 0.5, str(tmp_path / "r.tif"), 32633)
    raw = (tmp_path / "r.tif").read_bytes()
    assert raw[:4] == b"II*\0"
    (count,) = struct.unpack_from("<H", raw, 8)
    tags = {}
    for i in range(count):
        tag, kind, n = struct.unpack_from("<HHI", raw, 10 + 12 * i)
        form = {2: f"{n}s", 3: f"{n}H", 4: f"{n}I", 12: f"{n}d"}[kind]
        at = 18 + 12 * i if struct.calcsize("<" + form) <= 4 else struct.unpack_from("<I", raw, 18 + 12 * i)[0]
        tags[tag] = struct.unpack_from("<" + form, raw, at)
    assert list(tags) == sorted(tags) and (tags[256], tags[257], tags[277]) == ((3,), (132,), (2,)) and tags[33550] == (0.5, 0.5, 0) and tags[33922][3:5] == (500_000, 4_000_000) and tags[34735][-1] == 32633 and tags[42113] == (b"nan\0",)
    bands = [np.concatenate([np.frombuffer(raw, "<f4", tags[279][i] // 4, tags[273][i]) for i in range(b * 3, b * 3 + 3)]).reshape(132, 3) for b in (0, 1)]
    assert {(r, c): float(bands[0][r, c]) for r, c in np.argwhere(~np.isnan(bands[0]))} == {(0, 1): 2.5, (130, 0): -1.0, (131, 2): 7.0} and np.isnan(bands[1]).sum() == 132 * 3 - 2
    sinks.write_png(cells.select("row", "col", (F.col("h") / 7).alias("shade")), "shade", 3, 132, str(tmp_path / "r.png"))
    raw = (tmp_path / "r.png").read_bytes()
    at = raw.index(b"IDAT")
    image = np.frombuffer(zlib.decompress(raw[at + 4 : at + 4 + struct.unpack_from(">I", raw, at - 4)[0]]), "u1").reshape(132, 4)[:, 1:]
    assert image[131, 2] == 255 and image[0, 1] == 91 and (image > 0).sum() == 2 and struct.unpack_from(">II", raw, 16) == (3, 132)


def test_long_lines_are_parts_that_share_their_ends(spark):
    df = spark.createDataFrame([("a", i, float(i), 0.0) for i in range(21)] + [("b", 0, 1.0, 1.0)], "name string, seq int, lon double, lat double")
    got = {(r["name"], r["part"]): [p[0] for p in json.loads(r["geojson"])["geometry"]["coordinates"]] for r in sinks.line_features(df, most=10).collect()}
    assert got == {("a", 0): [float(i) for i in range(11)], ("a", 1): [float(i) for i in range(10, 21)], ("b", 0): [1.0]}


def test_scorecard_files(spark, tmp_path):
    m = spark.createDataFrame([("x", 2.0, 1.0, 100.0, True), ("y", 4.0, 3.0, 50.0, True), ("z", None, 3.0, 5.0, False)], "model string, q double, e double, runtime_s double, has_cameras boolean")
    sinks.write_scorecard(scorecard.scorecard(m, {"q": False}, {"e": True}), str(tmp_path))
    text = (tmp_path / "scorecard.md").read_text()
    assert "| z | 0.333 | N/A | 1.000 | N/A | no |" in text and "Winner: x" in text or "Winner: y" in text
    assert {r["model"] for r in json.loads((tmp_path / "scores.json").read_text())} == {"x", "y", "z"} and "Winner" in (tmp_path / "report.html").read_text()


def test_a_late_event_takes_its_place(spark, tmp_path):
    """What arrives in a later batch with a smaller seq, or an earlier time, counts as in the batch fold."""
    rows = [(5, 5.0, "a", "fallback"), (1, 1.0, "a", "start"), (3, 3.0, "b", "done"), (9, 9.0, "b", "start"), (2, 2.0, "a", "fallback"), (8, 8.0, "a", "done"), (4, 4.0, "b", "fallback"), (7, 7.0, "a", "start")]
    df = spark.createDataFrame([(*r, "") for r in rows], bus.SCHEMA)
    for i, r in enumerate(rows):
        df.where(F.col("seq") == r[0]).coalesce(1).write.parquet(str(tmp_path / "in" / f"p{i}"))
    stream = bus.read(spark, str(tmp_path / "in" / "*"), files_per_trigger=1)
    got = bus.run_last(bus.status(stream), str(tmp_path / "out"), str(tmp_path / "ck"), "update")
    last = {}
    for r in got.orderBy("batch").collect():
        last[r["stage"]] = (r["status"], r["start_ts"], r["n_fallbacks"])
    assert last == {r["stage"]: (r["status"], r["start_ts"], r["n_fallbacks"]) for r in report.fold_stages(df).collect()} == {"a": ("done", 1.0, 2), "b": ("running", 9.0, 1)}


def test_stitcher_waits_for_its_turn(spark, tmp_path):
    rows = [[(0, 2), (1, 0)], [(0, 0), (0, 3)], [(0, 1), (0, 1)], [(0, 5), (1, 1)]]
    for i, part in enumerate(rows):
        spark.createDataFrame(part, "run_id long, chunk_idx long").coalesce(1).write.parquet(str(tmp_path / "in" / f"p{i}"))
    stream = spark.readStream.schema("run_id long, chunk_idx long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    got = bus.run_last(bus.stitched(stream), str(tmp_path / "out"), str(tmp_path / "ck"), "append").collect()
    for run, want in ((0, [0, 1, 2, 3]), (1, [0, 1])):
        mine = [(r["batch"], r["chunk_idx"]) for r in got if r["run_id"] == run]
        assert sorted(c for _, c in mine) == want and all(b1 <= b2 for (b1, c1) in mine for (b2, c2) in mine if c1 < c2)


def test_watchdog_warns_of_a_silent_stage(spark, tmp_path):
    df = spark.createDataFrame([(0, 0.0, "a", "start", ""), (1, 1.0, "b", "start", ""), (2, 2.0, "b", "done", "")], bus.SCHEMA)
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    q = bus.watchdog(bus.read(spark, str(tmp_path / "in")), 1.0, 1.0).writeStream.format("memory").queryName("t_watch").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(processingTime="1 second").start()
    try:
        for _ in range(40):
            time.sleep(0.5)
            if spark.table("t_watch").count() >= 2:
                break
    finally:
        q.stop()
    assert {r["stage"] for r in spark.table("t_watch").collect()} == {"a"}


def test_stall_warnings_are_those_of_a_polling_watchdog(spark):
    times = [3.0, 20.0, 130.0, 200.0, 259.0, 400.0]
    df = spark.createDataFrame([("s", t, 0.0) for t in times], "stage string, ts double, begun double")
    got = sorted((r["warned_at"], r["stalled_s"]) for r in report.stall_warnings(df, "stage", "ts", "begun").collect())
    want, warned = [], -100.0
    for tick in range(10, 400, 10):
        last = max(t for t in times if t <= tick) if tick >= times[0] else None
        if last is not None and tick - last >= 60 and tick - warned >= 30:
            want.append((float(tick), tick - last))
            warned = tick
    assert got == want and len(want) > 4


def test_keyframes_are_selected_with_reasons(spark):
    rng = np.random.default_rng(12)
    rows = []
    for t in (1, 2, 3):
        for i in range(4 if t == 3 else 120):
            place = None if t == 2 or rng.random() < 0.3 else [float(x) for x in rng.uniform(0, 9, 3)]
            rows.append((t, i, None if rng.random() < 0.02 else float(rng.uniform(1, 100)), *(place or [None] * 3)))
    got = {(r["track_id"], r["frame_index"]): r for r in keyframes.select(spark.createDataFrame(rows, "track_id long, frame_index int, sharpness double, e double, n double, u double")).collect()}
    assert len(got) == len(rows)
    for t in (1, 2, 3):
        mine = [r for r in rows if r[0] == t]
        floor = np.quantile([r[2] for r in mine if r[2] is not None], 0.15)
        last, bare = None, 0
        for _, i, s, e, n, u in mine:
            if s is None or s < floor:
                want, why = False, "sharpness"
            elif e is not None:
                want = last is None or math.dist((e, n, u), last) >= 2.0
                last, why = ((e, n, u) if want else last), "GPS"
            else:
                want, why = bare % 5 == 0 or len(mine) <= 5, "stride"
                bare += 1
            r = got[(t, i)]
            assert r["accepted"] == want and (r["reject_reason"] is None) == want and (want or why in r["reject_reason"])


def test_inputs_are_found_and_read(spark):
    deep = '{"a": {"b": {"c": {"fx": 1}}}, "x": 1}'
    rows = [("/z/k.json", '{"camera": {"lens": {"fx": 700, "fy": "701"}}, "cx": 1, "cy": 2}'), ("/a/deep.json", deep), ("/b/too_deep.json", '{"a": {"b": {"c": {"d": {"fx": 1}}}}}'), ("/c/cam.yaml", "camera:\n  K: 1\n"), ("/d/x.txt", '{"fx": 1}'), ("/e/bad.json", "{nope"), ("/f/list.json", '[{"fx": 1}]')]
    found = {r["path"]: r["first"] for r in files.intrinsics_files(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert found == {"/z/k.json": False, "/a/deep.json": True, "/c/cam.yaml": False}
    info = [(1, rows[0][1]), (2, '{"p": {"q": {"intrinsic_matrix": [[5, 0, 6], [0, 7, 8], [0, 0, 1]]}}}'), (3, "{}"), (4, None)]
    got = {r["id"]: (r["fx"], r["fy"], r["cx"], r["cy"]) for r in files.intrinsics(spark.createDataFrame(info, "id int, info string").withColumns({"w": F.lit(100), "h": F.lit(50)}), "info", "w", "h").collect()}
    assert got == {1: (700.0, 701.0, 1.0, 2.0), 2: (5.0, 7.0, 6.0, 8.0), 3: (90.0, 90.0, 50.0, 25.0), 4: (90.0, 90.0, 50.0, 25.0)}
    texts = [(1, "embedded", "1\n00:00:01,5 --> 00:00:02,0\n<font size=36>[latitude: 1] [longitude: 2] [rel_alt: 3]</font>"), (2, "mavlink", '{"type": "ATTITUDE", "yaw": 1.5}\n{"type": "GLOBAL_POSITION_INT", "lat": 1e7, "lon": 2e7}'), (3, "tape", "x"), (4, "gpx", "<gpx"), (5, "csv", None), (6, None, "x")]
    notes = {r["track_id"]: (r["n_samples"], r["note"]) for r in telemetry.tracks(spark.createDataFrame(texts, "track_id long, kind string, text string")).collect()}
    assert {k: n for k, (n, _) in notes.items()} == {1: 1, 2: 1, 3: 0, 4: 0, 5: 0, 6: 0} and notes[1][1] is None and all(notes[k][1] for k in (3, 4, 5, 6))


def packet(number, payload, version, seq=0):
    """A message as the protocol frames it."""
    extra = telemetry.PACKETS.get(number, (0, 0, 0, 7))[3]
    body = bytes([len(payload), seq, 1, 1, number]) if version == 1 else bytes([len(payload), 0, 0, seq, 1, 1]) + number.to_bytes(3, "little")
    return bytes([0xFE if version == 1 else 0xFD]) + body + payload + telemetry._checksum(body + payload + bytes([extra])).to_bytes(2, "little")


def test_binary_flight_logs(spark):
    assert telemetry._checksum(b"123456789") == 0x6F91  # the check value of CRC-16/MCRF4XX
    stamp = bytes(8)
    attitude = struct.pack("<I6f", 5, 0.1, 0.2, 1.5, 0, 0, 0)
    place = lambda ms, lat: struct.pack("<Iiiii3hH", ms, lat, 20_000_000, 150_000, 50_000, 0, 0, 0, 0)
    for version in (1, 2):
        log = stamp + packet(33, place(1000, 10_000_000), version) + stamp + packet(30, attitude, version) + b"\xfe\x05noise" + packet(0, b"heartbeat", version) + packet(33, place(2500, -70_000_000).rstrip(b"\0") if version == 2 else place(2500, -70_000_000), version) + packet(33, place(9, 9), version)[:-1] + b"?"
        got = telemetry.mavlink_logs(spark.createDataFrame([(1, bytearray(log)), (2, None)], "track_id long, content binary")).orderBy("source_index").collect()
        assert [(r["t"], r["lat"], r["lon"], r["alt"], r["alt_is_relative"]) for r in got] == [(1.0, 1.0, 2.0, 50.0, True), (2.5, -7.0, 2.0, 50.0, True)]
        assert got[0]["yaw"] is None and got[1]["yaw"] == pytest.approx(math.degrees(1.5), abs=1e-4)


def test_point_arrays(spark, tmp_path):
    np.save(tmp_path / "a.npy", np.arange(12.0).reshape(2, 2, 3))
    np.savez(tmp_path / "b.npz", points=np.ones((2, 3), "f4"), other=np.ones(5))
    rows = [(p.name, bytearray(p.read_bytes())) for p in sorted(tmp_path.iterdir())] + [("c.npy", bytearray(b"junk")), ("d.npy", None)]
    got = sorted(tuple(r) for r in files.point_arrays(spark.createDataFrame(rows, "path string, content binary")).collect())
    assert got == [("a.npy", "", i, 3.0 * i, 3.0 * i + 1, 3.0 * i + 2) for i in range(4)] + [("b.npz", "points", i, 1.0, 1.0, 1.0) for i in range(2)]


def test_masks_of_moving_things_and_water(spark):
    rows = [(1, 1, "Car", 0, 0, 0.9), (1, 1, "Car", 0, 1, 0.5), (1, 2, "sky", 0, 0, 0.8), (1, 3, "tree", 1, 1, 0.9), (2, 4, "chair", 0, 0, 1.0), (1, 5, "dog", 1, 0, 0.2)]
    df = spark.createDataFrame([(*r, 2, 2) for r in rows], "frame_index int, detection_id int, class string, row int, col int, share double, height int, width int")
    assert {tuple(r) for r in masks.masks(df).collect()} == {(1, 2, 0.25), (2, 0, 0.0)}


def test_streams_agree_with_the_batch(spark, tmp_path):
    rows = [(0, 0.0, "a", "start"), (1, 1.0, "a", "fallback"), (2, 2.0, "b", "fallback"), (3, 3.0, "a", "done"), (4, 4.0, "b", "start"), (5, 5.0, "b", "fallback"), (6, 6.0, "c", "error")]
    df = spark.createDataFrame([(*r, "") for r in rows], bus.SCHEMA)
    for k in range(3):
        df.where(F.col("seq") % 3 == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    bus.run_once(bus.fold(bus.read(spark, str(tmp_path / "in"))), "t_fold", "complete", str(tmp_path / "ck1"))
    assert {(r["stage"], r["n_events"], r["n_fallbacks"]) for r in spark.table("t_fold").collect()} == {("a", 3, 1), ("b", 3, 2), ("c", 1, 0)}
    batch = {r["stage"]: (r["status"], r["n_fallbacks"]) for r in report.fold_stages(df).collect()}
    assert batch == {"a": ("done", 1), "b": ("fallback", 2), "c": ("error", 0)}
    df.coalesce(1).write.parquet(str(tmp_path / "one"))
    bus.run_once(bus.status(bus.read(spark, str(tmp_path / "one"))), "t_status", "update", str(tmp_path / "ck2"))
    assert {r["stage"]: (r["status"], r["n_fallbacks"]) for r in spark.table("t_status").collect()} == batch
    points = spark.createDataFrame([(1.0, 1.0, 1.0, 0.5, False)] * 3, "x double, y double, z double, conf double, masked boolean")
    points.write.parquet(str(tmp_path / "pts"))
    stream = spark.readStream.schema(points.schema).parquet(str(tmp_path / "pts"))
    bus.run_once(bus.fused_increments(stream, 1.0), "t_fused", "complete", str(tmp_path / "ck3"))
    assert spark.table("t_fused").collect()[0]["n"] == 3


def test_exact_quantiles_against_numpy(spark):
    rng = np.random.default_rng(8)
    values = {"a": rng.normal(size=40_000), "b": rng.integers(0, 5, 20_000).astype(float), "c": np.array([3.0]), "d": np.concatenate([np.zeros(30_000), rng.random(50)]), None: rng.random(7)}
    rows = [(k, float(x)) for k, v in values.items() for x in v] + [("a", None), ("a", float("nan")), ("none", None)]
    df = spark.createDataFrame(rows, "g string, x double")
    shares = {"q0": 0.0, "q15": 0.15, "q50": 0.5, "q90": 0.9, "q98": 0.98, "q1": 1.0}
    got = {r["g"]: r for r in quantiles.exact_quantiles(df, "x", shares, ["g"]).collect()}
    assert set(got) == set(values)
    for k, v in values.items():
        assert got[k]["n"] == len(v) and np.allclose([got[k][q] for q in shares], np.quantile(v, list(shares.values())), atol=1e-12)
    (whole,) = quantiles.exact_quantiles(df, "x", shares).collect()
    assert np.allclose([whole[q] for q in shares], np.quantile(np.concatenate(list(values.values())), list(shares.values())), atol=1e-12)
    assert quantiles.exact_quantiles(df.limit(0), "x", shares).count() == 0


def test_nearest_points_of_odd_clouds(spark):
    """Equal places, a far point, a dense corner, and places that aren't finite; nothing is left out."""
    rng = np.random.default_rng(9)
    p = np.vstack([np.zeros((400, 3)), rng.normal(size=(600, 3)) * 1e-3, rng.normal(size=(20, 3)) * 100, [[1e9, 0, 0]]])
    rows = [(i, *map(float, x)) for i, x in enumerate(p)] + [(5000, float("nan"), 0.0, 0.0), (5001, None, 0.0, 0.0), (5002, float("inf"), 0.0, 0.0)]
    df = spark.createDataFrame(rows, "id long, x double, y double, z double")
    got = {}
    for r in fusion.nearest_points(df, df, 3, "id", "id", 64.0).collect():
        got.setdefault(r["query"], {})[r["rank"]] = r["point"]
    d = np.linalg.norm(p[:, None] - p[None], axis=2)
    assert set(got) == set(range(len(p)))
    for i in range(len(p)):
        assert [got[i][k] for k in (1, 2, 3)] == sorted(range(len(p)), key=lambda j: (d[i, j], j))[:3]
    assert fusion.nearest_points(df.limit(0), df, 3, "id", "id", 1.0).count() == 0 and fusion.nearest_points(df, df.limit(0), 3, "id", "id", 1.0).count() == 0
