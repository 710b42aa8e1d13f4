"""The general data-preparation operators against brute force and hand-made cases."""

import datetime as dt
import json
import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrawing.operators import charts, clocks, drift, rejects
from terrawing.operators.blocks import blocked, neighbours, numbered
from terrawing.operators.grid import regular_grid, silences
from terrawing.operators.spikes import GPU, TELEMETRY, flag_readings


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


# ------------------------------------------------------------------- blocks


def test_blocks_cut_a_hot_source_and_copy_what_is_near_a_cut(spark):
    rows = [(1, float(i)) for i in range(1000)] + [(2, 5.0), (None, 1.0), (1, None), (1, float("nan"))]
    out = blocked(table(spark, rows, "k long, t double"), ["k"], "t", 100, halo=3.0).collect()
    core = [r for r in out if r["_core"]]
    assert len(core) == 1002 and len({r["_block"] for r in core if r["k"] == 1}) == 10
    extra = [r for r in out if not r["_core"]]
    assert extra and all(r["k"] == 1 for r in extra)


def test_neither_a_stray_time_nor_a_null_source_makes_a_block_large(spark):
    rows = [(k, float(i)) for k in (1, None) for i in range(20_000)] + [(1, 1.7e12)] + [(2, 5.0)] * 5000
    sizes = blocked(table(spark, rows, "k long, t double"), ["k"], "t", 1000).groupBy("k", "_block").count().collect()
    assert all(r["count"] <= 2000 for r in sizes if r["k"] != 2)
    assert 18 <= sum(r["k"] == 1 for r in sizes) <= 24 and 18 <= sum(r["k"] is None for r in sizes) <= 24 and sum(r["k"] == 2 for r in sizes) <= 2


@pytest.mark.parametrize("rows_per_block", [7, 10_000])
def test_numbers_over_cuts(spark, rows_per_block):
    rows = [(k, t, i) for k, n in ((1, 100), (None, 40), (2, 3)) for i, t in enumerate([None, None, *map(float, range(n))])]
    got = numbered(table(spark, rows, "k long, t double, i long"), ["k"], ["t", "i"], "place", rows_per_block).collect()
    assert len(got) == len(rows) and all(r["place"] == r["i"] and r["_total"] == {1: 102, None: 42, 2: 5}[r["k"]] for r in got)


@pytest.mark.parametrize("rows_per_block", [20, 10_000])
def test_neighbours_over_cuts(spark, rows_per_block):
    rng = random.Random(3)
    rows = [(k, float(t), rng.choice([None, None, t])) for k in (1, 2) for t in range(200 if k == 1 else 7)]
    df = table(spark, [(k, t, None if v is None else float(v)) for k, t, v in rows], "k long, t double, v double")
    got = {(r["k"], r["t"]): (r["_prev"], r["_next"]) for r in neighbours(df, ["k"], "t", [], F.col("v"), rows_per_block).collect()}
    for k, t, _ in rows:
        before = [float(v) for kk, tt, v in rows if kk == k and tt <= t and v is not None]
        after = [float(v) for kk, tt, v in rows if kk == k and tt > t and v is not None]
        assert got[(k, t)] == (before[-1] if before else None, after[0] if after else None)


# --------------------------------------------------------------------- grid


def empty_by_force(rows, gap=600):
    out = set()
    for k in {r[0] for r in rows}:
        t = sorted({r[1] for r in rows if r[0] == k and r[1] is not None and math.isfinite(r[1])})
        for a, b in zip(t, t[1:]):
            if round(b - a, 6) <= gap:
                out |= {(k, s) for s in range(math.floor(a) + 1, math.floor(b))}
    return out


@pytest.mark.parametrize("rows_per_block", [50, 100_000])
def test_grid_finds_the_empty_cells(spark, rows_per_block):
    rng = random.Random(1)
    rows, t = [], 0.0
    for _ in range(800):
        t += rng.choice([0.2, 0.3, 1.7, 30.0, 600.0, 601.0]) if rng.random() < 0.3 else 0.25
        rows.append((1, round(t, 3), 1.0, 5))
    rows += [(2, 1e9 + i * 0.9, 2.0, i) for i in range(50)] + [(1, None, 1.0, 1), (2, float("nan"), 1.0, 2), (2, float("inf"), 1.0, 2), rows[0], rows[1]]
    df = table(spark, rows, "track_id long, t double, x double, n long")
    cells = regular_grid(df, ["track_id"], "t", ["x"], ["n"], rows_per_block=rows_per_block).collect()
    assert {(r["track_id"], r["slot"]) for r in cells if r["mark"] == "filled"} == empty_by_force(rows)
    assert {r["mark"] for r in cells} == {"observed", "filled", "uncovered"} and all((r["last_slot"] > r["slot"] or r["n_samples"] == 0) == (r["mark"] == "uncovered" or r["n_samples"] == 0) for r in cells)
    assert len(cells) == len({(r["track_id"], r["slot"]) for r in cells})


def test_grid_spreads_increments_and_marks_resets(spark):
    rows = [(1, 0.5, 0.0, 10.0), (1, 2.5, 20.0, 30.0), (1, 3.5, None, 4.0)]
    got = {r["slot"]: r for r in regular_grid(table(spark, rows, "k long, t double, x double, c double"), ["k"], "t", ["x"], ["c"]).collect()}
    assert [got[s]["c_inc"] for s in range(4)] == [5.0, 10.0, 5.0 + 2.0, 2.0]
    assert got[3]["c_reset"] and not got[1]["c_reset"]
    assert got[1]["mark"] == "filled" and got[1]["x"] == pytest.approx(10.0)
    assert sum(r["c_inc"] for r in got.values()) == pytest.approx(20 + 4)


def test_grid_and_silences_of_empty_tables(spark):
    none = table(spark, [], "k long, t double, x double, slot long")
    assert regular_grid(none, ["k"], "t", ["x"]).count() == 0
    assert silences(none, ["k"], "t").count() == 0


@pytest.mark.parametrize("rows_per_block", [3, 100_000])
def test_silences_also_over_cuts(spark, rows_per_block):
    rows = [(1, t) for t in (0.0, 1.0, 700.0, 701.0, 702.5, 5000.0, 5001.0, 5002.0)]
    got = {(r["from_slot"], r["to_slot"]) for r in silences(table(spark, rows, "k long, t double"), ["k"], "t", rows_per_block=rows_per_block).collect()}
    assert got == {(2, 699), (703, 4999)}


# ------------------------------------------------------------------- spikes


def flight(n=400, seed=0):
    rng = np.random.default_rng(seed)
    t = np.cumsum(rng.uniform(0.15, 0.35, n))
    v = 80 + 10 * np.sin(t / 20) + rng.normal(0, 0.3, n)
    return t, v


def test_charts_mark_spikes_not_shifts():
    t, v = flight()
    w = v.copy()
    w[100] += 40
    w[200:203] -= 25
    w[300:] += 60  # the drone went up while nobody listened
    t = t.copy()
    t[300:] += 900
    marked = charts.spikes(t, w, TELEMETRY["alt"], charts.ChartParams())
    assert np.flatnonzero(marked).tolist() == [100, 200, 201, 202]


def test_charts_freeze_only_far_beyond_what_a_source_shows():
    t, v = flight()
    v[50:80] = v[50]
    assert np.flatnonzero(charts.frozen(v, TELEMETRY["alt"], charts.ChartParams())).tolist() == list(range(51, 80))
    coarse = np.repeat([1.0, 2.0, 3.0, 2.5] * 10, 8)
    assert not charts.frozen(coarse, TELEMETRY["alt"], charts.ChartParams()).any()
    rest = np.array([0.0] * 60 + [50.0, 3.0] + [100.0] * 60 + [44.0] * 30)
    assert np.flatnonzero(charts.frozen(rest, GPU["util_pct"], charts.ChartParams())).tolist() == list(range(123, 152))


def test_a_load_that_always_jumps_has_no_spikes():
    rng = np.random.default_rng(1)
    v = np.concatenate([np.full(k, x) + rng.normal(0, 2, k) for k, x in zip(rng.integers(4, 14, 30), rng.choice([10.0, 50.0, 90.0], 30))])
    t = np.arange(len(v)) * 0.5
    assert not charts.spikes(t, v, GPU["util_pct"], charts.ChartParams()).any()


@pytest.mark.parametrize("rows_per_block", [120, 50_000])
def test_flagged_readings_with_repeats_nulls_and_clashing_names(spark, rows_per_block):
    t, v = flight(600)
    v[100], v[300] = 32767.0, v[300] + 50
    rows = [(7, i, float(a), float(b), "x", 1) for i, (a, b) in enumerate(zip(t, v))]
    rows += [rows[100], rows[300], (7, 9999, None, 5.0, "x", 1), (7, 9998, 3.0, None, "x", 1), (None, 9997, 1.0, 99999.0, "x", 1)]
    df = table(spark, rows, "track_id long, sample_id long, t double, alt double, field_name string, _block int").drop("_block")
    got = flag_readings(df, ["track_id"], "t", "sample_id", {"alt": TELEMETRY["alt"]}, rows_per_block=rows_per_block).collect()
    assert sorted((r["row_id"], r["impossible"], r["spike"]) for r in got) == [(100, True, False), (300, False, True), (9997, True, False)]
    assert flag_readings(df.limit(0), ["track_id"], "t", "sample_id", {"alt": TELEMETRY["alt"]}).count() == 0


def test_where_a_source_is_cut_makes_no_difference(spark):
    rng = np.random.default_rng(5)
    n = 12_000
    t = np.cumsum(rng.uniform(0.15, 0.35, n) + 700 * (rng.random(n) < 0.0005))
    noise = np.where(np.arange(n) < n // 2, 0.2, 3.0)  # quiet first, then not
    v = 80 + 10 * np.sin(t / 20) + np.round(rng.normal(0, 1, n) * noise, 2)
    at = rng.choice(n, 80, replace=False)
    v[at] += rng.choice([-1, 1], 80) * rng.uniform(15, 90, 80)
    v[3000:3080], v[9000:9400], v[50], v[11_990] = v[3000], v[9000], 1e6, -4e4
    load = np.repeat(rng.choice([10.0, 60.0, 95.0], n // 50), 50) + rng.normal(0, 1, n)
    gone = rng.random(n) < 0.3
    gone[5000:6500] = True
    rows = [(k, i + 100_000 * k, float(t[i]), float(v[i]), None if gone[i] else float(load[i] if k else v[i])) for k in (0, 1) for i in range(n)]
    rows += rows[100:200]
    df = table(spark, rows, "s long, id long, t double, a double, b double").cache()
    fields = {"a": TELEMETRY["alt"], "b": GPU["util_pct"]}
    marks = {}
    for size in (120, 2_000, 50_000):
        marks[size] = {tuple(r)[1:] for r in flag_readings(df, ["s"], "t", "id", fields, rows_per_block=size).collect()}
    assert marks[120] == marks[2_000] == marks[50_000]
    assert sum(m[1] < 100_000 and m[0] == "a" and m[5] for m in marks[120]) > 20 and sum(m[6] for m in marks[120]) > 400


# ------------------------------------------------------------------- clocks


def moments(spark, marks, tracks):
    m = table(spark, marks, "mark_id long, track_id long, source_index int, t_text string")
    k = table(spark, tracks, "track_id long, kind string, site_tz string, started_ms long")
    stated = clocks.statements(m.join(k, "track_id"), "t_text", "kind", "site_tz", "started_ms")
    return {r["mark_id"]: r["epoch_ms"] for r in clocks.resolve(stated, "mark_id", "track_id", "source_index", "site_tz", "started_ms").collect()}


def ms(*a):
    return int(dt.datetime(*a, tzinfo=dt.timezone.utc).timestamp() * 1000)


def test_clock_notations(spark):
    start = ms(2024, 5, 1, 8, 0, 0)
    tracks = [(1, "csv", "Europe/Berlin", start), (2, "csv", "America/Denver", start), (3, "srt", None, start), (4, "mavlink", None, start), (5, "gpx", None, start)]
    cases = [
        (1, "2024-05-01T10:00:01.25", ms(2024, 5, 1, 8, 0, 1) + 250),
        (1, "  01.05.2024 10:00:02 ", ms(2024, 5, 1, 8, 0, 2)),
        (1, "03/05/2024 10:00:03", ms(2024, 5, 3, 8, 0, 3)),
        (2, "05/03/2024 2:00:03.5 PM", ms(2024, 5, 3, 20, 0, 3) + 500),
        (2, "05/03/2024 12:00:00 AM", ms(2024, 5, 3, 6, 0, 0)),
        (2, "2024-05-03 10:00:00 MDT", ms(2024, 5, 3, 16, 0, 0)),
        (1, "Fri, 03 May 2024 10:00:03 +0530", ms(2024, 5, 3, 4, 30, 3)),
        (1, "20240503T100003.5Z", ms(2024, 5, 3, 10, 0, 3) + 500),
        (1, "1714721003", 1714721003000),
        (1, "1.714721003500E+09", 1714721003500),
        (1, "1714721003500123", 1714721003500),
        (3, "00:01:02,5 --> 00:01:03,5", start + 62_500),
        (3, "00:01:02.05", start + 62_050),
        (4, " 1500 ", start + 1500),
        (5, "2024-05-01T10:00:00Z", ms(2024, 5, 1, 10, 0, 0)),
        (1, "1900-01-01 12:00:00", ms(1900, 1, 1, 11)), (1, "2300-07-01 12:00:00", ms(2300, 7, 1, 10)), (5, "0001-01-01 00:00:00", -62135596800000), (5, "9999-12-31 23:59:59", ms(9999, 12, 31, 23, 59, 59)),
        *[(1, x, None) for x in ("2024-02-30 10:00:00", "2024-13-01T00:00:00Z", "0000-00-00 00:00:00", "99:99:99", "", "no fix", None, "T+?", "2024-03-31 02:30:00", "2024-05-01 24:00:00")],
        (3, "00:61:00,0", None),
        (4, "12:00", None),
    ]
    got = moments(spark, [(i, k, i, text) for i, (k, text, _) in enumerate(cases)], tracks)
    assert {i: got.get(i) for i in range(len(cases))} == {i: want for i, (_, _, want) in enumerate(cases)}


def test_an_hour_that_comes_twice_is_told_by_the_marks_around(spark):
    true = [ms(2024, 10, 26, 23, 50), ms(2024, 10, 27, 0, 20), ms(2024, 10, 27, 0, 50), ms(2024, 10, 27, 1, 10), ms(2024, 10, 27, 1, 40), ms(2024, 10, 27, 2, 20)]
    local = ["2024-10-27 01:50:00", "2024-10-27 02:20:00", "2024-10-27 02:50:00", "2024-10-27 02:10:00", "2024-10-27 02:40:00", "2024-10-27 03:20:00"]
    late = ["2024-10-27 02:15:00", "2024-10-27 02:45:00", "2024-10-27 03:10:00"]
    first = ["2024-10-27 02:05:00", "2024-10-27 02:25:00"]
    marks = [(i, 1, i * 3, x) for i, x in enumerate(local)] + [(10 + i, 2, i, x) for i, x in enumerate(late)] + [(20 + i, 3, i, x) for i, x in enumerate(first)] + [(30, 4, 0, "2024-10-27 02:05:00")]
    marks += marks[:3]
    got = moments(spark, marks, [(1, "csv", "Europe/Berlin", true[0]), (2, "csv", "Europe/Berlin", ms(2024, 10, 27, 1, 0)), (3, "csv", "Europe/Berlin", ms(2024, 10, 27, 0, 0)), (4, "csv", "Europe/Berlin", ms(2024, 10, 27, 0, 30))])
    assert [got[i] for i in range(6)] == true
    assert [got[i] for i in (10, 11, 12)] == [ms(2024, 10, 27, 1, 15), ms(2024, 10, 27, 1, 45), ms(2024, 10, 27, 2, 10)]
    assert [got[i] for i in (20, 21)] == [ms(2024, 10, 27, 0, 5), ms(2024, 10, 27, 0, 25)]
    assert got[30] == ms(2024, 10, 27, 1, 5)


# -------------------------------------------------------------------- drift


def test_quantities_under_other_names():
    for name in ("yaw", "Yaw", "heading", "hdg", "yaw_deg", "attitude.yaw"):
        assert drift.quantity(name) == "yaw"
    for name in ("gimbalPitch", "gb_pitch", "gimbal.pitch", "cam_pitch", "gimbal_pitch_deg"):
        assert drift.quantity(name) == "gimbal_pitch"
    for name in ("kind", "source_kind", "trackKind", "format"):
        assert drift.quantity(name) == "kind"
    for name, q in {"true_heading": "yaw", "psi": "yaw", "yaw_rad": "yaw", "orientation.yaw": "yaw", "gimbal.vertical_angle": "gimbal_pitch", "gimbal_pitch_angle": "gimbal_pitch", "position.geo.lat": "lat", "src_idx": "source_index"}.items():
        assert drift.quantity(name) == q
    for name in ("battery_pct", "wind_ms", "sats", "pitch", "gimbal_yaw"):
        assert drift.quantity(name) == name


def test_changes_between_files(spark):
    files = table(spark, [(1, 1, dt.datetime(2024, 1, 1)), (2, 1, dt.datetime(2024, 1, 5)), (3, 1, dt.datetime(2024, 3, 1)), (4, 1, dt.datetime(2024, 3, 1)), (5, 2, dt.datetime(2024, 1, 1)), (6, 1, dt.datetime(2024, 4, 1))], "file_id long, feed_id long, recorded_at timestamp")
    lines = [
        (1, 0, '{"t": 1, "yaw": 3, "x": null}'), (2, 0, '{"t": 1.5, "attitude": {"yaw": "3"}}'), (2, 0, '{"t": 1.5, "attitude": {"yaw": "3"}}'), (2, 1, "not json"), (2, 2, None),
        (3, 0, '{"t": 1, "attitude": {"yaw": null}, "x": 1}'), (4, 0, '{"t": "1", "attitude": {"yaw": 1}, "x": 2}'), (5, 0, '{"q": 1}'),
    ]
    table_ = table(spark, lines, "file_id long, line_no int, line string")
    version = drift.versions(files, drift.file_schemas(table_, "file_id", "line"))
    got = {(r["file_id"], r["field_name"], r["change_kind"]) for r in drift.changes(version).collect()}
    assert got == {(2, "yaw", "renamed"), (2, "yaw", "retyped"), (2, "x", "removed"), (3, "x", "added"), (4, "t", "retyped"), *[(6, q, "removed") for q in ("t", "yaw", "x")]}
    rows = {(r["file_id"], r["line_no"]): r for r in drift.unified(table_, version).collect()}
    assert len(rows) == 5 and rows[(2, 0)]["yaw"] == 3.0 and rows[(4, 0)]["t"] == 1.0 and rows[(1, 0)]["kind"] is None


def test_names_that_only_their_values_tell(spark):
    """chi goes on where yaw ends, and back; battery and fuel only change places with nothing like them."""
    files = table(spark, [(i, 1, dt.datetime(2024, 1, i)) for i in range(1, 7)], "file_id long, feed_id long, recorded_at timestamp")
    record = lambda i, k: {"t": float(k), "chi" if i in (3, 4) else "yaw": 100.5 + k, **({"alt": 50.25 + k} if i < 5 else {}), "load" if i % 2 else "rpm": 3000 + 7 * k if i % 2 else 51.5}
    lines = [(i, k, json.dumps(record(i, k))) for i in range(1, 7) for k in range(12)]
    table_ = table(spark, lines, "file_id long, line_no int, line string")
    version = drift.versions(files, drift.file_schemas(table_, "file_id", "line"))
    got = {(r["file_id"], r["field_name"], r["change_kind"]) for r in drift.changes(version).collect()}
    swaps = {(i, q, kind) for i in range(2, 7) for q, kind in ((("rpm", "added"), ("load", "removed")) if i % 2 == 0 else (("load", "added"), ("rpm", "removed")))}
    assert got == swaps | {(3, "yaw", "renamed"), (5, "yaw", "renamed"), (5, "alt", "removed")}
    assert {r["yaw"] for r in drift.unified(table_, version).where("file_id = 3").collect()} == {100.5 + k for k in range(12)}


def test_steps_are_what_a_record_goes_through():
    steps = drift.migration([("yaw", "yaw_rad", ("string",)), ("kind", "kind", ("number",)), ("source_index", "src_idx", ("number",))])
    row, rest = drift.migrate({"yaw_rad": "1.5", "kind": 1, "src_idx": 4.0, "z": 1}, steps)
    assert row["yaw"] == pytest.approx(1.5 * 180 / math.pi) and row["kind"] == "csv" and row["source_index"] == 4 and rest == {"z": 1} and row["lat"] is None
    bare, _ = drift.migrate({"yaw_rad": "1.5", "kind": 1, "src_idx": 4.0, "z": 1}, [s for s in steps if s["op"] != "cast"])
    assert bare["kind"] is None and bare["source_index"] is None


def test_values_of_other_types():
    assert [drift.to_number(x) for x in ("-89.6 deg", [3.5], "12°", True, None, "x", [1, 2], "1e400", float("inf"))] == [-89.6, 3.5, 12.0, None, None, None, None, None, None]
    assert [drift.to_kind(x) for x in (0, 4, ["csv"], " SRT ", 9, None)] == ["srt", "json", "csv", "srt", None, None]


# ------------------------------------------------------------------- rejects


def read(lines, header):
    places, reasons, _ = rejects.read_lines(lines, [header] * len(lines))
    return {lines[p][0]: r for p, r in zip(places, reasons)}


def test_open_quotes_take_no_longer_than_sound_lines():
    began = time.time()
    got = read([(i + 1, f'{i},2,10,20,"open {i}') for i in range(4000)], "source_index,t,lat,lon,notes")
    assert set(got.values()) == {"quoting"} and len(got) == 4000 and time.time() - began < 1.5


def test_the_reject_table_names_the_reasons(monkeypatch):
    asked = []
    monkeypatch.setattr(rejects, "exact", lambda line, d, names: asked.append(line) or (None, {}))
    lines = ["1,2,3,4,ok", '1,2,3,4,"op,en', '1,2,3,4,"a" b', "1,2,3,4", "1,2,3,4,5,6", 'a"b,2,3,4,"open']
    assert list(read(list(enumerate(lines, 1)), "source_index,t,lat,lon,notes").values()) == [None, "quoting", "quoting", "column_count", "column_count", "quoting"]
    assert not asked


def test_first_reason_against_a_line():
    names = ["source_index", "t", "lat", "lon", "alt", "notes"]
    cases = {
        "1,2.5,10,20,30,ok": None, '"1",2.5, +10 ,2e1,,"a ""b"", c"': None, "0007,1e-3,10,20,,": None, "4e1,1,10,20,,": None,
        '1,2,10,20,30,"open': "quoting", '1,2,10,20,30,"a" b': "quoting", '"1,2,10,20,30,ok': "quoting", "1,2,10,20,30": "column_count", "1,2,10,20,30,a,b": "column_count", "1,2,10,20,30,ok,": "column_count",
        "-1,2,10,20,30,": "bad_value", "1.5,2,10,20,30,": "bad_value", ",2,10,20,30,": "bad_value", "1,nan,10,20,30,": "bad_value", "1,2,91,20,30,": "bad_value", "1,2,10,-180.5,30,": "bad_value", "1,2,10,20,x,": "bad_value", "1,2,10,20,inf,": "bad_value", "1,2,1_0,20,3,": "bad_value", "1,0x1F,10,20,3,": "bad_value",
    }
    assert {line: rejects.exact(line, ",", names)[0] for line in cases} == cases
    data = [(i + 1, line) for i, line in enumerate(cases)]
    assert read(data, ",".join(names)) == {n: w for (n, _), w in zip(data, cases.values())}


@pytest.mark.parametrize("delimiter", [",", ";", "\t", "|"])
def test_reader_agrees_with_the_exact_check_on_broken_files(delimiter):
    rng = random.Random(delimiter)
    names = ["notes", "t", "source_index", "lat", "lon"]
    lines = []
    for i in range(400):
        fields = [rng.choice(["", "calm", f'"a{delimiter} b"', '"say ""x"""', '"open', 'x"y', '"a" b']), f"{i / 3:.3f}", str(i), "10.5", rng.choice(["20", " 20 ", "200", "", "2,0"])]
        line = delimiter.join(fields)
        lines.append((i + 2, rng.choice([line, line, line, line + delimiter, line[: len(line) // 2], "", "# c", '"'])))
    got = read(lines, delimiter.join(names))
    want = {n: rejects.exact(s, delimiter, names)[0] for n, s in lines if s.strip() and not s.startswith("#")}
    assert got == want


def test_csv_files_with_nulls_headers_and_marks(spark):
    lines = [
        (1, 0, "# made by hand"), (1, 1, "﻿LAT;lon;T;Source_Index;extra;NOTES".replace("﻿", "")), (1, 2, "1;2;3;4;z;n"), (1, 2, "1;2;3;4;z;n"), (1, 3, None), (1, 4, "LAT;lon;T;Source_Index;extra;NOTES"), (1, 5, "1;2;3"),
        (2, 0, "﻿source_index,t,lat,lon,alt,yaw,gimbal_pitch,notes"), (2, 1, "1,2,3,4,,,,\r"), (3, 0, "1,2,3,4,5,6,7,no header"), (4, 0, ""),
    ]
    df = table(spark, [(*r, "clash", 1) for r in lines], "file_id long, line_no int, line string, reason string, piece int")
    got = sorted((r["file_id"], r["line_no"], r["reason"], r["lat"]) for r in rejects.read_csv_lines(df).collect())
    assert got == [(1, 2, None, 1.0), (1, 5, "column_count", None), (2, 1, None, 3.0), (3, 0, None, 3.0)]
    assert rejects.read_csv_lines(df.limit(0)).count() == 0
