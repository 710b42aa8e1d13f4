"""Queries read their whole input: against their SQL, brute force and hand-made tables."""

import json
from collections import Counter

import numpy as np
import pytest

import parity
from terrawing.operators import align, views
from terrawing.plans import survey

FOLDER = str(parity.DATA / "sf0.001")


@pytest.mark.parametrize("per_file", [5000, 7])
@pytest.mark.parametrize("name", ["parse_srt", "parse_csv", "parse_gpx", "parse_kml", "parse_json"])
def test_parsers_read_whole_tracks(spark, monkeypatch, name, per_file):
    monkeypatch.setattr(survey, "_PER_FILE", per_file)
    ours, theirs = parity.differences(spark, survey.QUERIES[name], survey.SQL[name], FOLDER)
    assert not ours and not theirs, (list(ours)[:3], list(theirs)[:3])


def test_lines_hold_every_sample(spark, tmp_path):
    con = parity.connection(FOLDER)
    con.execute(f"copy (select * replace (9 as track_id, row_number() over () - 1 as source_index) from telemetry limit 900) to '{tmp_path}/telemetry.parquet' (format parquet)")
    (row,) = survey.QUERIES["trajectory_geojson"](spark, str(tmp_path)).collect()
    assert len(json.loads(row["geojson"])["geometry"]["coordinates"]) == 900


def test_pose_graph_uses_every_pair(spark):
    """The same as the dense solver fed with all pairs of all chunks."""
    rows = sorted((r["chunk_idx"], r["vec_id"], *(r[c] for c in ("sx", "sy", "sz", "dx", "dy", "dz"))) for r in survey.pairs(spark, FOLDER).collect())
    fits = sorted(tuple(r[c] for c in ("chunk_idx", "scale", "yaw", "tx", "ty", "tz")) for r in align.fit_4dof(survey.pairs(spark, FOLDER)).collect())
    by = [np.array([r[2:] for r in rows if r[0] == f[0]]) for f in fits]
    assert min(map(len, by)) > 10
    places = [(i, q[:3], q[3:], 1.0) for i, m in enumerate(by) for q in m]
    n = [min(len(a), len(b)) for a, b in zip(by, by[1:])]
    links = [(i, i + 1, by[i][:k, :3], by[i + 1][:k, :3]) for i, k in enumerate(n)]
    want = align.refine_graph(np.array([[np.log(f[1]), *f[2:]] for f in fits]), links, places)
    got = np.array([tuple(r) for r in survey.QUERIES["pose_graph"](spark, FOLDER).orderBy("chunk_idx").collect()])
    assert got[:, 0].tolist() == [f[0] for f in fits] and np.allclose(got[:, 1:], want, atol=1e-3)


def test_too_many_chunks_are_an_error(spark):
    with pytest.raises(ValueError):
        align.refine_factors(np.zeros((align.MOST_CHUNKS + 1, 5)), None)


def _hits():
    """Brute force: the nearest point of each pixel of each camera."""
    p = parity.connection(FOLDER).execute("select l_quantity::double, l_extendedprice::double / 1000, l_discount::double * 100, l_returnflag = 'R', l_orderkey * 10 + l_linenumber from lineitem").fetchall()
    best = {}
    for c, cx, cy, cz in survey._CAMERAS:
        for x, y, z, masked, k in p:
            depth = cz - z
            u, v = 500 * (x - cx) / depth + 320, -500 * (y - cy) / depth + 240
            pixel = (c, round(round(v, 9)), round(round(u, 9)))
            if depth > 0 and 0 <= u < 640 and 0 <= v < 480 and pixel[1] < 480 and pixel[2] < 640 and (pixel not in best or (depth, k) < best[pixel][0]):
                best[pixel] = ((depth, k), (x, y, z), masked, (u, v))
    return best


def test_views_hold_every_pixel_hit(spark):
    best = _hits()
    got = {(r["camera_id"], r["row"], r["col"]): (r["x"], r["y"], r["z"]) for r in survey._geometry(spark, FOLDER).collect()}
    assert len(got) > 1000 and set(got) == set(best)
    assert all(np.allclose(got[k], best[k][1]) for k in got)
    warp = {r["camera_id"]: r["median_px"] for r in survey.QUERIES["self_warp"](spark, FOLDER).collect()}
    for c in warp:
        assert warp[c] == pytest.approx(np.median([np.hypot(b[3][0] - k[2], b[3][1] - k[1]) for k, b in best.items() if k[0] == c]))


def test_neighbouring_views_meet_as_by_brute_force(spark):
    best, want, total = _hits(), {}, {}
    project = lambda c, p: (500 * (p[0] - survey._CAMERAS[c][1]) / (60 - p[2]) + 320, -500 * (p[1] - 8) / (60 - p[2]) + 240)
    for a, b, chunk in ((0, 1, "same"), (1, 2, "same"), (2, 3, "cross")):
        for (c, row, col), (_, p, masked, _) in best.items():
            if c != a:
                continue
            u, v = project(b, p)
            other = best.get((b, round(round(v, 9)), round(round(u, 9))))
            if other and np.hypot(project(a, other[1])[0] - col, project(a, other[1])[1] - row) <= 2.0:
                for bucket in [f"{chunk}_all"] + [f"{chunk}_land", "land"] * (not masked and not other[2]):
                    want[a, bucket] = want.get((a, bucket), 0) + 1
                    total[bucket] = total.get(bucket, 0) + 1
    g = survey._geometry(spark, FOLDER)
    for a, same in ((0, True), (1, True), (2, False)):
        near = spark.createDataFrame([(a, a + 1, same)], "a int, b int, same_chunk boolean")
        got = {(a, r["bucket"]): r["n"] for r in views.cross_view(g, survey.cameras(spark), near).collect()}
        assert got == {k: n for k, n in want.items() if k[0] == a} and got
    assert {r["bucket"]: r["n"] for r in survey.QUERIES["cross_view_consistency"](spark, FOLDER).collect()} == total


def test_every_event_has_a_label(spark, tmp_path):
    parity.connection(FOLDER).execute(f"copy (select i::bigint as event_id, (i * 10 + 4.2)::double as value from range(14) t(i)) to '{tmp_path}/events.parquet' (format parquet)")
    got = {r["event_id"]: r["label"] for r in survey.QUERIES["rate_labels"](spark, str(tmp_path)).collect()}
    want = {i: f"{i % 7}/7 chunks, {i % 7 / (i * 10 + 5.2) * 60:.1f}/min" + (f", ETA {(7 - i % 7) * (i * 10 + 5.2) / (i % 7):.0f}s" if i % 7 else "") for i in range(14)}
    assert got == want and got[0] == "0/7 chunks, 0.0/min" and got[3] == "3/7 chunks, 5.1/min, ETA 47s" and len({x[0] for x in got.values()}) == 7


def test_components_of_all_orders_against_union_find(spark):
    keys = [r[0] for r in parity.connection(FOLDER).execute("select distinct o_custkey from orders").fetchall()]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a in keys:
        k = 1 << (max(a, 1).bit_length() - 1)
        x, y = sorted((find(a), find(k + (a - k) // 2)))
        root[y] = x
    sizes = Counter(find(x) for x in root)
    want = {(x, find(x)) for x in root if sizes[find(x)] >= max(50, 0.005 * len(root))}
    got = [(r["node"], r["component"]) for r in survey.QUERIES["component_filter"](spark, FOLDER).collect()]
    assert len(got) == len(set(got)) and set(got) == want and 0 < len(want) < len(root)


@pytest.mark.parametrize("name", ["parse_srt", "parse_csv", "parse_gpx", "parse_kml", "parse_json", "rate_labels", "match_telemetry"])
def test_sql_has_no_row_filter(name):
    assert "source_index <" not in survey.SQL[name] and "where event_id" not in survey.SQL[name] and "where track_id" not in survey.SQL[name]
