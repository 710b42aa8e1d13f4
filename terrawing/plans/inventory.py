"""Queries of the operators beside the survey's main path: selection, inputs, writers as readers see them, small rules, streams."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrawing.functions import camera, scoring
from terrawing.operators import align, keyframes, masks, raster, report, scorecard, views
from terrawing.plans import survey as s
from terrawing.runtime import checkpoint_folder, cut, table
from terrawing.sources import files, sinks, telemetry
from terrawing.streaming import bus

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


# -------------------------------------------------------------------- selection


@query(f"""
    with recursive {s._CANDS},
    q as (select track_id, quantile_cont(sharpness, 0.15) as floor, count(*) as total from cands group by track_id),
    c as (select cands.*, floor, total, e is not null and n is not null and u is not null as placed, sharpness >= floor as sharp from cands join q using (track_id)),
    p as (select track_id, frame_index, e, n, u, row_number() over (partition by track_id order by frame_index) as k from c where sharp and placed),
    g as (select track_id, k, frame_index, e, n, u, true as kept from p where k = 1
          union all
          select p.track_id, p.k, p.frame_index, case when far then p.e else g.e end, case when far then p.n else g.n end, case when far then p.u else g.u end, far
          from g join p on p.track_id = g.track_id and p.k = g.k + 1, lateral (select (p.e - g.e) ** 2 + (p.n - g.n) ** 2 + (p.u - g.u) ** 2 >= 4 as far) l),
    b as (select track_id, frame_index, total <= 5 or row_number() over (partition by track_id order by frame_index) % 5 = 1 as kept from c where sharp and not placed)
    select track_id, frame_index, false as accepted, 'sharpness' as reason from c where not sharp
    union all select track_id, frame_index, kept, case when not kept then 'GPS' end from g
    union all select track_id, frame_index, kept, case when not kept then 'frame-stride' end from b""")
def keyframe_select(spark: SparkSession, d: str) -> DataFrame:
    """The selection as one operator; of a reason its first word."""
    got = keyframes.select(s.cands(spark, d))
    return got.select("track_id", "frame_index", "accepted", F.substring_index("reject_reason", " ", 1).alias("reason"))


@query(f"""
    with {s._CANDS}, n as (select track_id, frame_index as a, lead(frame_index) over (partition by track_id order by frame_index) as b from cands)
    select track_id, a, b from n where b is not null""")
def adjacent_frames(spark: SparkSession, d: str) -> DataFrame:
    return views.adjacent(s.cands(spark, d))


@query("""
    select track_id, frame_index, '{"frame_index":' || frame_index || ',"file":"' || printf('frame_%06d.jpg', frame_index) || '"}' as entry
    from (select distinct track_id, frame_index from candidates where accepted)""")
def keyframe_manifest(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "candidates").where("accepted").select("track_id", "frame_index", F.lit(None).cast("double").alias("timestamp_s")).distinct()
    return sinks.manifest(c)


# --------------------------------------------------------------------- writers


@query("""
    select l_quantity::float::double as x, (l_extendedprice / 1000)::float::double as y, (l_discount * 100)::float::double as z,
           l_partkey % 256 as red, l_suppkey % 256 as green, l_linenumber * 30 as blue, (1 - 10 * l_tax)::float::double as confidence, least(l_orderkey, 65535) as view_count
    from lineitem""")
def ply_records(spark: SparkSession, d: str) -> DataFrame:
    """What a reader of the PLY file sees of every point."""
    p = s.points(spark, d).withColumns({"confidence": F.col("conf"), "view_count": F.floor(F.col("point_id") / 10)})
    got = sinks.unpacked(sinks.ply_points(p), sinks.PLY_POINT)
    return got.select("x", "y", "z", "red", "green", "blue", "confidence", "view_count")


@query("""
    select cast(l_quantity as bigint) * 1000 as x_mm, cast(round(l_extendedprice * 100) as bigint) * 10 as y_mm, l_partkey % 256 * 257 as red, l_suppkey % 256 * 257 as green, l_linenumber * 30 * 257 as blue,
           least(l_orderkey, 65535) as view_count
    from lineitem""")
def las_records(spark: SparkSession, d: str) -> DataFrame:
    """What a reader of the LAS file sees of every point, in millimetres."""
    p = s.points(spark, d).withColumns({"y": F.col("y") * 1000, "confidence": F.col("conf"), "view_count": F.floor(F.col("point_id") / 10)})
    offset, _, _ = sinks.las_offset(p)
    got = sinks.unpacked(sinks.las_points(p, offset), sinks.LAS_POINT)
    mm = lambda c, o: (F.col(c) + int(o * 1000)).alias(f"{c.lower()}_mm")
    return got.select(mm("X", offset[0]), mm("Y", offset[1]), "red", "green", "blue", "view_count")


_FACES = "faces as (select vec_id as face_id, vec_id as a, vec_id + 1 as b, vec_id + 2 as c from cloud where vec_id % 3 = 0)"


def _mesh(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The cloud as vertices, and a face for every third of them with the two after it."""
    v = s.cloud(spark, d).select(F.col("vec_id").alias("vertex_id"), "x", "y", "z", F.lit(1.0).alias("r"), F.lit(0.5).alias("g"), F.lit(0.0).alias("b"))
    i = F.col("vertex_id")
    return v, v.where("vertex_id % 3 = 0").select(i.alias("face_id"), i.alias("a"), (i + 1).alias("b"), (i + 2).alias("c"))


_INDEXED = f"""with {s._CLOUD}, {_FACES}, n as (select vec_id, x, y, z, row_number() over (order by vec_id) - 1 as k from cloud),
    t as (select face_id, a.k as a, b.k as b, c.k as c from faces join n a on a.vec_id = faces.a join n b on b.vec_id = faces.b join n c on c.vec_id = faces.c)"""


@query(f"""{_INDEXED}
    select 'v' as kind, k + 1 as id, printf('v %.6f %.6f %.6f %.6f %.6f %.6f', x, y, z, 1e0, 0.5e0, 0e0) as line from n
    union all select 'f', face_id, printf('f %d %d %d', a + 1, b + 1, c + 1) from t""")
def obj_mesh(spark: SparkSession, d: str) -> DataFrame:
    return sinks.obj_lines(*_mesh(spark, d))


@query(f"""{_INDEXED}
    select 'v' as kind, k + 1 as id, printf('v %.6f %.6f %.6f', x, y, z) as line from n
    union all select 'vt', 3 * i + j + 1, printf('vt %.6f %.6f', j / 4e0, 1 - 0.25e0) from (select row_number() over (order by face_id) - 1 as i from t), range(3) r(j)
    union all select 'f', i + 1, printf('f %d/%d %d/%d %d/%d', a + 1, 3 * i + 1, b + 1, 3 * i + 2, c + 1, 3 * i + 3) from (select *, row_number() over (order by face_id) - 1 as i from t)""")
def obj_textured(spark: SparkSession, d: str) -> DataFrame:
    v, f = _mesh(spark, d)
    corners = f.select("face_id", F.explode(F.array(*[F.lit(i) for i in range(3)])).alias("corner")).select("face_id", "corner", (F.col("corner") / 4.0).alias("u"), F.lit(0.25).alias("v"))
    return sinks.obj_lines(v, f, corners)


@query(f"""{_INDEXED} select face_id, a, b, c from t""")
def mesh_face_indices(spark: SparkSession, d: str) -> DataFrame:
    """Corners of the faces as the places that binary meshes (PLY, GLB) store."""
    _, f = sinks.indexed(*_mesh(spark, d))
    return f.select("face_id", *[F.col(f"k{c}").cast("bigint").alias(c) for c in "abc"])


@query(f"""with {s._POINTS}, {s._BOX.format('points')}, c as (select row, col, max(z) as h, count(*) as n from (select {s._CELL}, * from points, box) group by row, col)
    select row, col, h::float::double as height_m, n::double as n from c""")
def geotiff_cells(spark: SparkSession, d: str) -> DataFrame:
    """The cells that a reader of the raster's strips sees."""
    cells = raster.rasterise(s.points(spark, d), 1.0, {"height_m": F.max("z")})
    size = cells.agg(F.max("width"), F.max("height")).first()
    width, height, rows = int(size[0] or 1), int(size[1] or 1), 64

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for strip, payload in zip(batch.column("strip").to_pylist(), batch.column("payload").to_pylist()):
                bands = np.frombuffer(payload, "<f4").reshape(2, -1, width)
                r, c = np.nonzero(~np.isnan(bands[1]))
                yield pa.RecordBatch.from_pydict({"row": pa.array(r + strip * rows, pa.int64()), "col": pa.array(c, pa.int64()), "height_m": pa.array(bands[0][r, c].astype(float)), "n": pa.array(bands[1][r, c].astype(float))})

    return sinks.strips(cells, ["height_m", "n"], width, height, rows).mapInArrow(read, "row long, col long, height_m double, n double")


# ----------------------------------------------------------------------- inputs


@query()
def file_listing(spark: SparkSession, d: str) -> DataFrame:
    """The tables' own files: name and whether they hold bytes."""
    return files.listing(spark, d).select(F.regexp_extract("path", r"([^/]*)$", 1).alias("name"), (F.col("length") > 0).alias("filled"))


@query("""
    with t as (select track_id, '/in/d' || track_id % 40 as dir, '/in/d' || track_id % 40 || '/v' || track_id as stem, case kind when 'mavlink' then 'tlog' when 'embedded' then 'SRT' else kind end as e from tracks),
    v as (select stem || '.MP4' as path, dir, stem, (track_id % 97) * 1e0 as duration_s from t where track_id % 5 <> 0),
    f as (select stem || '.' || e as path, dir, stem, e from t where track_id % 2 = 0),
    c as (select v.path, f.path as tp, case when f.stem = v.stem then 0 when lower(f.e) = 'srt' then 1 else 2 end as p from v join f on f.stem = v.stem or f.dir = v.dir),
    b as (select path, arg_min(tp, (p, tp)) as tp from c group by path)
    select v.path, duration_s, row_number() over (order by duration_s desc, v.path) - 1 as rank, tp as telemetry_path,
           case lower(regexp_extract(tp, '\\.([^./]+)$', 1)) when 'tlog' then 'mavlink' else lower(regexp_extract(tp, '\\.([^./]+)$', 1)) end as kind
    from v left join b using (path)""")
def run_inputs(spark: SparkSession, d: str) -> DataFrame:
    """Videos, the longest first, with the telemetry that goes with each; files that can't be probed are no videos."""
    t = table(spark, d, "tracks")
    i, k = F.col("track_id"), F.col("kind")
    stem = F.concat(F.lit("/in/d"), (i % 40).cast("string"), F.lit("/v"), i.cast("string"))
    e = F.when(k == "mavlink", "tlog").when(k == "embedded", "SRT").otherwise(k)
    v = t.select(F.concat(stem, F.lit(".MP4")).alias("path"), i)
    kind = F.when(i % 5 == 0, "audio").otherwise("video")
    probe = F.to_json(F.struct(F.array(F.struct(kind.alias("codec_type"), F.lit("30/1").alias("r_frame_rate"))).alias("streams"), F.struct((i % 97).cast("string").alias("duration")).alias("format")))
    f = t.where(i % 2 == 0).select(F.concat(stem, F.lit("."), e).alias("path"))
    return files.detected(v.select("path").unionByName(f), v.select("path", probe.alias("probe_json")))


@query("""
    with r as (select distinct track_id, source_index, round(lat, 7) as lat, round(lon, 7) as lon, round(alt, 2) as alt from telemetry where abs(lat) <= 90 and abs(lon) <= 180),
    t as (select track_id, count(*) filter (source_index % 3 = 0) as n from r group by track_id)
    select track_id, case when track_id % 7 = 0 then 'tape' else 'csv' end as kind, case when track_id % 7 = 0 then 0 else n end as n_samples,
           track_id % 7 <> 0 and n > 0 as has_timestamps,
           case when track_id % 7 = 0 then 'no reader for kind tape' when n = 0 then 'no sample with a place in this csv file' end as note
    from t""")
def telemetry_tracks(spark: SparkSession, d: str) -> DataFrame:
    """Tracks written as text and read by kind: one of a kind that has no reader is empty and says so."""
    rows = s._track_rows(spark, d)
    line = F.when(F.col("source_index") % 3 == 0, F.concat_ws(",", F.format_string("%.7f", "lat"), F.format_string("%.7f", "lon"))).otherwise("")
    text = s._written(rows, line, "\n", "lat,lon\n").withColumn("track_id", F.shiftright("file", 32))
    text = text.withColumn("kind", F.when(F.col("track_id") % 7 == 0, "tape").otherwise("csv"))
    parts = telemetry.tracks(text, track="file").withColumn("track_id", F.shiftright("file", 32))
    whole = parts.groupBy("track_id", "kind").agg(F.sum("n_samples").alias("n_samples"), F.bool_or("has_timestamps").alias("has_timestamps"), F.max("note").alias("note"))
    return whole.withColumn("note", F.when(F.col("n_samples") == 0, F.col("note")))


@query("""
    with f as (select '/in/' || p_partkey || case p_partkey % 4 when 0 then '.json' when 1 then '.yaml' when 2 then '.json' else '.txt' end as path, p_partkey % 4 as k, p_size as n from part),
    g as (select path from f where k = 0 and n % 5 < 4 or k = 1)
    select path, path = (select min(path) from g) as first from g""")
def intrinsics_files(spark: SparkSession, d: str) -> DataFrame:
    """Files that speak of a camera's intrinsics: at depths 0 to 3 of an object they do, one deeper not."""
    k, n = F.col("p_partkey") % 4, F.col("p_size") % 5
    nested = F.when(n == 0, '{"fx": 1}').when(n == 1, '{"a": {"fx": 1}}').when(n == 2, '{"a": {"b": {"K": 1}}}').when(n == 3, '{"a": {"b": {"c": {"cy": 1}}}}').otherwise('{"a": {"b": {"c": {"d": {"fx": 1}}}}}')
    text = F.when(k == 0, nested).when(k == 1, "camera:\n  intrinsics: 1\n").when(k == 2, '{"note": "fx"}').otherwise('{"fx": 1}')
    e = F.when(k == 1, ".yaml").when(k == 3, ".txt").otherwise(".json")
    p = table(spark, d, "part").select(F.concat(F.lit("/in/"), F.col("p_partkey").cast("string"), e).alias("path"), text.alias("text"))
    return files.intrinsics_files(p).select("path", "first")


@query("""
    select '/in/' || case when o_orderkey % 4 = 0 then 'my_Cache_' else 'x_' end || o_orderkey as path from orders
    where o_orderkey % 4 = 0 or o_custkey % 3 < 2 group by 1""")
def cache_folders(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    name = F.concat(F.lit("/in/"), F.when(F.col("o_orderkey") % 4 == 0, "my_Cache_").otherwise("x_"), F.col("o_orderkey").cast("string"))
    child = F.when(F.col("o_custkey") % 3 == 0, "a.whl").when(F.col("o_custkey") % 3 == 1, "Checkpoints").otherwise("notes.txt")
    return files.cache_folders(o.select(name.alias("path"), F.array(child).alias("children"))).select("path").distinct()


@query("""
    select o_orderkey as model, o_custkey % 5 as k, case when o_custkey % 5 = 0 then 'timeout' when o_custkey % 5 < 3 then 'ok' else 'crash_no_status' end as state,
           case when o_custkey % 5 >= 3 then 'log of ' || o_orderkey end as tail from orders""")
def run_states(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_custkey") % 5
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("model"), k.alias("k"), (k == 0).alias("timed_out"), F.when(k < 3, '{"status": "ok"}').alias("status_json"), F.concat(F.lit("log of "), F.col("o_orderkey").cast("string")).alias("log"))
    return files.run_status(o).select("model", "k", "state", "tail")


# ------------------------------------------------------------------- small rules


@query(f"""with {s._POINTS}, {s._CAMERA_SQL}, {s._PROJ} select camera_id, point_id, round(x - px + 3e-10, 6) as cx, round(py - y + 3e-10, 6) as cy, round(pz - z + 3e-10, 6) as cz
    from proj where u >= 0 and u < 640 and v >= 0 and v < 480""")
def back_projection(spark: SparkSession, d: str) -> DataFrame:
    """Visible points from their pixels and depths back to the cameras' axes."""
    seen = views.visible(s.points(spark, d), s.cameras(spark)).withColumns({"f": F.lit(500.0), "u0": F.lit(320.0), "v0": F.lit(240.0)})
    back = camera.back_project(F.col("u"), F.col("v"), F.col("depth"), F.col("f"), F.col("f"), F.col("u0"), F.col("v0"))
    return s.off_tie(seen.select("camera_id", "point_id", *[c.alias(f"c{a}") for a, c in zip("xyz", back)]), 6, "cx", "cy", "cz")


@query("""
    with p as (select p_partkey, p_size * 10e0 as w, p_size * 5e0 as h, p_retailprice / 4 as f, (p_partkey % 90) * 6e0 as c from part)
    select p_partkey, round(f / 2, 6) as fx, round(f / 4, 6) as fy, c / 2 as cx, c / 8 as cy,
           c > 0 and c < w and c / 2 > 0 and c / 2 < h and f between 0.2 * greatest(w, h) and 5 * greatest(w, h) as plausible
    from p""")
def intrinsics_rules(spark: SparkSession, d: str) -> DataFrame:
    """Intrinsics rescaled to an image of half the width and a quarter of the height, and whether they were plausible."""
    p = table(spark, d, "part").select("p_partkey", (F.col("p_size") * 10.0).alias("w"), (F.col("p_size") * 5.0).alias("h"), (F.col("p_retailprice") / 4).alias("f"), (F.col("p_partkey") % 90 * 6.0).alias("c"))
    f, c = F.col("f"), F.col("c")
    fx, fy, cx, cy = camera.rescaled(f, f, c, c / 2, F.lit(0.5), F.lit(0.25))
    return p.select("p_partkey", F.round(fx, 6).alias("fx"), F.round(fy, 6).alias("fy"), cx.alias("cx"), cy.alias("cy"), camera.plausible(f, f, c, c / 2, F.col("w"), F.col("h")).alias("plausible"))


@query(f"""with {s._CLOUD} select vec_id, cast(greatest(0, least(255, round_even(x * 300, 0))) as int) as byte, cast(greatest(0, least(255, round_even(x * 300, 0))) as int) * 257 as word, x, -y as y, -z as z from cloud""")
def colours_and_axes(spark: SparkSession, d: str) -> DataFrame:
    """Colours clipped to 8 and 16 bits, and points between the two camera conventions."""
    x, y, z = scoring.flipped(F.col("x"), F.col("y"), F.col("z"))
    return s.cloud(spark, d).select("vec_id", scoring.colour_byte(F.col("x") * 300).alias("byte"), scoring.colour_16bit(F.col("x") * 300).alias("word"), x.alias("x"), y.alias("y"), z.alias("z"))


@query("""
    select o_orderkey, case when o_custkey % 3 = 0 then 'C' else ['A', 'B', 'C'][o_orderkey % 3 + 1] end as backbone,
           case when o_custkey % 3 = 0 then 'RGB' when o_orderkey % 2 = 0 then case when o_custkey % 5 = 0 then 'CP' else 'C' end else 'RGB' end as prior,
           case when o_custkey % 2 = 0 and o_custkey % 5 = 0 then 'pose_and_intrinsics' when o_custkey % 5 = 0 then 'intrinsics_only' else 'images_only' end as mode
    from orders""")
def prior_choice(spark: SparkSession, d: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    choice = F.array(*[F.lit(x) for x in "ABC"])[(k % 3).cast("int")]
    b, p = scoring.backbone(choice, F.when(k % 2 == 0, "AUTO").otherwise("RGB"), c % 3 != 0, c % 5 == 0)
    return table(spark, d, "orders").select("o_orderkey", b.alias("backbone"), p.alias("prior"), scoring.prior_mode(c % 2 == 0, c % 5 == 0).alias("mode"))


@query(f"""with {s._CLOUD}, {s._CAMERA_SQL}, p as (select *, 500e0 * (x - px) / (pz - z) + 320 as u, -500e0 * (y - py) / (pz - z) + 240 as v, pz - z as depth from cloud, cameras where pz - z > 0)
    select camera_id, vec_id, row_number() over (partition by camera_id order by depth desc, vec_id) - 1 as place from p where u >= 0 and u < 640 and v >= 0 and v < 480""")
def painters_order(spark: SparkSession, d: str) -> DataFrame:
    seen = views.visible(s.cloud(spark, d), s.cameras(spark))
    return views.painters_order(seen, ties="vec_id").select("camera_id", "vec_id", F.col("place").cast("bigint").alias("place"))


# ------------------------------------------------------------ models and reports


@query("""
    select l_orderkey * 8 + l_linenumber as point_id, l_quantity as x, l_suppkey % 40 as frame_index, (l_partkey % 640) / 640e0 as u_norm, (l_suppkey % 480) / 480e0 as v_norm
    from lineitem where l_suppkey % 3 <> 2""")
def sightings(spark: SparkSession, d: str) -> DataFrame:
    """Sparse points met with the training images that see them; test images don't count."""
    li, c = table(spark, d, "lineitem"), F.col
    point, image = c("l_orderkey") * 8 + c("l_linenumber"), c("l_suppkey")
    keypoint = F.monotonically_increasing_id()
    rows = li.select(point.alias("point_id"), c("l_quantity").alias("x"), F.lit(0.0).alias("y"), F.lit(1.0).alias("z"), image.alias("image_id"), (c("l_partkey") % 640).alias("u"), (image % 480).alias("v")).withColumn("keypoint", keypoint)
    rows = cut(spark, rows)
    ids = rows.select("image_id").distinct()
    name = F.concat(F.lit("i"), c("image_id").cast("string"))
    images = ids.select("image_id", name.alias("name"), F.lit(1).alias("camera_id"))
    names = ids.select(name.alias("name"), F.when(c("image_id") % 3 == 2, "heldout").otherwise("training").alias("kind"), (c("image_id") % 40).alias("frame_index"))
    cam = spark.createDataFrame([(1, 640, 480)], "camera_id int, width int, height int")
    got = align.correspondences(rows.select("point_id", "x", "y", "z", "image_id", "keypoint"), images, rows.select("image_id", "keypoint", "u", "v"), cam, names)
    return got.select("point_id", "x", "frame_index", "u_norm", "v_norm")


@query("""
    with a as (select vec_id as pos, case when label % 4 <> 0 then embedding[1]::double end as psnr from embeddings where vec_id % 5 <> 0), b as (select vec_id as pos, embedding[2]::double as psnr from embeddings where vec_id % 7 <> 0)
    select case when a.psnr >= b.psnr then 'first' else 'second' end as model, count(*) as n_wins from a full join b using (pos) where a.psnr is not null and b.psnr is not null group by 1""")
def paired_wins(spark: SparkSession, d: str) -> DataFrame:
    """Wins of two models whose result lists meet by position; what one of them lacks is nobody's."""
    e = table(spark, d, "embeddings")
    v = lambda i: F.col("embedding")[i].cast("double")
    a = e.where("vec_id % 5 != 0").select(F.col("vec_id").alias("pos"), F.when(F.col("label") % 4 != 0, v(0)).alias("psnr"))
    b = e.where("vec_id % 7 != 0").select(F.col("vec_id").alias("pos"), v(1).alias("psnr"))
    return scorecard.paired_wins(a, b, ("first", "second"))


_CLASSES = ("car", "Sky", "tree", "dog", "river", "chair")


@query(f"""
    with d as (select l_suppkey as frame_index, l_partkey as detection_id, {list(_CLASSES)}[l_partkey % 6 + 1] as class, l_linenumber as row, cast(l_quantity as int) % 10 as col, l_discount * 10 as share from lineitem),
    k as (select * from d where lower(class) in ('car', 'dog', 'sky', 'river')),
    p as (select frame_index, count(*) / 80 as masked_share from (select distinct frame_index, row, col from k where share > 0.5) group by 1),
    n as (select frame_index, count(distinct detection_id) as n_detections from k where class in ('car', 'dog') group by 1)
    select f.frame_index, coalesce(n_detections, 0) as n_detections, round(coalesce(masked_share, 0), 6) as masked_share from (select distinct frame_index from d) f left join n using (frame_index) left join p using (frame_index)""")
def image_masks(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    kind = F.array(*[F.lit(x) for x in _CLASSES])[(c("l_partkey") % 6).cast("int")]
    rows = table(spark, d, "lineitem").select(
        c("l_suppkey").alias("frame_index"), c("l_partkey").alias("detection_id"), kind.alias("class"), c("l_linenumber").alias("row"), (c("l_quantity").cast("int") % 10).alias("col"), (c("l_discount") * 10).alias("share"),
        F.lit(8).alias("height"), F.lit(10).alias("width"),
    )
    return s.rounded(masks.masks(rows), 6, "masked_share")


@query(f"""with {s._STAGES}, {s._UTIL}, j as (select stage as "window", gpu_index, util_pct from util join stages on ts >= start_ts and ts <= end_ts),
    x as ({s._RES_SQL.format('"window", gpu_index', 'j')}) select *, mean_util < 70 or idle_share > 0.2 as flagged from x""")
def util_windows(spark: SparkSession, d: str) -> DataFrame:
    """Each GPU's utilisation within each window of the run, flagged if it is low or idle."""
    w = s.stages(spark, d).withColumnRenamed("stage", "window")
    got = report.windowed(s.util(spark, d), w, ["gpu_index"], width=86_400.0)
    return s.rounded(s.rounded(got, 5, "mean_util"), 6, "idle_share")


@query(f"""with {s._PAIRS}, e as (select 'm' || chunk_idx as model, sqrt((sx - dx) ** 2 + (sy - dy) ** 2 + (sz - dz) ** 2) / 40 * 100 as t, degrees(acos(greatest(-1, least(1, (sx + sy + sz - 1) / 2)))) as r from pairs)
    select model, count(*) as n_cameras, round(median(t), 5) as translation_pct, round(median(r), 5) as rotation_deg from e group by model""")
def camera_pose_errors(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    p = s.pairs(spark, d).select(F.concat(F.lit("m"), c("chunk_idx").cast("string")).alias("model"), *[c(f"s{a}").alias(f"t{a}") for a in "xyz"], *[c(f"d{a}").alias(f"u{a}") for a in "xyz"], (c("sx") + c("sy") + c("sz")).alias("trace"))
    return s.rounded(scorecard.camera_errors(p, 40.0), 5, "translation_pct", "rotation_deg")


@query("select user_id, event_type as phase, min(event_id) as since from events group by 1, 2")
def phase_starts(spark: SparkSession, d: str) -> DataFrame:
    return report.phase_starts(table(spark, d, "events").withColumnRenamed("event_type", "phase"), "user_id", "phase", "event_id")


@query(f"""with {s._LOG}, b as (select min(ts) as t0 from bus), g as (select stage, ts, lead(ts) over (partition by stage order by ts) as nx from bus),
    f as (select stage, ts, nx, t0 + ceil((ts + 3600 - t0) / 600) * 600 as first from g, b where nx - ts >= 3600),
    w as (select stage, ts, nx, unnest(range(cast(floor((nx - first) / 1800) as bigint) + 1)) * 1800 + first as warned_at from f where first < nx)
    select stage, round(warned_at, 3) as warned_at, round(warned_at - ts, 3) as stalled_s from w where warned_at < nx""")
def stall_warnings(spark: SparkSession, d: str) -> DataFrame:
    """What a watchdog would say that polls every ten minutes, of silences of an hour, again every half hour."""
    e = s.events(spark, d)
    begun = e.agg(F.min("ts").alias("begun"))
    got = report.stall_warnings(e.join(F.broadcast(begun), F.lit(True)), "stage", "ts", "begun", 3600.0, 600.0, 1800.0)
    return s.rounded(got, 3, "warned_at", "stalled_s")


@query("""with models as (select 'm' || s_nationkey as model, avg(s_acctbal) as quality_a, 100e0 + 60 * s_nationkey as runtime_s from supplier group by s_nationkey),
    n as (select model, quality_a / max(quality_a) over () as q, min(runtime_s) over () / runtime_s as sp, runtime_s <= 900 as ok from models)
    select model, '| ' || model || ' | ' || printf('%.3f', q + 3e-10) || ' | ' || printf('%.3f', sp + 3e-10) || ' | ' || case when ok then 'yes' else 'no' end || ' |' as line from n""")
def scorecard_lines(spark: SparkSession, d: str) -> DataFrame:
    """Rows of a scorecard as text."""
    m = s.models(spark, d)
    card = scorecard.scorecard(m.withColumn("has_cameras", F.lit(True)), {"quality_a": False}, {})
    three = lambda c: F.format_string("%.3f", F.col(c) + 3e-10)
    return card.select("model", F.concat(F.lit("| "), "model", F.lit(" | "), three("quality"), F.lit(" | "), three("speed"), F.lit(" | "), F.when(F.col("eligible"), "yes").otherwise("no"), F.lit(" |")).alias("line"))


# ---------------------------------------------------------------------- streams


def _folder(spark: SparkSession) -> str:
    return f"{checkpoint_folder(spark)}/stream-{uuid.uuid4().hex}"


@query(f"""with {s._POINTS}, k as (select ((cast(floor(x / 2.5) as bigint) + 1048576) << 42) | ((cast(floor(y / 2.5) as bigint) + 1048576) << 21) | (cast(floor(z / 2.5) as bigint) + 1048576) as voxel_key, * from points where conf >= 0.1 and not masked)
    select voxel_key, round(sum(conf), 6) as w, count(*) as n, round(max(conf), 6) as conf from k group by voxel_key""")
def stream_fused(spark: SparkSession, d: str) -> DataFrame:
    """The voxels after all chunks have streamed in."""
    folder = _folder(spark)
    p = s.points(spark, d).select("x", "y", "z", "conf", "masked", "chunk_idx")
    p.repartition(4, "chunk_idx").write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(p.schema).option("maxFilesPerTrigger", 2).parquet(f"{folder}/in")
    got = bus.run_last(bus.fused_increments(stream, 2.5), f"{folder}/out", f"{folder}/ck")
    return s.rounded(got.select("voxel_key", "w", "n", "conf"), 6, "w", "conf")


@query("""with c as (select o_custkey % 20 as run_id, unnest(range(count(distinct o_custkey))) as chunk_idx from orders group by 1) select run_id, chunk_idx from c""")
def stream_stitched(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of twenty runs from two producers, each passed on once its turn has come."""
    folder = _folder(spark)
    per = table(spark, d, "orders").groupBy((F.col("o_custkey") % 20).alias("run_id")).agg(F.countDistinct("o_custkey").alias("n"))
    chunks = per.select("run_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)).alias("chunk_idx"))
    for producer in (1, 0):
        chunks.where(F.col("chunk_idx") % 2 == producer).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(chunks.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    return bus.run_last(bus.stitched(stream), f"{folder}/out", f"{folder}/ck", "append").select("run_id", "chunk_idx")


@query(f"""with {s._LOG}, g as (select stage, count(*) filter (kind = 'progress') as done, max(ts) - min(ts) as took from bus group by stage)
    select stage, done, round(done * 60 / took, 6) as per_minute, round(greatest(5000 - done, 0) * took / done, 3) as eta_s from g""")
def stream_progress(spark: SparkSession, d: str) -> DataFrame:
    folder = _folder(spark)
    bus.publish(s.events(spark, d).withColumn("payload", F.lit("")).select("seq", "ts", "stage", "kind", "payload"), f"{folder}/in")
    got = bus.run_last(bus.progress(bus.read(spark, f"{folder}/in"), 5000), f"{folder}/out", f"{folder}/ck")
    return s.rounded(s.rounded(got, 6, "per_minute"), 3, "eta_s")


@query(f"with {s._LOG} select seq, stage, kind from bus order by ts desc, seq desc limit 200")
def log_tail(spark: SparkSession, d: str) -> DataFrame:
    return bus.log_tail(s.events(spark, d)).select("seq", "stage", "kind")
