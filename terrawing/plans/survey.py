"""Queries of the survey operators on the project's and the benchmark tables, and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrawing.functions import camera, geo, scoring
from terrawing.operators import align, chunks, fusion, keyframes, mesh, raster, report, scorecard, sync, views
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


def rounded(df: DataFrame, places: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in columns})


#: Added before rounding where values with few decimals would lie on a tie and the last bit decide.
OFF_TIE = 3e-10


def off_tie(df: DataFrame, places: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c) + OFF_TIE, places) for c in columns})


# --------------------------------------------------------------------- bindings

SAMPLE = ["track_id", "source_index", "t", "lat", "lon", "alt", "alt_is_relative", "yaw", "pitch", "roll", "gimbal_yaw", "gimbal_pitch", "gimbal_roll"]
_SAMPLES = f"samples as (select distinct {', '.join(SAMPLE)} from telemetry)"
_FRAMES = "frames as (select distinct track_id, frame_index, timestamp_s from candidates where timestamp_s is not null)"
_CANDS = """cands as (select distinct track_id, frame_index, timestamp_s, sharpness, gps_enu.e as e, gps_enu.n as n, gps_enu.u as u, accepted, reject_reason
    from candidates)"""
_POINTS = """points as (select l_orderkey * 10 + l_linenumber as point_id, l_quantity as x, l_extendedprice / 1000 as y, l_discount * 100 as z, 1 - 10 * l_tax as conf,
    cast(l_partkey % 256 as double) as r, cast(l_suppkey % 256 as double) as g, l_linenumber * 30e0 as b, l_returnflag = 'R' as masked, cast(l_suppkey % 8 as int) as chunk_idx, l_linenumber as view_pos
    from lineitem)"""
_CLOUD = "cloud as (select vec_id, embedding[1]::double * 10 as x, embedding[2]::double * 10 as y, embedding[3]::double * 10 as z, label from embeddings)"
_PAIRS = """pairs as (select label as chunk_idx, vec_id, embedding[1]::double * 10 as sx, embedding[2]::double * 10 as sy, embedding[3]::double * 10 as sz,
    embedding[4]::double * 10 as dx, embedding[5]::double * 10 as dy, embedding[6]::double * 10 as dz, 1e0 as w from embeddings)"""
_STAGES = """stages as (select event_type as stage, epoch(min(ts)) as start_ts, epoch(min(ts)) + 518400 as end_ts from events group by event_type)"""
_UTIL = "util as (select event_id, epoch(ts) as ts, user_id % 2 as gpu_index, least(value, 100e0) as util_pct from events)"
_LOG = """bus as (select event_id as seq, epoch(ts) as ts, 'stage_' || (user_id % 12) as stage,
    case event_type when 'view' then 'start' when 'click' then 'progress' when 'purchase' then 'done' when 'error' then 'fallback' else 'error' end as kind
    from events)"""


def samples(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "telemetry").select(*SAMPLE).distinct()


def frames(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "candidates").where("timestamp_s is not null").select("track_id", "frame_index", "timestamp_s").distinct()


def cands(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "candidates").dropDuplicates(["track_id", "frame_index"])
    return c.select("track_id", "frame_index", "timestamp_s", "sharpness", *[F.col(f"gps_enu.{a}").alias(a) for a in "enu"], "accepted", "reject_reason")


def points(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    return table(spark, d, "lineitem").select(
        (c("l_orderkey") * 10 + c("l_linenumber")).alias("point_id"), c("l_quantity").alias("x"), (c("l_extendedprice") / 1000).alias("y"), (c("l_discount") * 100).alias("z"), (1 - 10 * c("l_tax")).alias("conf"),
        (c("l_partkey") % 256).cast("double").alias("r"), (c("l_suppkey") % 256).cast("double").alias("g"), (c("l_linenumber") * 30.0).alias("b"), (c("l_returnflag") == "R").alias("masked"),
        (c("l_suppkey") % 8).cast("int").alias("chunk_idx"), c("l_linenumber").alias("view_pos"),
    )


def _part(i: int) -> Column:
    return F.col("embedding")[i].cast("double") * 10


def cloud(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", *[_part(i).alias(c) for i, c in enumerate("xyz")], "label")


def pairs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("label").alias("chunk_idx"), "vec_id", *[_part(i).alias(c) for i, c in enumerate(("sx", "sy", "sz", "dx", "dy", "dz"))], F.lit(1.0).alias("w"))


def seconds(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp")) / 1e6


def stages(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").groupBy(F.col("event_type").alias("stage")).agg(F.min("ts").alias("ts"))
    return e.select("stage", seconds("ts").alias("start_ts"), (seconds("ts") + 518400).alias("end_ts"))


def util(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", seconds("ts").alias("ts"), (F.col("user_id") % 2).alias("gpu_index"), F.least("value", F.lit(100.0)).alias("util_pct"))


def events(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("event_type")
    named = F.when(kind == "view", "start").when(kind == "click", "progress").when(kind == "purchase", "done").when(kind == "error", "fallback").otherwise("error")
    return table(spark, d, "events").select(F.col("event_id").alias("seq"), seconds("ts").alias("ts"), F.concat(F.lit("stage_"), (F.col("user_id") % 12).cast("string")).alias("stage"), named.alias("kind"))


#: Four cameras over the cloud, one every 20 units, that look straight down.
_CAMERAS = [(k, 10.0 + 20 * k, 8.0, 60.0) for k in range(4)]
_CAMERA_SQL = "cameras as (select * from (values " + ", ".join(f"({k}, {x}e0, {y}e0, {z}e0)" for k, x, y, z in _CAMERAS) + ") v(camera_id, px, py, pz))"


def cameras(spark: SparkSession) -> DataFrame:
    rows = [(k, [1.0, 0.0, 0.0, x, 0.0, -1.0, 0.0, y, 0.0, 0.0, -1.0, z, 0.0, 0.0, 0.0, 1.0], 500.0, 500.0, 320.0, 240.0, 640, 480) for k, x, y, z in _CAMERAS]
    return spark.createDataFrame(rows, "camera_id int, pose array<double>, fx double, fy double, cx double, cy double, width int, height int")


# ----------------------------------------------------------------------- fusion

_VOXELS = """fused as (select ((least(greatest(cast(floor(x / 2.5) as bigint) + 1048576, 0), 2097151) << 42) | (least(greatest(cast(floor(y / 2.5) as bigint) + 1048576, 0), 2097151) << 21)
    | least(greatest(cast(floor(z / 2.5) as bigint) + 1048576, 0), 2097151)) as voxel_key, sum(conf * x) / sum(conf) as x, sum(conf * y) / sum(conf) as y, sum(conf * z) / sum(conf) as z,
    sum(conf * r) / sum(conf) as r, sum(conf * g) / sum(conf) as g, sum(conf * b) / sum(conf) as b, count(*) as view_count, count(distinct view_pos) as distinct_views, max(conf) as confidence
    from points where conf >= 0.1 and not masked group by 1 having sum(conf) > 1e-9)"""
_VOXEL_COLUMNS = ", ".join(f"round({c} + {OFF_TIE}, 6) as {c}" for c in ("x", "y", "z", "r", "g", "b", "confidence"))


@query(f"with {_POINTS}, {_VOXELS} select voxel_key, {_VOXEL_COLUMNS}, view_count, distinct_views from fused")
def voxel_fusion(spark: SparkSession, d: str) -> DataFrame:
    return off_tie(fusion.fuse(points(spark, d), 2.5), 6, "x", "y", "z", "r", "g", "b", "confidence")


@query(f"""with {_POINTS}, k as (select ((cast(floor(x / 2.5) as bigint) + 1048576) << 42) | ((cast(floor(y / 2.5) as bigint) + 1048576) << 21) | (cast(floor(z / 2.5) as bigint) + 1048576) as voxel_key, *
    from points where conf >= 0.1 and not masked)
    select voxel_key, round(sum(conf), 6) as w, round(sum(conf * x), 6) as wx, round(sum(conf * y), 6) as wy, round(sum(conf * z), 6) as wz, count(*) as n, round(max(conf), 6) as conf
    from k group by voxel_key""")
def voxel_increment(spark: SparkSession, d: str) -> DataFrame:
    """The accumulator after two batches, even and odd chunks."""
    p = points(spark, d)
    two = fusion.merge(fusion.partial_sums(p.where("chunk_idx % 2 = 0"), 2.5), fusion.partial_sums(p.where("chunk_idx % 2 = 1"), 2.5))
    return rounded(two, 6, "w", "conf", "wx", "wy", "wz")


_BOX = "box as (select min(x) x0, max(x) x1, min(y) y0, max(y) y1 from {0})"
_CELL = """least(cast(floor((x - x0) / 1e0) as bigint), cast(ceil((x1 - x0) / 1e0) as bigint)) as col, least(cast(floor((y1 - y) / 1e0) as bigint), cast(ceil((y1 - y0) / 1e0) as bigint)) as row"""


@query(f"""with {_POINTS}, {_BOX.format('points')} select row, col, round(max(z), 4) as height_m, round(avg(r), 4) as red, round(avg(g), 4) as green, round(avg(b), 4) as blue, count(*) as n
    from (select {_CELL}, * from points, box) group by row, col""")
def raster_dsm_ortho(spark: SparkSession, d: str) -> DataFrame:
    return rounded(raster.surface(points(spark, d), 1.0), 4, "height_m", "red", "green", "blue")


@query(f"""with {_POINTS}, {_VOXELS}, {_BOX.format('fused')} select row, col, round(avg(view_count), 4) as views, round(avg(confidence), 4) as conf, count(*) as n
    from (select {_CELL}, * from fused, box) group by row, col""")
def raster_coverage(spark: SparkSession, d: str) -> DataFrame:
    return rounded(raster.coverage(fusion.fuse(points(spark, d), 2.5), 1.0).drop("width", "height"), 4, "views", "conf")


@query(f"""with {_POINTS}, {_VOXELS}, {_BOX.format('fused')}, c as (select distinct row, col from (select {_CELL}, * from fused, box))
    select round(1 - (select count(*) from c) / (ceil(x1 - x0) + 1) / (ceil(y1 - y0) + 1), 6) as unobserved from box""")
def raster_unobserved(spark: SparkSession, d: str) -> DataFrame:
    return rounded(raster.unobserved(raster.coverage(fusion.fuse(points(spark, d), 2.5), 1.0)), 6, "unobserved")


@query(f"""with {_POINTS}, {_BOX.format('points')}, c as (select row, col, max(z) as h from (select {_CELL}, * from points, box)
    group by row, col), q as (select quantile_cont(h, 0.02) a, quantile_cont(h, 0.98) b from c)
    select row, col, round((greatest(a, least(b, h)) - a) / nullif(b - a, 0), 5) as shade from c, q""")
def raster_stretch(spark: SparkSession, d: str) -> DataFrame:
    return rounded(raster.stretched(raster.surface(points(spark, d), 1.0), "height_m"), 5, "shade").select("row", "col", "shade")


@query(f"with {_POINTS} select point_id, round(conf, 4) as conf from points where conf > (select median(conf) from points)")
def median_conf_filter(spark: SparkSession, d: str) -> DataFrame:
    return rounded(fusion.above_median(points(spark, d)), 4, "conf").select("point_id", "conf")


@query(f"with {_POINTS} select point_id, y from points where y >= (select quantile_cont(y, 0.02) from points)")
def density_trim(spark: SparkSession, d: str) -> DataFrame:
    return fusion.at_least_quantile(points(spark, d), "y", 0.02).select("point_id", "y")


@query(f"""with {_POINTS},
    b as (select min(x) x0, min(y) y0, min(z) z0, greatest(max(x) - min(x), 1e-6) * greatest(max(y) - min(y), 1e-6) * greatest(max(z) - min(z), 1e-6) as volume, greatest(1, count(*) // 10) as most
    from points),
    s as (select *, pow(volume / most, 1 / 3e0) as size from b),
    l as (select count(*) as kept from (select distinct floor((x - x0) / size), floor((y - y0) / size), floor((z - z0) / size) from points, s)),
    f as (select x0, y0, z0, case when kept > 1.5 * most then size * pow(kept / most, 1 / 3e0) else size end as size from s, l),
    c as (select avg(x) as x, avg(y) as y, avg(z) as z, count(*) as n from points, f group by floor((points.x - x0) / size), floor((points.y - y0) / size), floor((points.z - z0) / size))
    select round(x + 3e-10, 6) as x, round(y + 3e-10, 6) as y, round(z + 3e-10, 6) as z, n from c""")
def voxel_budget(spark: SparkSession, d: str) -> DataFrame:
    """The cloud thinned to about a tenth."""
    p = points(spark, d)
    return off_tie(fusion.down_sampled(p, fusion.budget_size(p, max(1, p.count() // 10))), 6, "x", "y", "z")


_KNN = """near as (select a.vec_id as query, b.vec_id as point, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) as distance,
    row_number() over (partition by a.vec_id order by sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2), b.vec_id) as rank from cloud a, cloud b)"""


@query(f"""with {_CLOUD}, {_KNN}, m as (select query, avg(distance) as mean_distance from near where rank <= 16 group by query),
    s as (select avg(mean_distance) + 2 * stddev_samp(mean_distance) as b from m)
    select query as vec_id, round(mean_distance, 5) as mean_distance from m, s where mean_distance > 0 and mean_distance < b""")
def outlier_removal(spark: SparkSession, d: str) -> DataFrame:
    return rounded(fusion.without_outliers(cloud(spark, d), "vec_id", 0.5), 5, "mean_distance").select("vec_id", "mean_distance")


@query(f"with {_CLOUD}, {_KNN} select query as vec_id, point, round(distance, 6) as distance from near where rank = 2")
def nearest_other(spark: SparkSession, d: str) -> DataFrame:
    c = cloud(spark, d)
    return rounded(fusion.nearest_points(c, c, 2, "vec_id", "vec_id", 0.5), 6, "distance").where("rank = 2").select(F.col("query").alias("vec_id"), "point", "distance")


@query(f"""with {_CLOUD}, a as (select * from cloud where label % 2 = 0), b as (select * from cloud where label % 2 = 1),
    ab as (select a.vec_id, min(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2)) m from a, b group by 1), ba as (select b.vec_id, min(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2)) m
    from a, b group by 1),
    g as (select sqrt((max(x) - min(x)) ** 2 + (max(y) - min(y)) ** 2 + (max(z) - min(z)) ** 2) s from b)
    select round(100 * (select median(m) from ab) / s, 5) as accuracy_pct, round(100 * (select median(m) from ba) / s, 5) as completeness_pct from g""")
def accuracy_completeness(spark: SparkSession, d: str) -> DataFrame:
    c = cloud(spark, d)
    a, b = c.where("label % 2 = 0"), c.where("label % 2 = 1")
    near = lambda p, q, n: fusion.nearest_points(p, q, 1, "vec_id", "vec_id", 0.5).agg(F.median("distance").alias(n))
    extent = b.agg(F.sqrt(sum(((F.max(k) - F.min(k)) ** 2 for k in "yz"), (F.max("x") - F.min("x")) ** 2)).alias("s"))
    both = near(a, b, "m1").join(near(b, a, "m2"), F.lit(True)).join(extent, F.lit(True))
    return both.select(F.round(100 * F.col("m1") / F.col("s"), 5).alias("accuracy_pct"), F.round(100 * F.col("m2") / F.col("s"), 5).alias("completeness_pct"))


# --------------------------------------------------------------- geodesy and sync

_ECEF = """(6378137e0 / sqrt(1 - {e2} * sin(radians({la})) * sin(radians({la}))))"""


def _ecef_sql(la: str, lo: str, al: str) -> tuple[str, str, str]:
    n = _ECEF.format(e2=repr(geo.E2), la=la)
    return f"({n} + {al}) * cos(radians({la})) * cos(radians({lo}))", f"({n} + {al}) * cos(radians({la})) * sin(radians({lo}))", f"({n} * {1 - geo.E2!r} + {al}) * sin(radians({la}))"


_ORIGIN = """o as (select track_id, arg_min(lat, (t, source_index)) la0, arg_min(lon, (t, source_index)) lo0, arg_min(coalesce(alt, 0e0), (t, source_index)) al0
    from samples group by track_id)"""
_X, _Y, _Z = _ecef_sql("lat", "lon", "coalesce(alt, 0e0)")
_X0, _Y0, _Z0 = _ecef_sql("la0", "lo0", "al0")
_ENU = f"""g as (select track_id, source_index, t, radians(la0) p, radians(lo0) q, la0, lo0, {_X} - {_X0} ax, {_Y} - {_Y0} ay, {_Z} - {_Z0} az
    from samples join o using (track_id) where abs(lat) <= 90 and abs(lon) <= 180),
    enu as (select track_id, source_index, t, la0, lo0, -sin(q) * ax + cos(q) * ay as e, -sin(p) * cos(q) * ax - sin(p) * sin(q) * ay + cos(p) * az as n, cos(p) * cos(q) * ax + cos(p) * sin(q) * ay + sin(p) * az as u
    from g)"""


@query(f"""with {_SAMPLES}, {_ORIGIN}, {_ENU} select track_id, source_index, round(e, 3) as e, round(n, 3) as n, round(u, 3) as u, cast(floor((lo0 + 180) / 6) as bigint) + 1 as zone, case when la0 >= 0 then 32600 else 32700 end + cast(floor((lo0 + 180) / 6) as bigint) + 1 as epsg
    from enu""")
def geodetic_to_enu(spark: SparkSession, d: str) -> DataFrame:
    return rounded(sync.ground_track(samples(spark, d)).where("abs(lat) <= 90 and abs(lon) <= 180"), 3, "e", "n", "u").select("track_id", "source_index", "e", "n", "u", "zone", "epsg")


@query(f"""with {_SAMPLES} select track_id, source_index, round(lat, 7) as lat, round(lon, 7) as lon, round(coalesce(alt, 0), 3) as alt
    from samples where abs(lat) < 80 and abs(lon) < 180 and abs(coalesce(alt, 0)) < 5000""")
def enu_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Every sample to the local plane of (lat, lon) = (10, 20) and back."""
    s = samples(spark, d).where("abs(lat) < 80 and abs(lon) < 180 and abs(coalesce(alt, 0)) < 5000")
    o = (F.lit(10.0), F.lit(20.0), F.lit(100.0))
    s = s.withColumns(dict(zip("enu", geo.ecef_to_enu(geo.geodetic_to_ecef(F.col("lat"), F.col("lon"), F.coalesce("alt", F.lit(0.0))), *o))))
    s = s.withColumns(dict(zip("xyz", geo.enu_to_ecef((F.col("e"), F.col("n"), F.col("u")), *o)))).withColumn("g", geo.ecef_to_geodetic(F.col("x"), F.col("y"), F.col("z")))
    return s.select("track_id", "source_index", F.round("g.lat", 7).alias("lat"), F.round("g.lon", 7).alias("lon"), F.round("g.alt", 3).alias("alt"))


_ASOF = f"""with {_SAMPLES}, {_FRAMES}, s1 as (select distinct on (track_id, t) * from samples order by track_id, t, source_index desc),
    s2 as (select distinct on (track_id, t) * from samples order by track_id, t, source_index),
    a as (select f.*, p.t as pt, p.source_index as pi, p.lat as plat, p.lon as plon, p.alt as palt, p.yaw as pyaw from frames f asof
    left join s1 p on f.track_id = p.track_id and f.timestamp_s >= p.t),
    b as (select a.*, q.t as nt, q.source_index as ni, q.lat as nlat, q.lon as nlon, q.alt as nalt, q.yaw as nyaw from a asof
    left join s2 q on a.track_id = q.track_id and a.timestamp_s < q.t)"""


def _lerp_sql(c: str) -> str:
    return f"case when pt is null then n{c} when nt is null then p{c} when p{c} is null then n{c} when n{c} is null then p{c} else p{c} + (n{c} - p{c}) * ((timestamp_s - pt) / (nt - pt)) end"


@query(_ASOF + " select track_id, frame_index, timestamp_s as frame_t, " + ", ".join(f"round({_lerp_sql(c)}, {k}) as {c}" for c, k in (("lat", 6), ("lon", 6), ("alt", 3), ("yaw", 3))) + " from b")
def sync_interpolate(spark: SparkSession, d: str) -> DataFrame:
    out = sync.interpolate(samples(spark, d), frames(spark, d), values=["lat", "lon", "alt", "yaw"])
    return rounded(rounded(out, 6, "lat", "lon"), 3, "alt", "yaw")


@query(_ASOF + " select track_id, frame_index, timestamp_s as frame_t, case when nt is null or (pt is not null and timestamp_s - pt <= nt - timestamp_s) then pi else ni end as source_index from b")
def prior_nearest(spark: SparkSession, d: str) -> DataFrame:
    return sync.nearest_sample(samples(spark, d), frames(spark, d), values=[]).select("track_id", "frame_index", "frame_t", F.col("source_index").cast("int").alias("source_index"))


@query(f"""with {_SAMPLES}, {_FRAMES}, s as (select *, row_number() over (partition by track_id order by source_index) - 1 as i, count(*) over (partition by track_id) as n
    from samples),
    f as (select *, row_number() over (partition by track_id order by frame_index) - 1 as k, count(*) over (partition by track_id) as m from frames),
    x as (select f.track_id, f.frame_index, k / greatest(m - 1, 1) * (c.n - 1) as x, c.n as n from f join (select distinct track_id, n from s) c using (track_id)),
    y as (select *, cast(floor(x) as bigint) as lo, least(cast(floor(x) as bigint) + 1, n - 1) as hi from x)
    select y.track_id, y.frame_index, round(a.lat + (b.lat - a.lat) * (x - lo) + 3e-10, 6) as lat, round(a.lon + (b.lon - a.lon) * (x - lo) + 3e-10, 6) as lon
    from y join s a on a.track_id = y.track_id and a.i = lo join s b on b.track_id = y.track_id and b.i = hi""")
def sync_proportional(spark: SparkSession, d: str) -> DataFrame:
    return off_tie(sync.proportional(samples(spark, d), frames(spark, d), values=["lat", "lon"]), 6, "lat", "lon")


@query(f"""with {_SAMPLES} select track_id, source_index, last_value(yaw ignore nulls) over (partition by track_id order by t, source_index rows unbounded preceding) as yaw_known,
    last_value(pitch ignore nulls) over (partition by track_id order by t, source_index rows unbounded preceding) as pitch_known from samples""")
def attitude_fill(spark: SparkSession, d: str) -> DataFrame:
    return sync.last_known(samples(spark, d), "track_id", "t", ["source_index"], ["yaw", "pitch"]).select("track_id", "source_index", "yaw_known", "pitch_known")


@query(f"with {_SAMPLES} select track_id, source_index, " + ", ".join(f"coalesce(nullif(gimbal_{a}, 0), {a}) as prior_{a}" for a in ("yaw", "pitch", "roll")) + " from samples")
def prior_angles(spark: SparkSession, d: str) -> DataFrame:
    return sync.prior_angles(samples(spark, d)).select("track_id", "source_index", *[f"prior_{a}" for a in ("yaw", "pitch", "roll")])


# -------------------------------------------------------------------- keyframes

@query(f"""with {_CANDS}, q as (select track_id, quantile_cont(sharpness, 0.15) as floor from cands group by track_id)
    select track_id, frame_index, round(floor, 9) as floor, sharpness >= floor as sharp from cands join q using (track_id)""")
def sharpness_gate(spark: SparkSession, d: str) -> DataFrame:
    return rounded(keyframes.sharpness_gate(cands(spark, d)), 9, "floor").select("track_id", "frame_index", "floor", "sharp")


@query(f"""with recursive {_CANDS}, p as (select *, row_number() over (partition by track_id order by frame_index) as k from cands where e is not null),
    g as (select track_id, k, frame_index, e, n, u, true as kept from p where k = 1
          union all select p.track_id, p.k, p.frame_index, case when far then p.e else g.e end, case when far then p.n else g.n end, case when far then p.u else g.u end, far
          from g join p on p.track_id = g.track_id and p.k = g.k + 1, lateral (select (p.e - g.e) ** 2 + (p.n - g.n) ** 2 + (p.u - g.u) ** 2 >= 4 as far) l)
    select track_id, frame_index, kept from g""")
def keyframe_spacing(spark: SparkSession, d: str) -> DataFrame:
    c = cands(spark, d).where("e is not null")
    return keyframes.spacing_gate(c).select("track_id", F.col("frame_index").cast("int").alias("frame_index"), "kept")


_NUMBERED = "x as (select *, row_number() over (partition by track_id order by frame_index) as k, count(*) over (partition by track_id) as m from cands)"


@query(f"with {_CANDS}, {_NUMBERED} select track_id, frame_index, m <= 5 or k % 5 = 1 as kept from x")
def keyframe_stride(spark: SparkSession, d: str) -> DataFrame:
    return keyframes.stride_gate(cands(spark, d)).select("track_id", "frame_index", "kept")


@query(f"""with {_CANDS}, {_NUMBERED} select track_id, frame_index from x where m <= 25 or exists (select 1 from range(25) r(i)
    where cast(floor(i * (m / 25)) as bigint) = k - 1)""")
def thin_even(spark: SparkSession, d: str) -> DataFrame:
    return keyframes.thin_even(cands(spark, d), 25).select("track_id", "frame_index")


@query(f"with {_CANDS}, {_NUMBERED} select track_id, frame_index from x where (k - 1) % greatest(1, m // 12) = 0 and (k - 1) // greatest(1, m // 12) < 12")
def pick_even(spark: SparkSession, d: str) -> DataFrame:
    return keyframes.pick_even(cands(spark, d), 12).select("track_id", "frame_index")


@query(f"with {_CANDS} select track_id, frame_index from cands where frame_index % 12 = 0")
def sample_fps(spark: SparkSession, d: str) -> DataFrame:
    return keyframes.sampled(cands(spark, d), 29.97, 2.5).select("track_id", "frame_index")


@query(f"with {_CANDS}, {_NUMBERED} select track_id, frame_index from x where k <= 40")
def decode_cap(spark: SparkSession, d: str) -> DataFrame:
    return keyframes.first_frames(cands(spark, d), 40).select("track_id", "frame_index")


@query(f"""with {_CANDS}, {_NUMBERED}, f as (select *, k - 1 as pos, cast(floor((k * 15 - 1) / m) as int) as win, max(case when accepted and frame_index % 7 = 0 then 1 else 0 end) over (partition by track_id
    order by k rows between 4 preceding and 4 following) as near from x),
    r as (select *, row_number() over (partition by track_id, win order by sharpness desc, pos) as rk from f where near = 0)
    select track_id, win as "window", frame_index from r where rk = 1""")
def heldout_select(spark: SparkSession, d: str) -> DataFrame:
    return keyframes.held_out(cands(spark, d), F.col("accepted") & (F.col("frame_index") % 7 == 0)).select("track_id", "window", "frame_index")


_COUNTS = """select track_id, count(*) filter (accepted) as n_accepted, count(*) filter (not accepted) as n_rejected, count(distinct reject_reason) as n_reasons
    from cands group by track_id"""


@query(f"with {_CANDS} {_COUNTS}")
def keyframe_counts(spark: SparkSession, d: str) -> DataFrame:
    a = F.col("accepted")
    return cands(spark, d).groupBy("track_id").agg(F.count_if(a).alias("n_accepted"), F.count_if(~a).alias("n_rejected"), F.countDistinct("reject_reason").alias("n_reasons"))


@query(f"""with {_CANDS}, {_NUMBERED}, c as (select track_id, m, unnest(range(greatest(cast(ceil((m - 50) / 40) as bigint), 0) + 1)) as c
    from (select distinct track_id, m from x)) select x.track_id, frame_index, cast(c as int) as chunk_idx, cast(k - 1 - c * 40 as int) as view_pos, cast(least(50, x.m - c * 40) as int) as chunk_len
    from x join c on c.track_id = x.track_id and k - 1 >= c * 40 and k - 1 < c * 40 + 50""")
def chunk_overlap(spark: SparkSession, d: str) -> DataFrame:
    return chunks.overlapping(cands(spark, d)).select("track_id", "frame_index", "chunk_idx", "view_pos", "chunk_len")


@query(f"""with {_CANDS}, {_NUMBERED}, c as (select track_id, m, unnest(range(greatest(cast(ceil((m - 50) / 40) as bigint), 0) + 1)) as c
    from (select distinct track_id, m from x)), v as (select x.track_id, frame_index, cast(c as int) as chunk_idx, cast(k - 1 - c * 40 as int) as view_pos, cast(least(50, x.m - c * 40) as int) as len
    from x join c on c.track_id = x.track_id and k - 1 >= c * 40 and k - 1 < c * 40 + 50) select a.track_id, a.chunk_idx, a.frame_index, a.view_pos, b.view_pos as prev_pos
    from v a join v b on a.track_id = b.track_id and a.frame_index = b.frame_index and a.chunk_idx = b.chunk_idx + 1 where b.view_pos >= b.len - 10""")
def overlap_pairs(spark: SparkSession, d: str) -> DataFrame:
    return chunks.shared_frames(chunks.overlapping(cands(spark, d)))


@query(f"""with {_CANDS}, s as (select track_id, count(*) k, var_samp(e) a, var_samp(n) b, covar_samp(e, n) c from cands where e is not null and n is not null
    group by track_id),
    v as (select track_id, k, (a + b) / 2 m, sqrt(((a - b) / 2) ** 2 + c ** 2) o from s) select track_id, round(case when k < 3 or m + o <= 1e-9 then 0 else greatest(m - o, 0) / (m + o) end, 6) as collinearity
    from v""")
def collinearity(spark: SparkSession, d: str) -> DataFrame:
    return rounded(align.collinearity(cands(spark, d)), 6, "collinearity")


@query(f"""with {_CANDS} select track_id, frame_index, round(coalesce(lead(e) over w - e, e - lag(e) over w, 1), 4) as fe, round(coalesce(lead(n) over w - n, n - lag(n) over w, 0), 4) as fn
    from cands where e is not null window w as (partition by track_id order by frame_index)""")
def forward_direction(spark: SparkSession, d: str) -> DataFrame:
    return rounded(align.forward_direction(cands(spark, d).where("e is not null")), 4, "fe", "fn").select("track_id", "frame_index", "fe", "fn")


# -------------------------------------------------------------------- alignment

_FIT = """select chunk_idx, case when vs <= 1e-12 then 1e0 else greatest(sqrt((xx + yy) ** 2 + (xy - yx) ** 2) / vs, 1e-6) end as scale, atan2(xy - yx, xx + yy) as yaw, mx, my, mz, nx, ny, nz
    from (
    select chunk_idx, sum(w * sx) / sum(w) mx, sum(w * sy) / sum(w) my, sum(w * sz) / sum(w) mz, sum(w * dx) / sum(w) nx, sum(w * dy) / sum(w) ny, sum(w * dz) / sum(w) nz,
    sum(w * sx * dx) / sum(w) - sum(w * sx) / sum(w) * sum(w * dx) / sum(w) xx, sum(w * sy * dy) / sum(w) - sum(w * sy) / sum(w) * sum(w * dy) / sum(w) yy,
    sum(w * sx * dy) / sum(w) - sum(w * sx) / sum(w) * sum(w * dy) / sum(w) xy, sum(w * sy * dx) / sum(w) - sum(w * sy) / sum(w) * sum(w * dx) / sum(w) yx,
    sum(w * (sx * sx + sy * sy)) / sum(w) - (sum(w * sx) / sum(w)) ** 2 - (sum(w * sy) / sum(w)) ** 2 vs from {0} group by chunk_idx)"""
_SHIFT = """select chunk_idx, scale, yaw, nx - scale * (cos(yaw) * mx - sin(yaw) * my) as tx, ny - scale * (sin(yaw) * mx + cos(yaw) * my) as ty, nz - scale * mz as tz
    from ({0})"""
_RES = "sqrt((dx - scale * (cos(yaw) * sx - sin(yaw) * sy) - tx) ** 2 + (dy - scale * (sin(yaw) * sx + cos(yaw) * sy) - ty) ** 2 + (dz - scale * sz - tz) ** 2)"
_IRLS = ["f1 as materialized (" + _SHIFT.format(_FIT.format("pairs")) + ")"]
for _k in range(1, 5):
    _IRLS.append(f"p{_k} as materialized (select p.* exclude (w), case when {_RES} <= 2 then 1e0 else 2 / {_RES} end as w from pairs p join f{_k} using (chunk_idx))")
    _IRLS.append(f"f{_k + 1} as materialized (" + _SHIFT.format(_FIT.format(f"p{_k}")) + ")")


@query(f"""with {_PAIRS}, {', '.join(_IRLS)} select chunk_idx, round(max(scale), 5) as scale, round(max(yaw), 5) as yaw, round(max(tx), 4) as tx, round(max(ty), 4) as ty, round(max(tz), 4) as tz, count(*) as n,
    round(sqrt(avg({_RES} ** 2)), 5) as rmse from pairs join f5 using (chunk_idx) group by chunk_idx having count(*) >= 2""")
def align_4dof(spark: SparkSession, d: str) -> DataFrame:
    return rounded(rounded(align.fit_4dof(pairs(spark, d)), 5, "scale", "yaw", "rmse"), 4, "tx", "ty", "tz")


#: Truth planted in the pairs: scale, turn and shift by chunk, and every fifth pair thrown far off.
_PLANTED = "1 + chunk_idx / 10e0 as scale, chunk_idx / 10e0 as yaw, chunk_idx * 1e0 as tx, 2e0 as ty, -1e0 as tz"


def planted(spark: SparkSession, d: str, tilted: bool = False, spoilt: bool = False) -> DataFrame:
    """Pairs whose source side is brought to the destination by a known similarity; with tilted from a frame whose up isn't +z."""
    c, i = F.col, F.col("chunk_idx")
    p = pairs(spark, d)
    s, q = 1 + i / 10.0, i / 10.0
    x, y, z = (c("dx") - i) / s, (c("dy") - 2.0) / s, (c("dz") + 1.0) / s
    level = [F.cos(q) * x + F.sin(q) * y, F.cos(q) * y - F.sin(q) * x, z]
    if tilted:
        g = camera.aligning_to_up(_up(i))
        level = [g[0][j] * level[0] + g[1][j] * level[1] + g[2][j] * level[2] for j in range(3)]
    off = F.when(F.lit(spoilt) & (c("vec_id") % 5 == 0), 80.0 + c("vec_id") % 7 * 20).otherwise(0.0)
    return p.withColumns(dict(zip(("sx", "sy", "sz"), level))).withColumns({"dx": c("dx") + off, "dy": c("dy") - off})


def _up(i: Column) -> list[Column]:
    """The unit up of each chunk's own frame."""
    x, y = (i % 5) / 10.0, (i % 3) / 10.0
    length = F.sqrt(x * x + y * y + 1.0)
    return [x / length, y / length, F.lit(1.0) / length]


@query(f"""with {_PAIRS} select chunk_idx, round(any_value(1 + chunk_idx / 10e0), 5) as scale, round(cos(any_value(chunk_idx / 10e0)), 5) as r00, round(any_value(chunk_idx) * 1e0, 4) as tx, 0e0 as rmse, count(*) as n
    from pairs group by chunk_idx having count(*) >= 3""")
def align_choice(spark: SparkSession, d: str) -> DataFrame:
    """Similarity or rigid fit of each chunk, to a planted truth."""
    f = align.fit_chunks(planted(spark, d))
    return f.select(F.col("chunk_idx").cast("int").alias("chunk_idx"), F.round("scale", 5).alias("scale"), F.round(F.col("r")[0], 5).alias("r00"), F.round(F.col("t")[0], 4).alias("tx"), F.abs(F.round("rmse", 4)).alias("rmse"), "n")


@query(f"""with {_PAIRS} select chunk_idx, round(any_value(1 + chunk_idx / 10e0), 5) as scale, round(cos(any_value(chunk_idx / 10e0)), 5) as r00, round(any_value(chunk_idx) * 1e0, 4) as tx, count(*) filter (vec_id % 5 <> 0) as n
    from pairs group by chunk_idx having count(*) filter (vec_id % 5 <> 0) >= 10""")
def align_ransac(spark: SparkSession, d: str) -> DataFrame:
    """The planted truth in spite of a fifth of the pairs that are far off."""
    f = align.fit_chunks(planted(spark, d, spoilt=True), robust=True)
    return f.select(F.col("chunk_idx").cast("int").alias("chunk_idx"), F.round("scale", 5).alias("scale"), F.round(F.col("r")[0], 5).alias("r00"), F.round(F.col("t")[0], 4).alias("tx"), "n")


@query(f"""with {_PAIRS}, u as (select *, (chunk_idx % 5) / 10e0 as x, (chunk_idx % 3) / 10e0 as y from pairs), n as (select *, sqrt(x * x + y * y + 1) as k from u)
    select chunk_idx, round(any_value(1 + chunk_idx / 10e0), 5) as scale, round(any_value(1 / k), 5) as r22, round(any_value(chunk_idx) * 1e0, 4) as tx, count(*) as n
    from n group by chunk_idx having count(*) >= 2""")
def align_gravity(spark: SparkSession, d: str) -> DataFrame:
    """Chunks turned upright by their gravity, then fitted in scale, turn and shift."""
    p = planted(spark, d, tilted=True)
    g = p.select("chunk_idx").distinct().select("chunk_idx", *[u.alias(f"u{c}") for c, u in zip("xyz", _up(F.col("chunk_idx")))])
    f = align.gravity_fixed(p, g)
    return f.select("chunk_idx", F.round("scale", 5).alias("scale"), F.round(F.col("r")[8], 5).alias("r22"), F.round(F.col("t")[0], 4).alias("tx"), "n")


@query(f"with {_PAIRS} select min(chunk_idx) as chunk_idx, 'identity' as mode, 1e0 as scale from pairs")
def align_identity(spark: SparkSession, d: str) -> DataFrame:
    return align.identity_seed(pairs(spark, d)).select("chunk_idx", "mode", "scale")


@query(f"""with {_PAIRS}, {', '.join(_IRLS)}, e as (select chunk_idx, sqrt(avg({_RES} ** 2)) as rmse from pairs join f5 using (chunk_idx)
    group by chunk_idx having count(*) >= 2)
    select round(avg(rmse), 5) as mean_rmse, count(*) as n_chunks from e""")
def align_mean_rmse(spark: SparkSession, d: str) -> DataFrame:
    return rounded(align.mean_rmse(align.fit_4dof(pairs(spark, d))), 5, "mean_rmse")


def _slope(frames: DataFrame, height: int, width: int, scale: float) -> DataFrame:
    """Each frame's pixels on one slope, as a camera of that size sees them; scaled about the origin."""
    rows = frames.withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(height - 1)))).withColumn("col", F.explode(F.sequence(F.lit(0), F.lit(width - 1))))
    v, u = (F.col("row") + 0.5) / height, (F.col("col") + 0.5) / width
    return rows.select("frame_index", "row", "col", F.lit(height).alias("height"), F.lit(width).alias("width"), (scale * 10 * u).alias("x"), (scale * 8 * v).alias("y"), (scale * (20 + 5 * v + F.col("frame_index") % 7)).alias("z"))


@query("select label::bigint as frame_index, 2e0 as scale, 0e0 as residual_pct, 1024::bigint as n from embeddings group by label")
def grid_fit(spark: SparkSession, d: str) -> DataFrame:
    """A model of half the size met with its reference on a grid of 32 x 32, one frame per label."""
    f = table(spark, d, "embeddings").select(F.col("label").alias("frame_index")).distinct()
    return rounded(align.grid_fit(_slope(f, 64, 96, 0.5), _slope(f, 64, 96, 1.0)), 5, "scale", "residual_pct")


@query(f"""with {_POINTS}, a as (select cast(i as int) as chunk_idx, 1 + i / 10e0 as s, radians(10e0 * i) as q from range(8) r(i))
    select point_id, round(s * (cos(q) * x - sin(q) * y) + chunk_idx + 3e-10, 6) as x, round(s * (sin(q) * x + cos(q) * y) - chunk_idx + 3e-10, 6) as y, round(s * z + 2 + 3e-10, 6) as z
    from points join a using (chunk_idx)""")
def align_apply(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("chunk_idx")
    q = F.radians(10.0 * i)
    r = F.array(F.cos(q), -F.sin(q), F.lit(0.0), F.sin(q), F.cos(q), F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))
    a = spark.range(8).select(F.col("id").cast("int").alias("chunk_idx")).select("chunk_idx", (1 + i / 10.0).alias("scale"), r.alias("r"), F.array(i * 1.0, -i * 1.0, F.lit(2.0)).alias("t"))
    return off_tie(chunks.apply_alignment(points(spark, d), a), 6, "x", "y", "z").select("point_id", "x", "y", "z")


@query(f"""with {_PAIRS}, c as (select chunk_idx, case when var_pop(sz) > 0 and var_pop(dz) > 0 then covar_pop(sz, dz) / sqrt(var_pop(sz) * var_pop(dz)) end as r
    from pairs group by chunk_idx)
    select chunk_idx, round(r, 6) as correlation, coalesce(r < 0, false) as flips, case when abs(r) < 0.3 then 4e-1 else 8e-1 end as confidence from c""")
def gravity_sign(spark: SparkSession, d: str) -> DataFrame:
    return rounded(align.sign_of_up(pairs(spark, d), "chunk_idx", "sz", "dz", 0.8), 6, "correlation")


_UP = """(select track_id, source_index, sin(radians(pitch)) as ux, -sin(radians(roll)) * cos(radians(pitch)) as uy, cos(radians(roll)) * cos(radians(pitch)) as uz
    from samples where pitch is not null and roll is not null and yaw is not null)"""


@query(f"""with {_SAMPLES} select track_id, source_index, round(ux, 6) as ux, round(uy, 6) as uy, round(uz, 6) as uz, round(1 - ux * ux / (1 + uz), 6) as r00, round(ux, 6) as r20
    from {_UP}""")
def gravity_rotation(spark: SparkSession, d: str) -> DataFrame:
    """The world's up in the camera's axes and the rotation that turns it to +z."""
    s = samples(spark, d).where("pitch is not null and roll is not null and yaw is not null")
    up = camera.up_vector(F.col("yaw"), F.col("pitch"), F.col("roll"))
    s = s.withColumns(dict(zip(("ux", "uy", "uz"), up)))
    r = camera.aligning_to_up([F.col(c) for c in ("ux", "uy", "uz")])
    return rounded(s.withColumns({"r00": r[0][0], "r20": r[2][0]}), 6, "ux", "uy", "uz", "r00", "r20").select("track_id", "source_index", "ux", "uy", "uz", "r00", "r20")


@query(f"""with {_SAMPLES} select track_id, source_index, case when yaw is null or pitch is null or roll is null then 1e0 else round(cos(radians(pitch)) * cos(radians(yaw)), 6) end as p00, round(lat, 7) as p03, 16 as n_cells
    from samples""")
def camera_pose(spark: SparkSession, d: str) -> DataFrame:
    p = camera.pose([F.col("lat"), F.col("lon"), F.coalesce("alt", F.lit(0.0))], F.col("yaw"), F.col("pitch"), F.col("roll"))
    return samples(spark, d).withColumn("p", p).select("track_id", "source_index", F.round(F.col("p")[0], 6).alias("p00"), F.round(F.col("p")[3], 7).alias("p03"), F.size("p").alias("n_cells"))


@query()
def gravity_plane(spark: SparkSession, d: str) -> DataFrame:
    """Normal and inlier share of the plane in each chunk's pairs; chunks without one are left out."""
    p = pairs(spark, d).select("chunk_idx", *[F.col(f"s{c}").alias(c) for c in "xyz"])
    return align.planes(p, bound=0.5)


@query()
def pose_graph(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of the embeddings' labels refined against each other: a pair is a place, and shared with the pair of the same rank in the next chunk."""
    import numpy as np

    p = cut(spark, pairs(spark, d))
    got = align.fit_4dof(p).orderBy("chunk_idx").limit(align.MOST_CHUNKS + 1).collect()
    if len(got) > align.MOST_CHUNKS:
        raise ValueError(f"more than {align.MOST_CHUNKS} chunks")
    order = [r["chunk_idx"] for r in got]
    start = np.array([[np.log(r["scale"]), r["yaw"], r["tx"], r["ty"], r["tz"]] for r in got]).reshape(-1, 5)
    number = F.broadcast(spark.createDataFrame(list(zip(order, range(len(order)))), "chunk_idx int, i int"))
    ranked = p.join(number, "chunk_idx").withColumn("_r", F.row_number().over(Window.partitionBy("i").orderBy("vec_id")))
    to = lambda s, n: [F.col(f"{s}{c}").alias(f"{n}{c}") for c in "xyz"]
    places = ranked.select("i", F.lit(-1).alias("j"), "w", *to("s", "p"), *to("d", "q"))
    after = ranked.select((F.col("i") - 1).alias("i"), F.col("i").alias("j"), "_r", *to("s", "q"))
    links = ranked.select("i", "_r", "w", *to("s", "p")).join(after, ["i", "_r"]).select(*places.columns)
    done = align.refine_factors(start, cut(spark, places.unionByName(links))) if order else start
    return spark.createDataFrame([(int(k), *map(float, done[i])) for i, k in enumerate(order)], "chunk_idx int, log_scale double, yaw double, tx double, ty double, tz double")


# ------------------------------------------------------------------------ views

_PROJ = "proj as (select *, 500e0 * (x - px) / (pz - z) + 320 as u, -500e0 * (y - py) / (pz - z) + 240 as v, pz - z as depth from points, cameras where pz - z > 0)"


@query(f"""with {_POINTS}, {_CAMERA_SQL}, {_PROJ} select camera_id, point_id, round(u + 3e-10, 5) as u, round(v + 3e-10, 5) as v, round(depth + 3e-10, 5) as depth
    from proj where u >= 0 and u < 640 and v >= 0 and v < 480""")
def project_visible(spark: SparkSession, d: str) -> DataFrame:
    return off_tie(views.visible(points(spark, d), cameras(spark)), 5, "u", "v", "depth").select("camera_id", "point_id", "u", "v", "depth")


@query(f"""with {_POINTS}, {_CAMERA_SQL}, {_PROJ}, h as (select distinct camera_id, floor(u / 64) bu, floor(v / 64) bv from proj
    where u >= 0 and u < 640 and v >= 0 and v < 480) select camera_id, round(100e0 * count(*) / 80, 4) as covered_pct from h
    group by camera_id""")
def coverage_bins(spark: SparkSession, d: str) -> DataFrame:
    return rounded(views.coverage(points(spark, d), cameras(spark)), 4, "covered_pct")


#: Normals and colours of points taken for mesh vertices, and an image whose pixels' colours follow from their place.
_NORMALS = """verts as (select vec_id, embedding[1]::double * 10 as x, embedding[2]::double * 10 as y, embedding[3]::double * 10 as z, embedding[4]::double as nx, embedding[5]::double as ny, 1e0 as nz, label / 10e0 as r, 0.5e0 as g, 0.25e0 as b
    from embeddings)"""
_SHADE = "((v_col * 7 + v_row * 13 + camera_id * 29 + {0}) % 256)"


def vertices(spark: SparkSession, d: str) -> DataFrame:
    normals = [F.col("embedding")[i].cast("double").alias(c) for i, c in ((3, "nx"), (4, "ny"))]
    colours = [(F.col("label") / 10.0).alias("r"), F.lit(0.5).alias("g"), F.lit(0.25).alias("b")]
    return table(spark, d, "embeddings").select("vec_id", *[_part(i).alias(c) for i, c in enumerate("xyz")], *normals, F.lit(1.0).alias("nz"), *colours)


def pixels(spark: SparkSession) -> DataFrame:
    """All pixels of the four cameras' images."""
    i = F.col("id")
    p = spark.range(640 * 480 * len(_CAMERAS)).select(F.floor(i / (640 * 480)).cast("int").alias("camera_id"), F.floor(i / 640 % 480).cast("int").alias("row"), (i % 640).cast("int").alias("col"))
    return p.select("*", *[((F.col("col") * 7 + F.col("row") * 13 + F.col("camera_id") * 29 + k) % 256).alias(c) for c, k in (("r", 0), ("g", 85), ("b", 170))])


@query(f"""with {_CAMERA_SQL}, {_NORMALS}, p as (select *, 500e0 * (x - px) / (pz - z) + 320 as u, -500e0 * (y - py) / (pz - z) + 240 as v
    from verts, cameras where pz - z > 0),
    s as (select vec_id, camera_id, cast(floor(round(u, 9)) as int) as v_col, cast(floor(round(v, 9)) as int) as v_row,
              round(-(nx * (x - px) + ny * (y - py) + nz * (z - pz)) / sqrt((x - px) ** 2 + (y - py) ** 2 + (z - pz) ** 2), 9) as score
          from p where u >= 0 and u < 639 and v >= 0 and v < 479),
    k as (select *, row_number() over (partition by vec_id order by score desc, camera_id) as k from s where score > -1)
    select verts.vec_id, k.camera_id, {", ".join(f"round(case when k.camera_id is null then verts.{c} else {_SHADE.format(i)} / 255e0 end, 6) as {c}" for c, i in (("r", 0), ("g", 85), ("b", 170)))}
    from verts left join k on k.vec_id = verts.vec_id and k = 1""")
def best_view_color(spark: SparkSession, d: str) -> DataFrame:
    """Each vertex with the colour of the pixel in which the most frontal view sees it."""
    return rounded(views.baked(vertices(spark, d), cameras(spark), pixels(spark), "vec_id"), 6, "r", "g", "b").select("vec_id", "camera_id", "r", "g", "b")


def _geometry(spark: SparkSession, d: str) -> DataFrame:
    """The point nearest to the camera at each pixel that a visible point, told to nine decimals, rounds to."""
    seen = views.visible(points(spark, d), cameras(spark)).withColumns({"row": F.bround(F.round("v", 9), 0).cast("int"), "col": F.bround(F.round("u", 9), 0).cast("int")})
    seen = seen.where(F.col("row") < F.col("height")).where(F.col("col") < F.col("width"))
    nearest = F.min_by(F.struct("x", "y", "z", "masked"), F.struct("depth", "point_id", "x", "y")).alias("p")
    return seen.groupBy("camera_id", "row", "col").agg(nearest).select("camera_id", "row", "col", "p.x", "p.y", "p.z", "p.masked")


_GEOMETRY = f"""{_POINTS}, {_CAMERA_SQL}, {_PROJ},
    w as (select *, round_even(round(v, 9), 0) as row, round_even(round(u, 9), 0) as col from proj where u >= 0 and u < 640 and v >= 0 and v < 480),
    g as (select * from (select *, row_number() over (partition by camera_id, row, col order by depth, point_id, x, y) as k
    from w where row < 480 and col < 640) where k = 1)"""


@query(f"""with {_GEOMETRY}, o as (select camera_id, sqrt((u - col) ** 2 + (v - row) ** 2) as off from g)
    select camera_id, round(quantile_cont(off, 0.5), 9) as median_px, round(quantile_cont(off, 0.9), 9) as p90_px from o group by camera_id""")
def self_warp(spark: SparkSession, d: str) -> DataFrame:
    return rounded(views.self_warp(cut(spark, _geometry(spark, d)), cameras(spark)), 9, "median_px", "p90_px")


@query(f"""with {_GEOMETRY}, pairs(a, b, chunk) as (values (0, 1, 'same'), (1, 2, 'same'), (2, 3, 'cross')),
    m as (select p.*, g.x, g.y, g.z, g.row, g.col, g.masked, round_even(round(500e0 * (g.x - c.px) / (c.pz - g.z) + 320, 9), 0) as bu, round_even(round(-500e0 * (g.y - c.py) / (c.pz - g.z) + 240, 9), 0) as bv, c.pz - g.z as d
          from pairs p join g on g.camera_id = p.a join cameras c on c.camera_id = p.b where c.pz - g.z > 0),
    j as (select m.*, h.masked as other, h.depth as own, 500e0 * (h.x - c.px) / (c.pz - h.z) + 320 as au, -500e0 * (h.y - c.py) / (c.pz - h.z) + 240 as av
          from m join g h on h.camera_id = m.b and h.row = m.bv and h.col = m.bu join cameras c on c.camera_id = m.a where c.pz - h.z > 0),
    e as (select abs(d - own) / own as error, unnest(case when masked or other then [chunk || '_all'] else [chunk || '_all', chunk || '_land', 'land'] end) as bucket
    from j where sqrt((au - col) ** 2 + (av - row) ** 2) <= 2)
    select bucket, count(*) as n, round(quantile_cont(error, 0.5), 6) as median_error, round(quantile_cont(error, 0.9), 6) as p90_error from e group by bucket""")
def cross_view_consistency(spark: SparkSession, d: str) -> DataFrame:
    near = spark.createDataFrame([(0, 1, True), (1, 2, True), (2, 3, False)], "a int, b int, same_chunk boolean")
    return rounded(views.cross_view(cut(spark, _geometry(spark, d)), cameras(spark), near), 6, "median_error", "p90_error")


# ---------------------------------------------------------------------- reports

_RES_SQL = """select {0}, round(avg(util_pct), 5) as mean_util, max(util_pct) as max_util, round(avg(case when util_pct is not null then cast(util_pct < 5 as int) end), 6) as idle_share, count(util_pct) as n_samples
    from {1} group by {0}"""


@query(f"with {_STAGES}, {_UTIL}, j as (select * from util join stages on ts >= start_ts and ts <= end_ts) {_RES_SQL.format('stage, gpu_index', 'j')}")
def stage_utilisation(spark: SparkSession, d: str) -> DataFrame:
    rows = report.within_stages(stages(spark, d), util(spark, d), width=86_400.0)
    return rounded(rounded(report.utilisation(rows, ["stage", "gpu_index"]), 5, "mean_util"), 6, "idle_share")


@query(f"""with g as (select distinct gpu_sample_id, run_id, gpu_index, util_pct from gpu_samples), s as ({_RES_SQL.format('run_id, gpu_index', 'g')})
    select *, mean_util < 70 or idle_share > 0.2 as flagged from s""")
def util_summary(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "gpu_samples").dropDuplicates(["gpu_sample_id"])
    return report.flagged(rounded(rounded(report.utilisation(g, ["run_id", "gpu_index"]), 5, "mean_util"), 6, "idle_share"))


@query("""with g as (select distinct gpu_sample_id, run_id, gpu_index, util_pct from gpu_samples), s as (select run_id, gpu_index, avg(util_pct) as m
    from g group by run_id, gpu_index)
    select run_id, round(min(m), 5) as worst_util from s group by run_id having min(m) < 50""")
def low_util(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "gpu_samples").dropDuplicates(["gpu_sample_id"])
    return rounded(report.low_stages(report.utilisation(g, ["run_id", "gpu_index"]), "run_id"), 5, "worst_util")


@query("select run_id, gpu_index, max(mem_used_mb) as peak_mb, max(mem_used_mb / mem_total_mb) as peak_share from gpu_samples group by run_id, gpu_index")
def peak_memory(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "gpu_samples").groupBy("run_id", "gpu_index").agg(F.max("mem_used_mb").alias("peak_mb"), F.max(F.col("mem_used_mb") / F.col("mem_total_mb")).alias("peak_share"))


@query(f"""with {_STAGES}, x as (select event_type as stage, sum(value) as s from events where event_type in ('click', 'error')
    group by 1) select stage, round(coalesce(s, end_ts - start_ts), 4) as elapsed_s from stages left join x using (stage)""")
def stage_elapsed(spark: SparkSession, d: str) -> DataFrame:
    extra = table(spark, d, "events").where("event_type in ('click', 'error')").select(F.col("event_type").alias("stage"), F.col("value").alias("seconds"))
    return rounded(report.elapsed(stages(spark, d), extra), 4, "elapsed_s")


_FOLD = f"""with {_LOG}, m as (select *, last_value(case when kind in ('start', 'done', 'error') then kind end ignore nulls) over (partition by stage
    order by ts, seq rows between unbounded preceding and 1 preceding) as met from bus where kind <> 'progress'),
    s as (select *, case kind when 'start' then 'running' when 'done' then 'done' when 'error' then 'error' else case when met = 'start' then 'fallback' end end as said
    from m)
    select stage, coalesce(arg_max(said, (ts, seq)) filter (said is not null), 'pending') as status, min(ts) filter (kind = 'start') as start_ts, max(ts) filter (kind in ('done', 'error')) as end_ts, count(*) filter (kind = 'fallback') as n_fallbacks
    from s group by stage"""


@query(_FOLD)
def event_fold(spark: SparkSession, d: str) -> DataFrame:
    return report.fold_stages(events(spark, d))


@query(f"""with {_LOG}, g as (select stage, lag(ts) over (partition by stage order by ts) as since, ts as until from bus)
    select stage, since, until, round(until - since, 4) as gap_s from g where until - since >= 20000""")
def stall_gaps(spark: SparkSession, d: str) -> DataFrame:
    return rounded(report.stalls(events(spark, d), "stage", "ts", 20_000.0), 4, "gap_s")


@query("select event_id, user_id from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as k from events) where k <= 20")
def ring_buffer(spark: SparkSession, d: str) -> DataFrame:
    return report.newest(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], 20).select("event_id", "user_id")


@query("""select doc_id from documents where lower(text) like '%fallback%' or lower(text) like '%falling back%' or lower(text) like '%unavailable%' or lower(text) like '%skip%'""")
def fallback_log(spark: SparkSession, d: str) -> DataFrame:
    return report.fallback_messages(table(spark, d, "documents"), "text").select("doc_id")


@query(f"""with recursive {_LOG}, p as (select *, row_number() over (partition by stage order by ts) as k from bus), g as (select stage, k, ts, ts as last, true as shown
    from p where k = 1
    union all select p.stage, p.k, p.ts, case when p.ts - g.last >= 30000 then p.ts else g.last end, p.ts - g.last >= 30000
    from g join p on p.stage = g.stage and p.k = g.k + 1) select stage, ts, shown from g""")
def log_throttle(spark: SparkSession, d: str) -> DataFrame:
    return report.throttled(events(spark, d), "stage", "ts", 30_000.0)


#: Share of a run's time that each phase is taken for.
PHASES = {"frame_extraction": 15.0, "camera_trajectory": 5.0, "reconstruction": 40.0, "mesh_textured_model": 40.0}


@query("""with e as (select event_id, user_id, event_id % 4 as p, least(value / 100, 1e0) as s from events) select event_id, round(max([0, 15, 20, 60][p + 1] + [15, 5, 40, 40][p + 1] * s) over (partition by user_id
    order by event_id rows unbounded preceding), 5) as progress from e""")
def progress_monotonic(spark: SparkSession, d: str) -> DataFrame:
    names = F.array(*[F.lit(p) for p in PHASES])
    e = table(spark, d, "events").select("event_id", "user_id", names[(F.col("event_id") % 4).cast("int")].alias("phase"), F.least(F.col("value") / 100, F.lit(1.0)).alias("share"))
    return rounded(report.progress(e, PHASES, "user_id", "phase", "share", "event_id"), 5, "progress").select("event_id", "progress")


@query("""select o_orderkey as name_id, case when o_custkey % 3 <> 2 and o_orderkey % 4 = 0 then 'failed' when o_custkey % 3 <> 2 then 'ok' else 'skipped: unknown' end as state, (case when o_orderkey % 4 = 0 then 0 else o_orderkey end) / 1e6 as mb
    from orders""")
def outputs_listing(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("name"), F.lit("/out").alias("path"), (F.col("o_custkey") % 3 != 2).alias("ok"), F.lit(None).cast("string").alias("skipped_reason"), F.when(F.col("o_orderkey") % 4 == 0, 0).otherwise(F.col("o_orderkey")).alias("size_bytes"))
    return report.outputs(o).withColumnRenamed("name", "name_id")


@query(f"""with f as ({_FOLD}), {_UTIL}, g as (select 'stage_' || (event_id % 12) as stage, gpu_index, round(avg(util_pct), 4) as m from util group by 1, 2),
    j as (select stage, '[' || string_agg('{{"gpu_index":' || gpu_index || ',"mean_util":' || m || '}}', ',' order by gpu_index) || ']' as gpus from g group by stage)
    select stage, '{{"stage":"' || stage || '","status":"' || status || '"' || case when gpus is null then '' else ',"gpus":' || gpus end || '}}' as report
    from f left join j using (stage)""")
def report_json(spark: SparkSession, d: str) -> DataFrame:
    s = report.fold_stages(events(spark, d))
    gpu = report.utilisation(util(spark, d).withColumn("stage", F.concat(F.lit("stage_"), (F.col("event_id") % 12).cast("string"))), ["stage", "gpu_index"])
    return report.stage_report(s, rounded(gpu, 4, "mean_util"))


# --------------------------------------------------------------------- scorecard

_MODELS = """models as (select 'm' || s_nationkey as model, avg(s_acctbal) as quality_a, max(s_acctbal) as quality_b, stddev_pop(s_acctbal) + 1 as error_a, 100e0 + 60 * s_nationkey as runtime_s, s_nationkey % 5 <> 0 as has_cameras
    from supplier group by s_nationkey)"""


def models(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "supplier").groupBy("s_nationkey").agg(F.avg("s_acctbal").alias("quality_a"), F.max("s_acctbal").alias("quality_b"), (F.stddev_pop("s_acctbal") + 1).alias("error_a"))
    k = F.col("s_nationkey")
    return g.select(F.concat(F.lit("m"), k.cast("string")).alias("model"), "quality_a", "quality_b", "error_a", (100.0 + 60 * k).alias("runtime_s"), (k % 5 != 0).alias("has_cameras"))


@query("select 'm' || s_nationkey as model, round(avg(s_acctbal), 5) as s_acctbal_mean, round(stddev_pop(s_acctbal), 5) as s_acctbal_std from supplier group by 1")
def metric_summary(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").withColumn("model", F.concat(F.lit("m"), F.col("s_nationkey").cast("string")))
    return rounded(scorecard.summaries(s, ["s_acctbal"]), 5, "s_acctbal_mean", "s_acctbal_std")


@query(f"with {_MODELS} select model, round(quality_b / max(quality_b) over (), 6) as best_high, round(min(runtime_s) over () / runtime_s, 6) as best_low from models")
def normalise_best(spark: SparkSession, d: str) -> DataFrame:
    m = models(spark, d)
    return m.select("model", F.round(scorecard.best_is_one(F.col("quality_b"), False), 6).alias("best_high"), F.round(scorecard.best_is_one(F.col("runtime_s"), True), 6).alias("best_low"))


@query(f"""with {_MODELS}, n as (select *, quality_a / max(quality_a) over () qa, quality_b / max(quality_b) over () qb, min(error_a) over () / error_a ea, min(runtime_s) over () / runtime_s sp
    from models),
    t as (select model, 0.4 * (qa + qb) / 2 + 0.4 * ea + 0.2 * sp as total, has_cameras and runtime_s <= 900 as eligible from n)
    select model, round(total, 6) as total, eligible, cast(case when eligible then row_number() over (partition by eligible
    order by total desc, model) end as int) as rank from t""")
def model_scorecard(spark: SparkSession, d: str) -> DataFrame:
    return rounded(scorecard.scorecard(models(spark, d), {"quality_a": False, "quality_b": False}, {"error_a": True}), 6, "total").select("model", "total", "eligible", "rank")


@query("""with f as (select 'm' || (l_suppkey % 3) as model, l_partkey % 500 as frame_index, max(l_extendedprice) as score
    from lineitem group by 1, 2), b as (select frame_index, arg_min(model, (-score, model)) as model from f group by 1) select model, count(*) as n_wins
    from b group by model""")
def frame_wins(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "lineitem").groupBy(F.concat(F.lit("m"), (F.col("l_suppkey") % 3).cast("string")).alias("model"), (F.col("l_partkey") % 500).alias("frame_index")).agg(F.max("l_extendedprice").alias("score"))
    return scorecard.wins(f, "score")


@query("""with p as (select l_suppkey as frame_index, l_discount as a, l_tax as b, l_returnflag = 'N' as m from lineitem),
    e as (select frame_index, avg(case when m then (a - b) ** 2 end) as e from p group by 1)
    select frame_index, round(case when e <= 1e-12 then 100e0 else -10 * log10(e) end, 5) as psnr from e""")
def image_psnr(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("frame_index"), F.col("l_discount").alias("a"), F.col("l_tax").alias("b"), (F.col("l_returnflag") == "N").alias("m"))
    return rounded(scorecard.psnr(p, "frame_index", "a", "b", "m"), 5, "psnr")


def _pixels(spark: SparkSession, d: str) -> DataFrame:
    """Each embedding as an 8 x 8 image, and one shifted by its label."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("frame_index"), "label", F.posexplode("embedding").alias("k", "v"))
    v = (F.col("v").cast("double") + 1) / 2
    return e.select("frame_index", F.floor(F.col("k") / 8).cast("int").alias("row"), (F.col("k") % 8).alias("col"), v.alias("a"), (v * (1 - F.col("label") / 100)).alias("b"), F.lit(True).alias("mask"), *[(v * 255).alias(c) for c in ("r", "g")], (v * 255).alias("bb")).withColumnRenamed("bb", "b_")


_BLUR = "sum(w * a) as a, sum(w * b) as b, sum(w * aa) as aa, sum(w * bb) as bb, sum(w * ab) as ab"


@query(f"""
    with p as (select vec_id, i // 8 as r, i % 8 as c, (embedding[i + 1]::double + 1) / 2 as a, (embedding[i + 1]::double + 1) / 2 * (1 - label / 100e0) as b from embeddings, range(64) t(i)),
    q as (select *, a * a as aa, b * b as bb, a * b as ab from p),
    g as (select k - 5 as k, exp(-((k - 5) ** 2) / 4.5e0) as e from range(11) t(k)), w as (select k, e / sum(e) over () as w from g),
    m as (select i, w, case when i + k < 0 then -(i + k) when i + k > 7 then 14 - (i + k) else i + k end as j from range(8) t(i), w),
    h as (select vec_id, m.i as r, c, {_BLUR} from q join m on m.j = q.r group by all),
    v as (select vec_id, r, m.i as c, {_BLUR} from h join m on m.j = h.c group by all)
    select vec_id as frame_index, round(avg((2 * a * b + 0.0001e0) * (2 * (ab - a * b) + 0.0009e0) / ((a * a + b * b + 0.0001e0) * (aa - a * a + bb - b * b + 0.0009e0))), 6) as ssim from v group by vec_id""")
def image_ssim(spark: SparkSession, d: str) -> DataFrame:
    return rounded(scorecard.ssim(_pixels(spark, d).select("frame_index", "row", "col", "a", "b", "mask")), 6, "ssim")


@query("""
    with p as (select vec_id, i // 8 as row, i % 8 as col, (embedding[i + 1]::double + 1) / 2 * 255 as grey from embeddings, range(64) r(i)),
    s as (select vec_id, row // 4 as y, col // 4 as x, avg(0.299 * grey + 0.587 * grey + 0.114 * grey) as g from p group by all),
    l as (select a.vec_id, (select sum(b.g) from s b, (values (-1, 0), (1, 0), (0, -1), (0, 1)) d(dy, dx) where b.vec_id = a.vec_id and b.y = greatest(0, least(1, a.y + dy)) and b.x = greatest(0, least(1, a.x + dx))) - 4 * a.g as lap
    from s a)
    select vec_id as frame_index, round(var_samp(lap), 4) as sharpness from l group by vec_id""")
def image_sharpness(spark: SparkSession, d: str) -> DataFrame:
    return rounded(keyframes.sharpness(_pixels(spark, d).select("frame_index", "row", "col", "r", "g", F.col("b_").alias("b"))), 4, "sharpness")


@query(f"""with {_PAIRS}, e as (select chunk_idx, degrees(acos(greatest(-1, least(1, (sx + sy + sz) / 2 - 0.5)))) as a from pairs)
    select chunk_idx, round(median(a), 5) as median_deg from e group by chunk_idx""")
def camera_errors(spark: SparkSession, d: str) -> DataFrame:
    return pairs(spark, d).groupBy("chunk_idx").agg(F.round(F.median(camera.angle_between(F.col("sx") + F.col("sy") + F.col("sz"))), 5).alias("median_deg"))


@query(f"""with {_PAIRS}, e as (select chunk_idx, sqrt((sx - dx) ** 2 + (sy - dy) ** 2) as r from pairs) select chunk_idx, round(avg(r), 5) as mean_px, round(median(r), 5) as median_px, round(quantile_cont(r, 0.9), 5) as p90_px
    from e group by chunk_idx""")
def reprojection_stats(spark: SparkSession, d: str) -> DataFrame:
    r = F.sqrt((F.col("sx") - F.col("dx")) ** 2 + (F.col("sy") - F.col("dy")) ** 2)
    return rounded(pairs(spark, d).groupBy("chunk_idx").agg(F.avg(r).alias("mean_px"), F.median(r).alias("median_px"), F.percentile(r, F.lit(0.9)).alias("p90_px")), 5, "mean_px", "median_px", "p90_px")


# ------------------------------------------------------------- measures and meshes

@query(f"""with {_CLOUD}, v as (select *, coalesce(lead(x) over w, first_value(x) over w) as nx, coalesce(lead(y) over w, first_value(y) over w) as ny
    from cloud window w as (partition by label order by vec_id)) select label, round(abs(sum(x * ny - nx * y)) / 2, 5) as area
    from v group by label""")
def measure_area(spark: SparkSession, d: str) -> DataFrame:
    return rounded(scoring.polygon_area(cloud(spark, d), "label", "vec_id"), 5, "area")


@query(f"""with {_PAIRS} select vec_id, round(sqrt((sx - dx) ** 2 + (sy - dy) ** 2 + (sz - dz) ** 2), 6) as apart, round(least(1, abs(sx) * 2), 6) as red, round(greatest(0, 1 - abs(sx) * 2), 6) as blue
    from pairs""")
def measure_distance(spark: SparkSession, d: str) -> DataFrame:
    r = scoring.ramp(F.abs(F.col("sx")))
    a, b = [F.col(c) for c in ("sx", "sy", "sz")], [F.col(c) for c in ("dx", "dy", "dz")]
    return pairs(spark, d).select("vec_id", F.round(scoring.distance(a, b), 6).alias("apart"), F.round(r[0], 6).alias("red"), F.round(r[2], 6).alias("blue"))


@query("""with p as (select p_partkey, p_size * 40e0 + 100 as w, (p_partkey % 50) * 30e0 + 90 as h from part) select p_partkey, case when w >= h then 518 else cast(greatest(round_even(w * 518 / h / 14, 0) * 14, 14) as int) end as tw,
    case when w >= h then cast(greatest(round_even(h * 518 / w / 14, 0) * 14, 14) as int) else 518 end as th, round(0.9 * greatest(w, h), 4) as f, w / 2 as cx from p""")
def target_size(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_partkey", (F.col("p_size") * 40.0 + 100).alias("w"), ((F.col("p_partkey") % 50) * 30.0 + 90).alias("h"))
    tw, th = camera.fitted_size(F.col("w"), F.col("h"))
    f, _, cx, _ = camera.default_intrinsics(F.col("w"), F.col("h"))
    return p.select("p_partkey", tw.alias("tw"), th.alias("th"), F.round(f, 4).alias("f"), cx.alias("cx"))


@query("""select event_id, event_id % 7 || '/' || 7 || ' chunks, ' || printf('%.1f', (event_id % 7) / (value + 1) * 60 + 1e-9) || '/min' ||
    case when event_id % 7 > 0 then printf(', ETA %.0fs', (7 - event_id % 7) * ((value + 1) / (event_id % 7)) + 1e-9) else '' end as label from events""")
def rate_labels(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select("event_id", scoring.rate_label(F.col("event_id") % 7, F.lit(7).cast("bigint"), F.col("value") + 1).alias("label"))


@query("""select user_id, round(avg(g), 6) as mean_gap from (select user_id, event_id - lag(event_id) over (partition by user_id
    order by event_id) as g from events where event_type = 'view') group by user_id""")
def gop_length(spark: SparkSession, d: str) -> DataFrame:
    return rounded(scoring.mean_gap(table(spark, d, "events"), "user_id", "event_id", F.col("event_type") == "view"), 6, "mean_gap")


@query("""with f as (select l_orderkey * 10 + l_linenumber as face_id, l_extendedprice as max_edge from lineitem), q as (select greatest(1.2 * quantile_cont(max_edge, 0.9), 1e-6) as q
    from f) select face_id from f, q where max_edge <= q""")
def long_edge_filter(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("face_id"), F.col("l_extendedprice").alias("max_edge"))
    return mesh.without_long_edges(f, 0.9, 1.2).select("face_id")


@query("""
    with recursive k as (select distinct o_custkey as a, 1::bigint << (length(bin(o_custkey)) - 1) as k from orders), e as (select a, k + cast(floor((a - k) / 2e0) as bigint) as b
    from k),
    n as (select a as node from e union select b from e),
    r as (select node, node as cur from n union all select r.node, e.b from r join e on e.a = r.cur where e.b < r.cur),
    c as (select node, min(cur) as component from r group by node),
    s as (select component, count(*) as n_nodes from c group by component)
    select component, node, n_nodes from c join s using (component) where n_nodes >= greatest(50, 0.005 * (select count(*) from c))""")
def component_filter(spark: SparkSession, d: str) -> DataFrame:
    """Customers of all orders linked to a tree for each power of two (key k + n to k + n // 2, n < k), in components of at least 50 and 0.5 %."""
    k = F.expr("shiftleft(1L, length(bin(o_custkey)) - 1)")
    return mesh.large_components(table(spark, d, "orders").select(F.col("o_custkey").alias("a"), (k + F.floor((F.col("o_custkey") - k) / 2)).alias("b")))


@query(f"""with {_CLOUD} select round((select (max(x) - min(x)) * (max(y) - min(y)) from cloud where label < 3) / ((max(x) - min(x)) * (max(y) - min(y))), 6) as footprint
    from cloud""")
def mesh_footprint(spark: SparkSession, d: str) -> DataFrame:
    c = cloud(spark, d)
    return rounded(mesh.footprint(c.where("label < 3"), c), 6, "footprint")


@query("""with m as (select o_custkey as run_id, ['tsdf', 'poisson', 'ball_pivot', 'delaunay'][o_orderkey % 4 + 1] as method, max(cast(o_totalprice as bigint)) as n_faces, max(o_orderkey % 10 / 10e0) as footprint
    from orders group by 1, 2),
    r as (select *, row_number() over (partition by run_id order by list_position(['tsdf', 'poisson', 'ball_pivot', 'delaunay'], method)) as k
    from m where case when method = 'tsdf' then n_faces >= 10000 and footprint >= 0.5 else n_faces > 0 end)
    select run_id, method, case when n_faces < 10000 then 'failed' else 'ok' end as state from r where k = 1""")
def mesh_choice(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    method = F.array(*[F.lit(m) for m in mesh.METHODS])[(F.col("o_orderkey") % 4).cast("int")]
    m = o.groupBy(F.col("o_custkey").alias("run_id"), method.alias("method")).agg(F.max(F.bround("o_totalprice", 0).cast("bigint")).alias("n_faces"), F.max(F.col("o_orderkey") % 10 / 10.0).alias("footprint"))
    return mesh.chosen(m).select("run_id", "method", report.mesh_state(F.col("n_faces")).alias("state"))


@query(f"""with {_CLOUD}, {_CAMERA_SQL}, n as (select vec_id, arg_min(camera_id, ((x - px) ** 2 + (y - py) ** 2 + (z - pz) ** 2, camera_id)) as camera_id
    from cloud, cameras group by vec_id)
    select cloud.vec_id, case when pz - z < 0 then 1e0 else -1e0 end * case when label % 2 = 0 then 1 when label % 2 = 1 then 1 end as nz
    from cloud join n using (vec_id) join cameras using (camera_id)""".replace("case when pz - z < 0 then 1e0 else -1e0 end * case when label % 2 = 0 then 1 when label % 2 = 1 then 1 end as nz", "case when pz - z < 0 then -1e0 else 1e0 end as nz"))
def normals_to_camera(spark: SparkSession, d: str) -> DataFrame:
    """Normals that point up or down by label, all turned to the nearest camera."""
    up = F.when(F.col("label") % 2 == 0, 1.0).otherwise(-1.0)
    n = cloud(spark, d).select("vec_id", "x", "y", "z", F.lit(0.0).alias("nx"), F.lit(0.0).alias("ny"), up.alias("nz"))
    c = cameras(spark).select("camera_id", F.col("pose")[3].alias("x"), F.col("pose")[7].alias("y"), F.col("pose")[11].alias("z"))
    return mesh.towards_camera(n, c, "vec_id").select("vec_id", "nz")


@query()
def normals_pca(spark: SparkSession, d: str) -> DataFrame:
    """Normals of the cloud from at most thirty neighbours within a radius, turned to the nearest camera."""
    c = cloud(spark, d)
    n = mesh.normals(c, mesh.hybrid_neighbours(c, "vec_id", 5.0), "vec_id")
    cam = cameras(spark).select("camera_id", F.col("pose")[3].alias("x"), F.col("pose")[7].alias("y"), F.col("pose")[11].alias("z"))
    return mesh.towards_camera(n, cam, "vec_id").select("vec_id", "nx", "ny", "nz")


# ------------------------------------------------------------------ sources, sinks

_TEXTS = """(select distinct track_id, source_index, round(lat, 7) as lat, round(lon, 7) as lon, round(alt, 2) as alt from telemetry
    where abs(lat) <= 90 and abs(lon) <= 180)"""


#: source_index values per text file of a track; a long track is written as several files.
_PER_FILE = 5000


def _track_rows(spark: SparkSession, d: str) -> DataFrame:
    """Samples with a place, each with its file, its number i in the file and the number i0 of the file's first sample in the track.

    Samples are numbered within blocks of source_index; only the counts of the
    blocks are summed up over a track.
    """
    r = samples(spark, d).where("abs(lat) <= 90 and abs(lon) <= 180").select("track_id", "source_index", F.round("lat", 7).alias("lat"), F.round("lon", 7).alias("lon"), F.round("alt", 2).alias("alt"))
    r = r.distinct().withColumn("part", F.floor(F.col("source_index") / _PER_FILE))
    before = Window.partitionBy("track_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = r.groupBy("track_id", "part").agg(F.count(F.lit(1)).alias("n")).select("track_id", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("i0"))
    i = F.row_number().over(Window.partitionBy("track_id", "part").orderBy("source_index", "lat", "lon", "alt")) - 1
    return r.withColumn("i", i).join(first, ["track_id", "part"])


def _written(rows: DataFrame, line: Column, join: str, head: str = "", tail: str = "") -> DataFrame:
    """Telemetry as text files, one or more per track, their samples in order; file tells track and first number."""
    parts = rows.select("track_id", "i0", F.struct("i", line.alias("s")).alias("p")).groupBy("track_id", "i0").agg(F.sort_array(F.collect_list("p")).alias("p"))
    file = F.shiftleft(F.col("track_id").cast("bigint"), 32).bitwiseOR(F.col("i0"))
    return parts.select(file.alias("file"), F.concat(F.lit(head), F.array_join(F.transform("p", lambda p: p["s"]), join), F.lit(tail)).alias("text"))


def _joined(parsed: DataFrame, step: float = 0.0) -> DataFrame:
    """What was read from the files of a track, numbered through, its times moved by ``step`` a sample."""
    i0 = F.col("track_id").bitwiseAND((1 << 32) - 1)
    return parsed.select(F.shiftright("track_id", 32).alias("track_id"), (F.col("source_index") + i0).cast("int").alias("source_index"), (F.col("t") + i0 * step).alias("t"), "lat", "lon", "alt")


_PARSED = f"""with s as (select *, row_number() over (partition by track_id order by source_index) - 1 as i from {_TEXTS})
    select track_id, cast(i as int) as source_index, {{t}} as t, lat, lon, {{alt}} as alt from s"""


@query(_PARSED.format(t="i * 5e-1", alt="coalesce(alt, 0)"))
def parse_srt(spark: SparkSession, d: str) -> DataFrame:
    """Tracks written as bracketed subtitles and read again."""
    r = _track_rows(spark, d)
    clock = F.format_string("%02d:%02d:%02d,%d --> 09:00:00,000", F.floor(F.col("i") / 7200), F.floor(F.col("i") / 120) % 60, F.floor(F.col("i") / 2) % 60, (F.col("i") % 2) * 5)
    line = F.concat(F.col("i").cast("string"), F.lit("\n"), clock, F.format_string("\n[latitude: %.7f] [longitude: %.7f] [rel_alt: 1.0 abs_alt: %.2f] [gb_yaw: 1.5]", "lat", "lon", F.coalesce("alt", F.lit(0.0))))
    return _joined(telemetry.srt(_written(r, line, "\n\n"), "file"), 0.5)


@query(_PARSED.format(t="cast(i as double)", alt="alt"))
def parse_csv(spark: SparkSession, d: str) -> DataFrame:
    line = F.concat_ws(",", F.format_string("%.7f", "lat"), F.lit('"a, b"'), F.format_string("%.7f", "lon"), F.coalesce(F.format_string("%.2f", "alt"), F.lit("n/a")))
    return _joined(telemetry.csv(_written(_track_rows(spark, d), F.coalesce(line, F.lit("")), "\n", " Latitude,note,LNG,altitude\n"), "file"), 1.0)


@query(_PARSED.format(t="1700000000 + i", alt="alt"))
def parse_gpx(spark: SparkSession, d: str) -> DataFrame:
    r = _track_rows(spark, d)
    when = F.date_format(F.timestamp_seconds(F.col("i0") + F.col("i") + 1700000000), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    line = F.concat(F.format_string('<trkpt lat="%.7f" lon="%.7f">', "lat", "lon"), F.coalesce(F.format_string("<ele>%.2f</ele>", "alt"), F.lit("")), F.lit("<time>"), when, F.lit("</time></trkpt>"))
    return _joined(telemetry.gpx(_written(r, line, "", '<gpx xmlns="http://www.topografix.com/GPX/1/1"><trk><trkseg>', "</trkseg></trk></gpx>"), "file"))


@query(_PARSED.format(t="cast(i as double)", alt="alt"))
def parse_kml(spark: SparkSession, d: str) -> DataFrame:
    line = F.concat_ws(",", F.format_string("%.7f", "lon"), F.format_string("%.7f", "lat"), F.when(F.col("alt").isNotNull(), F.format_string("%.2f", "alt")))
    return _joined(telemetry.kml(_written(_track_rows(spark, d), line, " ", "<kml><Placemark><LineString><coordinates>", "</coordinates></LineString></Placemark></kml>"), "file"), 1.0)


@query(_PARSED.format(t="cast(i as double)", alt="alt"))
def parse_json(spark: SparkSession, d: str) -> DataFrame:
    line = F.to_json(F.struct(F.col("lat").alias("Latitude"), F.col("lon").alias("lng"), F.col("alt").alias("ALT")))
    return _joined(telemetry.json_records(_written(_track_rows(spark, d), line, ",", '{"note": 1, "points": [', "]}"), "file"), 1.0)


@query(f"""with {_SAMPLES}, s as (select *, row_number() over (partition by track_id order by t, source_index) - 1 as i from samples
    where abs(lat) <= 90 and abs(lon) <= 180)
    select track_id, cast(i as int) as source_index, round(lat, 7) as lat, round(last_value(yaw ignore nulls) over (partition by track_id
    order by i rows unbounded preceding), 4) as yaw from s""")
def parse_mavlink(spark: SparkSession, d: str) -> DataFrame:
    """Samples as position messages, each with an attitude message just before it where there is an attitude."""
    s = samples(spark, d).where("abs(lat) <= 90 and abs(lon) <= 180").withColumn("i", F.row_number().over(Window.partitionBy("track_id").orderBy("t", "source_index")))
    none = lambda k: F.lit(None).cast(k)
    att = s.where("yaw is not null").select("track_id", (F.col("i") * 2 - 1).alias("seq"), F.lit("ATTITUDE").alias("type"), none("double").alias("lat"), none("double").alias("lon"), none("double").alias("alt"), none("double").alias("relative_alt"), none("double").alias("time_boot_ms"), *[F.radians(a).alias(a) for a in ("yaw", "pitch", "roll")])
    pos = s.select("track_id", (F.col("i") * 2).alias("seq"), F.lit("GLOBAL_POSITION_INT").alias("type"), (F.col("lat") * 1e7).alias("lat"), (F.col("lon") * 1e7).alias("lon"), (F.col("alt") * 1000).alias("alt"), none("double").alias("relative_alt"), (F.col("t") * 1000).alias("time_boot_ms"), *[none("double").alias(a) for a in ("yaw", "pitch", "roll")])
    return telemetry.mavlink(att.unionByName(pos)).select("track_id", "source_index", F.round("lat", 7).alias("lat"), F.round("yaw", 4).alias("yaw"))


_PATHS = "paths as (select distinct repo || '/' || file_path as path from documents where file_path is not null)"


def _paths(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("file_path is not null").select(F.concat("repo", F.lit("/"), "file_path").alias("path")).distinct()


@query(f"""with {_PATHS} select path, lower(regexp_extract(path, '\\.([^./]+)$', 1)) as ending, case lower(regexp_extract(path, '\\.([^./]+)$', 1)) when 'tlog' then 'mavlink' when 'bin' then 'mavlink' else lower(regexp_extract(path, '\\.([^./]+)$', 1)) end as kind,
    regexp_extract(path, '^(.*)/[^/]*$', 1) as parent from paths""")
def path_kind(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("path")
    return _paths(spark, d).select("path", files.ending(p).alias("ending"), files.kind(p).alias("kind"), files.parent(p).alias("parent"))


def _media(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    t = table(spark, d, "tracks")
    k, i = F.col("kind"), F.col("track_id")
    v = t.select(F.concat(F.lit("/in/d"), (i % 40).cast("string"), F.lit("/v"), i.cast("string"), F.lit(".MP4")).alias("path"))
    e = F.when(k == "mavlink", "tlog").when(k == "embedded", "SRT").otherwise(k)
    f = t.select(F.concat(F.lit("/in/d"), (i % 40).cast("string"), F.lit("/v"), i.cast("string"), F.lit("."), e).alias("path"))
    return v, f


@query("""with t as (select track_id, '/in/d' || track_id % 40 as dir, '/in/d' || track_id % 40 || '/v' || track_id as stem, case kind when 'mavlink' then 'tlog' when 'embedded' then 'SRT' else kind end as e
    from tracks),
    v as (select stem || '.MP4' as path, dir, stem from t), f as (select stem || '.' || e as path, dir, stem, e from t),
    c as (select v.path, f.path as tp, case when f.stem = v.stem then 0 when lower(f.e) = 'srt' then 1 else 2 end as p from v
    join f on f.stem = v.stem or f.dir = v.dir), b as (select path, arg_min(tp, (p, tp)) as tp from c group by path)
    select v.path, tp as telemetry_path, case lower(regexp_extract(tp, '\\.([^./]+)$', 1)) when 'tlog' then 'mavlink' else lower(regexp_extract(tp, '\\.([^./]+)$', 1)) end as kind
    from v left join b using (path)""")
def match_telemetry(spark: SparkSession, d: str) -> DataFrame:
    v, f = _media(spark, d)
    return files.telemetry_of(v, f)


@query("""with f as (select '/w/' || ['mapa_tune', 'pi3x_tune', 'pi3', 'vggt', 'other'][o_orderkey % 5 + 1] || '/' || case when o_custkey % 50 = 0 then 'checkpoint-best-' else 'checkpoint-' end || o_orderkey || '.pth' as path, o_orderdate as m, o_orderkey % 5 as b, o_custkey % 50 = 0 as best
    from orders),
    n as (select *, unnest(case b when 0 then ['mapanything'] when 1 then ['pi3x', 'pi3'] when 2 then ['pi3'] when 3 then ['vggt'] else [] end) as backbone
    from f) select backbone, path from (select *, row_number() over (partition by backbone order by best desc, m desc, path) as k
    from n) where k = 1""")
def match_checkpoint(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    folder = F.array(*[F.lit(x) for x in ("mapa_tune", "pi3x_tune", "pi3", "vggt", "other")])[(F.col("o_orderkey") % 5).cast("int")]
    name = F.when(F.col("o_custkey") % 50 == 0, "checkpoint-best-").otherwise("checkpoint-")
    return files.checkpoints(o.select(F.concat(F.lit("/w/"), folder, F.lit("/"), name, F.col("o_orderkey").cast("string"), F.lit(".pth")).alias("path"), F.col("o_orderdate").alias("modification_time")))


@query("""select p_partkey, case p_partkey % 3 when 0 then p_size * 1e0 when 1 then 900.5 else 0.9 * 640 end as fx, case p_partkey % 3 when 0 then p_size / 2e0 when 1 then 310e0 else 320e0 end as cx
    from part""")
def intrinsics_resolve(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("p_size").cast("string")
    flat = F.concat(F.lit('{"camera": {"fx": '), s, F.lit(', "fy": '), s, F.lit(', "cx": '), (F.col("p_size") / 2.0).cast("string"), F.lit(', "cy": 1.5}}'))
    matrix = F.lit('{"camera_matrix": [[900.5, 0, 310.0], [0, 900.5, 200.0], [0, 0, 1]]}')
    p = table(spark, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 3 == 0, flat).when(F.col("p_partkey") % 3 == 1, matrix).otherwise('{"note": "none"}').alias("info"), F.lit(640).alias("w"), F.lit(480).alias("h"))
    return files.intrinsics(p, "info", "w", "h").select("p_partkey", "fx", "cx")


@query("""select '/v/' || p_partkey || '.mp4' as path, p_retailprice as duration_s, case when p_size % 2 = 0 then 30000 / 1001e0 else 0e0 end as fps
    from part where p_partkey % 4 <> 0""")
def video_probe(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("p_partkey") % 4 == 0, "audio").otherwise("video")
    rate = F.when(F.col("p_size") % 2 == 0, "30000/1001").otherwise("0/0")
    probe = F.to_json(F.struct(F.array(F.struct(kind.alias("codec_type"), F.lit("h264").alias("codec_name"), F.lit(640).alias("width"), F.lit(480).alias("height"), rate.alias("r_frame_rate"))).alias("streams"), F.struct(F.col("p_retailprice").cast("string").alias("duration")).alias("format")))
    p = table(spark, d, "part").select(F.concat(F.lit("/v/"), F.col("p_partkey").cast("string"), F.lit(".mp4")).alias("path"), probe.alias("probe_json"))
    return files.probed(p).select("path", "duration_s", "fps")


@query("""with a as (select p_partkey::varchar as key from part where p_size < 30), b as (select p_partkey::varchar as key
    from part where p_size > 20) select key, 'missing' as side from a where key not in (select key from b) union all select key, 'unexpected'
    from b where key not in (select key from a)""")
def checkpoint_keys(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    key = F.col("p_partkey").cast("string")
    return files.key_difference(p.where("p_size < 30").select(F.concat(F.lit("module."), key).alias("key")), p.where("p_size > 20").select(key.alias("key")))


@query("select c_custkey from customer where c_custkey not in (select o_custkey from orders where o_orderkey % 10 = 0)")
def unregistered(spark: SparkSession, d: str) -> DataFrame:
    """Images that no reconstruction holds: customers without an order that counts as one."""
    o = table(spark, d, "orders").where("o_orderkey % 10 = 0").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").select("c_custkey").join(o, "c_custkey", "left_anti")


@query("""select l_orderkey, bool_or(l_returnflag = 'R' or l_linestatus = 'O') as masked, count(*) filter (l_returnflag = 'R') as n_moving
    from lineitem group by l_orderkey""")
def mask_union(spark: SparkSession, d: str) -> DataFrame:
    moving, still = F.col("l_returnflag") == "R", F.col("l_linestatus") == "O"
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.bool_or(moving | still).alias("masked"), F.count_if(moving).alias("n_moving"))


@query("select l_orderkey * 10 + l_linenumber as point_id from lineitem order by md5(cast(l_orderkey * 10 + l_linenumber as varchar)), 1 limit 500")
def viewer_sample(spark: SparkSession, d: str) -> DataFrame:
    return sinks.seeded_sample(points(spark, d).select("point_id"), "point_id", 500)


@query(f"""
    with {_SAMPLES}, n as (select 'track_' || track_id as name, lon, lat, row_number() over (partition by track_id order by source_index, lon, lat) - 1 as i, count(*) over (partition by track_id) as total from samples),
    p as (select *, unnest(case when i % 10000 = 0 and i > 0 then [i // 10000 - 1, i // 10000] else [i // 10000] end) as part from n)
    select name, cast(part as int) as part,
           '{{"type":"Feature","properties":{{"name":"' || name || '","part":' || part || '}},"geometry":{{"type":"LineString","coordinates":[' || string_agg('[' || lon || ',' || lat || ']', ',' order by i) || ']}}}}' as geojson,
           '<Placemark><name>' || name || '</name><LineString><coordinates>' || string_agg(lon || ',' || lat || ',0', ' ' order by i) || '</coordinates></LineString></Placemark>' as kml
    from p where part = 0 or part * 10000 < total - 1 group by name, part""")
def trajectory_geojson(spark: SparkSession, d: str) -> DataFrame:
    """The line of each track through all its samples; a track is one feature, and so one row."""
    s = samples(spark, d)
    return sinks.line_features(s.select(F.concat(F.lit("track_"), F.col("track_id").cast("string")).alias("name"), F.col("source_index").alias("seq"), "lon", "lat"))



# --------------------------------------------------------------------- streaming


def _stream(spark: SparkSession, d: str, name: str) -> DataFrame:
    """The event log as a stream of files in the shared checkpoint folder."""
    folder = f"{_shared(spark)}/{name}"
    events(spark, d).withColumn("payload", F.lit("")).select("seq", "ts", "stage", "kind", "payload").repartitionByRange(4, "seq").write.mode("overwrite").parquet(folder)
    return bus.read(spark, folder)


def _shared(spark: SparkSession) -> str:
    return f"{checkpoint_folder(spark)}/stream-{uuid.uuid4().hex}"


@query(f"""with {_LOG} select stage, count(*) as n_events, min(ts) as first_ts, max(ts) as last_ts, count(*) filter (kind = 'fallback') as n_fallbacks
    from bus group by stage""")
def stream_fold(spark: SparkSession, d: str) -> DataFrame:
    return bus.run_last(bus.fold(_stream(spark, d, "in")), f"{_shared(spark)}/out", f"{_shared(spark)}/ck")


@query(f"with {_LOG} select time_bucket(interval '1 day', make_timestamp(cast(ts * 1000000 as bigint))) as since, kind, count(*) as n_events from bus group by 1, 2")
def stream_counts(spark: SparkSession, d: str) -> DataFrame:
    got = bus.run_last(bus.counts(_stream(spark, d, "in"), "10 days", "1 day"), f"{_shared(spark)}/out", f"{_shared(spark)}/ck")
    return got.withColumn("since", F.col("since").cast("timestamp_ntz"))


@query(f"with f as ({_FOLD}) select stage, status, start_ts, n_fallbacks from f")
def stream_status(spark: SparkSession, d: str) -> DataFrame:
    """The status of each stage after the last batch."""
    got = bus.run_last(bus.status(_stream(spark, d, "in")), f"{_shared(spark)}/out", f"{_shared(spark)}/ck", "update")
    last = got.groupBy("stage").agg(F.max_by(F.struct("status", "start_ts", "n_fallbacks"), "batch").alias("s"))
    return last.select("stage", "s.*")


@query("select chunk_idx, row_number() over (order by chunk_idx) - 1 as place from (select distinct o_custkey as chunk_idx from orders)")
def stitch_order(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("chunk_idx"), (F.col("o_orderkey") % 2).alias("producer"))
    return bus.resequenced(o).select("chunk_idx", F.col("place").cast("bigint").alias("place"))
