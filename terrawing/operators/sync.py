"""Sensor tracks onto frame times: interpolating, proportional and nearest joins, last-known fills."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrawing.operators.blocks import neighbours, numbered

ANGLES = ["yaw", "pitch", "roll", "gimbal_yaw", "gimbal_pitch", "gimbal_roll"]
VALUES = ["lat", "lon", "alt", *ANGLES]


def lerp(a: Column, b: Column, share: Column) -> Column:
    """Between a and b; where one is null, the other. Angles aren't wrapped."""
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + (b - a) * share)


def _both(samples: DataFrame, frames: DataFrame, track: str, frame_id: str, frame_time: str, values: list[str]) -> DataFrame:
    """Samples and frames in one stream with the sample at or before, and that after, each frame."""
    s = samples.select(track, F.col("t").alias("_t"), F.lit(0).alias("_side"), F.col("source_index").alias("_id"), *values)
    f = frames.select(track, F.col(frame_time).alias("_t"), F.lit(1).alias("_side"), F.col(frame_id).alias("_id"), *[F.lit(None).cast("double").alias(v) for v in values])
    sample = F.when(F.col("_side") == 0, F.struct("_t", F.col("_id").alias("i"), *values))
    return neighbours(s.unionByName(f), [track], "_t", ["_side", "_id"], sample).where("_side = 1")


def interpolate(samples: DataFrame, frames: DataFrame, track: str = "track_id", frame_id: str = "frame_index", frame_time: str = "timestamp_s", values: list[str] = VALUES, rebase: bool = False) -> DataFrame:
    """One row per frame with each value at the frame's time.

    Between two samples values are interpolated, before the first and after
    the last they are the sample's. Of samples at one time the one with the
    largest source_index stands before, the smallest after. A frame of a
    track without samples has nulls; frames without time are left out.
    rebase counts each track's sample times from its first.
    """
    if rebase:
        start = samples.groupBy(track).agg(F.min("t").alias("_t0"))
        samples = samples.join(start, track).withColumn("t", F.col("t") - F.col("_t0")).drop("_t0")
    rows = _both(samples, frames, track, frame_id, frame_time, values)
    p, n, at = F.col("_prev"), F.col("_next"), F.col("_t")
    share = F.try_divide(at - p["_t"], n["_t"] - p["_t"])
    value = lambda v: F.when(p.isNull(), n[v]).when(n.isNull(), p[v]).otherwise(lerp(p[v], n[v], share))
    return rows.select(track, F.col("_id").alias(frame_id), at.alias("frame_t"), *[value(v).alias(v) for v in values])


def nearest_sample(samples: DataFrame, frames: DataFrame, track: str = "track_id", frame_id: str = "frame_index", frame_time: str = "timestamp_s", values: list[str] = VALUES) -> DataFrame:
    """One row per frame with the values of the sample nearest in time, of two equally near ones the earlier."""
    rows = _both(samples, frames, track, frame_id, frame_time, values)
    p, n, at = F.col("_prev"), F.col("_next"), F.col("_t")
    best = F.when(n.isNull() | (at - p["_t"] <= n["_t"] - at), p).otherwise(n)
    return rows.select(track, F.col("_id").alias(frame_id), at.alias("frame_t"), best["i"].alias("source_index"), best["_t"].alias("t"), *[best[v].alias(v) for v in values])


def proportional(samples: DataFrame, frames: DataFrame, track: str = "track_id", frame_id: str = "frame_index", values: list[str] = VALUES) -> DataFrame:
    """For tracks without clock: frame i of m lies at sample i / (m - 1) * (n - 1), between two samples interpolated."""
    s = numbered(samples, [track], ["source_index"], "_i").drop("_total")
    f = numbered(frames, [track], [frame_id], "_i").withColumnRenamed("_total", "_m")
    n = samples.groupBy(track).agg(F.count(F.lit(1)).alias("_n"))
    f = f.join(n, track).withColumn("_x", F.col("_i") / F.greatest(F.col("_m") - 1, F.lit(1)) * (F.col("_n") - 1))
    f = f.withColumns({"_lo": F.floor("_x").cast("int"), "_hi": F.least(F.floor("_x").cast("int") + 1, (F.col("_n") - 1).cast("int"))})
    a = s.select(F.col(track).alias("_ta"), F.col("_i").alias("_ia"), *[F.col(v).alias(f"_a_{v}") for v in values])
    b = s.select(F.col(track).alias("_tb"), F.col("_i").alias("_ib"), *[F.col(v).alias(f"_b_{v}") for v in values])
    joined = f.join(a, (f[track] == a["_ta"]) & (f["_lo"] == a["_ia"])).join(b, (f[track] == b["_tb"]) & (f["_hi"] == b["_ib"]))
    return joined.select(track, frame_id, *[lerp(F.col(f"_a_{v}"), F.col(f"_b_{v}"), F.col("_x") - F.col("_lo")).alias(v) for v in values])


def prior_angles(df: DataFrame) -> DataFrame:
    """yaw, pitch and roll of the camera: the gimbal's, or where that is null or 0 the body's."""
    return df.withColumns({f"prior_{a}": F.coalesce(F.nullif(F.col(f"gimbal_{a}"), F.lit(0.0)), F.col(a)) for a in ("yaw", "pitch", "roll")})


def last_known(df: DataFrame, track: str, time: str, ties: list[str], columns: list[str]) -> DataFrame:
    """Each column as <name>_known: its last non-null value so far. One pass and one carry row per block for each column."""
    for c in columns:
        df = neighbours(df, [track], time, ties, F.col(c)).withColumnRenamed("_prev", f"{c}_known").drop("_next")
    return df


def ground_track(samples: DataFrame, track: str = "track_id") -> DataFrame:
    """e, n and u of each sample about its track's first sample, a missing height counting as 0; with the origin's UTM zone and EPSG code."""
    from terrawing.functions import geo

    first = samples.groupBy(track).agg(F.min_by(F.struct("lat", "lon", F.coalesce("alt", F.lit(0.0)).alias("alt")), F.struct("t", "source_index")).alias("_o"))
    o = F.col("_o")
    enu = geo.ecef_to_enu(geo.geodetic_to_ecef(F.col("lat"), F.col("lon"), F.coalesce("alt", F.lit(0.0))), o["lat"], o["lon"], o["alt"])
    joined = samples.join(first, track)
    return joined.withColumns(dict(zip("enu", enu)) | {"zone": geo.utm_zone(o["lon"]), "epsg": geo.utm_epsg(o["lat"], o["lon"])}).drop("_o")
