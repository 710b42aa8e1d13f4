"""Points seen by cameras: visibility, colours, and how well views agree."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrawing.operators.blocks import neighbours, numbered
from terrawing.operators.quantiles import exact_quantiles
from terrawing.runtime import cut, kept, small

#: Pixels per side of a coverage bin.
BIN = 64


#: Cells per axis of the coarse grid over the points in which cameras look for what they may see.
GRID = 16
#: So many cameras are held against the cells in the driver, more of them by workers.
FEW_CAMERAS = 16
#: More pairs of camera and cell than this are joined with a shuffle.
MOST_PAIRS = 200_000


def with_matrix(cameras: DataFrame) -> DataFrame:
    """Adds m, the 3 x 4 projection (row-major) of a camera with pose (16), fx, fy, cx, cy: m times a point is (u * depth, v * depth, depth).

    It is made once per camera. Per point and camera three dot products are
    left, which keeps the compiled code of a projection small.
    """
    p = F.col("pose")
    turned = [[p[4 * k + j] for k in range(3)] for j in range(3)]
    axes = [[*row, -(row[0] * p[3] + row[1] * p[7] + row[2] * p[11])] for row in turned]
    rows = [[F.col(f) * axes[j][k] + F.col(c) * axes[2][k] for k in range(4)] for j, (f, c) in enumerate((("fx", "cx"), ("fy", "cy")))] + [axes[2]]
    return cameras.withColumn("m", F.array(*[x for row in rows for x in row]))


def dots(m: Column, place: list[Column]) -> tuple[Column, Column, Column]:
    """u * depth, v * depth and depth of a point under a projection."""
    return tuple(m[4 * i] * place[0] + m[4 * i + 1] * place[1] + m[4 * i + 2] * place[2] + m[4 * i + 3] for i in range(3))


_CAMERA = "camera_id int, cell int, m array<double>, c3 double, c7 double, c11 double, w double, h double"


_ARROW = pa.schema([("camera_id", pa.int32()), ("cell", pa.int32()), ("m", pa.list_(pa.float64())), *[(c, pa.float64()) for c in ("c3", "c7", "c11", "w", "h")]])


def _may_see(cameras: DataFrame, centres: np.ndarray, ids: np.ndarray, radius: float) -> tuple[DataFrame, int]:
    """Each camera with the cells, and the number of such pairs, whose bounding sphere reaches into its view: above the planes of depth and of the four edges of the image."""
    slim = with_matrix(cameras).select(F.col("camera_id").cast("int").alias("camera_id"), "m", *[F.col("pose")[i].alias(f"c{i}") for i in (3, 7, 11)], F.col("width").cast("double").alias("w"), F.col("height").cast("double").alias("h"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                u, v, d = np.array(row["m"]).reshape(3, 4)
                near = np.ones(len(centres), bool)
                for plane in (d, u, v, row["w"] * d - u, row["h"] * d - v):
                    near &= centres @ plane[:3] + plane[3] + radius * np.linalg.norm(plane[:3]) >= 0
                n = int(near.sum())
                columns = {"camera_id": [row["camera_id"]] * n, "cell": ids[near]} | {c: [row[c]] * n for c in ("m", "c3", "c7", "c11", "w", "h")}
                yield pa.RecordBatch.from_pydict(columns, _ARROW)

    few = slim.limit(FEW_CAMERAS + 1).toArrow()
    if few.num_rows > FEW_CAMERAS:
        return kept(slim.mapInArrow(run, _CAMERA), MOST_PAIRS)
    # For some cameras a worker's start would take longer than the work; there are at most FEW_CAMERAS * GRID ** 3 pairs.
    pairs = pa.Table.from_batches(list(run(iter(few.to_batches()))), _ARROW)
    return cameras.sparkSession.createDataFrame(pairs if pairs.num_rows else [], _CAMERA), pairs.num_rows


def _seen(points: DataFrame, cameras: DataFrame, margin: float = 0.0) -> DataFrame:
    """Points in the view of each camera, less ``margin`` pixels at the last row and column, with u, v, depth and camera_id.

    Points meet only the cameras that may see their cell of a coarse grid, so
    that neither the number of cameras nor that of points is bounded. Points
    whose place isn't finite are seen by none.
    """
    finite = points
    for c in "xyz":
        finite = finite.where(F.abs(F.col(c)) < float("inf"))
    box = finite.agg(*[f(c).cast("double") for c in "xyz" for f in (F.min, F.max)]).first()
    low = [x or 0.0 for x in box[::2]]
    width = [max((hi or 0.0) - lo, 1e-9) / GRID for lo, hi in zip(low, box[1::2])]
    along = [F.least(F.floor((F.col(c) - lo) / w), F.lit(GRID - 1)) for c, lo, w in zip("xyz", low, width)]
    placed = finite.withColumn("_cell", ((along[0] * GRID + along[1]) * GRID + along[2]).cast("int"))
    ids = np.sort(np.array([r[0] for r in placed.select("_cell").distinct().limit(GRID**3).collect()], int))
    index = np.stack([ids // GRID**2, ids // GRID % GRID, ids % GRID], 1) if len(ids) else np.zeros((0, 3))
    centres = np.array(low) + (index + 0.5) * np.array(width)
    pairs, n = _may_see(cameras, centres, ids, float(np.linalg.norm(width)) / 2 * (1 + 1e-9))
    both = placed.join(small(pairs, MOST_PAIRS, n), F.col("_cell") == F.col("cell"))
    dot = dots(F.col("m"), [F.col(c) for c in "xyz"])
    both = both.select(*points.columns, "camera_id", *[x.alias(n) for x, n in zip(dot, ("_u", "_v", "depth"))], F.col("c3").alias("_cx"), F.col("c7").alias("_cy"), F.col("c11").alias("_cz"), F.col("w").alias("_w"), F.col("h").alias("_h"))
    d = F.col("depth")
    inside = (d > 0) & (F.col("_u") >= 0) & (F.col("_v") >= 0) & (F.col("_u") < (F.col("_w") - margin) * d) & (F.col("_v") < (F.col("_h") - margin) * d)
    return both.where(inside).withColumns({"u": F.col("_u") / d, "v": F.col("_v") / d}).drop("_u", "_v")


def visible(points: DataFrame, cameras: DataFrame) -> DataFrame:
    """Points in the view of each camera, with camera_id, u, v and depth, and the camera's width and height."""
    return _seen(points, cameras).withColumnsRenamed({"_w": "width", "_h": "height"}).drop("_cx", "_cy", "_cz")


def coverage(points: DataFrame, cameras: DataFrame) -> DataFrame:
    """camera_id and the share in percent of its BIN x BIN pixel bins that hold a visible point; partial bins at the edges count."""
    bins = F.ceil(F.col("width") / BIN) * F.ceil(F.col("height") / BIN)
    hit = visible(points, cameras).select("camera_id", bins.alias("_all"), F.floor(F.col("u") / BIN).alias("_bu"), F.floor(F.col("v") / BIN).alias("_bv")).distinct()
    return hit.groupBy("camera_id").agg((100.0 * F.count(F.lit(1)) / F.first("_all")).alias("covered_pct"))


def best_view(vertices: DataFrame, cameras: DataFrame, vertex_id: str) -> DataFrame:
    """Vertices (x, y, z, nx, ny, nz) with camera_id, u and v of the view that meets them most frontally.

    A view's score is minus the cosine-like product of the vertex normal and
    the direction from the camera to the vertex; it must exceed -1, and the
    largest wins. Scores equal to nine decimals tie, for the smaller
    camera_id. A camera whose view a vertex just touches at the last row or
    column doesn't count. Vertices that no camera sees, or without a normal,
    have a null camera_id.
    """
    seen = _seen(vertices, cameras, margin=1.0)
    ray = [F.col(c) - F.col(f"_c{c}") for c in "xyz"]
    length = F.sqrt(ray[0] ** 2 + ray[1] ** 2 + ray[2] ** 2)
    score = F.round(-(F.col("nx") * ray[0] + F.col("ny") * ray[1] + F.col("nz") * ray[2]) / F.when(length > 1e-6, length).otherwise(1.0), 9)
    scored = seen.withColumn("_s", score).where("_s > -1")
    best = scored.groupBy(vertex_id).agg(F.max_by(F.struct("camera_id", "u", "v"), F.struct(F.col("_s"), (-F.col("camera_id")).alias("c"))).alias("_b"))
    named = best.select(F.col(vertex_id).alias("_id"), F.col("_b.camera_id").alias("camera_id"), F.col("_b.u").alias("u"), F.col("_b.v").alias("v"))
    return vertices.join(named, F.col(vertex_id) == F.col("_id"), "left").drop("_id")


def baked(vertices: DataFrame, cameras: DataFrame, pixels: DataFrame, vertex_id: str) -> DataFrame:
    """Vertices with r, g and b (0..1) from the pixel (camera_id, row, col, r, g, b of 0..255) in which their best view sees them.

    The pixel is the one that the projection, told to nine decimals, lies in. Vertices that no view
    sees, or whose pixel is missing, keep their colour.
    """
    seen = best_view(vertices, cameras, vertex_id).withColumns({"_row": F.floor(F.round("v", 9)).cast("int"), "_col": F.floor(F.round("u", 9)).cast("int")})
    p = pixels.select(F.col("camera_id").alias("_cam"), F.col("row").alias("_pr"), F.col("col").alias("_pc"), *[F.col(c).alias(f"_{c}") for c in "rgb"])
    met = seen.join(p, (F.col("camera_id") == F.col("_cam")) & (F.col("_row") == F.col("_pr")) & (F.col("_col") == F.col("_pc")), "left")
    colour = lambda c: F.when(F.col(f"_{c}").isNull(), F.col(c)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col(f"_{c}") / 255.0)))
    return met.withColumns({c: colour(c) for c in "rgb"}).drop("_row", "_col", "_cam", "_pr", "_pc", "_r", "_g", "_b")


def self_warp(geometry: DataFrame, cameras: DataFrame) -> DataFrame:
    """camera_id, median_px and p90_px: how far a view's own world points land from the pixels that they come from."""
    both = geometry.join(with_matrix(cameras).select("camera_id", "m"), "camera_id")
    ud, vd, depth = dots(F.col("m"), [F.col(c) for c in "xyz"])
    off = F.sqrt((ud / depth - F.col("col")) ** 2 + (vd / depth - F.col("row")) ** 2)
    return exact_quantiles(both.where(depth > 0).select("camera_id", off.alias("_off")), "_off", {"median_px": 0.5, "p90_px": 0.9}, ["camera_id"]).drop("n")


def cross_view(geometry: DataFrame, cameras: DataFrame, pairs: DataFrame, occlusion_px: float = 2.0) -> DataFrame:
    """pair, bucket, median and p90 of the relative depth difference between neighbouring views.

    geometry holds the world point of each pixel (camera_id, row, col, x, y,
    z, masked); pairs the neighbouring views (a, b, same_chunk). A point of a
    is projected into b, meets b's point at the rounded pixel (of a place told to
    nine decimals, so that a tie doesn't hang on the last bit), and counts
    unless that point, projected back into a, lands more than occlusion_px
    away. Buckets: same or cross chunk, over all pixels and those unmasked.
    """
    cam = lambda s: with_matrix(cameras).select(*[F.col(c).alias(f"{s}_{c}") for c in ("camera_id", "m")])

    a = geometry.select(F.col("camera_id").alias("a"), F.col("row").alias("a_row"), F.col("col").alias("a_col"), *[F.col(c).alias(f"a_{c}") for c in "xyz"], F.col("masked").alias("a_masked"))
    b = geometry.select(F.col("camera_id").alias("g_b"), F.col("row").alias("b_row"), F.col("col").alias("b_col"), *[F.col(c).alias(f"b_{c}") for c in "xyz"], F.col("masked").alias("b_masked"))
    rows = a.join(small(pairs, MOST_PAIRS), "a").join(small(cam("ca"), MOST_PAIRS), F.col("a") == F.col("ca_camera_id")).join(small(cam("cb"), MOST_PAIRS), F.col("b") == F.col("cb_camera_id"))
    ud, vd, depth = dots(F.col("cb_m"), [F.col(f"a_{c}") for c in "xyz"])
    rows = rows.withColumns({"_u": ud, "_v": vd, "_d": depth}).where("_d > 0").withColumns({"_u": F.bround(F.round(F.col("_u") / F.col("_d"), 9), 0).cast("int"), "_v": F.bround(F.round(F.col("_v") / F.col("_d"), 9), 0).cast("int")})
    met = rows.join(b, (rows["b"] == b["g_b"]) & (rows["_v"] == b["b_row"]) & (rows["_u"] == b["b_col"]))
    back_u, back_v, back_d = dots(F.col("ca_m"), [F.col(f"b_{c}") for c in "xyz"])
    own = dots(F.col("cb_m"), [F.col(f"b_{c}") for c in "xyz"])[2]
    met = met.withColumns({"_bu": back_u, "_bv": back_v, "_bd": back_d, "_own": own}).where("_bd > 0 and _own > 0")
    met = met.where(F.sqrt((F.col("_bu") / F.col("_bd") - F.col("a_col")) ** 2 + (F.col("_bv") / F.col("_bd") - F.col("a_row")) ** 2) <= occlusion_px)
    error = F.abs(F.col("_d") - F.col("_own")) / F.col("_own")
    chunk = F.when(F.col("same_chunk"), "same").otherwise("cross")
    land = ~F.coalesce(F.col("a_masked"), F.lit(False)) & ~F.coalesce(F.col("b_masked"), F.lit(False))
    buckets = F.array_compact(F.array(F.concat(chunk, F.lit("_all")), F.when(land, F.concat(chunk, F.lit("_land"))), F.when(land, F.lit("land"))))
    long = cut(geometry.sparkSession, met.select(error.alias("error"), F.explode(buckets).alias("bucket")))
    return exact_quantiles(long, "error", {"median_error": 0.5, "p90_error": 0.9}, ["bucket"])


def adjacent(frames: DataFrame, order: str = "frame_index", group: str = "track_id") -> DataFrame:
    """group, a, b: each frame with the next one."""
    rows = neighbours(frames.select(group, order), [group], order, [], F.col(order))
    return rows.where("_next is not null").select(group, F.col(order).alias("a"), F.col("_next").alias("b"))


def painters_order(seen: DataFrame, camera: str = "camera_id", depth: str = "depth", ties: str = "point_id") -> DataFrame:
    """Adds place: the order in which a camera's points are drawn, the farthest first."""
    return numbered(seen.withColumn("_d", -F.col(depth)), [camera], ["_d", ties], "place").drop("_d", "_total")
