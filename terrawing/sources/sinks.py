"""What leaves the engine other than as Parquet: point clouds, meshes, rasters, tracks, reports.

Binary formats are packed by the workers, a batch of rows to a piece of bytes;
the driver only strings the pieces together, a partition at a time, and writes
the counts into the header last. So no row passes the driver on its own, and
nothing is sorted as a whole: rows are numbered in blocks.
"""

from __future__ import annotations

import base64
import html
import json
import struct
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrawing.operators.blocks import numbered

#: Most points in a viewer page; it is a sample for the eye.
VIEWER_POINTS = 200_000
#: Points of a line at most; a longer line is several that share their ends.
LINE_POINTS = 10_000
_PIECES = "part int, seq int, n long, payload binary"


# ------------------------------------------------------------------ packed rows


def packed(rows: DataFrame, dtype: np.dtype) -> DataFrame:
    """part, seq, n and payload: the rows' columns, in the order of dtype's fields, as records of bytes. Nulls become 0 or NaN."""
    names = list(dtype.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for seq, batch in enumerate(batches):
            out = np.zeros(batch.num_rows, dtype)
            for i, name in enumerate(names):
                x = batch.column(i)
                x = x.fill_null(float("nan") if pa.types.is_floating(x.type) else 0).to_numpy(zero_copy_only=False)
                out[name] = x
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()), "n": pa.array([batch.num_rows], pa.int64()), "payload": pa.array([out.tobytes()], pa.binary())})

    return rows.select(*names).mapInArrow(run, _PIECES)


def unpacked(pieces: DataFrame, dtype: np.dtype) -> DataFrame:
    """The records in pieces of bytes as rows again, as doubles and longs: what a reader of the file sees."""
    kinds = {n: "double" if dtype[n].kind == "f" else "long" for n in dtype.names}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for payload in batch.column("payload").to_pylist():
                rec = np.frombuffer(payload, dtype)
                yield pa.RecordBatch.from_pydict({n: pa.array(rec[n].astype(np.float64 if k == "double" else np.int64)) for n, k in kinds.items()})

    return pieces.mapInArrow(run, ", ".join(f"{n} {k}" for n, k in kinds.items()))


def _append(f: object, pieces: DataFrame) -> int:
    """Writes the pieces in the order of part and seq; returns the number of rows."""
    n = 0
    for r in pieces.select("n", "payload").toLocalIterator(prefetchPartitions=True):
        f.write(r["payload"])
        n += r["n"]
    return n


def _byte(c: str) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(255), F.round(c))).cast("int")


#: Records of a point in a PLY and in a LAS file (point format 3, with confidence and view_count as extra bytes).
PLY_POINT = np.dtype([("x", "<f4"), ("y", "<f4"), ("z", "<f4"), ("red", "u1"), ("green", "u1"), ("blue", "u1"), ("confidence", "<f4"), ("view_count", "<u2")])
LAS_POINT = np.dtype([
    ("X", "<i4"), ("Y", "<i4"), ("Z", "<i4"), ("intensity", "<u2"), ("returns", "u1"), ("classification", "u1"), ("scan_angle", "i1"), ("user_data", "u1"), ("source_id", "<u2"), ("gps_time", "<f8"),
    ("red", "<u2"), ("green", "<u2"), ("blue", "<u2"), ("confidence", "<f4"), ("view_count", "<u2"),
])
LAS_SCALE = 0.001


def ply_points(points: DataFrame) -> DataFrame:
    """Points (x, y, z, r, g, b, confidence, view_count) as PLY records: colours rounded to bytes, view_count at most 65535."""
    colours = [_byte(c).alias(n) for c, n in zip("rgb", ("red", "green", "blue"))]
    return packed(points.select("x", "y", "z", *colours, F.col("confidence").cast("double").alias("confidence"), F.least("view_count", F.lit(65535)).cast("int").alias("view_count")), PLY_POINT)


def _ply_head(elements: list[tuple[str, int, list[str]]], length: int = 1024) -> bytes:
    """The header, filled up to a fixed length by a comment, so that counts can be written when they are known."""
    head = ["ply", "format binary_little_endian 1.0"]
    for name, n, properties in elements:
        head += [f"element {name} {n}", *[f"property {p}" for p in properties]]
    body = "\n".join(head) + "\ncomment "
    return (body + "-" * (length - len(body) - len("\nend_header\n")) + "\nend_header\n").encode()


_POINT_PROPERTIES = [*[f"float {c}" for c in "xyz"], *[f"uchar {c}" for c in ("red", "green", "blue")], "float confidence", "ushort view_count"]


def write_ply(points: DataFrame, path: str) -> int:
    """Binary little-endian PLY of points; returns their number."""
    with open(path, "wb") as f:
        f.write(_ply_head([("vertex", 0, _POINT_PROPERTIES)]))
        n = _append(f, ply_points(points))
        f.seek(0)
        f.write(_ply_head([("vertex", n, _POINT_PROPERTIES)]))
    return n


def las_offset(points: DataFrame) -> tuple[list[float], list[float], list[float]]:
    """Offset (the whole number at or below the least), least and most of x, y and z; zeros for no points."""
    box = points.agg(*[f(c).cast("double") for c in "xyz" for f in (F.min, F.max)]).first()
    low, high = [x or 0.0 for x in box[::2]], [x or 0.0 for x in box[1::2]]
    return [float(np.floor(x)) for x in low], low, high


def las_points(points: DataFrame, offset: list[float]) -> DataFrame:
    """Points as LAS records: whole multiples of LAS_SCALE above the offset, colours of 16 bits (bytes times 257)."""
    place = [F.round((F.col(c) - o) / LAS_SCALE).cast("int").alias(c.upper()) for c, o in zip("xyz", offset)]
    colours = [(F.greatest(F.lit(0.0), F.least(F.lit(255.0), F.col(c))) * 257).cast("int").alias(n) for c, n in zip("rgb", ("red", "green", "blue"))]
    none = [F.lit(0).alias(c) for c in ("intensity", "returns", "classification", "scan_angle", "user_data", "source_id")]
    return packed(points.select(*place, *none, F.lit(0.0).alias("gps_time"), *colours, F.col("confidence").cast("double").alias("confidence"), F.least("view_count", F.lit(65535)).cast("int").alias("view_count")), LAS_POINT)


def _vlr(user: bytes, record: int, data: bytes, about: bytes = b"") -> bytes:
    return struct.pack("<H16sHH32s", 0, user, record, len(data), about) + data


def _las_head(n: int, offset: list[float], low: list[float], high: list[float], epsg: int | None) -> bytes:
    extra = lambda name, kind: struct.pack("<2xBB32s4x24x24x24x24x24x32s", kind, 0, name, b"")
    records = _vlr(b"LASF_Spec", 4, extra(b"confidence", 9) + extra(b"view_count", 3), b"Extra bytes")
    count = 1
    if epsg:
        keys = struct.pack("<16H", 1, 1, 0, 3, 1024, 0, 1, 1, 1025, 0, 1, 1, 3072, 0, 1, epsg)
        records, count = _vlr(b"LASF_Projection", 34735, keys, b"GeoKeyDirectory") + records, 2
    head = struct.pack("<4sHH16sBB32s32sHHHIIBHI5I", b"LASF", 0, 0, b"", 1, 2, b"terrawing", b"terrawing", 1, 2024, 227, 227 + len(records), count, 3, LAS_POINT.itemsize, n, n, 0, 0, 0, 0)
    box = [v for hi, lo in zip(high, low) for v in (hi, lo)]
    return head + struct.pack("<12d", *[LAS_SCALE] * 3, *offset, *box) + records


def write_las(points: DataFrame, path: str, epsg: int | None = None) -> int:
    """LAS 1.2, point format 3 with confidence and view_count as extra bytes, and an EPSG code if the points are georeferenced; returns their number."""
    offset, low, high = las_offset(points)
    with open(path, "wb") as f:
        f.write(_las_head(0, offset, low, high, epsg))
        n = _append(f, las_points(points, offset))
        f.seek(0)
        f.write(_las_head(n, offset, low, high, epsg))
    return n


# ---------------------------------------------------------------------- meshes


MESH_VERTEX = np.dtype([("x", "<f4"), ("y", "<f4"), ("z", "<f4"), ("red", "u1"), ("green", "u1"), ("blue", "u1")])
MESH_FACE = np.dtype([("k", "u1"), ("a", "<i4"), ("b", "<i4"), ("c", "<i4")])


def indexed(vertices: DataFrame, faces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vertices with k, their 0-based place by vertex_id, and faces with their corners' places in ka, kb, kc; both in order. Faces with an unknown corner are left out."""
    v = numbered(vertices.withColumn("_mesh", F.lit(0)), ["_mesh"], ["vertex_id"], "k").drop("_mesh", "_total")
    f = faces.select("face_id", "a", "b", "c")
    for c in "abc":
        f = f.join(v.select(F.col("vertex_id").alias(f"_{c}"), F.col("k").alias(f"k{c}")), F.col(c) == F.col(f"_{c}")).drop(f"_{c}")
    return v, f


def mesh_pieces(vertices: DataFrame, faces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vertices (vertex_id, x, y, z and r, g, b of 0..1) and faces (face_id, a, b, c) as records of a PLY mesh, each in order."""
    v, f = indexed(vertices, faces)
    colours = [F.greatest(F.lit(0), F.least(F.lit(255), F.floor(F.col(c) * 255))).cast("int").alias(n) for c, n in zip("rgb", ("red", "green", "blue"))]
    v = v.repartitionByRange("k").sortWithinPartitions("k").select("x", "y", "z", *colours)
    f = f.repartitionByRange("face_id").sortWithinPartitions("face_id").select(F.lit(3).alias("k"), *[F.col(f"k{c}").cast("int").alias(c) for c in "abc"])
    return packed(v, MESH_VERTEX), packed(f, MESH_FACE)


def write_mesh_ply(vertices: DataFrame, faces: DataFrame, path: str) -> tuple[int, int]:
    """Binary PLY of a mesh with coloured vertices; returns the numbers of vertices and faces."""
    v, f = mesh_pieces(vertices, faces)
    parts = lambda n, m: [("vertex", n, [*[f"float {c}" for c in "xyz"], *[f"uchar {c}" for c in ("red", "green", "blue")]]), ("face", m, ["list uchar int vertex_indices"])]
    with open(path, "wb") as out:
        out.write(_ply_head(parts(0, 0)))
        n, m = _append(out, v), _append(out, f)
        out.seek(0)
        out.write(_ply_head(parts(n, m)))
    return n, m


def write_glb(vertices: DataFrame, faces: DataFrame, path: str) -> tuple[int, int]:
    """Binary glTF 2.0 of a mesh with coloured vertices: positions, colours of four bytes, and indices, one after the other; returns the numbers of vertices and faces."""
    v, f = indexed(vertices, faces)
    v = v.repartitionByRange("k").sortWithinPartitions("k")
    box = v.agg(*[g(c).cast("double") for g in (F.min, F.max) for c in "xyz"]).first()
    colours = [F.greatest(F.lit(0), F.least(F.lit(255), F.floor(F.col(c) * 255))).cast("int").alias(c) for c in "rgb"]
    places = packed(v.select("x", "y", "z"), np.dtype([(c, "<f4") for c in "xyz"]))
    shades = packed(v.select(*colours, F.lit(255).alias("a")), np.dtype([(c, "u1") for c in "rgba"]))
    corners = packed(f.repartitionByRange("face_id").sortWithinPartitions("face_id").select(*[F.col(f"k{c}").cast("long").alias(c) for c in "abc"]), np.dtype([(c, "<u4") for c in "abc"]))

    def head(n: int, m: int) -> bytes:
        sizes = [12 * n, 4 * n, 12 * m]
        views = [{"buffer": 0, "byteOffset": sum(sizes[:i]), "byteLength": s, "target": 34963 if i == 2 else 34962} for i, s in enumerate(sizes)]
        low, high = [float(np.float32(x or 0)) for x in box[:3]], [float(np.float32(x or 0)) for x in box[3:]]
        kinds = [(5126, n, "VEC3", {"min": low, "max": high}), (5121, n, "VEC4", {"normalized": True}), (5125, 3 * m, "SCALAR", {})]
        doc = {
            "asset": {"version": "2.0"}, "scene": 0, "scenes": [{"nodes": [0]}], "nodes": [{"mesh": 0}], "buffers": [{"byteLength": sum(sizes)}], "bufferViews": views,
            "meshes": [{"primitives": [{"attributes": {"POSITION": 0, "COLOR_0": 1}, "indices": 2}]}],
            "accessors": [{"bufferView": i, "componentType": c, "count": k, "type": t, **more} for i, (c, k, t, more) in enumerate(kinds)],
        }
        text = json.dumps(doc).encode().ljust(2048)
        return struct.pack("<4sII", b"glTF", 2, 12 + 8 + len(text) + 8 + sum(sizes)) + struct.pack("<I4s", len(text), b"JSON") + text + struct.pack("<I4s", sum(sizes), b"BIN\0")

    with open(path, "wb") as out:
        out.write(head(0, 0))
        n = _append(out, places)
        _append(out, shades)
        m = _append(out, corners)
        out.seek(0)
        out.write(head(n, m))
    return n, m


#: The material of a textured mesh.
MATERIAL = "newmtl material0\nKa 1.0 1.0 1.0\nKd 1.0 1.0 1.0\nKs 0.0 0.0 0.0\nmap_Kd {texture}\n"


def obj_lines(vertices: DataFrame, faces: DataFrame, corners: DataFrame | None = None) -> DataFrame:
    """kind, id and line of a Wavefront file: v x y z r g b with six decimals and f with numbers from 1.

    With corners (face_id, corner 0..2, u, v) the mesh is textured: vertices
    have no colour, each face's corners their own vt lines, upside down as the
    format has it.
    """
    v, f = indexed(vertices, faces)
    place = lambda c: F.col(f"k{c}") + 1
    if corners is None:
        lines = v.select(F.lit("v").alias("kind"), (F.col("k") + 1).cast("bigint").alias("id"), F.format_string("v %.6f %.6f %.6f %.6f %.6f %.6f", "x", "y", "z", "r", "g", "b").alias("line"))
        return lines.unionByName(f.select(F.lit("f").alias("kind"), F.col("face_id").cast("bigint").alias("id"), F.format_string("f %d %d %d", *[place(c) for c in "abc"]).alias("line")))
    lines = v.select(F.lit("v").alias("kind"), (F.col("k") + 1).cast("bigint").alias("id"), F.format_string("v %.6f %.6f %.6f", "x", "y", "z").alias("line"))
    f = numbered(f.withColumn("_mesh", F.lit(0)), ["_mesh"], ["face_id"], "_f").drop("_mesh", "_total")
    at = F.col("_f") * 3
    vt = corners.join(f.select(F.col("face_id").alias("_id"), "_f"), F.col("face_id") == F.col("_id")).select(F.lit("vt").alias("kind"), (at + F.col("corner") + 1).cast("bigint").alias("id"), F.format_string("vt %.6f %.6f", F.col("u"), 1.0 - F.col("v")).alias("line"))
    face = F.format_string("f %d/%d %d/%d %d/%d", *[x for i, c in enumerate("abc") for x in (place(c), at + i + 1)])
    return lines.unionByName(vt).unionByName(f.select(F.lit("f").alias("kind"), (F.col("_f") + 1).cast("bigint").alias("id"), face.alias("line")))


def write_obj(lines: DataFrame, path: str, texture: str | None = None) -> None:
    """The lines of obj_lines as one file, vertices before texture places before faces, and with a texture its material beside it."""
    rank = F.array_position(F.array(F.lit("v"), F.lit("vt"), F.lit("f")), F.col("kind"))
    with open(path, "w") as f:
        if texture:
            Path(path).with_suffix(".mtl").write_text(MATERIAL.format(texture=texture))
            f.write(f"mtllib {Path(path).with_suffix('.mtl').name}\nusemtl material0\n")
        for r in lines.withColumn("_r", rank).orderBy("_r", "id").select("line").toLocalIterator(prefetchPartitions=True):
            f.write(r["line"] + "\n")


# --------------------------------------------------------------------- rasters


def strips(cells: DataFrame, bands: list[str], width: int, height: int, rows_per_strip: int = 64) -> DataFrame:
    """strip and payload: a raster's rows in strips, each band's float32 values one after the other, NaN where there is no cell.

    A strip is filled by one worker from the cells in it, and holds
    rows_per_strip * width values a band whatever the cells. Strips without
    any cell aren't there.
    """
    slim = cells.select(F.floor(F.col("row") / rows_per_strip).cast("int").alias("strip"), (F.col("row") % rows_per_strip).cast("int").alias("y"), F.col("col").cast("int").alias("x"), *[F.col(b).cast("double").alias(b) for b in bands])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from terrawing.operators.segments import segments

        for seg in segments(batches, ["strip"]):
            strip = seg.column("strip")[0].as_py()
            out = np.full((len(bands), min(rows_per_strip, height - strip * rows_per_strip), width), np.nan, "<f4")
            for i, b in enumerate(bands):
                out[i, seg.column("y").to_numpy(), seg.column("x").to_numpy()] = seg.column(b).fill_null(float("nan")).to_numpy()
            yield pa.RecordBatch.from_pydict({"strip": pa.array([strip], pa.int32()), "payload": pa.array([out.tobytes()], pa.binary())})

    return slim.repartition("strip").sortWithinPartitions("strip", "y", "x").mapInArrow(run, "strip int, payload binary")


def write_geotiff(cells: DataFrame, bands: list[str], width: int, height: int, west: float, north: float, cell: float, path: str, epsg: int | None = None, rows_per_strip: int = 64) -> None:
    """Uncompressed float32 GeoTIFF, north up, a plane per band, NaN for no data, with an EPSG code if the raster is georeferenced. Cells: row, col and the bands."""
    n = -(-height // rows_per_strip)
    lengths = [4 * width * min(rows_per_strip, height - i * rows_per_strip) for i in range(n)]
    k = len(bands)
    named = "<GDALMetadata>" + "".join(f'<Item name="DESCRIPTION" sample="{i}" role="description">{html.escape(b)}</Item>' for i, b in enumerate(bands)) + "</GDALMetadata>"
    tags: list[tuple[int, str, list]] = [
        (256, "I", [width]), (257, "I", [height]), (258, "H", [32] * k), (259, "H", [1]), (262, "H", [1]), (273, "I", [0] * (n * k)), (277, "H", [k]), (278, "I", [rows_per_strip]), (279, "I", lengths * k), (284, "H", [2]),
        (339, "H", [3] * k), (33550, "d", [cell, cell, 0.0]), (33922, "d", [0.0, 0.0, 0.0, west, north, 0.0]), (34735, "H", [1, 1, 0, 3, 1024, 0, 1, 1, 1025, 0, 1, 1, 3072, 0, 1, epsg] if epsg else [1, 1, 0, 1, 1025, 0, 1, 1]),
        (42112, "s", [named.encode() + b"\0"]), (42113, "s", [b"nan\0"]),
    ]
    if k > 1:
        tags.append((338, "H", [0] * (k - 1)))
    tags.sort()

    def layout(offsets: list[int]) -> bytes:
        body = b""
        start = 8 + 2 + 12 * len(tags) + 4
        entries = b""
        for tag, kind, values in tags:
            values = offsets if tag == 273 else values
            data = values[0] if kind == "s" else struct.pack(f"<{len(values)}{kind}", *values)
            count = len(data) if kind == "s" else len(values)
            code = {"H": 3, "I": 4, "d": 12, "s": 2}[kind]
            if len(data) <= 4:
                entries += struct.pack("<HHI", tag, code, count) + data.ljust(4, b"\0")
            else:
                entries += struct.pack("<HHII", tag, code, count, start + len(body))
                body += data + b"\0" * (len(data) % 2)
        return struct.pack("<2sHIH", b"II", 42, 8, len(tags)) + entries + struct.pack("<I", 0) + body

    first = len(layout([0] * (n * k)))
    offsets = [first + b * sum(lengths) + sum(lengths[:i]) for b in range(k) for i in range(n)]
    with open(path, "wb") as f:
        f.write(layout(offsets))
        f.truncate(first + k * sum(lengths))
        seen = set()
        for r in strips(cells, bands, width, height, rows_per_strip).toLocalIterator(prefetchPartitions=True):
            seen.add(r["strip"])
            for b in range(k):
                f.seek(offsets[b * n + r["strip"]])
                f.write(r["payload"][b * lengths[r["strip"]] : (b + 1) * lengths[r["strip"]]])
        for i in set(range(n)) - seen:
            for b in range(k):
                f.seek(offsets[b * n + i])
                f.write(np.full(lengths[i] // 4, np.nan, "<f4").tobytes())


def write_png(cells: DataFrame, shade: str, width: int, height: int, path: str) -> None:
    """8-bit grey picture of a raster band scaled to 0..1 (see raster.stretched); cells without value are black. Rows go to the compressor strip by strip."""
    piece = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    pack, at, done = zlib.compressobj(), 0, []
    parts = strips(cells, [shade], width, height).select("strip", "payload").orderBy("strip")

    def rows(values: np.ndarray) -> bytes:
        grey = np.nan_to_num(np.clip(values, 0, 1) * 255).round().astype("u1")
        return np.concatenate([np.zeros((len(grey), 1), "u1"), grey], axis=1).tobytes()

    for r in parts.toLocalIterator(prefetchPartitions=True):
        done.append(pack.compress(rows(np.zeros((r["strip"] * 64 - at, width)))))
        values = np.frombuffer(r["payload"], "<f4").reshape(-1, width)
        done.append(pack.compress(rows(values)))
        at = r["strip"] * 64 + len(values)
    done.append(pack.compress(rows(np.zeros((height - at, width)))) + pack.flush())
    Path(path).write_bytes(b"\x89PNG\r\n\x1a\n" + piece(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)) + piece(b"IDAT", b"".join(done)) + piece(b"IEND", b""))


# -------------------------------------------------------------- tracks and pages


def line_features(tracks: DataFrame, name: str = "name", order: str = "seq", most: int = LINE_POINTS) -> DataFrame:
    """name, part, geojson and kml: a LineString of each track's lon and lat in order; a track of more than ``most`` points is several parts, each beginning where the one before ends."""
    placed = numbered(tracks.select(name, order, "lon", "lat"), [name], [order, "lon", "lat"], "_i")
    i = F.col("_i")
    part = F.floor(i / most).cast("int")
    both = placed.withColumn("part", F.explode(F.when((i % most == 0) & (i > 0), F.array(part - 1, part)).otherwise(F.array(part))))
    # The last point of a track that fills its parts exactly begins no part of its own.
    both = both.where((F.col("part") == 0) | (F.col("part") * most < F.col("_total") - 1))
    lines = both.groupBy(name, "part").agg(F.sort_array(F.collect_list(F.struct("_i", "lon", "lat"))).alias("_p"))
    coordinates = F.transform("_p", lambda p: F.array(p["lon"], p["lat"]))
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(F.col(name).alias("name"), "part").alias("properties"), F.struct(F.lit("LineString").alias("type"), coordinates.alias("coordinates")).alias("geometry"))
    flat = F.array_join(F.transform("_p", lambda p: F.concat(p["lon"].cast("string"), F.lit(","), p["lat"].cast("string"), F.lit(",0"))), " ")
    placemark = F.concat(F.lit("<Placemark><name>"), F.col(name), F.lit("</name><LineString><coordinates>"), flat, F.lit("</coordinates></LineString></Placemark>"))
    return lines.select(name, "part", F.to_json(feature).alias("geojson"), placemark.alias("kml"))


def manifest(frames: DataFrame, track: str = "track_id", frame: str = "frame_index", time: str = "timestamp_s") -> DataFrame:
    """track, frame and entry: the JSON object of each keyframe with the file that its image has."""
    file = F.format_string("frame_%06d.jpg", frame)
    return frames.select(track, frame, F.to_json(F.struct(F.col(frame), file.alias("file"), F.col(time))).alias("entry"))


def seeded_sample(rows: DataFrame, row_id: str, most: int) -> DataFrame:
    """The same ``most`` rows each time: those whose id has the smallest MD5; a top-k, no full sort."""
    return rows.orderBy(F.md5(F.col(row_id).cast("string")), row_id).limit(most)


def viewer_html(points: DataFrame, row_id: str, path: str, most: int = VIEWER_POINTS) -> None:
    """A page of its own with a sample of the points as base64 arrays, confidence scaled by the largest."""
    rows = seeded_sample(points, row_id, most).select("x", "y", "z", "r", "g", "b", "confidence").toPandas()
    pack = lambda cols, kind: base64.b64encode(np.ascontiguousarray(rows[cols].to_numpy(kind)).tobytes()).decode()
    top = float(rows["confidence"].max() or 1.0) if len(rows) else 1.0
    data = {"n": len(rows), "xyz": pack(["x", "y", "z"], "<f4"), "rgb": pack(["r", "g", "b"], "u1"), "conf": base64.b64encode((rows["confidence"].to_numpy("<f4") / top).tobytes()).decode()}
    Path(path).write_text(f"<!doctype html><meta charset=utf-8><title>Points</title><script>const DATA = {json.dumps(data)};</script>")


def report_html(title: str, tables: dict[str, DataFrame], path: str, most: int = 1000, text: str = "") -> None:
    """Tables of a report, a bounded number of rows each, as one page, with a text before them."""
    parts = [f"<!doctype html><meta charset=utf-8><title>{html.escape(title)}</title>", f"<pre>{html.escape(text)}</pre>" if text else ""]
    for name, df in tables.items():
        rows = df.limit(most).collect()
        body = "".join("<tr>" + "".join(f"<td>{html.escape(str(v))}</td>" for v in r) + "</tr>" for r in rows)
        parts.append(f"<h2>{html.escape(name)}</h2><table><tr>{''.join(f'<th>{html.escape(c)}</th>' for c in df.columns)}</tr>{body}</table>")
    Path(path).write_text("\n".join(parts))


def write_scorecard(card: DataFrame, folder: str) -> None:
    """scores.json, scorecard.md and report.html of a scorecard of a handful of models."""
    from terrawing.operators.scorecard import markdown

    text = markdown(card)
    Path(folder, "scorecard.md").write_text(text)
    Path(folder, "scores.json").write_text(json.dumps([r.asDict() for r in card.orderBy("model").limit(1000).collect()], default=str))
    report_html("Scorecard", {"Scores": card.orderBy("model")}, str(Path(folder, "report.html")), text=text)
