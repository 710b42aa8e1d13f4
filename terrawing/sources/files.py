"""Listings of files to the inputs of a run: videos, telemetry, intrinsics, checkpoints, caches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrawing.operators.blocks import numbered

#: File endings and name parts by which inputs are known.
VIDEO_ENDINGS = ("mp4", "mov", "mkv", "avi", "m4v", "ts")
KINDS = {"srt": "srt", "csv": "csv", "gpx": "gpx", "kml": "kml", "json": "json", "tlog": "mavlink", "bin": "mavlink"}
CHECKPOINT_ENDINGS = ("pth", "pt", "safetensors")
CHECKPOINT_HINTS = {"mapanything": ("mapanything", "map_anything", "map-anything", "mapa"), "pi3x": ("pi3x",), "pi3": ("pi3",), "vggt": ("vggt",)}
CACHE_HINTS = ("cache", "checkpoints", "wheels")
MATRIX_KEYS = ("camera_matrix", "K", "intrinsic_matrix")


def listing(spark: SparkSession, root: str) -> DataFrame:
    """path, length and modification time of all files below root; contents aren't read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length", F.col("modificationTime").alias("modification_time"))


def ending(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def stem(path: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", ""))


def parent(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def kind(path: Column) -> Column:
    """Kind of telemetry by the file's ending; other endings are their own kind."""
    e = ending(path)
    out = e
    for k, v in KINDS.items():
        out = F.when(e == k, v).otherwise(out)
    return out


def probed(probes: DataFrame, path: str = "path", probe: str = "probe_json") -> DataFrame:
    """path, duration_s, width, height, fps, codec of the first video stream; rows without one are left out."""
    schema = "streams array<struct<codec_type: string, codec_name: string, width: int, height: int, r_frame_rate: string, duration: string>>, format struct<duration: string>"
    j = F.from_json(probe, schema)
    rows = probes.withColumn("_j", j).withColumn("_v", F.get(F.filter("_j.streams", lambda s: s["codec_type"] == "video"), F.lit(0))).where("_v is not null")
    rate = F.split("_v.r_frame_rate", "/")
    fps = F.coalesce(F.try_divide(F.get(rate, F.lit(0)).try_cast("double"), F.coalesce(F.get(rate, F.lit(1)).try_cast("double"), F.lit(1.0))), F.lit(0.0))
    duration = F.coalesce(F.col("_j.format.duration").try_cast("double"), F.col("_v.duration").try_cast("double"), F.lit(0.0))
    return rows.select(path, duration.alias("duration_s"), F.col("_v.width").alias("width"), F.col("_v.height").alias("height"), fps.alias("fps"), F.col("_v.codec_name").alias("codec"))


def videos(files: DataFrame, probes: DataFrame) -> DataFrame:
    """Videos among the files, longest first, at equal lengths by path."""
    return probed(probes).join(files.where(ending(F.col("path")).isin(*VIDEO_ENDINGS)).select("path"), "path", "left_semi").orderBy(F.desc("duration_s"), "path")


def telemetry_of(videos: DataFrame, files: DataFrame) -> DataFrame:
    """path of each video and telemetry_path, kind: the first file of its name, else one of its folder, subtitles before others; null if there is none."""
    t = files.where(ending(F.col("path")).isin(*KINDS)).select(F.col("path").alias("telemetry_path"))
    by_name = t.withColumn("_k", stem(F.col("telemetry_path"))).withColumn("_p", F.lit(0))
    by_folder = t.withColumn("_k", parent(F.col("telemetry_path"))).withColumn("_p", F.when(kind(F.col("telemetry_path")) == "srt", 1).otherwise(2))
    keys = videos.select("path", F.explode(F.array(F.struct(stem(F.col("path")).alias("k"), F.lit(True).alias("n")), F.struct(parent(F.col("path")).alias("k"), F.lit(False).alias("n")))).alias("_key"))
    both = by_name.withColumn("_n", F.lit(True)).unionByName(by_folder.withColumn("_n", F.lit(False)))
    best = keys.join(both, (F.col("_key.k") == F.col("_k")) & (F.col("_key.n") == F.col("_n"))).groupBy("path").agg(F.min(F.struct("_p", "telemetry_path")).alias("_b"))
    return videos.select("path").join(best, "path", "left").select("path", F.col("_b.telemetry_path").alias("telemetry_path"), kind(F.col("_b.telemetry_path")).alias("kind"))


def checkpoints(files: DataFrame) -> DataFrame:
    """backbone and path: of the files that name a backbone the one called best, then the newest, then the first path."""
    low = F.lower("path")
    named = F.array_compact(F.array(*[F.when(_any(low, hints), F.lit(key)) for key, hints in CHECKPOINT_HINTS.items()]))
    rows = files.where(ending(F.col("path")).isin(*CHECKPOINT_ENDINGS)).withColumn("backbone", F.explode(named))
    best = F.when(F.lower(F.regexp_extract("path", r"([^/]*)$", 1)).contains("best"), 0).otherwise(1)
    w = Window.partitionBy("backbone").orderBy(best, F.desc("modification_time"), "path")
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").select("backbone", "path")


def _any(text: Column, parts: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | text.contains(p)
    return out


def cache_folders(folders: DataFrame) -> DataFrame:
    """Folders (path, children: array of names) whose name holds a cache hint, or that have wheels or a checkpoints folder inside."""
    name = F.lower(F.regexp_extract("path", r"([^/]*)$", 1))
    inside = F.exists("children", lambda c: c.endswith(".whl") | (F.lower(c) == "checkpoints"))
    return folders.where(_any(name, CACHE_HINTS) | inside)


#: Endings of files that may hold intrinsics, and keys that show it.
INTRINSICS_ENDINGS = ("json", "yaml", "yml")
INTRINSICS_KEYS = ("fx", "fy", "cx", "cy", "camera_matrix", "K", "intrinsics", "intrinsic_matrix")
#: Objects inside objects are looked through so deep.
DEPTH = 3


def _objects(text: Column, depth: int = DEPTH) -> Column:
    """The JSON object in a text and those inside it down to depth, as maps of texts; an array of none if the text is no object."""
    parsed = lambda t: F.from_json(t, "map<string,string>")
    level = F.array_compact(F.array(F.when(F.ltrim(text).startswith("{"), parsed(text))))
    out = [level]
    for _ in range(depth):
        inner = F.flatten(F.transform(level, lambda m: F.map_values(m)))
        level = F.transform(F.filter(inner, lambda v: v.startswith("{")), parsed)
        out.append(level)
    return F.filter(F.flatten(F.array(*out)), lambda m: m.isNotNull())


def _yaml_keys(text: Column, depth: int = DEPTH) -> Column:
    """Keys of block mappings in a YAML text, as deep as two blanks of indentation a level tell."""
    return F.regexp_extract_all(F.concat(F.lit("\n"), text), F.lit(rf"\n(?:  ){{0,{depth}}}([A-Za-z_]\w*)\s*:"), 1)


def intrinsics_files(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """Files (path, text) whose keys, down to depth 3, meet INTRINSICS_KEYS, with ``first``: the one that is taken, the first by path. Others, and those that don't parse, are left out."""
    e = ending(F.col(path))
    keys = F.when(e == "json", F.flatten(F.transform("_o", lambda m: F.map_keys(m)))).otherwise(_yaml_keys(F.col(text)))
    rows = files.where(e.isin(*INTRINSICS_ENDINGS)).withColumn("_o", F.when(e == "json", _objects(F.col(text))))
    found = rows.where(F.arrays_overlap(keys, F.array(*[F.lit(k) for k in INTRINSICS_KEYS]))).drop("_o")
    first = found.agg(F.min(path).alias("_p"))
    return found.join(F.broadcast(first), F.lit(True)).withColumn("first", F.col(path) == F.col("_p")).drop("_p")


def intrinsics(df: DataFrame, info: str, width: str, height: str) -> DataFrame:
    """Adds fx, fy, cx, cy: from keys of that name anywhere down to depth 3 of a JSON object, else from a 3 x 3 matrix there, else a default by the image's size."""
    from terrawing.functions.camera import default_intrinsics

    df = df.withColumn("_o", _objects(F.col(info)))
    under = lambda k: F.get(F.filter(F.transform("_o", lambda m: m[k]), lambda v: v.isNotNull()), F.lit(0))
    flat = {k: under(k).try_cast("double") for k in ("fx", "fy", "cx", "cy")}
    whole = flat["fx"].isNotNull() & flat["fy"].isNotNull() & flat["cx"].isNotNull() & flat["cy"].isNotNull()
    m = F.coalesce(*[F.from_json(under(k), "array<array<double>>") for k in MATRIX_KEYS])
    square = (F.size(m) == 3) & F.forall(m, lambda r: F.size(r) == 3)
    default = default_intrinsics(F.col(width), F.col(height))
    at = {"fx": (0, 0), "fy": (1, 1), "cx": (0, 2), "cy": (1, 2)}
    return df.withColumns({k: F.when(whole, flat[k]).when(F.coalesce(square, F.lit(False)), m[at[k][0]][at[k][1]]).otherwise(d) for k, d in zip(("fx", "fy", "cx", "cy"), default)}).drop("_o")


def detected(files: DataFrame, probes: DataFrame) -> DataFrame:
    """One row per video, longest first by rank: path, duration_s, rank, telemetry_path and kind (none: the run has no places)."""
    v = videos(files, probes).select("path", "duration_s")
    found = v.join(telemetry_of(v, files), "path")
    return numbered(found.withColumns({"_g": F.lit(0), "_d": -F.col("duration_s")}), ["_g"], ["_d", "path"], "rank").drop("_g", "_d", "_total")


def key_difference(ours: DataFrame, theirs: DataFrame, key: str = "key", prefix: str = "module.") -> DataFrame:
    """key and side (missing, unexpected) of two sets of keys, once a prefix is taken off."""
    plain = lambda df: df.select(F.regexp_replace(key, f"^{prefix}", "").alias(key)).distinct()
    a, b = plain(ours), plain(theirs)
    return a.join(b, key, "left_anti").withColumn("side", F.lit("missing")).unionByName(b.join(a, key, "left_anti").withColumn("side", F.lit("unexpected")))


def run_status(runs: DataFrame) -> DataFrame:
    """model and state of a run: timeout, else what its status file says, else that it crashed, with the end of its log."""
    said = F.get_json_object("status_json", "$.status")
    return runs.withColumn("state", F.when(F.col("timed_out"), "timeout").when(said.isNotNull(), said).otherwise("crash_no_status")).withColumn("tail", F.when(F.col("state") == "crash_no_status", F.substring(F.col("log"), -2000, 2000)))


def point_arrays(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """path, name, i, x, y, z of the arrays of points in npy and npz files (a file per row); arrays whose last dimension isn't 3, and files that don't read, have no rows."""
    import io
    from collections.abc import Iterator

    import numpy as np
    import pyarrow as pa

    def arrays(data: bytes) -> dict:
        try:
            got = np.load(io.BytesIO(data), allow_pickle=False)
            return {k: got[k] for k in got.files} if hasattr(got, "files") else {"": got}
        except (ValueError, OSError, EOFError, KeyError):
            return {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, data in zip(*[c.to_pylist() for c in batch.columns]):
                for name, a in arrays(data or b"").items():
                    if a.ndim and a.shape[-1] == 3 and a.dtype.kind in "fiu":
                        q = a.reshape(-1, 3).astype(float)
                        yield pa.RecordBatch.from_pydict({"path": pa.array([p] * len(q), pa.string()), "name": pa.array([name] * len(q), pa.string()), "i": pa.array(range(len(q)), pa.int64())} | {c: pa.array(q[:, k]) for k, c in enumerate("xyz")})

    return files.select(path, content).mapInArrow(run, "path string, name string, i long, x double, y double, z double")
