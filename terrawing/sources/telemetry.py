"""Flight telemetry of seven formats to the one samples table.

Every reader takes the raw contents as a DataFrame (a file per row for text
formats, a message per row for MAVLink) and gives track_id, source_index, t,
lat, lon, alt, alt_is_relative, yaw, pitch, roll, gimbal_yaw, gimbal_pitch,
gimbal_roll. Values that don't parse are null; records without place are left
out, but keep their number.
"""

from __future__ import annotations

import struct
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrawing.operators.blocks import neighbours, numbered

#: Other spellings of the columns, in order of preference.
ALIASES = {
    "lat": ("lat", "latitude"),
    "lon": ("lon", "lng", "longitude"),
    "alt": ("alt", "altitude", "rel_alt", "relative_altitude", "abs_alt"),
    "time": ("time", "timestamp", "t", "time_s", "datetime"),
    "yaw": ("yaw", "heading"),
    "pitch": ("pitch",),
    "roll": ("roll",),
    "gimbal_yaw": ("gimbal_yaw", "gb_yaw"),
    "gimbal_pitch": ("gimbal_pitch", "gb_pitch"),
    "gimbal_roll": ("gimbal_roll", "gb_roll"),
}
#: Keys of a JSON object under which its list of records lies.
RECORD_KEYS = ("samples", "points", "telemetry", "track", "data")
COLUMNS = ["track_id", "source_index", "t", "lat", "lon", "alt", "alt_is_relative", "yaw", "pitch", "roll", "gimbal_yaw", "gimbal_pitch", "gimbal_roll"]
_DOUBLES = [c for c in COLUMNS if c not in ("track_id", "source_index", "alt_is_relative")]


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """path and text of whole files."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def _samples(df: DataFrame, **columns: Column) -> DataFrame:
    """The samples table from the given columns; what isn't given is null, alt_is_relative false."""
    out = []
    for c in COLUMNS:
        kind = {"track_id": "bigint", "source_index": "int", "alt_is_relative": "boolean"}.get(c, "double")
        out.append(columns.get(c, F.col(c) if c == "track_id" else F.lit(False) if c == "alt_is_relative" else F.lit(None)).cast(kind).alias(c))
    return df.select(*out).where("lat is not null and lon is not null")


def time_value(text: Column, index: Column) -> Column:
    """Seconds from a number or an ISO moment (without zone: UTC), else the record's number."""
    iso = F.regexp_replace(F.trim(text), "Z$", "+00:00")
    zoned = F.when(iso.rlike(r"[+-]\d{2}:?\d{2}$"), iso).otherwise(F.concat(iso, F.lit("+00:00")))
    moment = F.unix_micros(F.when(iso.rlike(r"^\d{4}-\d{2}-\d{2}"), zoned).try_cast("timestamp")) / 1e6
    return F.coalesce(F.trim(text).try_cast("double"), moment, index.cast("double"))


def srt_seconds(h: Column, m: Column, s: Column, fraction: Column) -> Column:
    """Clock time with a fraction of one to three digits, filled up to milliseconds on the right."""
    return h.cast("double") * 3600 + m.cast("double") * 60 + s.cast("double") + F.substring(F.rpad(fraction, 3, "0"), 1, 3).cast("double") / 1000


def srt(files: DataFrame, track: str = "track_id", text: str = "text") -> DataFrame:
    """Subtitle blocks, parted by blank lines, of the bracketed or the older GPS(lon,lat,alt) form.

    The start of a block's time range counts, without one the block's number.
    An absolute height comes before a relative one.
    """
    blocks = files.select(F.col(track).alias("track_id"), F.posexplode(F.split(F.trim(F.regexp_replace(text, "\r\n", "\n")), r"\n\s*\n")).alias("i", "b"))
    b = F.col("b")
    figure = r"([+-]?[0-9]+(?:[.][0-9]*)?)"
    value = lambda name: F.nullif(F.regexp_extract(b, rf"{name}\s*:\s*{figure}", 1), F.lit("")).cast("double")
    # hours, minutes, seconds and their fraction before the arrow
    time = ":".join(["([0-9]{2})"] * 3) + "[.,]([0-9]{1,3}) *-->"
    clock = F.when(b.rlike(time), srt_seconds(*[F.regexp_extract(b, time, k) for k in range(1, 5)]))
    old = r"GPS *\( *" + " *, *".join([figure] * 3) + r" *\)"
    gps = lambda k: F.nullif(F.regexp_extract(b, old, k), F.lit("")).cast("double")
    new = b.rlike(r"\[latitude\s*:") & b.rlike(r"\[longitude\s*:")
    absolute, relative = value("abs_alt"), value("rel_alt")
    return _samples(
        blocks, source_index=F.col("i"), t=F.coalesce(clock, F.col("i").cast("double")), lat=F.when(new, value(r"\[latitude")).otherwise(gps(2)), lon=F.when(new, value(r"\[longitude")).otherwise(gps(1)),
        alt=F.when(new, F.coalesce(absolute, relative)).otherwise(gps(3)), alt_is_relative=new & absolute.isNull() & relative.isNotNull(),
        gimbal_yaw=value("gb_yaw"), gimbal_pitch=value("gb_pitch"), gimbal_roll=value("gb_roll"),
    )


def _aliased(m: Column, canon: str) -> Column:
    return F.coalesce(*[m[a] for a in ALIASES[canon]])


def csv(files: DataFrame, track: str = "track_id", text: str = "text") -> DataFrame:
    """Comma-separated text with a header in any case and spelling; rows without a numeric place are left out.

    The first alias of a column that the header has counts. A height is
    relative if its header says rel_alt.
    """
    lines = files.select(F.col(track).alias("track_id"), F.posexplode(F.split(F.regexp_replace(F.regexp_replace(text, "\r\n", "\n"), "^﻿", ""), "\n")).alias("i", "line"))
    head = lines.where("i = 0").select(F.col("track_id").alias("_t"), F.transform(F.split("line", ","), lambda x: F.lower(F.trim(x))).alias("names"))
    rows = lines.where("i > 0 and trim(line) != ''").join(head, F.col("track_id") == F.col("_t"))
    rows = rows.withColumn("_f", _split_quoted(F.col("line"))).withColumn("m", F.map_from_entries(F.arrays_zip(F.col("names"), F.slice("_f", 1, F.size("names")))))
    m = F.col("m")
    num = lambda c: F.trim(_aliased(m, c)).try_cast("double")
    has = lambda c: F.filter(F.array(*[F.lit(a) for a in ALIASES[c]]), lambda a: F.array_contains("names", a))
    index = F.col("i") - 1
    return _samples(
        rows, source_index=index, t=time_value(_aliased(m, "time"), index), alt_is_relative=F.coalesce(F.get(has("alt"), F.lit(0)).contains("rel_alt"), F.lit(False)),
        **{c: num(c) for c in ("lat", "lon", "alt", "yaw", "pitch", "roll", "gimbal_yaw", "gimbal_pitch", "gimbal_roll")},
    )


def _split_quoted(line: Column) -> Column:
    """Fields of a comma-separated line; commas in quoted fields don't part them."""
    parts = F.split(line, r',(?=(?:[^"]*"[^"]*")*[^"]*$)')
    return F.transform(parts, lambda x: F.regexp_replace(F.regexp_replace(F.trim(x), '^"|"$', ""), '""', '"'))


def json_records(files: DataFrame, track: str = "track_id", text: str = "text") -> DataFrame:
    """A list of records, or an object with one under the first of RECORD_KEYS; keys in any case. Gimbal angles aren't read."""
    listed = [F.from_json(text, "array<map<string,string>>")]
    listed += [F.from_json(F.get_json_object(text, f"$.{k}"), "array<map<string,string>>") for k in RECORD_KEYS]
    records = files.select(F.col(track).alias("track_id"), F.posexplode(F.coalesce(*[F.when(F.size(x) > 0, x) for x in listed])).alias("i", "r")).where("r is not null")
    rows = records.withColumn("m", F.map_from_entries(F.transform(F.map_entries("r"), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))))
    m = F.col("m")
    return _samples(rows, source_index=F.col("i"), t=time_value(_aliased(m, "time"), F.col("i")), **{c: _aliased(m, c).try_cast("double") for c in ("lat", "lon", "alt", "yaw", "pitch", "roll")})


def gpx(files: DataFrame, track: str = "track_id", text: str = "text") -> DataFrame:
    """All track points, or else all way points, with optional height and time; namespaces don't matter. Broken XML has no points."""

    def points(t: str | None) -> list[tuple]:
        try:
            root = ET.fromstring(t or "")
        except ET.ParseError:
            return []
        found = [e for e in root.iter() if e.tag.rpartition("}")[2] == "trkpt"] or [e for e in root.iter() if e.tag.rpartition("}")[2] == "wpt"]
        child = lambda e, n: next(((c.text or "").strip() for c in e if c.tag.rpartition("}")[2] == n), None)
        return [(e.get("lat"), e.get("lon"), child(e, "ele"), child(e, "time")) for e in found]

    return _xml(files, track, text, points)


def kml(files: DataFrame, track: str = "track_id", text: str = "text") -> DataFrame:
    """All lon,lat[,alt] tuples of all coordinates; the running number is the time."""

    def points(t: str | None) -> list[tuple]:
        try:
            root = ET.fromstring(t or "")
        except ET.ParseError:
            return []
        tuples = [p.split(",") for e in root.iter() if e.tag.rpartition("}")[2] == "coordinates" for p in (e.text or "").split()]
        return [(p[1], p[0], p[2] if len(p) > 2 else None, None) for p in tuples if len(p) >= 2]

    return _xml(files, track, text, points)


def _xml(files: DataFrame, track: str, text: str, points: Callable[[str | None], list[tuple]]) -> DataFrame:
    """Points of XML texts by an Arrow function: a text is a tree, which no built-in expression walks."""
    @F.pandas_udf("array<struct<lat: string, lon: string, ele: string, time: string>>")
    def parse(texts: pd.Series) -> pd.Series:
        return texts.map(points)

    rows = files.select(F.col(track).alias("track_id"), F.posexplode(parse(text)).alias("i", "p"))
    return _samples(rows, source_index=F.col("i"), t=time_value(F.col("p.time"), F.col("i")), lat=F.col("p.lat").try_cast("double"), lon=F.col("p.lon").try_cast("double"), alt=F.col("p.ele").try_cast("double"))


def mavlink(messages: DataFrame, track: str = "track_id", order: str = "seq") -> DataFrame:
    """Position messages with the last attitude before them; degrees times 1e7, millimetres, milliseconds and radians to plain units."""
    att = F.when(F.col("type") == "ATTITUDE", F.struct(*[F.degrees(a).alias(a) for a in ("yaw", "pitch", "roll")]))
    rows = neighbours(messages, [track], order, [], att).where(F.col("type").isin("GLOBAL_POSITION_INT", "GPS_RAW_INT"))
    rows = rows.withColumns({f"_{a}": F.col(f"_prev.{a}") for a in ("yaw", "pitch", "roll")}).drop("_prev", "_next")
    rows = numbered(rows, [track], [order], "_i")
    return _samples(
        rows.withColumn("track_id", F.col(track)), source_index=F.col("_i"), t=F.coalesce(F.col("time_boot_ms"), F.col("_i") * 100) / 1000.0, lat=F.col("lat") / 1e7, lon=F.col("lon") / 1e7,
        alt=F.coalesce("relative_alt", "alt", F.lit(0)) / 1000.0, alt_is_relative=F.col("relative_alt").isNotNull(), yaw=F.col("_yaw"), pitch=F.col("_pitch"), roll=F.col("_roll"),
    )


#: Names of the message table's columns in a log that is written as one JSON object per line.
MESSAGE = "seq long, type string, lat double, lon double, alt double, relative_alt double, time_boot_ms double, yaw double, pitch double, roll double"


def mavlink_lines(files: DataFrame, track: str = "track_id", text: str = "text") -> DataFrame:
    """A log whose messages are JSON objects, one per line, with the columns of MESSAGE; seq is the line's number where it isn't given."""
    lines = files.select(F.col(track).alias("track_id"), F.posexplode(F.split(text, "\n")).alias("i", "line"))
    rows = lines.withColumn("m", F.from_json("line", MESSAGE)).where("m.type is not null").select("track_id", "i", "m.*")
    return mavlink(rows.withColumn("seq", F.coalesce("seq", F.col("i").cast("long"))).drop("i"))


#: Fixed values of the protocol: message number to name, payload layout, its columns and the extra byte of its checksum.
PACKETS = {
    24: ("GPS_RAW_INT", "<Qiii", ("_usec", "lat", "lon", "alt"), 24),
    30: ("ATTITUDE", "<Ifff", ("time_boot_ms", "roll", "pitch", "yaw"), 39),
    33: ("GLOBAL_POSITION_INT", "<Iiiii", ("time_boot_ms", "lat", "lon", "alt", "relative_alt"), 104),
}


def _checksum(data: bytes) -> int:
    """The protocol's CRC-16 (X.25, unreflected end)."""
    crc = 0xFFFF
    for b in data:
        t = (b ^ crc) & 0xFF
        t = (t ^ t << 4) & 0xFF
        crc = crc >> 8 ^ t << 8 ^ t << 3 ^ t >> 4
    return crc & 0xFFFF


def packets(log: bytes) -> Iterator[tuple[str, dict[str, float]]]:
    """Names and values of the known messages of a log of protocol version 1 or 2, with or without time stamps between them; what doesn't check is skipped byte by byte."""
    i, n = 0, len(log)
    while i < n:
        if log[i] == 0xFE and i + 8 <= n:
            head, size, number, end = 6, log[i + 1], log[i + 5], i + 8 + log[i + 1]
        elif log[i] == 0xFD and i + 12 <= n:
            size, number = log[i + 1], int.from_bytes(log[i + 7 : i + 10], "little")
            head, end = 10, i + 12 + size + (13 if log[i + 2] & 1 else 0)
        else:
            i += 1
            continue
        known, at = PACKETS.get(number), i + head
        if known and end <= n and _checksum(log[i + 1 : at + size] + bytes([known[3]])) == int.from_bytes(log[at + size : at + size + 2], "little"):
            name, layout, columns, _ = known
            values = struct.unpack(layout, log[at : at + size].ljust(struct.calcsize(layout), b"\0")[: struct.calcsize(layout)])
            yield name, {c: float(v) for c, v in zip(columns, values) if c[0] != "_"}
            i = end
        else:
            i += 1


def mavlink_logs(files: DataFrame, track: str = "track_id", content: str = "content") -> DataFrame:
    """Binary logs (a file per row) to samples: their position and attitude messages, in order."""
    columns = ("lat", "lon", "alt", "relative_alt", "time_boot_ms", "yaw", "pitch", "roll")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t, log in zip(*[c.to_pylist() for c in batch.columns]):
                got = list(packets(log or b""))
                yield pa.RecordBatch.from_pydict(
                    {"track_id": pa.array([t] * len(got), pa.int64()), "seq": pa.array(range(len(got)), pa.int64()), "type": pa.array([g[0] for g in got], pa.string())}
                    | {c: pa.array([g[1].get(c) for g in got], pa.float64()) for c in columns}
                )

    return mavlink(files.select(F.col(track).cast("long").alias("track_id"), content).mapInArrow(run, "track_id long, seq long, type string, " + ", ".join(f"{c} double" for c in columns)))


def embedded(files: DataFrame, track: str = "track_id", text: str = "text") -> DataFrame:
    """The subtitle stream of a video, as a demuxer writes it out: subtitles as in srt, with styling tags and positions taken off."""
    return srt(files.withColumn(text, F.regexp_replace(text, r"</?[A-Za-z][^>\n]*>|\{\\[^}\n]*\}", "")), track, text)


#: Reader of each kind of track.
READERS: dict[str, Callable[..., DataFrame]] = {"srt": srt, "csv": csv, "gpx": gpx, "kml": kml, "json": json_records, "mavlink": mavlink_lines, "embedded": embedded}


def read(files: DataFrame, kind: str = "kind", track: str = "track_id", text: str = "text") -> DataFrame:
    """Samples of files of mixed kinds; files of unknown kinds have none."""
    parts = [reader(files.where(F.col(kind) == name), track, text) for name, reader in READERS.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def tracks(files: DataFrame, kind: str = "kind", track: str = "track_id", text: str = "text") -> DataFrame:
    """track, kind, n_samples, has_timestamps and note of each file: one that can't be read is an empty track with a note that says why."""
    counts = read(files, kind, track, text).groupBy("track_id").agg(F.count(F.lit(1)).alias("_n")).withColumnRenamed("track_id", "_t")
    rows = files.join(counts, F.col(track) == F.col("_t"), "left")
    n = F.coalesce("_n", F.lit(0))
    note = (
        F.when(~F.col(kind).isin(*READERS) | F.col(kind).isNull(), F.concat(F.lit("no reader for kind "), F.coalesce(kind, F.lit("(none)"))))
        .when(F.coalesce(F.trim(text), F.lit("")) == "", "the file is empty")
        .when(n == 0, F.concat(F.lit("no sample with a place in this "), F.col(kind), F.lit(" file")))
    )
    return rows.select(track, kind, n.alias("n_samples"), ((n > 0) & ~F.col(kind).isin("kml")).alias("has_timestamps"), note.alias("note"))
