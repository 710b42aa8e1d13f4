"""Problem 3: fields that are added, renamed, removed or retyped between the files of a feed.

Each file's fields and JSON types make its fingerprint. A feed's files in
the order of recording give its versions, and each version a chain of
migration steps (rename, scale, cast, default) that brings a record to the
one target schema. The chains are the one source of both results: a record is
routed through its file's chain, and the report compares each file's chain
with that of the file before.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrawing.runtime import cut, kept, small

#: The target columns and their types.
TARGET = {"source_index": "int", "t": "double", "lat": "double", "lon": "double", "alt": "double", "yaw": "double", "gimbal_pitch": "double", "kind": "string"}
#: More (feed, name) pairs than this, of names that only their values tell, are joined with a shuffle.
MOST_NAMES = 50_000
#: The kinds of track in the order of their numbers.
KINDS = ("srt", "csv", "gpx", "kml", "json", "mavlink", "embedded")
#: Words that name the same thing, words that add nothing, and units with what a value in them is worth in the target's.
WORDS = {
    "gb": "gimbal", "cam": "gimbal", "camera": "gimbal", "mount": "gimbal",
    "heading": "yaw", "hdg": "yaw", "azimuth": "yaw", "bearing": "yaw", "compass": "yaw", "psi": "yaw",
    "tilt": "pitch", "vertical": "pitch",
    "latitude": "lat", "longitude": "lon", "lng": "lon", "long": "lon",
    "altitude": "alt", "height": "alt", "elevation": "alt", "ele": "alt", "elev": "alt",
    "time": "t", "timestamp": "t", "ts": "t",
    "format": "kind", "type": "kind",
    "idx": "index", "sample": "source", "src": "source",
}
NEUTRAL = {"true", "magnetic", "drone", "uav", "aircraft", "body", "attitude", "orientation", "position", "pos", "geo", "location", "coord", "coords", "angle", "value"}
UNITS = {
    "deg": 1.0, "degree": 1.0, "degrees": 1.0, "rad": 180 / math.pi, "radian": 180 / math.pi, "radians": 180 / math.pi, "m": 1.0, "meters": 1.0, "metres": 1.0, "cm": 0.01, "mm": 0.001, "ft": 0.3048, "feet": 0.3048,
    "s": 1.0, "sec": 1.0, "seconds": 1.0, "millis": 0.001, "milliseconds": 0.001,
}
#: Sets of words, after WORDS and without the neutral ones, that stand for a target column.
QUANTITIES = {
    frozenset(words.split()): name
    for name, spellings in {
        "source_index": ("source index", "index"), "t": ("t",), "lat": ("lat", "gps lat"), "lon": ("lon", "gps lon"), "alt": ("alt", "gps alt"), "yaw": ("yaw",), "gimbal_pitch": ("gimbal pitch",),
        "kind": ("kind", "source kind", "track kind", "file kind", "telemetry kind"),
    }.items()
    for words in spellings
}


def _words(path: str) -> list[str]:
    return [w.lower() for w in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+", path)]


@lru_cache(maxsize=100_000)
def quantity(path: str) -> str:
    """The target column that a field's dotted name stands for by its words, or else the name itself."""
    words = _words(path)
    named = frozenset(WORDS.get(w, w) for w in words if len(words) == 1 or w not in UNITS and w not in NEUTRAL)
    return QUANTITIES.get(named, path)


def factor(path: str) -> float:
    """What a number under a name is worth in the target's unit, by the unit that the name ends with."""
    words = _words(path)
    return UNITS.get(words[-1], 1.0) if len(words) > 1 else 1.0


def json_type(v: object) -> str:
    if v is None:
        return "null"
    if isinstance(v, bool):
        return "boolean"
    if isinstance(v, (int, float)):
        return "number"
    return "string" if isinstance(v, str) else "array" if isinstance(v, list) else "object"


def flatten(record: dict, prefix: str = "") -> Iterator[tuple[str, object]]:
    """Dotted paths and values; an empty object counts as a value."""
    todo = [(prefix, record)]
    while todo:
        head, part = todo.pop()
        for k, v in part.items():
            if isinstance(v, dict) and v:
                todo.append((f"{head}{k}.", v))
            else:
                yield f"{head}{k}", v


def parse(line: str | None) -> dict | None:
    """The record of a line, or None if it isn't a JSON object; a byte order mark may come first."""
    try:
        record = json.loads((line or "").lstrip("﻿"))
    except (ValueError, RecursionError):
        return None
    return record if isinstance(record, dict) else None


_PROFILE = "n long, least double, most double, digits int, place int"
_FIELD = "struct<quantity: string, name: string, types: array<string>, " + _PROFILE.replace(" long", ": long").replace(" double", ": double").replace(" int", ": int") + ">"


def file_schemas(lines: DataFrame, file_id: str, line: str) -> DataFrame:
    """file_id and fields of each file that has any: for each its quantity (by its words), name, types (sorted array) and profile.

    The profile is n (records that carry a value), least and most of its
    numbers, digits (decimals of the finest one) and place (the field's least
    position in a record). A field is in a file if any record carries it, even
    if only with nulls; null isn't a type. Lines that aren't JSON objects, null
    and empty lines carry nothing; repeated lines change nothing but n.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[tuple, list] = {}
            for f, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for place, (path, v) in enumerate(flatten(parse(text) or {})):
                    at = seen.setdefault((f, path, json_type(v)), [0, math.inf, -math.inf, 0, place])
                    at[0] += v is not None
                    at[4] = min(at[4], place)
                    x = to_number(v)
                    if x is not None:
                        at[1], at[2] = min(at[1], x), max(at[2], x)
                        at[3] = max(at[3], len(repr(x).partition(".")[2].rstrip("0").partition("e")[0]))
            keys, rows = list(seen), list(seen.values())
            yield pa.RecordBatch.from_pydict({
                "file_id": pa.array([k[0] for k in keys], pa.int64()), "quantity": pa.array([quantity(k[1]) for k in keys], pa.string()),
                "name": pa.array([k[1] for k in keys], pa.string()), "type": pa.array([k[2] for k in keys], pa.string()),
                "n": pa.array([r[0] for r in rows], pa.int64()), "least": pa.array([r[1] for r in rows], pa.float64()), "most": pa.array([r[2] for r in rows], pa.float64()),
                "digits": pa.array([r[3] for r in rows], pa.int32()), "place": pa.array([r[4] for r in rows], pa.int32()),
            })

    found = lines.select(F.col(file_id).cast("long").alias("file_id"), F.col(line).alias("line")).mapInArrow(
        scan, "file_id long, quantity string, name string, type string, n long, least double, most double, digits int, place int"
    )
    # Tasks have merged their own lines already; a file's rows stay together from here to its schema.
    fields = found.repartition("file_id").groupBy("file_id", "quantity", "name").agg(
        F.sort_array(F.collect_set(F.when(F.col("type") != "null", F.col("type")))).alias("types"),
        F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most"), F.max("digits").alias("digits"), F.min("place").alias("place"),
    )
    return fields.groupBy("file_id").agg(F.sort_array(F.collect_list(F.struct("quantity", "name", "types", "n", "least", "most", "digits", "place"))).alias("fields"))


def before(files: DataFrame, group: str, order: str, row_id: str) -> DataFrame:
    """Adds ``previous``: the row_id of the row just before in its group.

    A group may hold a third of all rows: the rows of one month of ``order``
    are taken together, and the first of each month looks at the last of the
    month before, of which there is one row per group and month.
    """
    month = files.withColumn("_m", F.trunc(F.col(order).cast("date"), "month"))
    w = Window.partitionBy(group, "_m").orderBy(order, row_id)
    inside = month.withColumn("_p", F.lag(row_id).over(w))
    last = month.groupBy(group, "_m").agg(F.max_by(row_id, F.struct(order, row_id)).alias("_last"))
    last = last.withColumn("_carry", F.lag("_last").over(Window.partitionBy(group).orderBy("_m"))).select(F.col(group).alias("_g"), F.col("_m").alias("_gm"), "_carry")
    joined = inside.join(last, inside[group].eqNullSafe(last["_g"]) & inside["_m"].eqNullSafe(last["_gm"]), "left")
    return joined.withColumn("previous", F.coalesce("_p", "_carry")).drop("_m", "_p", "_g", "_gm", "_carry")


def same_quantity(pairs: DataFrame, feed: str) -> DataFrame | None:
    """feed, name and quantity: names that words don't tell, but what the files show; None if there are none.

    pairs holds each file's fields beside those of the file before (now, old).
    A name stands for a target column if it first comes in a file in which
    every name of that column goes, or the other way round, never beside it in
    a file of the feed, at nearly the same place of the record, as often, with
    the same decimals, and with numbers that go on in the same range. Where
    two names or two columns would do, none is taken.
    """
    numbers = [q for q, k in TARGET.items() if k != "string"]
    only = lambda a, b: F.filter(a, lambda f: ~F.exists(b, lambda g: g["quantity"] == f["quantity"]))
    rows = pairs.select(F.col(feed).alias("_feed"), F.array(F.struct(only("now", "old").alias("come"), only("old", "now").alias("gone")), F.struct(only("old", "now").alias("come"), only("now", "old").alias("gone"))).alias("_s"))
    rows = rows.select("_feed", F.explode("_s").alias("_s"))
    unknown = F.filter("_s.come", lambda f: (f["quantity"] == f["name"]) & ~f["name"].isin(*TARGET) & (f["n"] > 0) & (f["most"] >= f["least"]))
    known = F.filter("_s.gone", lambda f: f["quantity"].isin(*numbers))
    rows = rows.select("_feed", unknown.alias("_a"), known.alias("_b")).where("size(_a) > 0 and size(_b) > 0")
    met = rows.withColumn("a", F.explode("_a")).withColumn("b", F.explode("_b"))
    widest = F.greatest(F.col("a.most") - F.col("a.least"), F.col("b.most") - F.col("b.least"))
    common = F.least("a.most", "b.most") - F.greatest("a.least", "b.least")
    like = (common > 0) & (common >= 0.4 * widest) & (F.col("a.digits") == F.col("b.digits")) & (F.abs(F.col("a.place") - F.col("b.place")) <= 1) & F.col("a.n").between(F.col("b.n") * 0.5, F.col("b.n") * 2)
    likely, n = kept(met.where(like).select("_feed", F.col("a.name").alias("name"), F.col("b.quantity").alias("q")).distinct(), MOST_NAMES)
    if not n:
        return None
    # Both never stand in one file of the feed.
    both = F.exists("now", lambda f: f["name"] == F.col("name")) & F.exists("now", lambda f: f["quantity"] == F.col("q"))
    beside = pairs.join(small(likely, MOST_NAMES, n), F.col(feed) == F.col("_feed")).where(both).select("_feed", "name", "q").distinct()
    apart = likely.join(beside, ["_feed", "name", "q"], "left_anti")
    alone = apart.withColumns({"_k": F.count(F.lit(1)).over(Window.partitionBy("_feed", "name")), "_l": F.count(F.lit(1)).over(Window.partitionBy("_feed", "q"))}).where("_k = 1 and _l = 1")
    return alone.groupBy("_feed").agg(F.map_from_entries(F.collect_list(F.struct("name", "q"))).alias("_shown"))


def versions(files: DataFrame, schemas: DataFrame, feed: str = "feed_id", recorded: str = "recorded_at") -> DataFrame:
    """file_id, feed, previous (the file before), fingerprint, starts (whether a version of the feed starts here), steps and old_steps (JSON: the chains of the file and of that before) of every file.

    Files without any field take part as empty ones. Files recorded at the
    same time follow each other by file_id.
    """
    placed = before(files.select(feed, recorded, "file_id"), feed, recorded, "file_id").select(F.col(feed).cast("long").alias(feed), "file_id", "previous")
    old = schemas.select(F.col("file_id").alias("_pf"), F.col("fields").alias("_old"))
    none = F.array().cast(f"array<{_FIELD}>")
    pairs = placed.join(schemas, "file_id", "left").join(old, F.col("previous") == F.col("_pf"), "left")
    pairs = cut(files.sparkSession, pairs.select(feed, "file_id", "previous", F.coalesce("fields", none).alias("now"), F.coalesce("_old", none).alias("old")))
    shown = same_quantity(pairs, feed)
    if shown is not None:
        shown, n = kept(shown, MOST_NAMES)
        pairs = pairs.join(small(shown, MOST_NAMES, n), F.col(feed) == F.col("_feed"), "left")
    quantity_of = lambda f: f["quantity"] if shown is None else F.coalesce(F.col("_shown")[f["name"]], f["quantity"])
    plain = lambda c: F.sort_array(F.transform(c, lambda f: F.struct(quantity_of(f).alias("quantity"), f["name"].alias("name"), f["types"].alias("types"))))
    rows = pairs.select(feed, "file_id", "previous", F.to_json(plain("now")).alias("now"), F.to_json(plain("old")).alias("old"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chains: dict[str, str] = {}

        def chain(fields: str) -> str:
            if fields not in chains:
                chains[fields] = json.dumps(migration([(f["quantity"], f["name"], tuple(f["types"])) for f in json.loads(fields)]))
            return chains[fields]

        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *[pa.array([chain(x) for x in batch.column(c).to_pylist()], pa.string()) for c in ("now", "old")]], [*batch.schema.names[:3], "steps", "old_steps"])

    chained = rows.mapInArrow(write, f"{feed} long, file_id long, previous long, steps string, old_steps string")
    return chained.withColumns({"fingerprint": F.md5("steps"), "starts": F.col("previous").isNull() | (F.col("steps") != F.col("old_steps"))})


def changes(version: DataFrame, feed: str = "feed_id") -> DataFrame:
    """feed, file_id, field_name, change_kind, and the names and types before and after: how the chain of each file that starts a version differs from that before.

    A feed's first file has no change.
    """
    kind = "array<struct<op: string, from: string, to: string, types: array<string>>>"
    pair = version.where("starts and previous is not null").select(feed, "file_id", F.from_json("steps", kind).alias("now"), F.from_json("old_steps", kind).alias("old"))
    every = F.array_distinct(F.transform(F.concat("now", "old"), lambda s: s["to"]))
    each = pair.withColumn("field_name", F.explode(every))
    q = F.col("field_name")
    named = lambda c: F.array_sort(F.array_distinct(F.transform(F.filter(c, lambda s: (s["to"] == q) & s["op"].isin("keep", "rename")), lambda s: s["from"])))
    typed = lambda c: F.array_sort(F.array_distinct(F.flatten(F.transform(F.filter(c, lambda s: (s["to"] == q) & s["op"].isin("keep", "rename")), lambda s: s["types"]))))
    each = each.select(feed, "file_id", "field_name", named("old").alias("old_names"), named("now").alias("new_names"), typed("old").alias("old_types"), typed("now").alias("new_types"))
    both = (F.size("old_names") > 0) & (F.size("new_names") > 0)
    kinds = F.array(
        F.when((F.size("old_names") == 0) & (F.size("new_names") > 0), "added"),
        F.when((F.size("new_names") == 0) & (F.size("old_names") > 0), "removed"),
        F.when(both & (F.col("old_names") != F.col("new_names")), "renamed"),
        F.when(both & (F.size("old_types") > 0) & (F.size("new_types") > 0) & (F.col("old_types") != F.col("new_types")), "retyped"),
    )
    return each.withColumn("change_kind", F.explode(F.array_compact(kinds)))


def migration(fields: list[tuple[str, str, tuple[str, ...]]]) -> list[dict]:
    """The chain of steps from a file's fields to the target: each field kept or renamed, then scaled to the target's unit, cast to its type, or set to a default where there is none."""
    steps = [{"op": "keep" if name == q else "rename", "from": name, "to": q, "types": list(types)} for q, name, types in fields]
    for q, kind in TARGET.items():
        own = [(name, types) for f, name, types in fields if f == q]
        if not own:
            steps.append({"op": "default", "to": q, "value": None})
            continue
        if kind != "string" and (times := factor(own[0][0])) != 1.0:
            steps.append({"op": "scale", "to": q, "by": times})
        steps.append({"op": "cast", "to": q, "types": sorted({t for _, ts in own for t in ts}), "as": kind})
    return steps


def to_number(v: object) -> float | None:
    """The finite number in a JSON value: itself, the number that a text starts with, or that of an array's only element."""
    if isinstance(v, list):
        return to_number(v[0]) if len(v) == 1 else None
    if isinstance(v, str):
        m = re.match(r"\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)\s*(?:°|[a-z]*)\s*$", v)
        v = float(m[1]) if m else None
    if v is None or isinstance(v, (bool, dict)):
        return None
    x = float(v)
    return x if math.isfinite(x) else None


def to_kind(v: object) -> str | None:
    """A kind of track from its name, its number in KINDS or an array of one of them."""
    if isinstance(v, list):
        return to_kind(v[0]) if len(v) == 1 else None
    if isinstance(v, bool) or v is None or isinstance(v, dict):
        return None
    if isinstance(v, (int, float)):
        return KINDS[int(v)] if v == int(v) and 0 <= v < len(KINDS) else None
    return v.strip().lower() or None


def _whole(x: float | None) -> int | None:
    return int(x) if x is not None and abs(x) < 2**31 and x == int(x) else None


#: What a cast step to a type does.
CASTS = {"int": lambda v: _whole(to_number(v)), "double": to_number, "string": to_kind}
_NATIVE = {"int": int, "double": float, "string": str}


def migrate(record: dict, steps: list[dict]) -> tuple[dict, dict]:
    """The target row of a record and what is left over of it, by a file's steps, in their order.

    Of several fields that carry a quantity the first that isn't null counts.
    What no cast step has brought to a column's type doesn't enter the row.
    """
    flat = dict(flatten(record))
    for s in steps:
        to = s["to"]
        if s["op"] == "rename" and s["from"] in flat:
            v = flat.pop(s["from"])
            if flat.get(to) is None:
                flat[to] = v
        elif s["op"] == "scale" and to in flat:
            x = to_number(flat[to])
            flat[to] = None if x is None else x * s["by"]
        elif s["op"] == "cast" and to in flat:
            flat[to] = CASTS[s["as"]](flat[to])
        elif s["op"] == "default":
            flat.setdefault(to, s["value"])
    row = {}
    for q, kind in TARGET.items():
        v = flat.pop(q, None)
        row[q] = v if type(v) is _NATIVE[kind] else None
    return row, flat


def unified(lines: DataFrame, version: DataFrame, line_no: str = "line_no", line: str = "line") -> DataFrame:
    """One table of all records: file_id, line_no, the target columns, and rest (JSON of the fields that have no column).

    Repeated rows of a line count once. Lines that aren't JSON objects are left out.
    """
    joined = lines.select(F.col("file_id").cast("long").alias("file_id"), F.col(line_no).cast("int").alias("line_no"), F.col(line).alias("line")).join(version.select("file_id", "steps"), "file_id")
    joined = joined.dropDuplicates(["file_id", "line_no"])
    kinds = {"int": pa.int32(), "double": pa.float64(), "string": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain: dict[str, list] = {}
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("file_id", "line_no", *TARGET, "rest")}
            for f, n, text, steps in zip(*[c.to_pylist() for c in batch.columns]):
                record = parse(text)
                if record is None:
                    continue
                row, rest = migrate(record, chain.setdefault(steps, json.loads(steps)) if steps not in chain else chain[steps])
                for k, v in {"file_id": f, "line_no": n, **row, "rest": json.dumps(rest, sort_keys=True, ensure_ascii=False)}.items():
                    out[k].append(v)
            types = {"file_id": pa.int64(), "line_no": pa.int32(), "rest": pa.string()} | {q: kinds[k] for q, k in TARGET.items()}
            yield pa.RecordBatch.from_pydict({k: pa.array(v, types[k]) for k, v in out.items()})

    return joined.mapInArrow(run, "file_id long, line_no int, " + ", ".join(f"{q} {k}" for q, k in TARGET.items()) + ", rest string")
