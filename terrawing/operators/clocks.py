"""Problem 4: clock texts of many notations to UTC moments.

Texts are parsed to one of three statements: a moment, a span since the
track's start, or a local time, with or without zone letters. Local times
meet their zone in an as-of join against the zone's offset intervals, one row
each: no matching interval means a time that the clocks skipped, one gives the offset,
two mean a time that occurred twice. Those are settled by the moments around
them in the same track. All of it runs as built-in expressions.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrawing.operators.blocks import neighbours
from terrawing.runtime import cut, kept, small

#: Kinds of tracks whose texts count from the track's start, as a clock or in milliseconds.
SPAN_KINDS, MILLI_KINDS = ("srt", "embedded"), ("mavlink",)
#: Letters that mean UTC wherever the site is.
UTC_LETTERS = ("Z", "UTC", "GMT", "UT")
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")

#: Doubtful times and their neighbours are looked at within so many milliseconds of a change of the clocks.
AROUND_MS = 6 * 3_600_000
DAY_MS = 86_400_000
#: The calendar's ends, in s since 1970, less a day for the zones.
FIRST_S, LAST_S = -62_135_596_800 + 86_400, 253_402_300_799 - 86_400
#: More pairs of zone and year (or turns of the clocks in a track, or runs of doubtful marks) than this aren't broadcast.
MOST_PAIRS = 50_000
#: A coarser text may lie behind the text before it by less than this.
SLACK_MS = 1_000


def zone_intervals(pairs: DataFrame) -> DataFrame:
    """zone, from, to, offset, letters and until of each interval of constant offset that local times of a (zone, year) of pairs can meet, and that year.

    from, to (excluded) are local ends and offset in ms, until is the UTC end.
    Workers make the rows from the tz database; unknown zones have none. What
    is asked for is what the marks hold: at most the tz database's some 600
    zones times the calendar's years, each with three or four intervals.
    """

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"zone": pa.string(), "year": pa.int32(), "from": pa.int64(), "to": pa.int64(), "offset": pa.int64(), "letters": pa.string(), "until": pa.int64()}
        for batch in batches:
            rows = []
            for name, year in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    zone_info = ZoneInfo(name)
                except (KeyError, ValueError, OSError):
                    continue
                start, end = _ms(year), _ms(year + 1)
                rows += [(name, year, a + o, b + o, o, letters, b) for o, letters, a, b in _constant(zone_info, start - 2 * DAY_MS, end + 2 * DAY_MS) if a + o < end and b + o > start]
            yield pa.RecordBatch.from_pydict({k: pa.array([r[i] for r in rows], kind) for i, (k, kind) in enumerate(kinds.items())})

    return pairs.mapInArrow(make, "zone string, year int, from long, to long, offset long, letters string, until long")


def _ms(year: int) -> int:
    """The start of a year in ms since 1970, counted by the calendar on both sides."""
    return (year - 1970) * 365 * DAY_MS + ((year - 1) // 4 - (year - 1) // 100 + (year - 1) // 400 - 477) * DAY_MS


def _constant(zone: ZoneInfo, start_ms: int, end_ms: int) -> list[tuple[int, str, int, int]]:
    """(offset, letters, from, to) of each stretch of constant offset, in ms; changes are found by bisection between weeks."""
    base = datetime(1970, 1, 1, tzinfo=timezone.utc)

    def at(s: int) -> tuple[int, str]:
        local = (base + timedelta(seconds=min(max(s, FIRST_S), LAST_S))).astimezone(zone)
        return int(local.utcoffset().total_seconds()) * 1000, local.tzname() or ""

    start, end = start_ms // 1000, end_ms // 1000
    out, since, now = [], start, at(start)
    step = 7 * 86_400
    for s in range(start, end, step):
        b = min(s + step, end)
        if at(b) != now:
            lo, hi = s, b
            while hi - lo > 1:
                mid = (lo + hi) // 2
                lo, hi = (mid, hi) if at(mid) == now else (lo, mid)
            out.append((*now, since * 1000, hi * 1000))
            since, now = hi, at(hi)
    out.append((*now, since * 1000, end * 1000))
    return out


def statements(marks: DataFrame, text: str, kind: str, zone: str, started_ms: str) -> DataFrame:
    """Adds ``utc_ms`` (the moment, if the text alone or with the start says it), ``local_ms`` and ``letters`` (else, if it states a local time).

    All three are null for a text that states no possible moment. Padding of
    blanks, no-break spaces and byte order marks is taken off. Milliseconds
    are cut off, not rounded.
    """
    time = r"(\d{1,2}):(\d{2}):(\d{2})(?:[.,](\d+))?"
    tail = r"\s*(Z|[+-]\d{2}:?\d{2}|[A-Za-z]{1,5})?"
    # Each notation is rewritten to the same ten fields: order of the date, its parts, hour, minute, second, fraction, half of the day, ending.
    forms = [
        (rf"^(\d{{4}})-(\d{{1,2}})-(\d{{1,2}})[T ]\s*{time}{tail}$", "ymd|$1|$2|$3|$4|$5|$6|$7||$8"),
        (rf"^(\d{{4}})(\d{{2}})(\d{{2}})T(\d{{2}})(\d{{2}})(\d{{2}})(?:[.,](\d+))?{tail}$", "ymd|$1|$2|$3|$4|$5|$6|$7||$8"),
        (rf"^(\d{{1,2}})\.(\d{{1,2}})\.(\d{{4}})\s+{time}{tail}$", "ymd|$3|$2|$1|$4|$5|$6|$7||$8"),
        (rf"^(\d{{1,2}})/(\d{{1,2}})/(\d{{4}})\s+{time}(?:\s*([AaPp])\.?[Mm]\.?)?{tail}$", "slash|$3|$1|$2|$4|$5|$6|$7|$8|$9"),
        (rf"^(?:[A-Za-z]{{3,9}},?\s+)?(\d{{1,2}})[\s-]([A-Za-z]{{3}})[A-Za-z]*[\s-](\d{{4}})\s+{time}{tail}$", "name|$3|$2|$1|$4|$5|$6|$7||$8"),
        (r"^(\d{1,4}):(\d{2}):(\d{2})(?:[.,](\d+))?(?:\s*-->.*)?$", "span||||$1|$2|$3|$4||"),
    ]
    same = F.regexp_replace(F.col(text), r"^[\s\u00a0\ufeff]+|[\s\u00a0\ufeff]+$", "")
    for pattern, fields in forms:
        same = F.regexp_replace(same, pattern, fields)
    df = marks.withColumn("_g", F.split(same, r"\|", -1))
    g = lambda i: F.get("_g", F.lit(i))
    n = lambda i: g(i).try_cast("int")
    month_first = F.coalesce(F.col(zone), F.lit("UTC")).startswith("America/")
    named = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.lower(g(2))).cast("int")
    df = df.withColumns({
        "_mo": F.when(g(0) == "name", named).when((g(0) == "slash") & ~month_first, n(3)).otherwise(n(2)),
        "_d": F.when((g(0) == "slash") & ~month_first, n(2)).otherwise(n(3)),
        "_h": F.when(g(8) == "", n(4)).when((n(4) >= 1) & (n(4) <= 12), n(4) % 12 + F.when(F.upper(g(8)) == "P", 12).otherwise(0)),
        "_ms": F.when((n(5) <= 59) & (n(6) <= 59), (n(5) * 60 + n(6)).cast("long") * 1000 + F.coalesce(F.rpad(F.substring(g(7), 1, 3), 3, "0").try_cast("int"), F.lit(0))),
        "_end": F.upper(g(9)),
    })
    day = F.unix_date(F.try_make_timestamp_ntz(n(1), F.col("_mo"), F.col("_d"), F.lit(0), F.lit(0), F.lit(0)).cast("date")).cast("long")
    signed = r"^([+-])(\d{2}):?(\d{2})$"
    minutes = F.regexp_extract("_end", signed, 2).try_cast("long") * 60 + F.regexp_extract("_end", signed, 3).try_cast("long")
    # The size of a number tells its unit: seconds since 1970 have up to 11 figures until the year 5138, and so on by thousands.
    number = F.when(F.size("_g") == 1, F.when(g(0).rlike(r"^[+]?\d+(\.\d*)?([eE][+]?\d+)?$"), g(0).try_cast("decimal(38,12)")))
    df = df.withColumns({
        "_local": F.when(g(0).isin("ymd", "slash", "name") & (F.col("_h") <= 23), day * 86_400_000 + F.col("_h") * 3_600_000 + F.col("_ms")),
        "_shift": F.when(F.col("_end").isin(*UTC_LETTERS), 0).when(F.col("_end").rlike(signed), minutes * F.when(F.col("_end").startswith("-"), -60_000).otherwise(60_000)),
        "_span": F.when(g(0) == "span", n(4).cast("long") * 3_600_000 + F.col("_ms")),
        "_n": number,
    })
    x, k = F.col("_n"), F.col(kind)
    counted = F.floor(F.when(x < 10**11, x * 1000).when(x < 10**14, x).when(x < 10**17, x / 1000).otherwise(x / 10**6)).cast("long")
    said = (
        F.when(k.isin(*SPAN_KINDS), F.col(started_ms) + F.col("_span"))
        .when(k.isin(*MILLI_KINDS), F.col(started_ms) + F.floor("_n").cast("long"))
        .otherwise(F.coalesce(counted, F.col("_local") - F.col("_shift")))
    )
    left = ~k.isin(*SPAN_KINDS, *MILLI_KINDS) & F.col("_shift").isNull()
    out = df.withColumns({"utc_ms": said, "local_ms": F.when(left, F.col("_local")), "letters": F.when(left & F.col("_local").isNotNull() & (F.col("_end") != ""), F.col("_end"))})
    return out.drop("_g", "_mo", "_d", "_h", "_ms", "_end", "_local", "_shift", "_span", "_n")


def resolve(marks: DataFrame, mark_id: str, track: str, order: str, zone: str, started_ms: str) -> DataFrame:
    """mark_id and epoch_ms of every mark that states a possible moment, from the columns of ``statements``.

    Zone letters choose among the intervals; a time whose letters fit none of
    its intervals keeps the letters' offset. Of a time that occurred twice, a
    fall of the local time between doubtful neighbours separates first from
    second occurrence; without a fall the known moments before and after, and
    the start of the track, decide, and else the first occurrence is taken.
    Repeated marks count once; a null order comes first. Null zones mean UTC,
    zones that the tz database doesn't know give no moment. Empty tables give
    an empty result.
    """
    spark = marks.sparkSession
    placed = marks.select(
        F.col(mark_id).alias("_id"), F.col(track).alias("_track"), F.coalesce(F.col(order).cast("long"), F.lit(-(1 << 62))).alias("_order"), F.col(started_ms).alias("_start"), "utc_ms", "local_ms", "letters",
        F.coalesce(F.col(zone), F.lit("UTC")).alias("_zone"), F.year(F.timestamp_millis("local_ms")).alias("_year"),
    )
    # The filter comes behind the written table: before it, the parsing would be done once for the filter and once for the columns.
    placed = cut(spark, placed.dropDuplicates(["_id"])).where("utc_ms is not null or local_ms is not null")
    asked, n = kept(placed.where("utc_ms is null").select(F.col("_zone").alias("zone"), F.col("_year").alias("year")).distinct(), MOST_PAIRS)
    iv = zone_intervals(asked).select(F.col("zone").alias("_z"), F.col("year").alias("_y"), "from", "to", "offset", F.upper("letters").alias("_known"), "until")
    inside = (F.col("from") <= F.col("local_ms")) & (F.col("local_ms") < F.col("to"))
    fits = F.col("letters").isNull() | (F.col("_known") == F.col("letters"))
    # Two intervals in which a local time lies make it doubtful, one gives its offset, and one of none is a time that never was.
    met = placed.where("utc_ms is null").join(small(iv, MOST_PAIRS, n), (F.col("_zone") == F.col("_z")) & (F.col("_year") == F.col("_y")) & (inside | (F.col("letters").isNotNull() & fits)))
    moment = F.col("local_ms") - F.col("offset")
    said = met.groupBy("_id", "_track", "_order", "_start", "local_ms").agg(
        F.min(F.when(inside & fits, moment)).alias("_a"), F.max(F.when(inside & fits, moment)).alias("_b"), F.min_by(F.when(fits, moment), F.when(fits, F.col("from"))).alias("_c"), F.min(F.when(inside, F.col("until"))).alias("_until"),
    )
    said = said.select("_id", "_track", "_order", "_start", "local_ms", F.coalesce("_a", "_c").alias("_c1"), F.coalesce("_b", "_c").alias("_c2"), "_until").where("_c1 is not null")
    # In an hour that comes twice the clocks went back at _turn; it names the group of neighbours.
    said = said.withColumn("_turn", F.when(F.col("_c1") != F.col("_c2"), F.col("_until"))).drop("_until")
    known = placed.where("utc_ms is not null").select("_id", "_track", "_order", "_start", "local_ms", F.col("utc_ms").alias("_c1"), F.col("utc_ms").alias("_c2"), F.lit(None).cast("long").alias("_turn"))
    said = cut(spark, said.unionByName(known))

    sure, twice = said.where("_turn is null"), said.where("_turn is not null")
    turns, n = kept(twice.select(F.col("_track").alias("_t"), F.col("_turn").alias("_n")).distinct(), MOST_PAIRS)
    if not n:
        return sure.select(F.col("_id").alias(mark_id), F.col("_c1").alias("epoch_ms"))
    near = sure.drop("_turn").join(small(turns, MOST_PAIRS, n), (F.col("_track") == F.col("_t")) & (F.abs(F.col("_c1") - F.col("_n")) <= AROUND_MS)).withColumnRenamed("_n", "_turn").drop("_t")
    group = near.withColumn("_sure", F.lit(True)).unionByName(twice.withColumn("_sure", F.lit(False)))
    around = neighbours(group, ["_track", "_turn"], "_order", ["_id"], F.when(F.col("_sure"), F.struct("_order", "_id", "_c1")))
    # Doubtful marks between the same two sure ones form a run.
    run = ["_track", "_turn", "_ro", "_ri"]
    doubt = around.where(~F.col("_sure")).select(
        "_id", "_track", "_turn", "_order", "_start", "local_ms", "_c1", "_c2", F.col("_prev._order").alias("_ro"), F.col("_prev._id").alias("_ri"), F.col("_prev._c1").alias("_before"), F.col("_next._c1").alias("_after")
    )
    doubt = cut(spark, neighbours(doubt, run, "_order", ["_id"], F.struct("_order", "_id", "local_ms")).drop("_prev"))
    falls = F.col("_next.local_ms") < F.col("local_ms") - SLACK_MS
    runs = doubt.groupBy(*run).agg(F.min(F.when(falls, F.struct("_next._order", "_next._id"))).alias("_fall"), F.max("_c1").alias("_last"), F.min("_c1").alias("_first"))
    runs, n = kept(runs.select(*[F.col(c).alias(f"{c}_") for c in run], "_fall", "_last", "_first"), MOST_PAIRS)
    doubt = doubt.join(small(runs, MOST_PAIRS, n), [F.col(c).eqNullSafe(F.col(f"{c}_")) for c in run])
    fold = F.col("_c2") - F.col("_c1")
    second = (
        F.when(F.col("_fall").isNotNull(), F.struct("_order", "_id") >= F.col("_fall"))
        .when(F.col("_before").isNotNull(), F.col("_first") < F.col("_before") - SLACK_MS)
        .when(F.col("_first") < F.col("_start") - SLACK_MS, True)
        .when(F.col("_after").isNotNull(), F.col("_after") - F.col("_last") >= fold - SLACK_MS)
        .otherwise(False)
    )
    settled = doubt.withColumn("_c1", F.when(second, F.col("_c2")).otherwise(F.col("_c1")))
    return sure.select("_id", "_c1").unionByName(settled.select("_id", "_c1")).toDF(mark_id, "epoch_ms")
