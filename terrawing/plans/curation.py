"""Queries of the general data-preparation operators (p1 to p5) on the project's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrawing.operators.clocks import resolve, statements
from terrawing.operators.drift import changes, file_schemas, unified, versions
from terrawing.operators.grid import regular_grid, silences
from terrawing.operators.rejects import read_csv_lines
from terrawing.operators.spikes import GPU, TELEMETRY, flag_readings
from terrawing.runtime import cut, table


#: Added before rounding, so that values with few decimals don't lie on a tie where the last bit decides.
OFF_TIE = 3e-10


def _clocked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Telemetry of all tracks but those said to have no timestamps."""
    without = table(spark, sf_dir, "tracks").where("has_timestamps = false").select("track_id")
    return table(spark, sf_dir, "telemetry").join(without, "track_id", "left_anti")


def _grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regular_grid(_clocked(spark, sf_dir), ["track_id"], "t", ["lat", "lon", "alt"], ["source_index"])


def p1_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reading of lat, lon and alt, and the samples recorded, per second and track; a silence is one row, marked uncovered."""
    return _grid(spark, sf_dir).select(
        "track_id", "slot", "last_slot", F.col("n_samples").cast("long").alias("n_samples"), "mark",
        *[F.round(F.col(c) + OFF_TIE, 6).alias(c) for c in ("covered_s", "lat", "lon", "alt", "source_index_inc")], "source_index_reset",
    )


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells of the grid that have no sample, but increments of the pair of samples around them."""
    return _grid(spark, sf_dir).where("mark = 'filled'").select("track_id", "slot")


def p1_silences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return silences(_clocked(spark, sf_dir), ["track_id"], "t")


def _suspects(spark: SparkSession, sf_dir: str) -> DataFrame:
    flight = flag_readings(table(spark, sf_dir, "telemetry"), ["track_id"], "t", "sample_id", TELEMETRY)
    gpu = flag_readings(table(spark, sf_dir, "gpu_samples"), ["run_id", "gpu_index"], "ts", "gpu_sample_id", GPU)
    return flight.drop("track_id").unionByName(gpu.drop("run_id", "gpu_index"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _suspects(spark, sf_dir).select("field_name", "row_id")


def p2_suspects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each suspected reading with what speaks against it."""
    return _suspects(spark, sf_dir)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    tracks = table(spark, sf_dir, "tracks").where("has_timestamps").select("track_id", "kind", "site_tz", F.unix_millis(F.col("started_at").cast("timestamp")).alias("started_ms"))
    marks = table(spark, sf_dir, "clock_marks").join(tracks, "track_id")
    stated = statements(marks, "t_text", "kind", "site_tz", "started_ms")
    return resolve(stated, "mark_id", "track_id", "source_index", "site_tz", "started_ms")


def _json_lines(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The json lines, and the versions of their files with their migration steps."""
    files = table(spark, sf_dir, "raw_files").where("kind = 'json'").select("file_id", "feed_id", "recorded_at")
    lines = table(spark, sf_dir, "raw_lines").join(files.select("file_id"), "file_id", "left_semi")
    return lines, versions(files, cut(spark, file_schemas(lines, "file_id", "line")))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of the migration steps: what differs from the file before."""
    return changes(_json_lines(spark, sf_dir)[1]).select("file_id", "field_name", "change_kind")


def p3_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every change with the names and types before and after it."""
    got = changes(_json_lines(spark, sf_dir)[1])
    return got.select("feed_id", "file_id", "field_name", "change_kind", *[F.array_join(c, "+").alias(c) for c in ("old_names", "new_names", "old_types", "new_types")])


def p3_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The samples of all json files as one table, by the same steps."""
    return unified(*_json_lines(spark, sf_dir))


def _csv_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "raw_files").where("kind = 'csv'").select("file_id")
    return read_csv_lines(table(spark, sf_dir, "raw_lines").join(files, "file_id", "left_semi"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _csv_lines(spark, sf_dir).where("reason is not null").select("file_id", "line_no", "reason")


def p5_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sound samples of all csv files, typed."""
    return _csv_lines(spark, sf_dir).where("reason is null").drop("reason", "line")


QUERIES = {
    "p1_grid": p1_grid,
    "p1_found": p1_found,
    "p1_silences": p1_silences,
    "p2_found": p2_found,
    "p2_suspects": p2_suspects,
    "p3_found": p3_found,
    "p3_changes": p3_changes,
    "p3_table": p3_table,
    "p4_found": p4_found,
    "p5_found": p5_found,
    "p5_samples": p5_samples,
}

_CLOCKED = "telemetry where track_id not in (select track_id from tracks where not has_timestamps)"

_ROUND = lambda x: f"round({x} + {OFF_TIE}, 6)"


def _grid_sql() -> str:
    """Each pair of neighbouring samples spread over the cells between them, cell by cell, and the silences."""
    gauges = ("lat", "lon", "alt")
    known = lambda c: f"case when {c} is not null then {{'t': t, 'x': {c}}} end"
    around = ", ".join(
        f"last_value({known(c)} ignore nulls) over (partition by track_id order by t rows between unbounded preceding and 1 preceding) as b_{c}, "
        f"first_value({known(c)} ignore nulls) over (partition by track_id order by t rows between 1 following and unbounded following) as a_{c}"
        for c in gauges
    )
    bridged = ", ".join(f"coalesce({c}, case when a_{c}.t - b_{c}.t > 0 and a_{c}.t - b_{c}.t <= 600 then b_{c}.x + (a_{c}.x - b_{c}.x) * (t - b_{c}.t) / (a_{c}.t - b_{c}.t) end) as x_{c}" for c in gauges)
    weight = lambda c: f"(case when p_{c} is not null and x_{c} is not null then over_s end)"
    course = lambda c: f"(p_{c} + (x_{c} - p_{c}) * (case when t > pt then ((greatest(pt, slot) + least(t, slot + 1)) / 2 - pt) / (t - pt) end))"
    means = ", ".join(_ROUND(f"coalesce(sum({weight(c)} * {course(c)}) / nullif(sum({weight(c)}), 0), avg(case when own then {c} end))") + f" as {c}" for c in gauges)
    nulls = ", ".join(f"null::double as {c}" for c in ("lat", "lon", "alt", "source_index_inc"))
    return f"""
        with s as (select distinct track_id, t, lat, lon, alt, source_index::double as n from {_CLOCKED}),
        w as (select *, lag(t) over (partition by track_id order by t) as pt, lag(n) over (partition by track_id order by t) as pn, {around} from s),
        x as (select track_id, t, pt, n, pn, {", ".join(gauges)}, {bridged} from w),
        l as (select *, {", ".join(f"lag(x_{c}) over (partition by track_id order by t) as p_{c}" for c in gauges)}, pt is not null and round(t - pt, 6) <= 600 as joined from x),
        p as (select *, unnest(generate_series(cast(floor(case when joined then pt else t end) as bigint), cast(floor(t) as bigint))) as slot from l),
        o as (select *, slot = floor(t) as own, case when joined then greatest(least(t, slot + 1) - greatest(pt, slot), 0) else 0 end as over_s from p)
        select track_id, slot, slot as last_slot, count(*) filter (own) as n_samples, case when count(*) filter (own) > 0 then 'observed' else 'filled' end as mark,
               {_ROUND("sum(over_s)")} as covered_s, {means},
               {_ROUND("coalesce(sum(case when joined and pn is not null then case when n >= pn then n - pn else n end * (case when t > pt then over_s / (t - pt) when own then 1 else 0 end) end), 0)")} as source_index_inc,
               coalesce(bool_or(joined and own and n < pn), false) as source_index_reset
        from o group by track_id, slot
        union all
        select track_id, cast(floor(pt) as bigint) + 1, cast(floor(t) as bigint) - 1, 0, 'uncovered', {OFF_TIE} * 0, {nulls}, null::boolean
        from w where round(t - pt, 6) > 600 and floor(pt) + 1 <= floor(t) - 1"""


#: Names under which the test data's json files carry the target columns; other names stand for themselves.
_NAMES = {
    "yaw": ("heading", "hdg", "attitude.yaw", "yaw_deg", "Yaw"), "gimbal_pitch": ("gb_pitch", "gimbal.pitch", "gimbal_pitch_deg", "gimbalPitch", "cam_pitch"), "kind": ("source_kind", "format", "trackKind"),
}
_SAME = ", ".join(f"('{n}', '{q}')" for q, names in _NAMES.items() for n in names)

_FIELDS = f"""
    l as (select distinct file_id, ltrim(line, chr(65279)) as line from raw_lines where file_id in (select file_id from js)),
    v as (select file_id, line from l where json_valid(line) and json_type(line) = 'OBJECT'),
    t as (select file_id, replace(substr(j.fullkey, 3), '"', '') as name, j.type, j.value from v, json_tree(v.line) j),
    leaf as (select file_id, name, case type when 'VARCHAR' then 'string' when 'BOOLEAN' then 'boolean' when 'ARRAY' then 'array' when 'OBJECT' then 'object' when 'NULL' then null else 'number' end as type
             from t where name <> '' and not contains(name, '[') and (type <> 'OBJECT' or value::varchar = '{{}}')),
    same(name, quantity) as (values {_SAME}),
    f as (select file_id, coalesce(quantity, leaf.name) as field_name, list_sort(list(distinct leaf.name)) as names, coalesce(list_sort(list(distinct type) filter (type is not null)), []) as types
          from leaf left join same using (name) group by all)"""

_CHANGES = """
    with js as (select file_id, feed_id, recorded_at from raw_files where kind = 'json'), {schemas},
    o as (select feed_id, file_id, lag(file_id) over (partition by feed_id order by recorded_at, file_id) as previous from js),
    n as (select feed_id, o.file_id, field_name, names, types from o join f using (file_id) where previous is not null),
    p as (select feed_id, o.file_id, field_name, names, types from o join f on f.file_id = o.previous),
    b as (select coalesce(n.feed_id, p.feed_id) as feed_id, coalesce(n.file_id, p.file_id) as file_id, coalesce(n.field_name, p.field_name) as field_name,
                 coalesce(p.names, []) as old_names, coalesce(n.names, []) as new_names, coalesce(p.types, []) as old_types, coalesce(n.types, []) as new_types
          from n full join p on n.file_id = p.file_id and n.field_name = p.field_name),
    c as (select *, unnest(list_filter([case when len(old_names) = 0 then 'added' end, case when len(new_names) = 0 then 'removed' end,
                 case when len(old_names) > 0 and len(new_names) > 0 and old_names <> new_names then 'renamed' end,
                 case when len(old_types) > 0 and len(new_types) > 0 and len(old_names) > 0 and len(new_names) > 0 and old_types <> new_types then 'retyped' end], lambda x: x is not null)) as change_kind from b)"""
_CHANGES = _CHANGES.format(schemas=_FIELDS)


def _table_sql() -> str:
    """Records taken apart leaf by leaf; of a column's leaves the one under its own name comes first, then the others by name."""
    single = "case when type = 'ARRAY' and json_array_length(value) = 1 then value -> 0 else value end"
    figure = r"regexp_extract(text, '^\s*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)\s*(?:°|[a-z]*)\s*$', 1)"
    numbers = ("source_index", "t", "lat", "lon", "alt", "yaw", "gimbal_pitch")
    kinds = ["srt", "csv", "gpx", "kml", "json", "mavlink", "embedded"]
    pick = lambda c, what: f"arg_min({what}, (case when name = '{c}' then 0 else 1 end, name)) filter (field_name = '{c}' and type <> 'NULL')"
    columns = ", ".join(pick(c, "number") + f" as {c}" for c in numbers)
    return f"""
        with l as (select file_id, line_no, min(ltrim(line, chr(65279))) as line from raw_lines where file_id in (select file_id from raw_files where kind = 'json') group by all),
        v as (select * from l where json_valid(line) and json_type(line) = 'OBJECT'),
        t as (select file_id, line_no, replace(substr(j.fullkey, 3), '"', '') as name, j.type, j.value from v, json_tree(v.line) j),
        leaf as (select * from t where name <> '' and not contains(name, '[') and (type <> 'OBJECT' or value::varchar = '{{}}')),
        same(name, quantity) as (values {_SAME}),
        f as (select file_id, line_no, leaf.name, type, value, coalesce(quantity, leaf.name) as field_name, {single} as one from leaf left join same using (name)),
        x as (select *, one ->> '$' as text, json_type(one) as kind_of from f),
        n as (select *, case when kind_of in ('BIGINT', 'UBIGINT', 'DOUBLE', 'HUGEINT') then try_cast(text as double) when kind_of = 'VARCHAR' then try_cast({figure} as double) end as number from x),
        c as (select *, case when kind_of = 'VARCHAR' then nullif(lower(trim(text)), '') when number = floor(number) and number >= 0 then {kinds}[cast(number as int) + 1] end as kind_text from n),
        r as (select file_id, line_no, {columns}, {pick("kind", "kind_text")} as kind,
                     '{{' || coalesce(string_agg('"' || name || '": ' || value::varchar, ', ' order by name) filter (field_name not in {(*numbers, "kind")}), '') || '}}' as rest from c group by file_id, line_no)
        select v.file_id, v.line_no, case when abs(source_index) < 2147483648 and source_index = floor(source_index) then cast(source_index as int) end as source_index, t, lat, lon, alt, yaw, gimbal_pitch, kind, coalesce(rest, '{{}}') as rest
        from v left join r on r.file_id = v.file_id and r.line_no = v.line_no"""


def _csv_sql() -> str:
    """Lines of csv files taken apart by one pattern per delimiter; a line that the pattern doesn't cover whole has a quoting error."""
    delimiters = {",": ",", ";": ";", "\t": "\t", "|": "\\|"}
    required = "('source_index' in {0} and 't' in {0} and 'lat' in {0} and 'lon' in {0})"
    names = lambda line, d: f"list_transform(string_split(lower({line}), '{d}'), lambda x: trim(trim(x, chr(34))))"
    which = lambda line: "case " + " ".join(f"when {required.format(names(line, d))} then '{d}'" for d in delimiters) + " end"
    fields = "case d " + " ".join(f"""when '{d}' then regexp_extract_all(s || '{d}', '("(?:[^"]|"")*" *|[^"{p}][^{p}]*|){p}', 1)""" for d, p in delimiters.items()) + " end"
    at = lambda c: f"(case when list_position(names, '{c}') > 0 then plain[list_position(names, '{c}')] end)"
    number = lambda x: f"(case when regexp_full_match({x}, '\\s*[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?\\s*') then try_cast(trim({x}) as double) end)"
    value = lambda c: f"v_{c}"
    numbers = ("source_index", "t", "lat", "lon", "alt", "yaw", "gimbal_pitch")
    wrong = " or ".join(f"(trim(coalesce({at(c)}, '')) <> '' and ({value(c)} is null or isinf({value(c)})))" for c in numbers)
    empty = " or ".join(f"{value(c)} is null" for c in ("source_index", "t", "lat", "lon"))
    return f"""
        with l as (select file_id, line_no, min(line) as line from raw_lines where file_id in (select file_id from raw_files where kind = 'csv') group by all),
        c as (select *, case when line_no = 0 then ltrim(rtrim(line, chr(13) || chr(10)), chr(65279)) else rtrim(line, chr(13) || chr(10)) end as s from l),
        k as (select *, {which("s")} as own from c),
        h as (select file_id, arg_min(own, line_no) as d, {"case arg_min(own, line_no) " + " ".join(f"when '{d}' then {names('arg_min(s, line_no)', d)}" for d in delimiters) + " end"} as names from k where own is not null and s not like '#%' group by file_id),
        r as (select k.file_id, k.line_no, s, coalesce(d, ',') as d, coalesce(names, {list(numbers) + ["notes"]}) as names from k left join h using (file_id) where own is null and trim(s) <> '' and s not like '#%'),
        x as (select *, {fields} as raw from r),
        q as (select *, list_transform(raw, lambda f: case when starts_with(f, '"') then replace(regexp_extract(f, '^"((?:[^"]|"")*)" *$', 1), '""', '"') else f end) as plain,
                     list_sum(list_transform(raw, lambda f: len(f) + 1)) <> len(s) + 1 as broken from x),
        n as (select *, {", ".join(f"{number(at(c))} as v_{c}" for c in numbers)}, {at("notes")} as notes_text from q),
        e as (select *, case when broken then 'quoting' when len(raw) <> len(names) then 'column_count'
                             when {empty} or {wrong} or v_source_index < 0 or v_source_index <> floor(v_source_index) or abs(v_lat) > 90 or abs(v_lon) > 180 then 'bad_value' end as reason from n)"""


#: Letters of the zones in the test data, with their hours ahead of UTC.
_LETTERS = {"CET": 1, "CEST": 2, "WET": 0, "WEST": 1, "BST": 1, "EST": -5, "EDT": -4, "MST": -7, "MDT": -6, "AEST": 10, "AEDT": 11, "IST": 5.5}


def _clock_sql() -> str:
    """Clock texts rewritten to one form, local times met with the offset intervals of their zone and year, doubtful ones settled by their neighbours."""
    time, tail = r"(\d{1,2}):(\d{2}):(\d{2})(?:[.,](\d+))?", r"\s*(Z|[+-]\d{2}:?\d{2}|[A-Za-z]{1,5})?"
    forms = [
        (rf"^(\d{{4}})-(\d{{1,2}})-(\d{{1,2}})[T ]\s*{time}{tail}$", r"ymd|\1|\2|\3|\4|\5|\6|\7||\8"),
        (rf"^(\d{{4}})(\d{{2}})(\d{{2}})T(\d{{2}})(\d{{2}})(\d{{2}})(?:[.,](\d+))?{tail}$", r"ymd|\1|\2|\3|\4|\5|\6|\7||\8"),
        (rf"^(\d{{1,2}})\.(\d{{1,2}})\.(\d{{4}})\s+{time}{tail}$", r"ymd|\3|\2|\1|\4|\5|\6|\7||\8"),
        (rf"^(\d{{1,2}})/(\d{{1,2}})/(\d{{4}})\s+{time}(?:\s*([AaPp])\.?[Mm]\.?)?{tail}$", r"slash|\3|\1|\2|\4|\5|\6|\7|\8|\9"),
        (rf"^(?:[A-Za-z]{{3,9}},?\s+)?(\d{{1,2}})[\s-]([A-Za-z]{{3}})[A-Za-z]*[\s-](\d{{4}})\s+{time}{tail}$", r"name|\3|\2|\1|\4|\5|\6|\7||\8"),
        (r"^(\d{1,4}):(\d{2}):(\d{2})(?:[.,](\d+))?(?:\s*-->.*)?$", r"span||||\1|\2|\3|\4||"),
    ]
    same = r"regexp_replace(t_text, '^[\s\x{00a0}\x{feff}]+|[\s\x{00a0}\x{feff}]+$', '', 'g')"
    for pattern, fields in forms:
        same = f"regexp_replace({same}, '{pattern}', '{fields}')"
    int_ = lambda i: f"try_cast(g[{i}] as int)"
    letters = ", ".join(f"('{k}', {v} * 3600000)" for k, v in _LETTERS.items())
    return rf"""
        with k as (select m.mark_id, any_value(m.track_id) as track_id, any_value(m.source_index) as source_index, any_value(m.t_text) as t_text, any_value(kind) as kind,
                          any_value(coalesce(site_tz, 'UTC')) as zone, any_value(epoch_ms(started_at)) as started
                   from clock_marks m join tracks using (track_id) where has_timestamps group by m.mark_id),
        g as (select *, string_split({same}, '|') as g from k),
        p as (select *, zone like 'America/%' as us, case when g[9] = '' then {int_(5)} when {int_(5)} between 1 and 12 then {int_(5)} % 12 + case when upper(g[9]) = 'P' then 12 else 0 end end as h,
                     case when {int_(6)} <= 59 and {int_(7)} <= 59 then ({int_(6)} * 60 + {int_(7)})::bigint * 1000 + coalesce(try_cast(rpad(substr(g[8], 1, 3), 3, '0') as int), 0) end as ms, upper(g[10]) as ending,
                     case when len(g) = 1 and regexp_full_match(g[1], '[+]?\d+(\.\d*)?([eE][+]?\d+)?') then try_cast(g[1] as decimal(38, 12)) end as x from g),
        d as (select *, try_cast(printf('%04d-%02d-%02d', {int_(2)}, case when g[1] = 'name' then list_position(['jan', 'feb', 'mar', 'apr', 'may', 'jun', 'jul', 'aug', 'sep', 'oct', 'nov', 'dec'], lower(g[3]))
                                 when g[1] = 'slash' and not us then {int_(4)} else {int_(3)} end, case when g[1] = 'slash' and not us then {int_(3)} else {int_(4)} end) as date) as day from p),
        t as (select *, case when g[1] in ('ymd', 'slash', 'name') and h <= 23 then (day - date '1970-01-01')::bigint * 86400000 + h * 3600000 + ms end as local,
                     case when ending in ('Z', 'UTC', 'GMT', 'UT') then 0 when regexp_full_match(ending, '[+-]\d{{2}}:?\d{{2}}')
                          then (substr(ending, 2, 2)::int * 60 + right(ending, 2)::int) * case when ending like '-%' then -60000 else 60000 end end as shift,
                     floor(x)::hugeint as whole from d),
        u as (select mark_id, track_id, source_index, started, zone, kind in ('srt', 'embedded', 'mavlink') as spans, local,
                     case when kind in ('srt', 'embedded') then case when g[1] = 'span' then started + h::bigint * 3600000 + ms end when kind = 'mavlink' then started + whole::bigint
                          else coalesce(case when x < 100000000000 then floor(x * 1000) when x < 100000000000000 then whole when x < 100000000000000000 then whole // 1000 else whole // 1000000 end::bigint, local - shift) end as utc,
                     shift, case when ending <> '' then ending end as letters from t),
        asked as (select distinct zone, year(make_timestamp(local * 1000)) as year from u where utc is null and not spans and local is not null),
        ticks as (select zone, year, unnest(generate_series(epoch(make_date(year, 1, 1))::bigint - 172800, epoch(make_date(year + 1, 1, 1))::bigint + 172800, 900)) as s from asked),
        offs as (select *, epoch_ms(timezone(zone, to_timestamp(s))) - s * 1000 as o from ticks),
        marks as (select *, lag(o) over (partition by zone, year order by s) as po, max(s) over (partition by zone, year) as last from offs),
        iv as (select zone, year, o, s * 1000 + o as a, coalesce(lead(s) over (partition by zone, year order by s), last) * 1000 + o as b, coalesce(lead(s) over (partition by zone, year order by s), last) * 1000 as until from marks where po is null or po <> o),
        names(l, lo) as (values {letters}),
        met as (select u.*, iv.o, iv.a, iv.until, iv.a <= local and local < iv.b as inside, letters is null or lo = iv.o as fits
                from u join iv on u.zone = iv.zone and year(make_timestamp(local * 1000)) = iv.year left join names on l = letters where utc is null and not spans and local is not null),
        said as (select mark_id, track_id, source_index, started, local, coalesce(min(local - o) filter (inside and fits), arg_min(local - o, a) filter (letters is not null and fits)) as c1,
                        coalesce(max(local - o) filter (inside and fits), arg_min(local - o, a) filter (letters is not null and fits)) as c2, min(until) filter (inside) as until from met group by all),
        every as (select mark_id, track_id, source_index, started, local, c1, c2, case when c1 <> c2 then until end as turn from said where c1 is not null
                  union all select mark_id, track_id, source_index, started, local, utc, utc, null from u where utc is not null),
        turns as (select distinct track_id, turn from every where turn is not null),
        grp as (select e.* exclude (turn), t.turn, e.c1 as sure from every e join turns t on e.track_id = t.track_id and abs(e.c1 - t.turn) <= 21600000 where e.turn is null
                union all select * exclude (turn), turn, null from every where turn is not null),
        w as (select *, last_value(sure ignore nulls) over (partition by track_id, turn order by source_index, mark_id rows between unbounded preceding and 1 preceding) as before,
                     first_value(sure ignore nulls) over (partition by track_id, turn order by source_index, mark_id rows between 1 following and unbounded following) as after,
                     count(sure) over (partition by track_id, turn order by source_index, mark_id rows unbounded preceding) as run from grp),
        f as (select *, case when local < lag(local) over (partition by track_id, turn, run order by source_index, mark_id) - 1000 then 1 else 0 end as fall from w where sure is null),
        r as (select *, sum(fall) over (partition by track_id, turn, run order by source_index, mark_id rows unbounded preceding) as falls, sum(fall) over (partition by track_id, turn, run) as whole,
                     max(c1) over (partition by track_id, turn, run) as last, min(c1) over (partition by track_id, turn, run) as first from f)
        select mark_id, c1 as epoch_ms from every where turn is null
        union all
        select mark_id, case when case when whole > 0 then falls > 0 when before is not null then first < before - 1000 when first < started - 1000 then true when after is not null then after - last >= c2 - c1 - 1000 else false end then c2 else c1 end from r"""


SQL = {
    "p4_found": _clock_sql(),
    "p3_found": f"{_CHANGES} select file_id, field_name, change_kind from c",
    "p3_changes": f"{_CHANGES} select feed_id, file_id, field_name, change_kind, {', '.join(f"array_to_string({c}, '+') as {c}" for c in ('old_names', 'new_names', 'old_types', 'new_types'))} from c",
    "p3_table": _table_sql(),
    "p5_found": f"{_csv_sql()} select file_id, line_no, reason from e where reason is not null",
    "p5_samples": f"""{_csv_sql()} select file_id, line_no, cast(v_source_index as bigint) as source_index, {", ".join(f"v_{c} as {c}" for c in ("t", "lat", "lon", "alt", "yaw", "gimbal_pitch"))}, case when trim(notes_text) <> '' then notes_text end as notes from e where reason is null""",
    "p1_grid": _grid_sql(),
    "p1_found": f"""
        with s as (select distinct track_id, t from {_CLOCKED}),
        p as (select track_id, t, lag(t) over (partition by track_id order by t) as before from s)
        select track_id, unnest(generate_series(cast(floor(before) as bigint) + 1, cast(floor(t) as bigint) - 1)) as slot
        from p where round(t - before, 6) <= 600""",
    "p1_silences": f"""
        with s as (select distinct track_id, t from {_CLOCKED}),
        p as (select track_id, t, lag(t) over (partition by track_id order by t) as before from s)
        select track_id, cast(floor(before) as bigint) + 1 as from_slot, cast(floor(t) as bigint) - 1 as to_slot, round(t - before, 6) as silent_s
        from p where round(t - before, 6) > 600 and floor(before) + 1 <= floor(t) - 1""",
}
