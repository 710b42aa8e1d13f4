"""Problem 2: readings that a source cannot have had.

Robust exponentially weighted control charts run along each source's
readings, once forwards and once backwards; suspected readings are clipped
before they reach mean and scale. Run-length counters find frozen values and
physical limits the impossible ones. The charts are in ``charts``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrawing.operators import charts
from terrawing.operators.blocks import MOST_BROADCAST, block_of, hot_sources, joined_cuts, placeable
from terrawing.operators.charts import SHARES, ChartParams, Limits, judge
from terrawing.operators.segments import segments
from terrawing.runtime import cut, kept, small

#: Heights outside are those of sentinels and overflows; no survey drone flies there.
TELEMETRY = {"lat": Limits(-90.0, 90.0, 1e-6), "lon": Limits(-180.0, 180.0, 1e-6), "alt": Limits(-500.0, 10_000.0, 0.05)}
GPU = {"util_pct": Limits(0.0, 100.0, 2.0, resting=(0.0, 100.0), jumps=True, limit=4.5, relock=4)}

#: Readings before and after each piece of a hot source that are judged along but not taken. The charts have forgotten what was before
#: after some hundred readings, and the longest run that isn't frozen is shorter (its bound grows with the logarithm of the rows; at 1e12 rows it is 702).
MARGIN = 1_000

_MARKS = "field_name string, row_id long, t double, value double, impossible boolean, spike boolean, frozen boolean"


def flag_readings(
    df: DataFrame,
    source: list[str],
    time: str,
    row_id: str,
    fields: dict[str, Limits],
    params: ChartParams = ChartParams(),
    rows_per_block: int = 50_000,
) -> DataFrame:
    """One row per suspected reading: source, field_name, row_id, t, value, impossible, spike, frozen.

    Each field is judged alone, in the order of ``time`` within a source.
    Rows equal in row_id and time count once. A null reading, and one without
    time, is never marked. Readings at equal times are taken in the order of
    row_id. Sources of fewer than three sound readings are only held against
    the limits. Null source values form a source of their own. An empty table
    gives an empty result; other columns of df don't matter and may have any
    name.

    A source of at most 2 * rows_per_block rows is judged whole. Of a larger
    one a first pass counts what is usual for all of it, and pieces of
    rows_per_block sound readings, with margins, are judged by that; where the
    cuts fall makes no difference.
    """
    names, limits = list(fields), list(fields.values())
    slim = df.select(
        *[F.col(c).cast("long").alias(f"k{i}") for i, c in enumerate(source)],
        F.col(row_id).cast("long").alias("row_id"),
        F.col(time).cast("double").alias("t"),
        *[F.col(f).cast("double").alias(f"v{i}") for i, f in enumerate(names)],
    )
    key = [f"k{i}" for i in range(len(source))]
    slim = placeable(slim, "t")
    hot = hot_sources(slim, key, "t", rows_per_block)
    schema = ", ".join(f"{k} long" for k in key) + ", " + _MARKS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for seg in segments(batches, key):
            out = _judge_source(seg, names, limits, params)
            if out is not None:
                keys = {k: pa.array([seg.column(k)[0].as_py()] * len(out["row_id"]), pa.int64()) for k in key}
                yield pa.RecordBatch.from_pydict(keys | out)

    if hot is None:
        found = slim.repartition(*key).sortWithinPartitions(*key, "t", "row_id").mapInArrow(run, schema)
    else:
        parted = joined_cuts(slim, hot, key)
        cold = parted.where("_cuts is null").drop("_cuts")
        found = cold.repartition(*key).sortWithinPartitions(*key, "t", "row_id").mapInArrow(run, schema)
        found = found.unionByName(_judge_hot(parted.where("_cuts is not null").withColumn("_block", block_of(F.col("t"))).drop("_cuts"), key, names, limits, params, rows_per_block, schema))
    return found.select(*[F.col(k).alias(c) for k, c in zip(key, source)], *found.columns[len(key) :])


def _judge_source(seg: pa.Table, names: list[str], limits: list[Limits], params: ChartParams) -> dict[str, pa.Array] | None:
    ids, t = seg.column("row_id").to_numpy(), seg.column("t").to_numpy()
    first = np.concatenate([[True], (ids[1:] != ids[:-1]) | (t[1:] != t[:-1])])
    ids, t = ids[first], t[first]
    parts = []
    for i, (name, lim) in enumerate(zip(names, limits)):
        v = seg.column(f"v{i}").to_numpy()[first].astype(float)
        marks = judge(t, v, lim, params)
        at = np.flatnonzero(marks[0] | marks[1] | marks[2])
        if len(at):
            parts.append((name, ids[at], t[at], v[at], *[m[at] for m in marks]))
    return _rows(parts)


def _rows(parts: list[tuple]) -> dict[str, pa.Array] | None:
    if not parts:
        return None
    column = lambda j, kind: pa.array(np.concatenate([p[j] for p in parts]), kind)
    return {
        "field_name": pa.array([p[0] for p in parts for _ in p[1]], pa.string()),
        "row_id": column(1, pa.int64()),
        "t": column(2, pa.float64()),
        "value": column(3, pa.float64()),
        "impossible": column(4, pa.bool_()),
        "spike": column(5, pa.bool_()),
        "frozen": column(6, pa.bool_()),
    }


def _judge_hot(rows: DataFrame, key: list[str], names: list[str], limits: list[Limits], params: ChartParams, rows_per_block: int, schema: str) -> DataFrame:
    """Readings of hot sources, each field a series of its own, in pieces of rows_per_block readings and MARGIN more on both sides."""
    series = [*key, "f"]
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("f"), F.col(f"v{i}").alias("v")) for i in range(len(names))]))
    melted = rows.select(*key, "_block", "t", "row_id", each.alias("e")).select(*key, "_block", "t", "row_id", "e.f", "e.v").where("v is not null and not isnan(v)")
    # Once rows of a block are together, repeated deliveries go without another exchange.
    melted = melted.repartition(*series, "_block").dropDuplicates([*series, "_block", "t", "row_id"])
    possible = F.coalesce(*[F.when(F.col("f") == i, F.col("v").between(lim.low, lim.high)) for i, lim in enumerate(limits)])
    flag = lambda x: F.lit(x)
    field = F.array(*[F.lit(n) for n in names])[F.col("f")]
    impossible = melted.where(~possible).select(*key, field.alias("field_name"), "row_id", "t", F.col("v").alias("value"), flag(True).alias("impossible"), flag(False).alias("spike"), flag(False).alias("frozen"))

    sound = melted.where(possible)
    by = Window.partitionBy(*series)
    counts = sound.groupBy(*series, "_block").agg(F.count(F.lit(1)).alias("_n"))
    starts, n = kept(
        counts.select(
            *[F.col(c).alias(f"_{c}") for c in series], F.col("_block").alias("_b"),
            (F.sum("_n").over(by.orderBy("_block")) - F.col("_n")).alias("_start"), F.sum("_n").over(by).alias("_total"),
        ), MOST_BROADCAST,
    )
    place = F.row_number().over(Window.partitionBy(*series, "_block").orderBy("t", "row_id")) - 1
    placed = sound.withColumn("_place", place).join(small(starts, MOST_BROADCAST, n), [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in series] + [F.col("_block") == F.col("_b")])
    at = F.col("_place") + F.col("_start")
    piece = lambda x: F.floor(x / rows_per_block).cast("int")
    near = F.sequence(F.greatest(piece(at - MARGIN), F.lit(0)), F.least(piece(at + MARGIN), piece(F.col("_total") - 1)))
    placed = placed.select(*series, "t", "row_id", "v", at.alias("_at"), F.explode(near).alias("piece")).withColumn("_core", F.col("piece") == piece(F.col("_at")))
    together = lambda df: df.repartition(*series, "piece").sortWithinPartitions(*series, "piece", "_at")
    placed = cut(rows.sparkSession, together(placed).select(*series, "piece", "_at", "t", "row_id", "v", "_core"))
    columns = ", ".join(f"{k} long" for k in key) + ", f int"

    def with_usual(usual: DataFrame, n: int) -> DataFrame:
        """The pieces with what is known of their series; a broadcast leaves them together and in order."""
        named = usual.select(*[F.col(c).alias(f"_{c}") for c in series], *usual.columns[len(series) :])
        joined = placed.join(small(named, MOST_BROADCAST, n), [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in series]).drop(*[f"_{c}" for c in series])
        return joined if n <= MOST_BROADCAST else together(joined)

    def counted(df: DataFrame, count: object) -> tuple[DataFrame, int]:
        """One row per series with the bin at its share of each statistic that has one, and the sum of the others."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for seg in segments(batches, [*series, "piece"]):
                t, v, core = seg.column("t").to_numpy(), seg.column("v").to_numpy(), seg.column("_core").to_numpy(zero_copy_only=False).astype(bool)
                known = {c: seg.column(c)[0].as_py() for c in seg.column_names}
                for name, x in count(t, v, core, known).items():
                    bins, many = np.unique(x, return_counts=True) if isinstance(x, np.ndarray) else (np.array([0]), np.array([x]))
                    own = {c: pa.array([known[c]] * len(bins), pa.int32() if c == "f" else pa.int64()) for c in series}
                    yield pa.RecordBatch.from_pydict(own | {"stat": pa.array([name] * len(bins)), "bin": pa.array(bins, pa.int64()), "n": pa.array(many, pa.int64())})

        sums = df.mapInArrow(run, columns + ", stat string, bin long, n long").groupBy(*series, "stat", "bin").agg(F.sum("n").alias("n"))
        of = Window.partitionBy(*series, "stat")
        share = F.coalesce(*[F.when(F.col("stat") == k, F.lit(x)) for k, x in SHARES.items()])
        sums = sums.withColumns({"_up": F.sum("n").over(of.orderBy("bin")), "_all": F.sum("n").over(of), "_share": share})
        reached = F.when(F.col("_up") > F.floor(F.col("_share") * (F.col("_all") - 1)), F.col("bin"))
        return sums.groupBy(*series), reached

    stat = lambda name, what: F.when(F.col("stat") == name, what)

    def first(t: np.ndarray, v: np.ndarray, core: np.ndarray, known: dict) -> dict:
        repeats, total = charts.repeat_counts(v, core, params.least_run)
        return {"step": charts.step_bins(t, core), "n": int(core.sum()), "odd": int(np.count_nonzero((t != np.floor(t)) & core)), "repeats": repeats, "total": total}

    def second(t: np.ndarray, v: np.ndarray, core: np.ndarray, known: dict) -> dict:
        return dict(zip(("speed", "bend"), charts.move_bins(t, v, core, charts.usual_step(known["step"]))))

    def third(t: np.ndarray, v: np.ndarray, core: np.ndarray, known: dict) -> dict:
        lim = limits[known["f"]]
        return {"moves": charts.jump_count(v, core, charts.least_jump(known["bend"], known["n"], lim, params)) if lim.jumps else 0}

    groups, reached = counted(placed, first)
    usual, n = kept(groups.agg(F.min(stat("step", reached)).alias("step"), *[F.sum(stat(c, F.col("n"))).alias(c) for c in ("n", "odd", "repeats", "total")]), MOST_BROADCAST)
    groups, reached = counted(with_usual(usual, n), second)
    moving = groups.agg(*[F.min(stat(c, reached)).alias(c) for c in ("speed", "bend")])
    usual, n = kept(_beside(usual, moving, series), MOST_BROADCAST)
    if any(lim.jumps for lim in limits):
        groups, _ = counted(with_usual(usual, n), third)
        usual, n = kept(_beside(usual, groups.agg(F.sum("n").alias("moves")), series), MOST_BROADCAST)
    else:
        usual = usual.withColumn("moves", F.lit(0).cast("long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for seg in segments(batches, [*series, "piece"]):
            t, v, core = seg.column("t").to_numpy(), seg.column("v").to_numpy(), seg.column("_core").to_numpy(zero_copy_only=False).astype(bool)
            known = {c: seg.column(c)[0].as_py() for c in seg.column_names}
            lim = limits[known["f"]]
            m = charts.motion(*[known[c] for c in ("n", "odd", "step", "speed", "bend", "moves", "repeats", "total")], lim, params)
            still = charts.frozen(v, lim, params, m)
            spike = charts.spikes(t, v, lim, params, m)
            at = np.flatnonzero((still | spike) & core)
            if len(at):
                keys = {k: pa.array([known[k]] * len(at), pa.int64()) for k in key}
                yield pa.RecordBatch.from_pydict(keys | _rows([(names[known["f"]], seg.column("row_id").to_numpy()[at], t[at], v[at], np.zeros(len(at), bool), spike[at], still[at])]))

    return impossible.unionByName(with_usual(usual, n).mapInArrow(run, schema))


def _beside(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """a with the columns of b, null where b has no such row."""
    b = b.select(*[F.col(c).alias(f"_{c}") for c in on], *[c for c in b.columns if c not in on])
    return a.join(b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in on], "left").drop(*[f"_{c}" for c in on])
