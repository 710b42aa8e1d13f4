"""Stages, resources and events folded to what a run's report says."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrawing.operators.blocks import neighbours, numbered
from terrawing.runtime import cut

#: Words of a message that tell of a way round, and the events that decide a stage's status.
FALLBACK_WORDS = ("fallback", "falling back", "unavailable", "skip")
STAGE_EVENTS = ("start", "done", "fallback", "error")


def within_stages(stages: DataFrame, samples: DataFrame, time: str = "ts", now: Column | None = None, width: float = 3600.0) -> DataFrame:
    """Samples with the stages that are open at their time, both ends included; a stage without end is open until ``now``.

    Stages are laid out over stretches of ``width`` seconds and meet samples
    by stretch, so neither side needs to be small; stages without start have
    no samples.
    """
    end = F.coalesce(F.col("end_ts"), now if now is not None else F.col("start_ts"))
    laid = stages.where("start_ts is not null").withColumn("_end", end).withColumn("_slot", F.explode(F.sequence(F.floor(F.col("start_ts") / width).cast("bigint"), F.floor(F.greatest("start_ts", "_end") / width).cast("bigint"))))
    rows = samples.withColumn("_slot", F.floor(F.col(time) / width).cast("bigint"))
    return rows.join(laid, "_slot").where((F.col(time) >= F.col("start_ts")) & (F.col(time) <= F.col("_end"))).drop("_slot", "_end")


def utilisation(rows: DataFrame, by: list[str], value: str = "util_pct", idle_below: float = 5.0) -> DataFrame:
    """Mean, largest and idle share (below idle_below) of a value per group; nulls don't count."""
    return rows.groupBy(*by).agg(F.avg(value).alias("mean_util"), F.max(value).alias("max_util"), F.avg(F.when(F.col(value).isNotNull(), (F.col(value) < idle_below).cast("double"))).alias("idle_share"), F.count(value).alias("n_samples"))


def flagged(summary: DataFrame, least_mean: float = 70.0, most_idle: float = 0.2) -> DataFrame:
    return summary.withColumn("flagged", (F.col("mean_util") < least_mean) | (F.col("idle_share") > most_idle))


def low_stages(per_gpu: DataFrame, stage: str = "stage", below: float = 50.0) -> DataFrame:
    """Stages whose worst GPU has a mean below a bound."""
    return per_gpu.groupBy(stage).agg(F.min("mean_util").alias("worst_util")).where(F.col("worst_util") < below)


def elapsed(stages: DataFrame, extra: DataFrame, stage: str = "stage") -> DataFrame:
    """stage and elapsed_s: the sum of the seconds reported for it, or else end minus start."""
    added = extra.groupBy(stage).agg(F.sum("seconds").alias("_s"))
    return stages.join(added, stage, "left").select(stage, F.coalesce("_s", F.col("end_ts") - F.col("start_ts")).alias("elapsed_s"))


def fold_stages(events: DataFrame) -> DataFrame:
    """stage, status, start_ts, end_ts, n_fallbacks from events (stage, kind, ts, seq).

    pending becomes running at a start, done, fallback or error after it; a
    fallback only counts while the stage runs; done overwrites a fallback.
    Expressed by the last event that decides, no state has to be kept. Events
    without time are left out.
    """
    # What a fallback meets: the last start, done or error before it. A stage may hold a third of the log, so it is looked for in blocks of time.
    decides = F.when(F.col("kind").isin("start", "done", "error"), F.col("kind"))
    rows = neighbours(events.where(F.col("kind").isin(*STAGE_EVENTS)), ["stage"], "ts", ["seq"], decides).withColumnRenamed("_prev", "_met").drop("_next")
    fell = F.when((F.col("kind") == "fallback") & (F.col("_met") == "start"), F.lit("fallback"))
    said = F.when(F.col("kind") == "start", "running").when(F.col("kind") == "done", "done").when(F.col("kind") == "error", "error").otherwise(fell)
    return rows.withColumn("_said", said).groupBy("stage").agg(
        F.coalesce(F.max_by("_said", F.when(F.col("_said").isNotNull(), F.struct("ts", "seq"))), F.lit("pending")).alias("status"),
        F.min(F.when(F.col("kind") == "start", F.col("ts"))).alias("start_ts"), F.max(F.when(F.col("kind").isin("done", "error"), F.col("ts"))).alias("end_ts"), F.count(F.when(F.col("kind") == "fallback", 1)).alias("n_fallbacks"),
    )


def stalls(events: DataFrame, group: str, time: str, least_s: float = 60.0) -> DataFrame:
    """Gaps of at least least_s seconds between consecutive events of a group: group, since, until, gap_s."""
    rows = neighbours(events.select(group, time), [group], time, [], F.col(time))
    gap = F.col("_next") - F.col(time)
    return rows.where(gap >= least_s).select(group, F.col(time).alias("since"), F.col("_next").alias("until"), gap.alias("gap_s"))


def stall_warnings(events: DataFrame, group: str, time: str, start: str, least_s: float = 60.0, poll_s: float = 10.0, again_s: float = 30.0) -> DataFrame:
    """group, warned_at, stalled_s: what a watchdog says that looks every poll_s seconds from the group's ``start``.

    It warns once nothing has come for least_s seconds, and again every
    again_s while nothing comes. Silence after a group's last event isn't a
    stall: nobody knows how long the group was watched.
    """
    rows = neighbours(events.select(group, time, start), [group], time, [], F.col(time)).where(F.col("_next") - F.col(time) >= least_s)
    tick = lambda t: F.col(start) + F.ceil((t - F.col(start)) / poll_s) * poll_s
    first = tick(F.col(time) + least_s)
    n = F.floor((F.col("_next") - first) / again_s)
    said = rows.withColumns({"_first": first, "_n": n}).where(F.col("_first") < F.col("_next"))
    said = said.withColumn("warned_at", F.explode(F.transform(F.sequence(F.lit(0), F.col("_n").cast("int")), lambda k: F.col("_first") + k * again_s))).where(F.col("warned_at") < F.col("_next"))
    return said.select(group, "warned_at", (F.col("warned_at") - F.col(time)).alias("stalled_s"))


def newest(rows: DataFrame, group: list[str], order: list[str], most: int) -> DataFrame:
    """The ring buffer: the last so many rows of each group."""
    w = Window.partitionBy(*group).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most).drop("_r")


def fallback_messages(log: DataFrame, text: str) -> DataFrame:
    """Messages that speak of a way round, in any case."""
    low = F.lower(text)
    said = F.lit(False)
    for word in FALLBACK_WORDS:
        said = said | low.contains(word)
    return log.where(said)


def throttled(log: DataFrame, group: str, time: str, least_s: float) -> DataFrame:
    """group, time and ``shown``: a line is shown if it comes at least least_s after the last one shown."""
    from terrawing.operators.keyframes import spacing_gate

    zero = F.lit(0.0)
    placed = cut(log.sparkSession, numbered(log.select(group, time), [group], [time], "_k").select(group, "_k", F.col(time).alias("e"), zero.alias("n"), zero.alias("u")))
    kept = spacing_gate(placed, group, "_k", least_s)
    return placed.join(kept, [group, "_k"]).select(group, F.col("e").alias(time), F.col("kept").alias("shown"))


def progress(events: DataFrame, weights: dict[str, float], run: str, phase: str, share: str, order: str) -> DataFrame:
    """Adds ``progress``: the weighted share of phases done so far, which never falls."""
    at, before = F.lit(None).cast("double"), 0.0
    for name, w in weights.items():
        at = F.when(F.col(phase) == name, F.lit(before) + F.lit(w) * F.col(share)).otherwise(at)
        before += w
    w = Window.partitionBy(run).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn("progress", F.max(at).over(w))


def phase_starts(events: DataFrame, run: str, phase: str, time: str) -> DataFrame:
    """run, phase and since: the first time at which each phase of a run was seen."""
    return events.groupBy(run, phase).agg(F.min(time).alias("since"))


def windowed(samples: DataFrame, windows: DataFrame, by: list[str], value: str = "util_pct", time: str = "ts", width: float = 3600.0) -> DataFrame:
    """Utilisation of each GPU within each window (window, start_ts, end_ts), and whether it is flagged."""
    rows = within_stages(windows, samples, time, width=width)
    return flagged(utilisation(rows, ["window", *by], value))


def stage_report(stages: DataFrame, per_gpu: DataFrame) -> DataFrame:
    """stage and report: the JSON object of a stage with its GPUs in the order of their index."""
    gpus = per_gpu.groupBy("stage").agg(F.sort_array(F.collect_list(F.struct("gpu_index", "mean_util"))).alias("gpus"))
    return stages.join(gpus, "stage", "left").select("stage", F.to_json(F.struct("stage", "status", "gpus")).alias("report"))


def outputs(listing: DataFrame) -> DataFrame:
    """name, state and megabytes of outputs; one that claims to be there with a path and no bytes has failed."""
    empty = F.col("ok") & F.col("path").isNotNull() & (F.col("size_bytes") == 0)
    state = F.when(empty, "failed").when(F.col("ok"), "ok").otherwise(F.concat(F.lit("skipped: "), F.coalesce("skipped_reason", F.lit("unknown"))))
    return listing.select("name", state.alias("state"), (F.col("size_bytes") / 1e6).alias("mb"))


def mesh_state(faces: Column, least: int = 10_000) -> Column:
    return F.when(faces < least, "failed").otherwise("ok")
