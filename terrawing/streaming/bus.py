"""The event stream as Structured Streaming, and the batch twins it agrees with."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from terrawing.operators.blocks import numbered

SCHEMA = "seq long, ts double, stage string, kind string, payload string"


def read(spark: SparkSession, folder: str, schema: str = SCHEMA, files_per_trigger: int = 8) -> DataFrame:
    """Events from Parquet files that arrive in a folder; nothing is dropped when many arrive at once."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def counts(events: DataFrame, late: str = "10 minutes", width: str = "1 minute") -> DataFrame:
    """Events per window and kind; an event later than ``late`` behind the newest is no longer counted."""
    at = F.timestamp_seconds("ts")
    return events.withColumn("at", at).withWatermark("at", late).groupBy(F.window("at", width).alias("w"), "kind").agg(F.count(F.lit(1)).alias("n_events")).select(F.col("w.start").alias("since"), "kind", "n_events")


def fold(events: DataFrame) -> DataFrame:
    """Per stage: number of events, first and last time, in update or complete mode."""
    return events.groupBy("stage").agg(F.count(F.lit(1)).alias("n_events"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count(F.when(F.col("kind") == "fallback", 1)).alias("n_fallbacks"))


STATUS_STATE = "last_ts double, last_seq long, last string, fell_ts double, fell_seq long, start_ts double, n_fallbacks long"


def status(events: DataFrame) -> DataFrame:
    """stage, status, start_ts, n_fallbacks after each batch, whatever the order in which events arrive.

    pending, running, done, fallback, error: a fallback only leaves running,
    done overwrites it. By (ts, seq), as in fold_stages, the last start, done
    or error decides, and after a start the last fallback, if it is later; so
    these two are all that a stage's state holds. An event that comes a second
    time changes nothing but n_fallbacks if it is a fallback.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ts, seq, last, fell_ts, fell_seq, start, falls = state.get if state.exists else (None, None, None, None, None, None, 0)
        decided, fell = None if ts is None else (ts, seq, last), None if fell_ts is None else (fell_ts, fell_seq)
        for rows in batches:
            rows = rows[rows["ts"].notna()]
            deciding = rows[rows["kind"].isin(["start", "done", "error"])]
            for r in zip(deciding["ts"].astype(float), deciding["seq"].astype(int), deciding["kind"]):
                decided = r if decided is None else max(decided, r)
                start = min(start, r[0]) if r[2] == "start" and start is not None else r[0] if r[2] == "start" else start
            fallen = rows[rows["kind"] == "fallback"]
            falls += len(fallen)
            for r in zip(fallen["ts"].astype(float), fallen["seq"].astype(int)):
                fell = r if fell is None else max(fell, r)
        now = "pending" if decided is None else {"start": "running"}.get(decided[2], decided[2])
        if now == "running" and fell is not None and fell > decided[:2]:
            now = "fallback"
        state.update((*(decided or (None, None, None)), *(fell or (None, None)), start, falls))
        yield pd.DataFrame({"stage": [key[0]], "status": [now], "start_ts": [start], "n_fallbacks": [falls]})

    return events.groupBy("stage").applyInPandasWithState(step, "stage string, status string, start_ts double, n_fallbacks long", STATUS_STATE, "update", GroupStateTimeout.NoTimeout)


WATCH_STATE = "last_ts double, warned_ms long, active boolean"


def watchdog(events: DataFrame, least_s: float = 60.0, again_s: float = 30.0) -> DataFrame:
    """stage and warned_ms: a warning when a stage that has started, and isn't over, has sent nothing for least_s of processing time; again after again_s."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, warned, active = state.get if state.exists else (None, 0, False)
        if state.hasTimedOut:
            now = state.getCurrentProcessingTimeMs()
            state.update((last, now, active))
            if active:
                state.setTimeoutDuration(int(again_s * 1000))
                yield pd.DataFrame({"stage": [key[0]], "warned_ms": [now]})
            return
        for rows in batches:
            for kind, ts in sorted(zip(rows["kind"], rows["ts"]), key=lambda x: x[1]):
                last, active = ts, True if kind == "start" else False if kind in ("done", "error") else active
        state.update((last, warned, active))
        state.setTimeoutDuration(int(least_s * 1000))

    return events.groupBy("stage").applyInPandasWithState(step, "stage string, warned_ms long", WATCH_STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)


STITCH_STATE = "next long, held string"


def stitched(results: DataFrame, index: str = "chunk_idx", run: str = "run_id") -> DataFrame:
    """run, place, index: chunks of two or more producers in the order of their index, each as soon as all before it are there; one that comes twice goes out once. Of a run only the chunks that wait are held."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        following, held = (state.get[0], set(json.loads(state.get[1]))) if state.exists else (0, set())
        for rows in batches:
            held |= {int(i) for i in rows[index] if i >= following}
        out = []
        while following in held:
            held.remove(following)
            out.append(following)
            following += 1
        state.update((following, json.dumps(sorted(held))))
        yield pd.DataFrame({run: [key[0]] * len(out), index: out}).astype({index: "int64"})

    return results.groupBy(run).applyInPandasWithState(step, f"{run} long, {index} long", STITCH_STATE, "append", GroupStateTimeout.NoTimeout)


def publish(events: DataFrame, folder: str, files: int = 4) -> None:
    """Events as files of a stream's folder, in the order of seq; a stream that reads them takes files_per_trigger files a tick."""
    events.repartitionByRange(files, "seq").sortWithinPartitions("seq").write.mode("append").parquet(folder)


def log_tail(events: DataFrame, most: int = 200) -> DataFrame:
    """The last so many events by (ts, seq): a top-k, no full sort."""
    return events.orderBy(F.desc("ts"), F.desc("seq")).limit(most)


def progress(events: DataFrame, total: int) -> DataFrame:
    """Per stage: done (progress events), rate a minute between first and last event, and eta_s for what is left of total; in update or complete mode."""
    g = events.groupBy("stage").agg(F.count(F.when(F.col("kind") == "progress", 1)).alias("done"), F.min("ts").alias("_a"), F.max("ts").alias("_b"))
    took = F.col("_b") - F.col("_a")
    rate = F.coalesce(F.try_divide(F.col("done") * 60.0, took), F.lit(0.0))
    left = F.greatest(F.lit(total) - F.col("done"), F.lit(0))
    return g.select("stage", "done", rate.alias("per_minute"), F.try_divide(left * took, F.col("done")).alias("eta_s"))


def resequenced(results: DataFrame, producer: str = "producer", index: str = "chunk_idx") -> DataFrame:
    """The stitcher's order, whichever producer was first: place by chunk, a chunk delivered twice once."""
    once = results.dropDuplicates([index]).withColumn("_run", F.lit(0))
    return numbered(once, ["_run"], [index], "place").drop("_run", "_total")


def run_last(stream: DataFrame, folder: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """Takes all that has arrived, each batch's rows into files of their own, and gives what a complete result was last; in update mode all rows with their batch."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number:08d}")

    stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    spark = stream.sparkSession
    rows = spark.read.schema(f"{stream.schema.simpleString()[7:-1].replace(':', ' ')}, batch int").parquet(folder)
    return rows if mode != "complete" else rows.join(F.broadcast(rows.agg(F.max("batch").alias("batch"))), "batch", "left_semi").drop("batch")


def run_once(stream: DataFrame, name: str, mode: str, checkpoint: str) -> None:
    """Takes all that has arrived into a table in the driver's memory and ends; for tests."""
    stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def run_to(stream: DataFrame, folder: str, checkpoint: str, mode: str = "append") -> None:
    """Takes all that has arrived into Parquet files and ends."""
    stream.writeStream.format("parquet").option("path", folder).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def fused_increments(points: DataFrame, size: float) -> DataFrame:
    """Voxel sums over a stream of points, in complete or update mode: the incremental fusion."""
    from terrawing.operators.fusion import partial_sums

    return partial_sums(points, size)
