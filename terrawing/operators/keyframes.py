"""Choosing keyframes: sharpness floor, spacing, strides, thinning, held-out frames."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrawing.operators.blocks import MOST_BROADCAST, numbered
from terrawing.operators.quantiles import exact_quantiles
from terrawing.operators.segments import segments
from terrawing.runtime import cut, small
from terrawing.runtime import kept as kept_rows


def sharpness_gate(frames: DataFrame, track: str = "track_id", share: float = 0.15) -> DataFrame:
    """Adds ``floor``, the track's exact sharpness quantile, and ``sharp``: whether the frame isn't below it (ties pass)."""
    floors = exact_quantiles(frames, "sharpness", {"floor": share}, [track]).drop("n")
    return frames.join(floors, track).withColumn("sharp", F.col("sharpness") >= F.col("floor"))


def spacing_gate(frames: DataFrame, track: str = "track_id", order: str = "frame_index", least_m: float = 2.0, rows_per_block: int = 100_000) -> DataFrame:
    """track, order and ``kept``: a frame is kept if it lies at least least_m from the last one kept, or is the first.

    Input needs e, n and u; frames without place aren't kept and don't count.
    The choice depends on the last frame kept. A track of at most
    2 * rows_per_block frames is read in one stream that holds that frame's
    place. A longer one is read in blocks at once, each from the place that
    the block before ended with when it was read last; chains from different
    places soon keep the same frames, so that the ends settle after a round or
    two, and the rounds go on until they do.
    """
    kind = frames.schema[track].dataType
    slim = frames.select(F.col(track).cast("string").alias("track"), F.col(order).cast("long").alias("pos"), *[F.col(c).cast("double").alias(c) for c in "enu"])
    sizes = slim.groupBy("track").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 2 * rows_per_block)
    hot, n = kept_rows(sizes.select(F.col("track").alias("_hot")), MOST_BROADCAST)
    none = [F.lit(0).cast("long").alias("block"), *[F.lit(None).cast("double").alias(f"_{c}") for c in "enu"]]
    flags = "track string, pos long, kept boolean"

    def chain(batches: Iterator[pa.RecordBatch], ends: bool) -> Iterator[pa.RecordBatch]:
        """Flags of the rows or, with ends, the place with which each block ends."""
        key, place = None, None
        for batch in batches:
            kept = []
            for t, block, e, n, u, *start in zip(*[batch.column(c).to_pylist() for c in ("track", "block", "e", "n", "u", "_e", "_n", "_u")]):
                if (t, block) != key:
                    if ends and key is not None:
                        yield _end(key, place)
                    key, place = (t, block), tuple(start) if None not in start else None
                ok = None not in (e, n, u) and (place is None or (e - place[0]) ** 2 + (n - place[1]) ** 2 + (u - place[2]) ** 2 >= least_m * least_m)
                if ok:
                    place = (e, n, u)
                kept.append(ok)
            if not ends:
                yield pa.RecordBatch.from_arrays([batch.column("track"), batch.column("pos"), pa.array(kept, pa.bool_())], ["track", "pos", "kept"])
        if ends and key is not None:
            yield _end(key, place)

    together = lambda df: df.repartition("track", "block").sortWithinPartitions("track", "block", "pos")
    whole = slim if not n else slim.join(small(hot, MOST_BROADCAST, n), F.col("track").eqNullSafe(F.col("_hot")), "left_anti")
    out = together(whole.select("*", *none)).mapInArrow(lambda b: chain(b, False), flags)
    if n:
        long = slim.join(small(hot, MOST_BROADCAST, n), F.col("track").eqNullSafe(F.col("_hot"))).drop("_hot")
        long = numbered(long, ["track"], ["pos"], "_i").withColumn("block", F.floor(F.col("_i") / rows_per_block).cast("long"))
        long = cut(frames.sparkSession, together(long.select("track", "block", "pos", *"enu")))
        ends, size = kept_rows(long.select("*", *none[1:]).mapInArrow(lambda b: chain(b, True), _ENDS), MOST_BROADCAST)
        while True:
            before = small(ends.select(F.col("track").alias("_t"), (F.col("block") + 1).alias("_b"), *[F.col(f"end_{c}").alias(f"_{c}") for c in "enu"]), MOST_BROADCAST, size)
            started = long.join(before, F.col("track").eqNullSafe(F.col("_t")) & (F.col("block") == F.col("_b")), "left").drop("_t", "_b")
            started = started if size <= MOST_BROADCAST else together(started)
            again, size = kept_rows(started.mapInArrow(lambda b: chain(b, True), _ENDS), MOST_BROADCAST)
            old = ends.select(F.col("track").alias("_t"), F.col("block").alias("_b"), *[F.col(f"end_{c}").alias(f"_{c}") for c in "enu"])
            same = [F.col("track").eqNullSafe(F.col("_t")), F.col("block") == F.col("_b"), *[F.col(f"end_{c}").eqNullSafe(F.col(f"_{c}")) for c in "enu"]]
            moved = again.join(old, same, "left_anti").limit(1).count()
            ends = again
            if not moved:
                break
        out = out.unionByName(started.mapInArrow(lambda b: chain(b, False), flags))
    return out.select(F.col("track").cast(kind).alias(track), F.col("pos").alias(order), "kept")


_ENDS = "track string, block long, end_e double, end_n double, end_u double"


def _end(key: tuple, place: tuple | None) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"track": pa.array([key[0]], pa.string()), "block": pa.array([key[1]], pa.int64())} | {f"end_{c}": pa.array([place and place[i]], pa.float64()) for i, c in enumerate("enu")})


def stride_gate(frames: DataFrame, track: str = "track_id", order: str = "frame_index", stride: int = 5) -> DataFrame:
    """Adds ``kept``: of the frames of a track every stride-th, from the first; all if there are at most stride. stride is at least 2."""
    if stride < 2:
        raise ValueError("stride must be at least 2")
    return numbered(frames, [track], [order], "_k").withColumn("kept", (F.col("_total") <= stride) | (F.col("_k") % stride == 0)).drop("_k", "_total")


def select(frames: DataFrame, track: str = "track_id", order: str = "frame_index", share: float = 0.15, least_m: float = 2.0, stride: int = 5) -> DataFrame:
    """Candidates (sharpness; e, n, u, null without place) with ``accepted`` and ``reject_reason``, as one selection per track.

    A frame below the track's sharpness quantile is out. Of those left, one
    with a place must lie at least least_m from the last one kept that had a
    place; one without must be every stride-th of such, from the first, if the
    track has more than stride candidates. A frame without sharpness is out
    and doesn't count for the quantile, but is a candidate. Columns that
    already have the results' names are replaced.
    """
    frames = frames.drop("accepted", "reject_reason")
    if stride < 2:
        raise ValueError("stride must be at least 2")
    n = frames.groupBy(track).agg(F.count(F.lit(1)).alias("_n"))
    floors = exact_quantiles(frames, "sharpness", {"floor": share}, [track]).drop("n")
    rows = frames.join(n, track).join(floors, track, "left")
    sharp = F.coalesce(F.col("sharpness") >= F.col("floor"), F.lit(False))
    rows = rows.withColumn("_place", F.col("e").isNotNull() & F.col("n").isNotNull() & F.col("u").isNotNull())
    blurred = rows.where(~sharp).withColumns({"accepted": F.lit(False), "reject_reason": F.coalesce(F.format_string("sharpness %.1f below floor %.1f", "sharpness", "floor"), F.lit("no sharpness"))})
    blurred = blurred.withColumn("reject_reason", F.when(F.col("sharpness").isNull(), "no sharpness").otherwise(F.col("reject_reason")))
    placed, bare = rows.where(sharp & F.col("_place")), rows.where(sharp & ~F.col("_place"))
    spaced = spacing_gate(placed, track, order, least_m).select(F.col(track).alias("_t"), F.col(order).alias("_o"), F.col("kept").alias("accepted"))
    placed = placed.join(spaced, F.col(track).eqNullSafe(F.col("_t")) & (F.col(order) == F.col("_o"))).drop("_t", "_o")
    placed = placed.withColumn("reject_reason", F.when(~F.col("accepted"), F.lit(f"GPS spacing < {least_m}m from last keyframe")))
    bare = numbered(bare, [track], [order], "_k").withColumn("accepted", (F.col("_n") <= stride) | (F.col("_k") % stride == 0)).drop("_k", "_total")
    bare = bare.withColumn("reject_reason", F.when(~F.col("accepted"), "frame-stride spacing (no GPS available)"))
    return blurred.unionByName(placed).unionByName(bare).drop("_n", "floor", "_place")


def thin_even(frames: DataFrame, most: int, track: str = "track_id", order: str = "frame_index") -> DataFrame:
    """At most so many frames of a track, evenly spread: those at int(i * n / most)."""
    rows = numbered(frames, [track], [order], "_k").withColumnRenamed("_total", "_n")
    # Frame k is the one of pick i = ceil(k * most / n) if int(i * n / most) is k.
    step = F.col("_n") / F.lit(most).cast("double")
    i = F.ceil(F.col("_k") / step)
    taken = (F.floor(i * step) == F.col("_k")) & (i < most) | (F.floor((i - 1) * step) == F.col("_k")) & (i > 0)
    return rows.where((F.col("_n") <= most) | taken).drop("_k", "_n")


def pick_even(frames: DataFrame, most: int, track: str = "track_id", order: str = "frame_index") -> DataFrame:
    """The first so many of every max(1, n // most)-th frame."""
    rows = numbered(frames, [track], [order], "_k").withColumnRenamed("_total", "_n")
    every = F.greatest(F.lit(1), F.floor(F.col("_n") / most).cast("int"))
    return rows.where((F.col("_k") % every == 0) & (F.col("_k") / every < most)).drop("_k", "_n")


def sampled(frames: DataFrame, fps: float, target: float, index: str = "frame_index") -> DataFrame:
    """Frames whose index is a multiple of max(1, fps / target), rounded half to even."""
    return frames.where(F.pmod(F.col(index), F.greatest(F.lit(1), F.bround(F.lit(fps / target), 0).cast("int"))) == 0)


def first_frames(frames: DataFrame, most: int, track: str = "track_id", order: str = "frame_index") -> DataFrame:
    """The decoder's cap: the first so many frames of each track."""
    return numbered(frames, [track], [order], "_k").where(F.col("_k") < most).drop("_k", "_total")


def held_out(frames: DataFrame, keyframe: Column, windows: int = 15, apart: int = 5, track: str = "track_id", order: str = "frame_index") -> DataFrame:
    """The sharpest frame of each of so many windows among those at least ``apart`` positions from every keyframe; ties go to the earliest."""
    rows = numbered(frames.withColumn("_key", keyframe), [track], [order], "pos")
    taken = rows.where("_key").select(F.col(track).alias("_t"), F.explode(F.sequence(F.col("pos") - (apart - 1), F.col("pos") + (apart - 1))).alias("_p")).distinct()
    free = rows.join(taken, F.col(track).eqNullSafe(F.col("_t")) & (F.col("pos") == F.col("_p")), "left_anti")
    free = free.withColumn("window", F.floor(((F.col("pos") + 1) * windows - 1) / F.col("_total")).cast("int")).drop("_key", "_total")
    # One row per window from each partition meets the others'.
    place = F.struct(F.coalesce("sharpness", F.lit(float("-inf"))).alias("s"), (-F.col("pos")).alias("p"))
    best = free.groupBy(track, "window").agg(F.max_by(F.struct(*[c for c in free.columns if c not in (track, "window")]), place).alias("_b"))
    return best.select(track, "window", "_b.*")


def laplacian_variance(pixels: np.ndarray) -> float:
    """Sharpness of a grey image: 4 x 4 average pool, 3 x 3 Laplacian with repeated edges, sample variance."""
    h, w = (s // 4 * 4 for s in pixels.shape)
    small = pixels[:h, :w].reshape(h // 4, 4, w // 4, 4).mean(axis=(1, 3))
    p = np.pad(small, 1, mode="edge")
    lap = p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * small
    return float(lap.var(ddof=1)) if lap.size > 1 else 0.0


def sharpness(pixels: DataFrame, frame: str = "frame_index") -> DataFrame:
    """frame and sharpness from a pixel table (row, col, r, g, b from 0); a frame's pixels come together in one stream."""
    grey = pixels.select(F.col(frame).cast("long").alias("frame"), "row", "col", (0.299 * F.col("r") + 0.587 * F.col("g") + 0.114 * F.col("b")).alias("grey"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for seg in segments(batches, ["frame"]):
            row, col = seg.column("row").to_numpy(), seg.column("col").to_numpy()
            image = np.zeros((int(row.max()) + 1, int(col.max()) + 1))
            image[row, col] = seg.column("grey").to_numpy()
            yield pa.RecordBatch.from_pydict({"frame": pa.array([seg.column("frame")[0].as_py()], pa.int64()), "sharpness": pa.array([laplacian_variance(image)])})

    out = grey.repartition("frame").sortWithinPartitions("frame").mapInArrow(run, "frame long, sharpness double")
    return out.withColumnRenamed("frame", frame)
