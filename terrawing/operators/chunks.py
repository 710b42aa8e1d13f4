"""Overlapping chunks of frames and what consecutive chunks share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrawing.operators.blocks import numbered


def overlapping(frames: DataFrame, size: int = 50, overlap: int = 10, track: str = "track_id", order: str = "frame_index") -> DataFrame:
    """One row per frame and chunk: chunk_idx, view_pos and chunk_len.

    Chunks begin every max(size - overlap, 1) frames; the last is the first
    that reaches the end, and may be short.
    """
    step = max(size - overlap, 1)
    rows = numbered(frames, [track], [order], "_k").withColumnRenamed("_total", "_n")
    last = F.greatest(F.ceil((F.col("_n") - size) / step), F.lit(0)).cast("int")
    low = F.greatest(F.ceil((F.col("_k") - size + 1) / step), F.lit(0)).cast("int")
    rows = rows.withColumn("_last", last).withColumn("chunk_idx", F.explode(F.sequence(low, F.least(F.floor(F.col("_k") / step).cast("int"), F.col("_last")))))
    rows = rows.withColumns({"view_pos": (F.col("_k") - F.col("chunk_idx") * step).cast("int"), "chunk_len": F.least(F.lit(size), F.col("_n") - F.col("chunk_idx") * step).cast("int")})
    return rows.drop("_k", "_n", "_last")


def shared_frames(chunks: DataFrame, overlap: int = 10, track: str = "track_id", frame: str = "frame_index") -> DataFrame:
    """track, chunk_idx, frame, view_pos here and in the chunk before, whose last ``overlap`` views are remembered."""
    before = chunks.where(F.col("view_pos") >= F.col("chunk_len") - overlap).select(F.col(track).alias("_t"), (F.col("chunk_idx") + 1).alias("_c"), F.col(frame).alias("_f"), F.col("view_pos").alias("prev_pos"))
    joined = chunks.join(before, (chunks[track] == before["_t"]) & (chunks["chunk_idx"] == before["_c"]) & (chunks[frame] == before["_f"]))
    return joined.select(track, "chunk_idx", frame, "view_pos", "prev_pos")


def apply_alignment(points: DataFrame, alignments: DataFrame) -> DataFrame:
    """Points with x, y and z moved by their chunk's scale, rotation (r, 9 doubles) and shift (t, 3 doubles)."""
    joined = points.join(alignments.select("chunk_idx", F.col("scale").alias("_s"), F.col("r").alias("_r"), F.col("t").alias("_t")), "chunk_idx")
    moved = {a: F.col("_s") * (F.col("_r")[3 * i] * F.col("x") + F.col("_r")[3 * i + 1] * F.col("y") + F.col("_r")[3 * i + 2] * F.col("z")) + F.col("_t")[i] for i, a in enumerate("xyz")}
    return joined.withColumns(moved).drop("_s", "_r", "_t")
