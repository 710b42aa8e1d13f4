"""Problem 6: pairing records with the nearest record in time of the same entity.

Both tables go into one stream, partitioned by entity and sorted by time
inside each partition; a merge runs along it and holds nothing but the right
record just passed and the left records that still wait for the next one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrawing.operators.blocks import blocked


def nearest(
    left: DataFrame,
    right: DataFrame,
    entity: str,
    left_time: str,
    right_time: str,
    left_id: str,
    right_id: str,
    tolerance: float,
    rows_per_block: int = 200_000,
) -> DataFrame:
    """entity, left_id, right_id, apart_s: every left record with its nearest right record.

    right_id and apart_s (right time minus left time) are null where no right
    record lies within tolerance, both ends included to the microsecond. At
    equal distances the earlier right record is taken, of right records at
    the same time the one with the smallest id. Left records without time, or
    whose entity is null, are left out, as are such right records; repeated
    rows of a left record (same entity, id and time) come out once. Ids are
    whole numbers. Empty tables and further columns, whatever their names, do
    no harm.
    """
    sides = []
    for df, time, key, side in ((right, right_time, right_id, 0), (left, left_time, left_id, 1)):
        sides.append(
            df.select(F.col(entity).cast("long").alias("entity"), F.col(time).cast("double").alias("t"), F.lit(side).cast("byte").alias("side"), F.col(key).cast("long").alias("id")).where("entity is not null")
        )
    placed = blocked(sides[0].unionByName(sides[1]), ["entity"], "t", rows_per_block, tolerance + 1e-3)
    placed = placed.repartition("entity", "_block").sortWithinPartitions("entity", "_block", "t", "side", "id")
    merged = placed.mapInArrow(lambda batches: merge(batches, tolerance), "entity long, left_id long, right_id long, apart_s double")
    return merged.select(F.col("entity").alias(entity), F.col("left_id").alias(left_id), F.col("right_id").alias("nearest_id"), "apart_s")


def merge(batches: Iterator[pa.RecordBatch], tolerance: float) -> Iterator[pa.RecordBatch]:
    """The two-pointer merge, a batch at a time.

    Between batches it keeps the last right record and the left records that
    the next right record may still be nearest to: those within tolerance of
    the last time seen.
    """
    kept: dict[str, np.ndarray] | None = None
    for batch in batches:
        if batch.num_rows:
            rows = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ("entity", "_block", "t", "side", "id", "_core")}
            if kept is not None:
                rows = {c: np.concatenate([kept[c], v]) for c, v in rows.items()}
            out, kept = _step(rows, tolerance, last=False)
            yield out
    if kept is not None:
        yield _step(kept, tolerance, last=True)[0]


def _step(rows: dict[str, np.ndarray], tolerance: float, last: bool) -> tuple[pa.RecordBatch, dict[str, np.ndarray]]:
    key, block, t, ids = rows["entity"], rows["_block"], rows["t"], rows["id"]
    n = len(t)
    is_right = rows["side"] == 0
    new = np.concatenate([[True], (key[1:] != key[:-1]) | (block[1:] != block[:-1])])
    start = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    ends = np.append(np.flatnonzero(new)[1:], n)
    end = ends[np.cumsum(new) - 1]

    before = np.maximum.accumulate(np.where(is_right, np.arange(n), -1))
    # Right records at one time stand in the order of their ids: go to the first of them.
    first = np.arange(n)
    again = np.concatenate([[False], is_right[1:] & is_right[:-1] & (t[1:] == t[:-1]) & ~new[1:]])
    first = np.maximum.accumulate(np.where(again, 0, first)) if n else first
    after = np.minimum.accumulate(np.where(is_right, np.arange(n), n)[::-1])[::-1]
    has_before, has_after = before >= start, after < end

    left = np.flatnonzero(~is_right)
    same = np.zeros(n, bool)
    if len(left) > 1:
        a, b = left[1:], left[:-1]
        same[a] = (key[a] == key[b]) & (block[a] == block[b]) & (t[a] == t[b]) & (ids[a] == ids[b])
    open_ = end == n if not last else np.zeros(n, bool)
    waits = ~is_right & open_ & ~has_after & (t + tolerance + 1e-6 >= t[-1])
    done = left[~waits[left]]
    take = done[rows["_core"][done].astype(bool) & ~same[done]]

    p, q = first[np.maximum(before[take], 0)], np.minimum(after[take], n - 1)
    dp = np.where(has_before[take], t[take] - t[p], np.inf)
    dq = np.where(has_after[take], t[q] - t[take], np.inf)
    use = np.where(dp <= dq, p, q)
    gap = np.minimum(dp, dq)
    with np.errstate(invalid="ignore"):
        near = np.round(gap, 6) <= tolerance
    none = ~near
    out = pa.RecordBatch.from_arrays(
        [pa.array(key[take], pa.int64()), pa.array(ids[take], pa.int64()), pa.array(ids[use], pa.int64(), mask=none), pa.array(t[use] - t[take], pa.float64(), mask=none)],
        ["entity", "left_id", "right_id", "apart_s"],
    )
    keep = np.flatnonzero(waits)
    if not last:
        tail = before[n - 1]
        # Of the last right record, and of those at its time, the first will do; a left record just passed serves to tell repeats.
        held = ([first[tail]] if tail >= start[n - 1] else []) + ([left[-1]] if len(left) and end[left[-1]] == n and not waits[left[-1]] else [])
        keep = np.unique(np.concatenate([np.array(held, dtype=int), keep]))
    kept = {c: v[keep] for c, v in rows.items()}
    if not last and len(keep):
        # What has come out already must not come out again.
        kept["_core"] = kept["_core"] & (waits[keep] | is_right[keep])
    return out, kept
