"""Problem 7: texts into containers of fixed capacity with little space left over.

Sum-of-squares packing: an item goes where the sum, over all gaps, of the
squared number of open containers with that gap becomes smallest. Items are
spread over buckets by a hash of their id; each bucket is packed alone, its
largest pieces first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrawing.operators.segments import segments

#: Items per bucket on average. A bucket wastes a few dozen half-filled containers at its end, whatever its size.
ITEMS_PER_BUCKET = 25_000
#: container_id = bucket * SPACE + number within the bucket.
SPACE = 2**32


class Packer:
    """Open containers of one capacity, by the gap that they have left."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]
        # counts[g] = open containers with gap g; a new one (gap capacity) and a full one (gap 0) count as none.
        self.counts = np.zeros(capacity + 1, np.int64)
        self.made = 0

    def new(self) -> int:
        self.made += 1
        return self.made - 1

    def place(self, size: int) -> int:
        """The container for an item of 0 <= size <= capacity."""
        c, n = self.capacity, self.counts
        if size == c:
            return self.new()
        # Moving a container from gap g to g - size changes the sum of squares by 2 * (n[g - size] - n[g]) + 2,
        # or by 1 - 2 * n[g] where it gets full, and opening one by 2 * n[c - size] + 1.
        best_gap, best = c, 2 * int(n[c - size]) + 1
        from_ = n[size:c]
        if size and len(from_):
            delta = 2 * (n[: c - size] - from_) + 2
            delta[0] = 1 - 2 * from_[0]
            delta[from_ == 0] = np.iinfo(np.int64).max
            at = int(delta.argmin())
            if delta[at] <= best:
                best_gap, best = at + size, int(delta[at])
        elif not size:
            used = np.flatnonzero(n[:c])
            if len(used):
                return self.open[int(used[0])][-1]
        if best_gap == c:
            bin_ = self.new()
        else:
            bin_ = self.open[best_gap].pop()
            n[best_gap] -= 1
        gap = best_gap - size
        if gap:
            self.open[gap].append(bin_)
            n[gap] += 1
        return bin_


def pieces(size: int, capacity: int) -> list[int]:
    """The sizes an item is packed in: itself, or, only if it exceeds the capacity, full containers and the rest."""
    if size <= capacity:
        return [size]
    return [capacity] * (size // capacity) + ([size % capacity] if size % capacity else [])


def pack(items: DataFrame, item_id: str, size: str, containers: dict[str, int], buckets: int) -> DataFrame:
    """container_kind, container_id, item_id, piece, start, size: where each piece of each item lies.

    Each kind is a task of its own and gets every item. Pieces of an item are
    numbered from 0 and start at the token ``start``. Items of size 0 take no
    space and get a container like any other; null sizes count as 0. Repeated
    ids count as items of their own. No container exceeds its capacity; an
    empty table, or no containers, gives an empty result.
    """
    kinds = {k: int(c) for k, c in containers.items()}
    if any(c < 1 for c in kinds.values()):
        raise ValueError("a capacity must be at least 1")
    slim = items.select(F.col(item_id).cast("long").alias("id"), F.greatest(F.coalesce(F.col(size).cast("long"), F.lit(0)), F.lit(0)).alias("size"))
    placed = slim.withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(max(1, buckets)))).repartition(max(1, buckets), "bucket")
    # Pieces of one size come in the order of another hash: not by source.
    placed = placed.withColumn("turn", F.xxhash64("id", F.lit(7))).sortWithinPartitions("bucket", "turn", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for seg in segments(batches, ["bucket"]):
            base = seg.column("bucket")[0].as_py() * SPACE
            ids, sizes = seg.column("id").to_pylist(), seg.column("size").to_pylist()
            for kind, capacity in kinds.items():
                packer, out = Packer(capacity), ([], [], [], [], [])
                # Large pieces first: what is small at the end fills the gaps that are left.
                parts = sorted(((part, i, k) for i, n in zip(ids, sizes) for k, part in enumerate(pieces(n, capacity))), key=lambda p: -p[0])
                for part, i, k in parts:
                    for column, v in zip(out, (base + packer.place(part), i, k, k * capacity, part)):
                        column.append(v)
                yield pa.RecordBatch.from_pydict(
                    {"container_kind": pa.array([kind] * len(out[0]), pa.string())}
                    | {c: pa.array(v, t) for c, v, t in zip(("container_id", "item_id", "piece", "start", "size"), out, (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()))}
                )

    return placed.mapInArrow(run, "container_kind string, container_id long, item_id long, piece int, start long, size long")


def fill(packed: DataFrame, containers: DataFrame) -> DataFrame:
    """Per kind: containers used, least that could do, tokens packed, share of the space that is filled."""
    per = packed.groupBy("container_kind").agg(F.countDistinct("container_id").alias("n_containers"), F.sum("size").alias("n_tokens"))
    space = F.col("n_containers") * F.col("capacity_tokens")
    return per.join(containers.select("container_kind", "capacity_tokens"), "container_kind").select(
        "container_kind", "n_containers", F.ceil(F.col("n_tokens") / F.col("capacity_tokens")).alias("least_containers"), "n_tokens", F.round(F.col("n_tokens") / space, 6).alias("filled")
    )
