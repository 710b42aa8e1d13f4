"""Sorted Arrow batches in, one source's rows at a time out."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def _changes(batch: pa.RecordBatch, key: list[str]) -> np.ndarray:
    """Positions at which the key differs from that of the row before (0 not among them)."""
    n = batch.num_rows
    moved = np.zeros(n - 1, bool) if n > 1 else np.zeros(0, bool)
    for name in key:
        c = batch.column(name)
        if pa.types.is_integer(c.type) and not c.null_count:
            a = c.to_numpy(zero_copy_only=False)
            moved |= a[1:] != a[:-1]
        else:
            a = np.array([(x is None, "" if x is None else x) for x in c.to_pylist()], dtype=object)
            moved |= np.fromiter((tuple(a[i]) != tuple(a[i - 1]) for i in range(1, n)), bool, max(0, n - 1))
    return np.flatnonzero(moved) + 1


def segments(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[pa.Table]:
    """The rows of each key, from batches in which equal keys are neighbours."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cuts = [0, *_changes(batch, key).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            piece = batch.slice(a, b - a)
            now = tuple(piece.column(k)[0].as_py() for k in key) if a == 0 else None
            if held and (a > 0 or now != last):
                yield pa.Table.from_batches(held)
                held = []
            held.append(piece)
        last = tuple(batch.column(k)[batch.num_rows - 1].as_py() for k in key)
    if held:
        yield pa.Table.from_batches(held)
