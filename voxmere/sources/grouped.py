"""Groups of sorted rows inside a task, one after the other."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """A table for each run of rows that agree in keys, which have no nulls; a run may go over several batches.

    Where rows were dealt and sorted by keys, a run is a whole group. Only one is held at a time, and small ones cost little.
    """
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        new = np.zeros(batch.num_rows, bool)
        for key in keys:
            column = batch.column(key)
            new[1:] |= pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
            new[0] |= bool(held) and column[0] != held[-1].column(key)[-1]
        starts = [0, *(np.flatnonzero(new[1:]) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(starts, starts[1:]):
            if held and new[lo]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)
