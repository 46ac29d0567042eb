"""Groups of rows held whole in a task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows ordered by the first column, cut only where its value changes."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        first = batch.column(0).to_numpy()
        if held and held[0].column(0)[0].as_py() != first[0]:
            yield pa.Table.from_batches(held)
            held = []
        start = int(np.searchsorted(first, first[-1]))
        if start:
            yield pa.Table.from_batches([*held, batch.slice(0, start)])
            held = []
        held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held)
