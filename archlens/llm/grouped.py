"""Groups of sorted Arrow rows, whole, without one call per group."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """(rows, bounds): rows of whole groups of equal integer ``keys``; group k is bounds[k] to bounds[k + 1].

    Rows must come sorted by ``keys``. Only the last, perhaps unfinished, group
    of a batch is held back.
    """
    held: pa.Table | None = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        if not rows.num_rows:
            continue
        rows = rows if held is None else pa.concat_tables([held, rows])
        place = np.stack([rows[c].to_numpy() for c in keys], axis=1)
        starts = np.flatnonzero(np.any(place[1:] != place[:-1], axis=1)) + 1
        if len(starts):
            yield rows.slice(0, int(starts[-1])), np.concatenate([[0], starts])
            rows = rows.slice(int(starts[-1]))
        held = rows
    if held is not None:
        yield held, np.array([0, held.num_rows])
