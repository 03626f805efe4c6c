"""Arrow batches in tasks, a few rows at a time.

A batch stays in Arrow's buffers; only the rows at hand are Python objects, so a task's memory follows neither how many rows a
batch has nor how much Python adds to each. An empty batch gives no rows; nulls are None.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa

#: Rows that are Python objects at a time.
AT_ONCE = 128


def slices(batches: Iterable[pa.RecordBatch], n: int = AT_ONCE) -> Iterator[list[list]]:
    """The columns of ``n`` rows after the other, as lists."""
    for batch in batches:
        for at in range(0, batch.num_rows, n):
            yield [c.to_pylist() for c in batch.slice(at, n).columns]
