"""Arrow batches in small steps, so that a Python worker's memory does not grow with its task's input."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  as pa.compute

#: Contents made into Python objects at a time have about so many bytes, or are one content.
AT_ONCE = 1 << 20


def slices(batches: Iterator[pa.RecordBatch], *columns: int, most: int = AT_ONCE) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in slices with at most ``most`` bytes in the binary ``columns``; a larger row is a slice of its own."""
    for batch in batches:
        lengths = sum(pa.compute.fill_null(pa.compute.binary_length(batch.column(c)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns)
        start, held = 0, 0
        for i, n in enumerate(lengths.tolist()):
            if held and held + n > most:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if start < batch.num_rows:
            yield batch.slice(start)


def record_batch(rows: list[tuple], kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    """Rows as a record batch with columns of the given names and types."""
    columns = zip(*rows, strict=True) if rows else [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds.values(), strict=True)], names=list(kinds))
