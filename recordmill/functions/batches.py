"""Arrow batches worked on in slices, so that what Python holds does not follow the size of a batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa

#: Arrow data of a slice, about; as Python objects it is up to twenty times as much.
SLICE_BYTES = 1 << 20


def slices(data: pa.RecordBatch | pa.Array, size: int | None = None) -> Iterator:
    """Rows in order, a slice of about SLICE_BYTES (one row at least) at a time."""
    size = data.nbytes if size is None else size
    step = max(1, len(data) * SLICE_BYTES // max(size, 1))
    for at in range(0, len(data), step):
        yield data.slice(at, step)


def by_slices(data: pa.Array, kind: pa.DataType, values_of: Callable[[list], list]) -> pa.Array:
    """The column that values_of makes of the values of a column."""
    return pa.chunked_array([pa.array(values_of(part.to_pylist()), type=kind) for part in slices(data)], type=kind).combine_chunks()
