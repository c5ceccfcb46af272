"""Arrays of a fixed width, filled by every task and merged in levels of shuffles."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, scratch
from .textkernel import give_back

#: Pieces in which an array travels, and arrays that one task merges at most.
PIECES, MERGED = 64, 64
TYPE = "piece int, part int, data binary"


def fixed_array(df: DataFrame, width: int, dtype: str, fill: Callable[[np.ndarray, pa.RecordBatch], None], merge: np.ufunc) -> np.ndarray:
    """The array of `width` entries that merge makes of all tasks' arrays; fill(array, batch) notes a batch.

    Its size does not depend on the data, so it may be sent to the driver and broadcast.
    Each level of merging leaves a MERGED-th of the arrays, however many tasks there are.
    """

    def note(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, any_rows = np.zeros(width, dtype=dtype), False
        for batch in batches:
            any_rows |= batch.num_rows > 0
            fill(own, batch)
            del batch  # before the next one is read
        if any_rows:
            press, part = zstandard.ZstdCompressor(level=1), TaskContext.get().partitionId() // MERGED
            data = [press.compress(x.tobytes()) for x in np.split(own, PIECES)]
            yield pa.RecordBatch.from_pydict({"piece": pa.array(range(PIECES), type=pa.int32()), "part": pa.array([part] * PIECES, type=pa.int32()), "data": pa.array(data, type=pa.binary())})
        del own
        give_back()

    def joined(rows: pd.DataFrame) -> pd.DataFrame:
        open_, total = zstandard.ZstdDecompressor(), None
        for x in rows["data"]:
            one = np.frombuffer(open_.decompress(x), dtype=dtype)
            total = one.copy() if total is None else merge(total, one)
        return pd.DataFrame({"piece": rows["piece"][:1], "part": rows["part"][:1] // MERGED, "data": [zstandard.ZstdCompressor(level=1).compress(total.tobytes())]})

    with scratch(df.sparkSession):
        parts = materialize(df.mapInArrow(note, TYPE), "sketch")
        left = parts.agg(F.max("part")).first()[0]
        while left is not None:
            parts = parts.groupBy("piece", "part").applyInPandas(joined, TYPE)
            left = left // MERGED if left else None
        out = np.zeros(width, dtype=dtype)
        size, open_ = width // PIECES, zstandard.ZstdDecompressor()
        for r in parts.select("piece", "data").collect():  # PIECES rows
            out[r["piece"] * size : (r["piece"] + 1) * size] = np.frombuffer(open_.decompress(bytes(r["data"])), dtype=dtype)
    return out
