"""Vectorised word and k-gram hashing over Arrow string batches, used inside Spark tasks.

A batch of texts is handled as one byte buffer: word limits, word hashes and
rolling k-gram hashes are numpy passes over that buffer, so the cost per word is
a few tens of nanoseconds and memory is bounded by the batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Words are runs of bytes other than space and \t \n \v \f \r (what bytes.split() uses too).
SPACE_TABLE = np.zeros(256, dtype=bool)
SPACE_TABLE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: ASCII capitals to small letters; every other byte stays.
LOWER_TABLE = np.arange(256, dtype=np.uint8)
LOWER_TABLE[0x41:0x5B] += 0x20
#: Largest number of text bytes that one numpy pass handles (a longer text is a pass of its own).
BLOCK_BYTES = 400_000

_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _byte_values(seed: int) -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * _ODD + np.uint64(seed))


@dataclass
class Words:
    """The words of a run of texts: text i has words[first[i]:first[i + 1]]."""

    first: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray


_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64 (those of usual lengths are kept)."""
    kept = _POWERS.get(base)
    if kept is None or len(kept) < n:
        kept = np.full(max(n, BLOCK_BYTES + 1), base, dtype=np.uint64)
        kept[0] = 1
        kept = np.multiply.accumulate(kept)
        if n <= 8 * BLOCK_BYTES:
            _POWERS[base] = kept
    return kept[:n]


def words_of(buf: np.ndarray, bounds: np.ndarray, seed: int = 1, lower: bool = False) -> Words:
    """Words of the texts buf[bounds[i]:bounds[i + 1]], each with a 64-bit hash of its bytes."""
    n = len(buf)
    if lower:
        buf = LOWER_TABLE[buf]
    inside = ~SPACE_TABLE[buf]
    before = np.zeros(n, dtype=bool)
    before[1:] = inside[:-1]
    cuts = bounds[:-1][bounds[:-1] < n]
    before[cuts] = False
    start = np.flatnonzero(inside & ~before)
    after = np.zeros(n, dtype=bool)
    after[:-1] = inside[1:]
    after[bounds[1:][bounds[1:] > 0] - 1] = False
    end = np.flatnonzero(inside & ~after) + 1
    first = np.searchsorted(start, bounds)
    # sum of value(byte) * base ** (place in the word): prefix sums over the buffer, then the word's offset taken out
    base, inverse = 0xD1342543DE82EF95, pow(0xD1342543DE82EF95, -1, 1 << 64)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_byte_values(seed)[buf] * powers(base, n), out=sums[1:])
    h = (sums[end] - sums[start]) * powers(inverse, n + 1)[start]
    return Words(first, start, end, mix(h + (end - start).astype(np.uint64) * _ODD))


def grams(h: np.ndarray, k: int, seed: int = 7) -> np.ndarray:
    """Hash of each k consecutive entries of h (one per start; crossing a text's end is the caller's to drop)."""
    n = len(h)
    if n < k:
        return np.zeros(0, dtype=np.uint64)
    base = (int(mix(np.array([seed], dtype=np.uint64))[0]) & ~7) | 5
    inverse = pow(base, -1, 1 << 64)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(mix(h + np.uint64(seed)) * powers(base, n), out=sums[1:])
    return mix((sums[k:] - sums[:-k]) * powers(inverse, n - k + 1))


def leftmost_minimum(x: np.ndarray, w: int) -> np.ndarray:
    """For each window of w entries of x, the place of its smallest entry, the leftmost one of ties."""
    n = len(x) - w + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    value, place, span = x.copy(), np.arange(len(x)), 1
    while span < w:  # windows of doubled length; the last step overlaps
        step = min(span, w - span)
        a, b = value[:-step], value[step:]
        right = b < a
        value, place, span = np.where(right, b, a), np.where(right, place[step:], place[:-step]), span + step
    return place


def texts_as_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """One byte buffer, that of the column itself, and the texts' bounds in it; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.type not in (pa.string(), pa.large_string()):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    width = np.int32 if column.type == pa.string() else np.int64
    offsets = np.frombuffer(column.buffers()[1], dtype=width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    buf = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    return buf[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(bounds: np.ndarray, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most `most` bytes together (one text at least)."""
    at, n = 0, len(bounds) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + most, side="right")) - 1)
        yield at, min(to, n)
        at = to


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def give_back() -> None:
    """Memory that a task has freed, back to the system: its worker stays for later tasks, beside those of other stages."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim is not None:
        trim(0)
