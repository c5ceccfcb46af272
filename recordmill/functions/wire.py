"""Values inside wire-format bytes: numbered fields of varints, fixed widths and length-delimited parts, which may be messages again."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .batches import by_slices, slices


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 0x7F) << shift
        if byte < 0x80:
            return value & 0xFFFFFFFFFFFFFFFF, at
        shift += 7
        if shift > 63:
            raise ValueError("varint of more than ten bytes")


def fields_of(data: bytes) -> list[tuple[int, int, int | bytes]]:
    """(number, wire type, value) of the fields of a message in order; ValueError or IndexError if it is none."""
    out, at = [], 0
    while at < len(data):
        tag, at = _varint(data, at)
        kind, value = tag & 7, None
        if kind == 0:
            value, at = _varint(data, at)
        else:
            size = {1: 8, 5: 4}.get(kind)
            if kind == 2:
                size, at = _varint(data, at)
            if size is None or at + size > len(data) or tag >> 3 == 0:
                raise ValueError(f"wire type {kind}")
            value, at = data[at : at + size], at + size
        out.append((tag >> 3, kind, value))
    return out


def value_at(data: bytes | None, path: tuple[int, ...]) -> int | bytes | None:
    """The first value under a path of field numbers, null where it leads nowhere or the bytes are no message."""
    value: int | bytes | None = data
    for number in path:
        if not isinstance(value, bytes):
            return None
        try:
            value = next((v for n, _, v in fields_of(value) if n == number), None)
        except (ValueError, IndexError):
            return None
    return value


def wire_number(data: Column, *path: int) -> Column:
    """A varint, or little-endian fixed field, as a whole number (64-bit ones as signed)."""

    @F.arrow_udf("bigint")
    def found(column: pa.Array) -> pa.Array:
        def number(x: bytes | None) -> int | None:
            v = value_at(x, path)
            v = int.from_bytes(v, "little") if isinstance(v, bytes) and len(v) in (4, 8) else v
            return None if not isinstance(v, int) else v - (1 << 64) if v >= 1 << 63 else v

        return by_slices(column, pa.int64(), lambda xs: [number(x) for x in xs])

    return found(data)


def wire_text(data: Column, *path: int) -> Column:
    """A length-delimited field as text, null if it is no UTF-8."""

    @F.arrow_udf("binary")
    def found(column: pa.Array) -> pa.Array:
        return by_slices(column, pa.binary(), lambda xs: [v if isinstance(v := value_at(x, path), bytes) else None for x in xs])

    return F.try_validate_utf8(found(data).cast("string"))


def _written(n: int) -> bytes:
    n &= 0xFFFFFFFFFFFFFFFF
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def wire_message(*fields: tuple[int, Column]) -> Column:
    """The bytes of a message: whole numbers as varints, texts and bytes length-delimited; nulls are left out."""
    numbers = [n for n, _ in fields]

    @F.arrow_udf("binary")
    def made(*columns: pa.Array) -> pa.Array:
        made_of = pa.chunked_array([pa.array([message(values) for values in zip(*[c.to_pylist() for c in part.columns], strict=True)], type=pa.binary()) for part in slices(pa.RecordBatch.from_arrays(list(columns), [str(i) for i in range(len(columns))]))], type=pa.binary())
        return made_of.combine_chunks()

    def message(values: tuple) -> bytes:
        out = b""
        for number, v in zip(numbers, values, strict=True):
            if isinstance(v, int):
                out += _written(number << 3) + _written(v)
            elif v is not None:
                part = v.encode() if isinstance(v, str) else v
                out += _written(number << 3 | 2) + _written(len(part)) + part
        return out

    return made(*[c for _, c in fields])
