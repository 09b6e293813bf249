"""Delta and variable-byte coding of posting lists, as Column expressions over arrays.

A value is cut into groups of seven bits, the lowest first; the last byte of a value has its high bit set. Lists are coded
by Arrow functions over whole batches, so the cost is linear in the number of values.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def delta(ids: Column) -> Column:
    """Differences of neighbours of an ascending array; the first is kept."""
    # the array is moved as a whole: inside the lambda, the expression of ``ids`` would be evaluated for every element
    return F.zip_with(ids, F.slice(F.concat(F.array(F.lit(0)), ids), 1, F.size(ids)), lambda x, before: x - before)


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of all lists, and where each begins (one more entry than lists). Null lists count as empty."""
    sizes = np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.float64)).astype(np.int64)
    return lists.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(sizes)])


def _lists(values: pa.Array, starts: np.ndarray, like: pa.Array) -> pa.Array:
    out = pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), values)
    return pa.array(out.to_pylist(), out.type, mask=like.is_null().to_numpy(zero_copy_only=False)) if like.null_count else out


def running_sums(lists: pa.Array) -> pa.Array:
    values, starts = _flat(lists)
    sums = np.concatenate([[0], np.cumsum(values.astype(np.int64))])
    return _lists(pa.array(sums[1:] - np.repeat(sums[starts[:-1]], np.diff(starts))), starts, lists)


def to_vbytes(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all values, and the number of bytes of each. Values must not be negative."""
    values = values.astype(np.int64)
    if len(values) and values.min() < 0:
        raise ValueError("a negative value has no variable-byte code")
    sizes = np.ones(len(values), np.int64)
    for i in range(1, 9):
        sizes += values >= 1 << 7 * i
    ends = np.cumsum(sizes)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    for i in range(int(sizes.max()) if len(sizes) else 0):
        at = sizes > i
        out[ends[at] - sizes[at] + i] = values[at] >> 7 * i & 127
    out[ends - 1] |= 128
    return out, sizes


def from_vbytes(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of byte strings that begin at ``starts`` (one more entry than strings), and where each string's values
    begin. Bytes behind the last end mark of a string are ignored; a value of more than nine bytes raises."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(len(starts), np.int64)
    last = data >= 128
    first = np.concatenate([[True], last[:-1]])
    first[starts[:-1][starts[:-1] < len(data)]] = True
    at = np.flatnonzero(first)
    place = np.arange(len(data)) - np.repeat(at, np.diff(np.append(at, len(data))))
    if place.max() > 8:
        raise ValueError("a variable-byte code is longer than nine bytes")
    values = np.add.reduceat((data & 127).astype(np.int64) << 7 * place, at)
    whole = last[np.append(at[1:], len(data)) - 1]
    return values[whole], np.searchsorted(at[whole], starts)


def _encoded(lists: pa.Array) -> pa.Array:
    values, starts = _flat(lists)
    data, sizes = to_vbytes(values)
    ends = np.concatenate([[0], np.cumsum(sizes)])[starts]
    raw = data.tobytes()
    return pa.array([raw[a:b] if ok else None for a, b, ok in zip(ends[:-1].tolist(), ends[1:].tolist(), lists.is_valid().to_pylist())], pa.binary())


def _decoded(data: pa.Array) -> pa.Array:
    parts = [x or b"" for x in data.to_pylist()]
    starts = np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int64)
    values, at = from_vbytes(np.frombuffer(b"".join(parts), np.uint8), starts)
    return _lists(pa.array(values), at, data)


def undelta(deltas: Column) -> Column:
    """Running sums: the inverse of ``delta``. Null gives null."""
    return _udf(running_sums, "array<bigint>")(deltas.cast("array<bigint>"))


def vbyte_size(v: Column) -> Column:
    """Bytes of one value of up to 63 bits; a negative value raises when it is computed."""
    bits = F.when(v >= 0, F.length(F.bin(v))).otherwise(F.raise_error(F.lit("a negative value has no variable-byte code")))
    return F.when(v.isNotNull(), F.ceil(bits / 7).cast("int"))


def vbyte_encode(values: Column) -> Column:
    """The bytes of all values in order. Null gives null; a negative value raises."""
    return _udf(_encoded, "binary")(values.cast("array<bigint>"))


def vbyte_decode(data: Column) -> Column:
    """The values of a byte string; bytes after the last end mark are ignored. Null gives null."""
    return _udf(_decoded, "array<bigint>")(data)


def _udf(f, kind: str):
    # annotated here: Spark reads the hints of the function it is given
    def over(column: pa.Array) -> pa.Array:
        return f(column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column)

    over.__annotations__ = {"column": pa.Array, "return": pa.Array}
    return F.arrow_udf(over, kind)
