"""Terms of a text as NumPy arrays over Arrow buffers.

A term is a longest run of ASCII letters, digits and underscores, in lower case,
of 2 to 40 characters and not starting with a digit.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

TERM_MIN, TERM_MAX = 2, 40

_IN_TERM = np.zeros(256, bool)
_LOWER = np.arange(256, dtype=np.uint8)
for _c in b"abcdefghijklmnopqrstuvwxyz0123456789_ABCDEFGHIJKLMNOPQRSTUVWXYZ":
    _IN_TERM[_c] = True
    if 65 <= _c <= 90:
        _LOWER[_c] = _c + 32
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True


def as_string(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """One contiguous string array, nulls as empty texts, offset 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("")
    if column.offset:
        column = pa.concat_arrays([column])
        if column.offset:
            column = pa.array(column.to_pylist(), pa.large_string())
    return column.cast(pa.large_string())


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts one after another, offset of each text and the end)."""
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[: len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def term_array(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(every term in order, index of the record of each term)."""
    raw, at = text_bytes(column)
    if not len(raw):
        return pa.array([], pa.large_string()), np.zeros(0, np.int64)
    inside = _IN_TERM[raw]
    begins = np.zeros(len(raw) + 1, bool)  # a record's first byte ends any run before it
    begins[at] = True
    before = np.empty(len(raw), bool)
    before[0] = False
    before[1:] = inside[:-1]
    first = np.flatnonzero(inside & (~before | begins[:-1]))
    after = np.empty(len(raw), bool)
    after[-1] = False
    after[:-1] = inside[1:]
    last = np.flatnonzero(inside & (~after | begins[1:]))
    size = last - first + 1
    good = (size >= TERM_MIN) & (size <= TERM_MAX) & ~_DIGIT[raw[first]]
    first, size = first[good], size[good]
    record = np.searchsorted(at, first, side="right") - 1
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    take = np.arange(total) + np.repeat(first - (ends - size), size)
    data = _LOWER[raw[take]]
    offsets = np.zeros(len(size) + 1, np.int64)
    offsets[1:] = ends
    return pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(offsets), pa.py_buffer(data)), record
