"""Words of whole Arrow columns of text, found bytewise with numpy.

A word is a run of bytes of one class, so classes are tables over the 256 bytes. Classes that hold
all bytes from 0x80 on are classes of code points too, as UTF-8 uses those bytes for nothing else.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes with A-Z as a-z.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


@dataclass(frozen=True)
class Words:
    row: np.ndarray  # of each word, the row of its text
    start: np.ndarray  # its first byte
    code: np.ndarray  # its place in ``vocabulary``
    vocabulary: pa.StringArray


def text_slices(column: pa.Array, limit: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, bounds) of runs of rows that hold about ``limit`` bytes; null texts are empty.

    One text is never cut, so a longer one makes a run of its own.
    """
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + limit, side="right")) - 1)
        yield first, data[bounds[first] : bounds[last]], bounds[first : last + 1] - bounds[first]
        first = last


def words_of(data: np.ndarray, bounds: np.ndarray, is_word: np.ndarray) -> Words:
    """Every maximal run of word bytes within a text, as lower case."""
    inside = is_word[data]
    begins = np.zeros(len(data) + 1, bool)
    begins[bounds] = True  # a text begins here, or all end
    start = np.flatnonzero(inside & (begins[:-1] | ~np.concatenate(([False], inside[:-1])))) if len(data) else np.empty(0, np.int64)
    end = np.flatnonzero(inside & (begins[1:] | ~np.concatenate((inside[1:], [False])))) + 1 if len(data) else np.empty(0, np.int64)
    offsets = np.zeros(len(start) + 1, np.int64)
    np.cumsum(end - start, out=offsets[1:])
    flat = pa.Array.from_buffers(pa.large_string(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(LOWER[data[inside]]))])
    coded = flat.dictionary_encode()
    row = np.searchsorted(bounds, start, side="right") - 1
    return Words(row, start, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.cast(pa.string()))
