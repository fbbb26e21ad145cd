"""Array-at-a-time tokenising of Arrow string columns.

A word is a run of bytes outside ``\\x20\\x09-\\x0D``.  All those separators are
ASCII, so cutting UTF-8 bytes is the same as cutting code points.  Everything
here works on whole slices of a column with numpy; there is no loop over words.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import cached_property, wraps

import numpy as np
import pyarrow as pa
import xxhash

SLICE_BYTES = 1 << 19
#: Words of more bytes are hashed one by one.
LONG = 64

_SEP = np.zeros(256, bool)
_SEP[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)  # masks of the first k bytes


def tidy(run: Callable) -> Callable:
    """A task's function that gives freed memory back when it ends: Python workers stay for later tasks, idle ones too."""

    @wraps(run)
    def tidied(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc's
                trim(0)

    return tidied


def mix(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser."""
    h = h ^ np.uint64(salt)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges that hold at most ``limit`` bytes of text, or a single row."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    off = _offsets(column)
    i, n = 0, len(column)
    while i < n:
        j = int(np.searchsorted(off, off[i] + limit, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def _offsets(column: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    return np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, and offsets into them; null is empty."""
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    off = _offsets(column)
    buf = column.buffers()[2]
    data = np.frombuffer(buf, np.uint8)[off[0] : off[-1]] if buf is not None else np.empty(0, np.uint8)
    return data, off - off[0]


def hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, key: int = 0) -> np.ndarray:
    """A 64-bit hash of each span of ``data``; eight bytes at a time are mixed in, see LONG for the longest spans."""
    size = end - start
    if not len(start):
        return np.empty(0, np.uint64)
    data = np.concatenate([data, np.zeros(8, np.uint8)])
    wide = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    h = mix((wide[start] & _FIRST[np.minimum(size, 8)]) ^ (size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), key)
    more, k = np.flatnonzero((size > 8) & (size <= LONG)), 8
    while len(more):
        h[more] = mix(h[more] ^ (wide[start[more] + k] & _FIRST[np.minimum(size[more] - k, 8)]), key ^ k)
        k += 8
        more = more[size[more] > k]
    for i in np.flatnonzero(size > LONG).tolist():
        h[i] = xxhash.xxh3_64_intdigest(data[start[i] : end[i]].tobytes(), key)
    return h


class Words:
    """Words of a slice: hash, start, end (bytes), document and line in it.

    ``key`` varies the hash, so that nobody can prepare words that collide; A-Z
    hash as a-z.
    """

    def __init__(self, column: pa.Array, key: int = 0):
        self.data, self.off = raw(column)
        data, off, n = self.data, self.off, len(self.data)
        self._key = key
        if n == 0:
            self.start = self.end = np.empty(0, np.int64)
            self.doc = np.empty(0, np.int64)
            return
        word = ~_SEP[data]
        edge = np.zeros(n + 1, bool)
        edge[off] = True
        begins = word & edge[:-1]
        begins[1:] |= word[1:] & ~word[:-1]
        begins[0] = word[0]
        ends = word & edge[1:]
        ends[:-1] |= word[:-1] & ~word[1:]
        ends[-1] = word[-1]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.doc = np.repeat(np.arange(len(off) - 1), np.diff(np.searchsorted(self.start, off)))

    @cached_property
    def hash(self) -> np.ndarray:
        return hashes(_LOWER[self.data], self.start, self.end, self._key)

    @cached_property
    def line(self) -> np.ndarray:
        breaks = np.flatnonzero(self.data == 10)
        return np.searchsorted(breaks, self.start) - np.searchsorted(breaks, self.off)[self.doc]


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
