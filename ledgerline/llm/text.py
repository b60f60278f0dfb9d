"""Vectorised words, hashes and windows over Arrow string columns.

A word is a run of bytes other than 0x20 and 0x09-0x0D, which in UTF-8 is the pattern
``[^\\x20\\x09-\\x0D]+``. Everything works on the column's bytes, so no Python object is made per word.
"""

from __future__ import annotations

import ctypes
import functools
import hashlib
import inspect
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BASE, _STEP = U64(0x9E3779B97F4A7C15), U64(0xD1342543DE82EF95)
_LONG_WORD = 1 << 16
_SEGMENT = 1 << 19


_LIBC = ctypes.CDLL(None) if sys.platform == "linux" else None


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base, and of its inverse modulo 2**64."""
    inverse = U64(pow(int(_BASE), -1, 1 << 64))
    up, down = np.full(n, _BASE), np.full(n, inverse)
    up[0] = down[0] = U64(1)
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


_UP, _DOWN = _powers(_SEGMENT + _LONG_WORD + 1)


def give_back() -> None:
    """Returns freed memory to the system: workers stay, and what they hold counts beside Spark's own."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None and hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


def thrifty(task):
    """A function over a task's batches, or over a group's table, that gives freed memory back once it is through."""
    if inspect.isgeneratorfunction(task):

        @functools.wraps(task)
        def batches(*args):
            try:
                yield from task(*args)
            finally:
                give_back()

        return batches

    def group(table: pa.Table) -> pa.Table:
        try:
            return task(table)
        finally:
            give_back()

    return group


def string_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = pc.fill_null(column.cast(pa.large_string()), "")
    raw = column.buffers()
    offsets = np.frombuffer(raw[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column) or raw[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(raw[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and the index of each row's first word (one entry more than rows)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    solid = ~_SPACE[data]
    edge = offsets[(offsets > 0) & (offsets < len(data))]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    first[edge] = solid[edge]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    last[edge - 1] = solid[edge - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word: a polynomial over its bytes, mixed with its length."""
    out = np.empty(len(starts), U64)
    long_words = np.flatnonzero(ends - starts > _LONG_WORD)
    at = 0
    while at < len(starts):
        low = starts[at]
        to = max(int(np.searchsorted(starts, low + _SEGMENT)), at + 1)
        high = min(int(ends[to - 1]), low + _SEGMENT + _LONG_WORD)
        total = np.zeros(high - low + 1, U64)
        np.cumsum((data[low:high].astype(U64) + U64(1)) * _UP[: high - low], out=total[1:])
        s, e = starts[at:to] - low, np.minimum(ends[at:to] - low, high - low)
        out[at:to] = mix((total[e] - total[s]) * _DOWN[s] + (e - s).astype(U64) * _STEP)
        at = to
    for i in long_words:
        out[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def window_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words, whatever rows they lie in."""
    count = len(words) - n + 1
    if count <= 0:
        return np.zeros(0, U64)
    total = np.zeros(count, U64)
    for j in range(n):
        total *= _STEP
        total += words[j : j + count]
    return mix(total)


def windows_of_rows(first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Word indices at which a run of n words starts and stays in its row, and the row of each."""
    counts = np.maximum(np.diff(first) - n + 1, 0)
    row = np.repeat(np.arange(len(counts)), counts)
    return np.repeat(first[:-1], counts) + ranges(counts), row


def ranges(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... counts[0]-1, 0, 1, ... counts[1]-1, and so on."""
    if not len(counts) or not counts.sum():
        return np.zeros(0, np.int64)
    ends = np.cumsum(counts)
    return np.arange(ends[-1]) - np.repeat(ends - counts, counts)


def pieces(batch: pa.RecordBatch, text: str, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about `most` bytes of text, never less than one row."""
    if not len(batch):
        return
    column = batch.column(batch.schema.get_field_index(text))
    size = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(size) // most
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1), len(batch)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        yield batch.slice(a, b - a)


_ZSTD = pa.Codec("zstd", 1)


def pack(values: np.ndarray) -> bytes:
    """The bytes of an array by place value, compressed; runs and repeats in the high places shrink to little."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.dtype.itemsize).T
    return len(values).to_bytes(8, "little") + _ZSTD.compress(planes.tobytes(), asbytes=True)


def unpack(raw: bytes, kind: type) -> np.ndarray:
    count, width = int.from_bytes(raw[:8], "little"), np.dtype(kind).itemsize
    planes = np.frombuffer(_ZSTD.decompress(raw[8:], decompressed_size=count * width, asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(width, -1).T).reshape(-1).view(kind)


def pack_sorted(values: np.ndarray) -> bytes:
    """pack() of the steps between sorted 64-bit values."""
    return pack(np.diff(values, prepend=np.uint64(0)))


def unpack_sorted(raw: bytes) -> np.ndarray:
    return np.cumsum(unpack(raw, np.uint64), dtype=np.uint64)
