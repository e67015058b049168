"""Vectorised text primitives on Arrow string buffers.

A text is handled as its UTF-8 bytes. A word is a maximal run of bytes other than the six
ASCII white-space bytes 0x20 and 0x09-0x0D; no such byte occurs inside a multi-byte
character, so words of bytes and words of characters agree. Nulls count as empty texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
#: Bytes of text handled at once; bounds the working arrays to some tens of MB.
SLICE = 1 << 20

WHITE = np.zeros(256, bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: every input bit reaches every output bit."""
    h = h.astype(U, copy=True)
    h ^= h >> U(30)
    h *= U(0xBF58476D1CE4E5B9)
    h ^= h >> U(27)
    h *= U(0x94D049BB133111EB)
    h ^= h >> U(31)
    return h


def seeded(n: int, seed: int) -> np.ndarray:
    """n 64-bit values of the splitmix64 sequence that starts at ``seed``."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=U) * U(0x9E3779B97F4A7C15) + U(seed))


BYTE = seeded(256, 0x5EED)
BYTE_WORDS = np.where(WHITE, U(0), BYTE)
BASE = U(0x9FB21C651E98DF25)
GRAM = U(0xD6E8FEB86659FD93)
_POWERS = np.ones(1, U)


def powers(n: int) -> np.ndarray:
    """BASE**0 .. BASE**(n-1) modulo 2**64."""
    global _POWERS
    while len(_POWERS) < n:
        _POWERS = np.concatenate([_POWERS, _POWERS * U(pow(int(BASE), len(_POWERS), 1 << 64))])
    return _POWERS


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; nulls become empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


@cache
def _allocator():
    import ctypes

    try:
        return ctypes.CDLL("libc.so.6").malloc_trim
    except (OSError, AttributeError):
        return lambda _: 0


def give_back() -> None:
    """Return freed memory to the system, for a worker process lives longer than its task."""
    pa.default_memory_pool().release_unused()
    _allocator()(0)


def slices(batch: pa.RecordBatch, text: str, limit: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows with about ``limit`` bytes of text (one long text may exceed it)."""
    _, at = buffers(batch.column(text))
    lo, n = 0, batch.num_rows
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, "right")) - 1)
        yield batch.slice(lo, hi - lo)
        lo = hi
    give_back()


class Words:
    """Words of a run of texts: 64-bit hashes, byte bounds and the row each belongs to."""

    def __init__(self, raw: np.ndarray, at: np.ndarray, lower: bool = False):
        self.at = at
        space = WHITE[raw]
        first = np.empty(len(raw), bool)
        if len(raw):
            first[0] = True
            first[1:] = space[:-1]
            first[at[:-1][at[:-1] < len(raw)]] = True
        first &= ~space
        self.start = np.flatnonzero(first)
        n = len(self.start)
        self.row = np.searchsorted(at, self.start, "right") - 1
        if not n:
            self.end, self.hash = self.start, np.zeros(0, U)
        else:
            gone = np.concatenate([[0], np.cumsum(space)])
            limit = np.append(self.start[1:], len(raw))
            self.end = limit - (gone[limit] - gone[self.start])
            table = BYTE_WORDS[LOWER] if lower else BYTE_WORDS
            within = np.arange(self.start[0], len(raw)) - np.repeat(self.start, limit - self.start)
            value = table[raw[self.start[0] :]] * powers(int(within.max()) + 1)[within]
            self.hash = mix(np.add.reduceat(value, self.start - self.start[0]) + (self.end - self.start).astype(U) * GRAM)
        #: First word of each row, and the count of all at the end.
        self.first = np.searchsorted(self.row, np.arange(len(at)))


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive values, by joining runs of doubled length."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    out, done, run, size = None, 0, h, 1
    while True:
        if k & size:
            if out is None:
                out, done = run, size
            else:  # what is there already stands first
                scale = U(pow(int(GRAM), done, 1 << 64))
                m = min(len(out), len(run) - done)
                out, done = out[:m] + scale * run[done : done + m], done + size
        if size * 2 > k:
            return mix(out[:n])
        run, size = run[:-size] + U(pow(int(GRAM), size, 1 << 64)) * run[size:], size * 2


def in_one_row(row: np.ndarray, k: int) -> np.ndarray:
    """Which runs of k consecutive words lie in one text."""
    return row[: len(row) - k + 1] == row[k - 1 :] if len(row) >= k else np.zeros(0, bool)


def shingle_sets(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct shingles of every text, ordered by both.

    A text with fewer than ``width`` words has its whole sequence as one shingle; without
    words it has none.
    """
    good = in_one_row(words.row, width)
    row, value = words.row[: len(good)][good], grams(words.hash, width)[good]
    count = np.diff(words.first)
    if len(short := np.flatnonzero((count > 0) & (count < width))):
        tail = np.zeros(len(short), U)
        for j in range(width - 1):
            has = count[short] > j
            tail[has] = mix(tail[has] * GRAM + words.hash[words.first[short[has]] + j] + U(1))
        row, value = np.concatenate([row, short]), np.concatenate([value, tail])
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    if len(row):
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
        row, value = row[new], value[new]
    return row, value


def columns(schema: pa.Schema, **arrays) -> pa.RecordBatch:
    """A batch with the named columns, cast to the schema."""
    return pa.RecordBatch.from_arrays([a if isinstance(a, pa.Array) and a.type == f.type else pa.array(a, f.type) for f in schema for a in [arrays[f.name]]], schema=schema)


def lists(values: np.ndarray, at: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """A list column from flat values and offsets."""
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values, kind))


def binaries(raw: np.ndarray, at: np.ndarray) -> pa.Array:
    """A binary column from flat bytes and offsets in bytes."""
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(np.ascontiguousarray(at, np.int32)), pa.py_buffer(np.ascontiguousarray(raw))])


def ragged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Positions of many runs (start, size), one after another."""
    end = np.cumsum(size)
    return np.repeat(start - (end - size), size) + np.arange(int(end[-1]) if len(end) else 0)
