"""CRC-32C (Castagnoli) of many byte strings at once in numpy, and its masked form.

The checksum is linear over GF(2) apart from its constant start value, so a block's checksum
is the exclusive or of one table entry for each byte, and longer strings combine block
checksums with a table-driven shift.
"""

from __future__ import annotations

from functools import cache

import numpy as np

from . import textops as T

POLYNOMIAL, BLOCK, MASK = 0x82F63B78, 256, 0xA282EAD8
FULL = np.uint32(0xFFFFFFFF)


@cache
def _byte_table() -> np.ndarray:
    x = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        x = np.where(x & 1, (x >> np.uint32(1)) ^ np.uint32(POLYNOMIAL), x >> np.uint32(1))
    return x


@cache
def _block_table() -> np.ndarray:
    """Entry [j, b]: what byte b at place j of a block adds to the block's checksum."""
    t = _byte_table()
    rows = [t]
    for _ in range(BLOCK - 1):
        rows.append(t[rows[-1] & 255] ^ (rows[-1] >> np.uint32(8)))
    return np.array(rows[::-1])


@cache
def _shift(power: int) -> np.ndarray:
    """(4, 256) tables that advance a state over 2**power zero bytes."""
    if not power:
        t = _byte_table()
        base = np.arange(256, dtype=np.uint32)[None] << (8 * np.arange(4, dtype=np.uint32))[:, None]
        return t[base & 255] ^ (base >> np.uint32(8))
    half = _shift(power - 1)
    return _apply(half, half)


def _apply(tables: np.ndarray, state: np.ndarray) -> np.ndarray:
    return tables[0][state & 255] ^ tables[1][(state >> np.uint32(8)) & 255] ^ tables[2][(state >> np.uint32(16)) & 255] ^ tables[3][state >> np.uint32(24)]


def crc32c(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Checksum of each of the strings ``raw[at[i]:at[i+1]]``."""
    size = np.diff(at)
    n = len(size)
    if not n:
        return np.zeros(0, np.uint32)
    blocks = -(-size // BLOCK)
    ends = np.cumsum(blocks)
    # Zero bytes in front do not change the linear part: fill the first block from the right.
    padded = np.zeros(int(ends[-1]) * BLOCK, np.uint8)
    padded[T.ragged(ends * BLOCK - size, size)] = raw[at[0] : at[-1]]
    padded = padded.reshape(-1, BLOCK)
    part = np.zeros(len(padded), np.uint32)
    table, place = _block_table(), np.arange(BLOCK)
    for lo in range(0, len(padded), 2048):
        part[lo : lo + 2048] = np.bitwise_xor.reduce(table[place, padded[lo : lo + 2048]], axis=1)
    state, first = np.zeros(n, np.uint32), ends - blocks
    order = np.argsort(-blocks, kind="stable")
    tables, active = _shift(BLOCK.bit_length() - 1), n
    for k in range(int(blocks.max())):
        while active and blocks[order[active - 1]] <= k:
            active -= 1
        rows = order[:active]
        state[rows] = _apply(tables, state[rows]) ^ part[first[rows] + k]
    start = np.full(n, FULL)
    for k in range(int(size.max()).bit_length()):
        rows = np.flatnonzero((size >> k) & 1)
        start[rows] = _apply(_shift(k), start[rows])
    return state ^ start ^ FULL


def masked(crc: np.ndarray) -> np.ndarray:
    """Rotated by 15 bits plus a constant, so that data holding checksums stays checkable."""
    return ((crc >> np.uint32(15)) | (crc << np.uint32(17))) + np.uint32(MASK)
