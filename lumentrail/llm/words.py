"""Vectorised splitting and hashing of words straight from Arrow string buffers.

A word is a maximal run of bytes other than space, tab, line feed, vertical tab, form feed and
carriage return. Working on UTF-8 bytes is exact: none of these occurs inside a longer sequence.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Texts are worked on in groups of about so many bytes (a longer text makes a group of its own). Winnowing holds
#: some 35 bytes for each of them, in every worker at once.
BLOCK_BYTES = 1 << 18

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_MIX1, _MIX2 = U(0xFF51AFD7ED558CCD), U(0xC4CEB9FE1A85EC53)


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than rows) of a string column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.fill_null(col.cast(pa.large_string()), "")
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def blocks(data: np.ndarray, off: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Consecutive groups of rows: first row, row after the last, their bytes and offsets."""
    i, n = 0, len(off) - 1
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(off, off[i] + limit, side="right")) - 1))
        yield i, j, data[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and per row the number of its first word (one more than rows)."""
    solid = ~SPACE[data]
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    cut = np.zeros(len(data) + 1, dtype=bool)
    cut[off] = True
    before = np.empty_like(solid)
    before[0], before[1:] = False, solid[:-1]
    starts = np.flatnonzero(solid & (~before | cut[:-1]))
    after = np.empty_like(solid)
    after[-1], after[:-1] = False, solid[1:]
    ends = np.flatnonzero(solid & (~after | cut[1:])) + 1
    return starts, ends, np.searchsorted(starts, off)


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n + 1, U(base), dtype=U)
    out[0] = 1
    return np.multiply.accumulate(out)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(33))) * _MIX1
    h = (h ^ (h >> U(29))) * _MIX2
    return h ^ (h >> U(32))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes: a polynomial over the bytes modulo 2**64, then mixed."""
    if not len(starts):
        return np.zeros(0, U)
    inverse = pow(_BASE, -1, 1 << 64)
    up, down = _powers(len(data), _BASE), _powers(int(starts[-1]), inverse)
    total = np.zeros(len(data) + 1, U)
    np.cumsum((data.astype(U) + U(1)) * up[:-1], out=total[1:])
    return _mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(U))


def gram_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each run of ``k`` words (``len(hashes) - k + 1`` of them, or none)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    inverse = pow(_BASE, -1, 1 << 64)
    total = np.zeros(len(hashes) + 1, U)
    np.cumsum(hashes * _powers(len(hashes), _BASE)[:-1], out=total[1:])
    return _mix((total[k:] - total[:-k]) * _powers(n - 1, inverse))


_P1, _P2, _P3, _P4, _P5 = map(U, (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))


def _rot(x: np.ndarray, r: int) -> np.ndarray:
    return (x << U(r)) | (x >> U(64 - r))


def _round(acc, lane):
    return _rot(acc + lane * _P2, 31) * _P1


def xxh64(data: np.ndarray, start: np.ndarray, length: np.ndarray, seed: int) -> np.ndarray:
    """XXH64 of many slices of ``data`` at once."""
    buf = np.concatenate([data, np.zeros(8, np.uint8)])
    by8 = np.ndarray((len(buf) - 7,), "<u8", buf, strides=(1,))
    by4 = np.ndarray((len(buf) - 3,), "<u4", buf, strides=(1,))
    n = len(start)
    with np.errstate(over="ignore"):
        acc = np.full(n, U(seed) + _P5, U)
        pos, left = start.astype(np.int64), length.astype(np.int64)
        if len(long := np.flatnonzero(left >= 32)):
            v = [np.full(len(long), x, U) for x in (U(seed) + _P1 + _P2, U(seed) + _P2, U(seed), U(seed) - _P1)]
            at, rest, live = pos[long], left[long], np.arange(len(long))
            while len(live):
                for j in range(4):
                    v[j][live] = _round(v[j][live], by8[at[live] + 8 * j])
                at[live] += 32
                rest[live] -= 32
                live = live[rest[live] >= 32]
            h = _rot(v[0], 1) + _rot(v[1], 7) + _rot(v[2], 12) + _rot(v[3], 18)
            for x in v:
                h = (h ^ _round(U(0), x)) * _P1 + _P4
            acc[long], pos[long], left[long] = h, at, rest
        acc += length.astype(U)
        for _ in range(3):
            if not len(i := np.flatnonzero(left >= 8)):
                break
            acc[i] = _rot(acc[i] ^ _round(U(0), by8[pos[i]]), 27) * _P1 + _P4
            pos[i] += 8
            left[i] -= 8
        if len(i := np.flatnonzero(left >= 4)):
            acc[i] = _rot(acc[i] ^ (by4[pos[i]].astype(U) * _P1), 23) * _P2 + _P3
            pos[i] += 4
            left[i] -= 4
        for _ in range(3):
            if not len(i := np.flatnonzero(left > 0)):
                break
            acc[i] = _rot(acc[i] ^ (buf[pos[i]].astype(U) * _P5), 11) * _P1
            pos[i] += 1
            left[i] -= 1
        acc = (acc ^ (acc >> U(33))) * _P2
        acc = (acc ^ (acc >> U(29))) * _P3
        return acc ^ (acc >> U(32))


def normalized(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A-Z lower-cased and words joined by one space: bytes, word starts and ends in them, first word per row."""
    starts, ends, first = spans(data, off)
    row_end = np.repeat(off[1:], np.diff(first))
    gap = ends[ends < row_end]
    keep = ~SPACE[data]
    keep[gap] = True
    low = LOWER[data]
    low[gap] = 32
    at = np.cumsum(keep)[starts] - 1 if len(starts) else starts
    return low[keep], at, at + (ends - starts), first
