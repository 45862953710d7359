"""Words of whole Arrow text columns as numpy arrays: spans, rows and 64-bit hashes.

One pass over the bytes of many texts at a time; no Python object is made per word. Rows of a
column are taken in slices of a bounded number of bytes (one text is never cut), so memory follows
the slice and the longest text, not the partition.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 512 << 10
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_UNBASE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def _separators(keep: bytes, lower: bool) -> np.ndarray:
    """256 byte classes: 0 separates words, other bytes stand for themselves (A-Z lower-cased)."""
    table = np.zeros(256, np.uint8)
    for b in keep:
        table[b] = b + 32 if lower and 65 <= b <= 90 else b
    return table


#: Lower-cased runs of ASCII letters, digits and everything beyond ASCII.
PLAIN = _separators(bytes([*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]), True)
#: Runs of anything but the space and the controls 9 to 13.
SPACED = _separators(bytes(b for b in range(1, 256) if b != 32 and not 9 <= b <= 13), False)
SPACED_NUL = SPACED.copy()
SPACED_NUL[0] = 1  # byte 0 is part of a word too; it shares a class with byte 1

_powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64, at least ``n`` of each.

    Those that a slice needs are kept; the many of a longer text are made for it alone.
    """
    global _powers
    if len(_powers[0]) >= n:
        return _powers
    n = max(n, min(3 * len(_powers[0]) // 2, SLICE_BYTES), 1 << 14)
    up, down = np.full(n, _BASE), np.full(n, _UNBASE)
    up[0] = down[0] = 1
    made = np.multiply.accumulate(up, out=up), np.multiply.accumulate(down, out=down)
    if n <= 2 * SLICE_BYTES:
        _powers = made
    return made


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finish that spreads the high bits over the low ones (murmur3's)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text or binary column and its row offsets; null rows are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null(b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offsets, data = col.buffers()
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offs - offs[0]


def slices(raw: np.ndarray, offs: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of consecutive rows, up to ``most`` bytes or one long text."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + most, "right")) - 1)
        yield i, raw[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


@dataclass
class Words:
    """Word spans of a slice: byte ``start``/``end``, owning ``row``, and ``first`` word of each row."""

    bytes: np.ndarray
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    first: np.ndarray
    count: np.ndarray

    def hashes(self) -> np.ndarray:
        return span_hashes(self.bytes, self.start, self.end)


def words(raw: np.ndarray, offs: np.ndarray, table: np.ndarray) -> Words:
    """The words of each row under a byte-class ``table``."""
    m = table[raw]
    n, rows = len(m), len(offs) - 1
    inside = m != 0
    edge = np.zeros(n + 1, bool)
    edge[offs] = True  # a row begins here
    start = inside.copy()
    start[1:] &= ~inside[:-1] | edge[1:n]
    stop = inside.copy()
    stop[:-1] &= ~inside[1:] | edge[1:n]
    starts, ends = np.flatnonzero(start), np.flatnonzero(stop) + 1
    first = np.searchsorted(starts, offs)
    count = np.diff(first)
    return Words(m, starts, ends, np.repeat(np.arange(rows), count), first[:-1], count)


def span_hashes(m: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit polynomial hash of each byte span, independent of where it stands."""
    up, down = powers(len(m) + 1)
    total = np.zeros(len(m) + 1, np.uint64)
    np.cumsum((m.astype(np.uint64) + np.uint64(1)) * up[: len(m)], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


def span_array(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.LargeBinaryArray:
    """The bytes of each span."""
    size = end - start
    offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    at = np.arange(offsets[-1]) + np.repeat(start - offsets[:-1], size)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(raw[at].tobytes())])


def shingles(hashes: np.ndarray, row: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every ``size`` consecutive words of a row, and the index of each first word."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(row[:n] == row[size - 1 :])
    h = np.zeros(n, np.uint64)
    for k in range(size):
        h = h * _BASE + hashes[k : k + n]
    return mix(h[at]), at


def hash_text(text: str | bytes, table: np.ndarray) -> np.ndarray:
    """Word hashes of one text, as the column functions give them."""
    raw = np.frombuffer(text.encode() if isinstance(text, str) else text, np.uint8)
    return words(raw, np.array([0, len(raw)]), table).hashes()
