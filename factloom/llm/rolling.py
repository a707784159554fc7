"""Numpy primitives shared by the substring operators.

Hashes are polynomials modulo 2**64 over random per-byte values, so the hash of
any stretch comes from two prefix sums.  Equality of strings is decided on 96
bits (two independent tables) wherever a hash stands for a string.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa

from .memory import dropped_when_done

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_CHUNK = 1 << 14  # values worked on at once, so that they stay in the processor's cache


@lru_cache(maxsize=4)
def byte_values(seed: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(1, 1 << 64, 256, dtype=U64)


_powers: dict[int, np.ndarray] = {}
dropped_when_done(_powers.clear)


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        full = np.full(max(n, 1 << 16), base, U64)
        full[0] = 1
        have = np.cumprod(full, dtype=U64)
        if n <= 1 << 22:  # powers for long stretches are not kept
            _powers[base] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    if len(h) <= _CHUNK:
        return _mix(h)
    out = np.empty_like(h)
    for a in range(0, len(h), _CHUNK):
        out[a : a + _CHUNK] = _mix(h[a : a + _CHUNK])
    return out


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> U64(32))
    h *= U64(0xD6E8FEB86659FD93)
    h ^= h >> U64(29)
    h *= U64(0xD6E8FEB86659FD93)
    h ^= h >> U64(32)
    return h


class Prefix:
    """Prefix sums of a symbol sequence; `span` hashes stretches of it."""

    def __init__(self, symbols: np.ndarray):
        n = len(symbols)
        self.sums = np.zeros(n + 1, U64)
        np.cumsum(symbols * _power(_BASE, n), dtype=U64, out=self.sums[1:])
        self.down = _power(_INVERSE, n + 1)

    def fixed(self, length: int) -> np.ndarray:
        """Hash of every stretch of this length, by start."""
        m = len(self.sums) - length
        return (self.sums[length:] - self.sums[:m]) * self.down[:m] if m > 0 else np.zeros(0, U64)

    def span(self, starts: np.ndarray, ends) -> np.ndarray:
        return (self.sums[ends] - self.sums[starts]) * self.down[starts]


def slide(values: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (np.minimum or np.maximum) over every full window, by its start."""
    n = len(values) - width + 1
    if n <= 0:
        return values[:0]
    out = np.empty(n, values.dtype)
    for a in range(0, n, _CHUNK):
        out[a : a + _CHUNK] = _slide(values[a : a + _CHUNK + width - 1], width, pick)
    return out


def _slide(values: np.ndarray, width: int, pick) -> np.ndarray:
    out, have = values, 1
    while 2 * have <= width:
        out = pick(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return pick(out[: len(out) - rest], out[rest:]) if rest else out


def column_bytes(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text or binary column and its row offsets; null is empty."""
    arr = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(arr, pa.ChunkedArray):
        arr = pa.concat_arrays(arr.chunks) if arr.num_chunks else pa.array([], pa.string())
    if arr.null_count:
        arr = arr.fill_null(b"" if pa.types.is_binary(arr.type) or pa.types.is_large_binary(arr.type) else "")
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    _, where, data = arr.buffers()
    if not len(arr) or where is None:
        return np.zeros(0, np.uint8), np.zeros(len(arr) + 1, np.int64)
    offsets = np.frombuffer(where, np.int64 if wide else np.int32)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches, column: str, most: int = 2 << 20):
    """The batches cut by rows to about this many bytes of text (a longer text stands alone), to bound memory."""
    for batch in batches:
        offsets = column_bytes(batch.column(column))[1]
        row = 0
        while row < batch.num_rows:
            end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, side="right")) - 1)
            yield batch.slice(row, end - row)
            row = end


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True."""
    edge = np.diff(np.concatenate(([0], mask.view(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def covered(starts: np.ndarray, length: int, n: int) -> np.ndarray:
    """Mask of the n places covered by stretches of this length."""
    edge = np.bincount(starts, minlength=n + 1) - np.bincount(starts + length, minlength=n + 1)
    return np.cumsum(edge[:-1]) > 0
