"""Vectorised code-point windows: rolling hashes, sliding minima, runs of equal minima.

Everything works on one flat ``uint32`` array of code points; callers hand in slices of at most
``SLICE`` code points, so memory does not follow the length of a text or of an Arrow batch.
Hashes are 64-bit (arithmetic modulo 2**64, code points mixed first, results mixed last).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 1 << 18
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    h = h ^ (h >> np.uint64(30))
    h *= _M1
    h ^= h >> np.uint64(27)
    h *= _M2
    h ^= h >> np.uint64(31)
    return h


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    base = np.full(n, BASE, dtype=np.uint64)
    inverse = np.full(n, np.uint64(pow(int(BASE), -1, 1 << 64)), dtype=np.uint64)
    base[0] = inverse[0] = 1
    return np.multiply.accumulate(base), np.multiply.accumulate(inverse)


_UP, _DOWN = _powers(SLICE + 4096)


def code_points(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Flat code points of a string column and the offsets of its rows (nulls are empty)."""
    column = pc.fill_null(column, "")
    if pa.types.is_large_string(column.type):
        column = column.cast(pa.string())
    sizes = pc.utf8_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    offsets = np.zeros(len(column) + 1, dtype=np.int64)
    np.cumsum(sizes, out=offsets[1:])
    ends = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int32)
    data = column.buffers()[2]
    raw = memoryview(data)[int(ends[0]) : int(ends[-1])] if data is not None else b""
    return np.frombuffer(bytes(raw).decode("utf-8").encode("utf-32-le"), dtype=np.uint32), offsets


def row_blocks(column: pa.Array, most: int = 1 << 20):
    """(first row, slice) of slices of whole rows of about ``most`` bytes of text each, so that what is computed
    for a slice does not follow the size of the Arrow batch."""
    if not len(column):
        return
    ends = np.frombuffer(column.buffers()[1], dtype=np.int64 if pa.types.is_large_string(column.type) else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    row = 0
    while row < len(column):
        stop = max(row + 1, int(np.searchsorted(ends, ends[row] + most, side="right")) - 1)
        yield row, column.slice(row, stop - row)
        row = stop


class Prefix:
    """Prefix hashes of one slice; any sub-range hashes in constant time."""

    def __init__(self, codes: np.ndarray):
        if len(codes) >= len(_UP):
            raise ValueError("slice too long")
        mixed = mix(codes.astype(np.uint64) + np.uint64(0x1234567))
        mixed *= _UP[: len(codes)]
        self.sums = np.zeros(len(codes) + 1, dtype=np.uint64)
        np.cumsum(mixed, out=self.sums[1:])

    def windows(self, k: int) -> np.ndarray:
        """The hash of each window of k code points."""
        raw = self.sums[k:] - self.sums[:-k]
        raw *= _DOWN[: len(raw)]
        return mix(raw)

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The hash of each range [start, end)."""
        raw = (self.sums[end] - self.sums[start]) * _DOWN[start]
        return mix(raw ^ (end - start).astype(np.uint64) * _M2)


def sliding_min(values: np.ndarray, w: int) -> np.ndarray:
    """The minimum of each w neighbouring values, in linear time (prefix and suffix minima of blocks)."""
    n = len(values)
    if w <= 1:
        return values
    if n < w:
        return values[:0]
    blocks = -(-n // w)
    padded = np.full(blocks * w, np.iinfo(values.dtype).max, dtype=values.dtype)
    padded[:n] = values
    padded = padded.reshape(blocks, w)
    forward = np.minimum.accumulate(padded, axis=1).ravel()
    backward = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(backward[: n - w + 1], forward[w - 1 : n])


def runs(values: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each run of equal values that crosses none of the marked places."""
    if not len(values):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    change = values[1:] != values[:-1]
    change |= breaks[1:]
    start = np.concatenate([[0], np.flatnonzero(change) + 1])
    return start, np.concatenate([start[1:], [len(values)]])


def slices(offsets: np.ndarray, reach: int, limit: int = SLICE):
    """(first row, last row + 1, begin, end) of slices of whole rows; a row longer than the limit comes in
    overlapping pieces, so that each window of ``reach`` code points lies whole in exactly one slice."""
    row, rows = 0, len(offsets) - 1
    while row < rows:
        size = int(offsets[row + 1] - offsets[row])
        if size > limit:
            at, stop = int(offsets[row]), int(offsets[row + 1])
            while True:
                end = min(at + limit, stop)
                yield row, row + 1, at, end
                if end == stop:
                    break
                at = end - reach + 1
            row += 1
            continue
        last = int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1
        last = max(row + 1, min(last, rows))
        yield row, last, int(offsets[row]), int(offsets[last])
        row = last
