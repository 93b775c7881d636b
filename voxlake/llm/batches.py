"""Helpers for functions that run over Arrow batches inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that a task works on at once.
CHUNK_BYTES = 1 << 20


def pieces(batches: Iterator[pa.RecordBatch], text: str, limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches with about `limit` bytes of text (one row at least), and the texts as UTF-8 (null: empty)."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text)).cast(pa.large_binary())
        ends = np.cumsum(pc.binary_length(column).fill_null(0).to_numpy())
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(ends, before + limit, "right")))
            yield batch.slice(start, end - start), [x or b"" for x in column.slice(start, end - start).to_pylist()]
            start = end


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the input moves every bit of the output."""
    x = x.astype("uint64", copy=True)
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    return x ^ (x >> np.uint64(33))


BYTE_VALUES = mix(np.arange(1, 257, dtype="uint64") * np.uint64(0x9E3779B97F4A7C15))
BASE = np.uint64(0x5851F42D4C957F2D)
_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def _power(n: int, name: str, factor: np.uint64) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 16), factor, dtype="uint64")
        steps[0] = 1
        have = np.multiply.accumulate(steps)
        if n <= 2 * CHUNK_BYTES:
            _powers[name] = have
    return have[:n]


class RollingHash:
    """64-bit hashes of any substrings of a byte string, from one prefix sum."""

    def __init__(self, data: bytes):
        raw = np.frombuffer(data, dtype="uint8")
        n = len(raw)
        self.sums = np.zeros(n + 1, dtype="uint64")
        np.cumsum(BYTE_VALUES[raw] * _power(n + 1, "up", BASE)[:n], out=self.sums[1:])
        self.down = _power(n + 1, "down", _INVERSE)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype("uint64") * BASE)

    def windows(self, length: int) -> np.ndarray:
        """The hash of every substring of one length, by its start."""
        n = len(self.sums) - 1 - length + 1
        if n <= 0:
            return np.zeros(0, dtype="uint64")
        return mix((self.sums[length:] - self.sums[:n]) * self.down[:n] + np.uint64(length * int(BASE) & 0xFFFFFFFFFFFFFFFF))
