"""Arrow string columns as numpy bytes, and numpy kernels for DNA."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 1 << 20
CODE = np.full(256, 4, np.uint8)
CODE[list(b"ACGTacgt")] = (0, 1, 2, 3) * 2  # soft-masked bases count as bases


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string or binary column; null is empty."""
    if pa.types.is_string(column.type):
        column = column.cast(pa.large_string())
    elif pa.types.is_binary(column.type):
        column = column.cast(pa.large_binary())
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_large_string(column.type) else b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def pieces(column: pa.Array, limit: int = PIECE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of runs of whole rows of about limit bytes (more if one row has more)."""
    data, offsets = utf8(column)
    low, n = 0, len(offsets) - 1
    while low < n:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + limit, "right")) - 1)
        yield low, high, data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
        low = high


def packed_windows(code: np.ndarray, k: int) -> np.ndarray:
    """2-bit packed value of each window of k bases (k up to 31), by doubling."""
    if len(code) < k:
        return np.zeros(0, np.int64)
    value, have = (code & 3).astype(np.int64), 1
    out, got = None, 0
    rest = k
    while rest:
        if rest & 1:
            out, got = (value, have) if out is None else ((out[: len(value) - got] << (2 * have)) | value[got:], got + have)
        rest >>= 1
        if rest:
            value = (value[:-have] << (2 * have)) | value[have:]
            have *= 2
    return out[: len(code) - k + 1]


def valid_starts(code: np.ndarray, offsets: np.ndarray, k: int) -> np.ndarray:
    """Starts of windows of k bases that stay in their row and hold A, C, G and T only."""
    n = len(code)
    if n < k:
        return np.zeros(0, np.int64)
    bad = np.zeros(n + 1, np.int32)
    np.cumsum(code > 3, out=bad[1:])
    room = np.repeat(offsets[1:], np.diff(offsets))[: n - k + 1]
    at = np.arange(n - k + 1)
    return np.flatnonzero((bad[k:] == bad[: n - k + 1]) & (at + k <= room))


def packed_valid(code: np.ndarray, offsets: np.ndarray, k: int, canonical: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Valid starts and the packed (or canonical) windows there."""
    at = valid_starts(code, offsets, k)
    packed = packed_windows(code, k)[at]
    if canonical and len(at):
        packed = np.minimum(packed, packed_windows((3 - (code & 3))[::-1], k)[len(code) - k - at])
    return at, packed


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    have, out = 1, values
    while 2 * have <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    return np.minimum(out[: len(values) - width + 1], out[width - have :]) if have < width else out


def letters(packed: np.ndarray, k: int, alphabet: bytes = b"ACGT") -> pa.Array:
    """Strings of k letters from packed values."""
    shift = 2 * np.arange(k - 1, -1, -1, dtype=np.int64)
    data = np.frombuffer(alphabet, np.uint8)[(packed[:, None] >> shift) & 3]
    return pa.Array.from_buffers(pa.string(), len(packed), [None, pa.py_buffer(np.arange(0, k * len(packed) + 1, k, dtype=np.int32).tobytes()), pa.py_buffer(np.ascontiguousarray(data).tobytes())])
