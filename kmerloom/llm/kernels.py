"""Vectorised text kernels over Arrow string arrays.

Everything works on UTF-8 bytes of whole rows. A row batch is cut into pieces of whole rows
(about ``PIECE`` bytes, more only if one row is longer), so memory is bounded by the batch Spark sends
plus one piece. Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from ..functions.arrow import sliding_min, utf8  # noqa: F401

PIECE = 1 << 20
U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
WORDY = ~SPACE
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Hashes of spans are polynomials modulo this prime. Modulo a power of two, long texts of two alternating parts (as in the Thue-Morse sequence) would collide whatever the base.
PRIME = (1 << 61) - 1
_rng = np.random.default_rng(20240601)
TABLE = _rng.permutation(1 << 20)[:256].astype(np.uint64) + U(1 << 28)
BASE = 0x1E3779B97F4A7C15 % PRIME
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
#: Elements of one step: its temporary arrays stay in the processor's cache.
STEP = 1 << 15


def pieces(column: pa.Array, limit: int = PIECE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of runs of whole rows, at most 65,535 of them; null is empty."""
    data, offsets = utf8(column)
    low, n = 0, len(offsets) - 1
    while low < n:
        high = max(low + 1, min(low + 65_535, int(np.searchsorted(offsets, offsets[low] + limit, "right")) - 1))
        yield low, high, data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
        low = high


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words [^\\x20\\x09-\\x0D]+, and each row's first word's number (one more at the end)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = WORDY[data]
    before = np.zeros(n + 1, bool)
    before[1:] = inside
    before[offsets] = False
    after = np.zeros(n + 1, bool)
    after[:-1] = inside
    after[offsets] = False
    starts = np.flatnonzero(inside & ~before[:-1])
    ends = np.flatnonzero(inside & ~after[1:]) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (two multiply-xorshift rounds)."""
    h = h ^ (h >> U(32))
    h *= U(0xD6E8FEB86659FD93)
    h ^= h >> U(32)
    h *= U(0xD6E8FEB86659FD93)
    h ^= h >> U(32)
    return h


def _folded(x: np.ndarray) -> np.ndarray:
    """The same residue, at most PRIME + 7."""
    return (x & U(PRIME)) + (x >> U(61))


def _residue(x: np.ndarray) -> np.ndarray:
    x = _folded(x)
    x -= U(PRIME) * (x >= U(PRIME))
    return x


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products modulo PRIME, up to PRIME + 7, of numbers up to that, by halves of 31 bits."""
    low, m31, m30 = U(31), U((1 << 31) - 1), U((1 << 30) - 1)
    a1, a0, b1, b0 = a >> low, a & m31, b >> low, b & m31
    middle = a1 * b0 + a0 * b1
    return _folded(((a1 * b1) << U(1)) + (middle >> U(30)) + ((middle & m30) << low) + a0 * b0)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, n at least."""
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        for i, base in enumerate((BASE, pow(BASE, -1, PRIME))):
            p = np.ones(1, np.uint64)
            while len(p) < size:
                p = np.concatenate((p, _residue(times(p, U(pow(base, len(p), PRIME))))))
            _powers[i] = p
    return _powers[0], _powers[1]


def prefix(values: np.ndarray, small: bool = False) -> np.ndarray:
    """Prefix sums of values times powers of the base, modulo PRIME: any span's hash is one difference and one product.

    small: values are below 2^29, so that a product takes two multiplications.
    """
    n = len(values)
    out = np.zeros(n + 1, np.uint64)
    power = powers(n + 1)[0]
    last = U(0)
    for low in range(0, n, STEP):
        high = min(n, low + STEP)
        v, p = values[low:high], power[low:high]
        if small:
            y = v * (p >> U(32))
            term = _folded((y >> U(29)) + ((y & U((1 << 29) - 1)) << U(32)) + v * (p & U((1 << 32) - 1)))
        else:
            term = times(_folded(v), p)
        term[0] += last
        total = np.cumsum(term)
        wraps = np.zeros(high - low, np.uint64)  # 2^64 is 8 modulo PRIME
        np.cumsum(total[1:] < total[:-1], out=wraps[1:])
        out[low + 1 : high + 1] = _residue(_folded(total) + (wraps << U(3)))
        last = out[high]
    return out


def byte_prefix(data: np.ndarray) -> np.ndarray:
    return prefix(TABLE[data], True)


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the spans [start, end), alike for equal contents wherever they stand."""
    back = powers(len(sums))[1]
    out = np.empty(len(starts), np.uint64)
    for low in range(0, len(starts), STEP):
        s, e = starts[low : low + STEP], ends[low : low + STEP]
        h = _residue(times(sums[e] + (U(PRIME) - sums[s]), back[s]))
        out[low : low + STEP] = mix(h + ((e - s).astype(np.uint64) << U(40)))
    return out


def gram_hash(sums: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all spans of k units; the last is at len - k."""
    n = max(0, len(sums) - k)
    back = powers(len(sums))[1]
    out = np.empty(n, np.uint64)
    for low in range(0, n, STEP):
        high = min(n, low + STEP)
        out[low:high] = mix(_residue(times(sums[low + k : high + k] + (U(PRIME) - sums[low:high]), back[low:high])))
    return out


def rows_of(first: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def row_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values[bounds[i]:bounds[i + 1]]."""
    total = np.zeros(len(values) + 1, np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
