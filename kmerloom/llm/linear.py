"""Hashed sparse features and small linear models (logistic, softmax, cumulative link) trained with numpy.

Training happens on the driver over a bounded sample of labelled rows; scoring is vectorised over Arrow batches.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from . import kernels as K

U32 = np.uint32


@dataclass(frozen=True)
class Spec:
    """Feature families: byte n-grams and word n-grams, each hashed to 2**bits buckets, by relative frequency."""

    chars: tuple[int, ...] = (3, 4)
    words: tuple[int, ...] = (1, 2)
    bits: int = 17
    scale: float = 30.0

    @property
    def families(self) -> int:
        return len(self.chars) + len(self.words)


def grams(data: np.ndarray, offsets: np.ndarray, spec: Spec):
    """For each family: bucket of each gram, and each row's range [low, high) of grams."""
    shift = U32(32 - spec.bits)
    n = len(data)
    for k in spec.chars:
        m = max(0, n - k + 1)
        code = np.zeros(m, U32)
        for j in range(k):
            code *= U32(0x01000193 if k > 4 else 256)
            code += data[j : j + m]
        code *= U32(2654435761)
        low = np.minimum(offsets[:-1], m)
        yield code >> shift, low, np.minimum(np.maximum(low, offsets[1:] - k + 1), m)
    if spec.words:
        starts, ends, first = K.words(data, offsets)
        sums = K.prefix(K.span_hash(K.byte_prefix(data), starts, ends))
        for k in spec.words:
            h = (K.gram_hash(sums, k) >> K.U(64 - spec.bits)).astype(U32)
            low = np.minimum(first[:-1], len(h))
            yield h, low, np.minimum(np.maximum(low, first[1:] - k + 1), len(h))


def raw_scores(data: np.ndarray, offsets: np.ndarray, spec: Spec, weights: np.ndarray) -> np.ndarray:
    """Dot product of each row's features with weights[family, bucket]."""
    out = np.zeros(len(offsets) - 1)
    for f, (bucket, low, high) in enumerate(grams(data, offsets, spec)):
        total = np.zeros(len(bucket) + 1)
        np.cumsum(weights[f][bucket], out=total[1:])
        out += (total[high] - total[low]) / np.maximum(1, high - low) * spec.scale
    return out


@dataclass
class Matrix:
    """Rows in compressed form over families * 2**bits columns."""

    bounds: np.ndarray
    column: np.ndarray
    value: np.ndarray
    row: np.ndarray = field(init=False)

    def __post_init__(self):
        self.row = np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))

    def dot(self, w: np.ndarray) -> np.ndarray:
        return K.row_sums(self.value * w[self.column], self.bounds)

    def back(self, r: np.ndarray, size: int) -> np.ndarray:
        return np.bincount(self.column, self.value * r[self.row], size)


def matrix(data: np.ndarray, offsets: np.ndarray, spec: Spec) -> Matrix:
    n, size = len(offsets) - 1, 1 << spec.bits
    keys, values = [], []
    for f, (bucket, low, high) in enumerate(grams(data, offsets, spec)):
        count = high - low
        row = np.repeat(np.arange(n), count)
        at = np.arange(count.sum()) + np.repeat(low - (np.cumsum(count) - count), count)
        key, times = np.unique(row * (spec.families * size) + f * size + bucket[at].astype(np.int64), return_counts=True)
        keys.append(key)
        values.append(times / np.maximum(1, count)[key // (spec.families * size)] * spec.scale)
    key, value = np.concatenate(keys), np.concatenate(values)
    order = np.argsort(key, kind="stable")
    key, value = key[order], value[order]
    width = spec.families * size
    return Matrix(np.searchsorted(key, np.arange(n + 1) * width), key % width, value)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit_logistic(x: Matrix, y: np.ndarray, size: int, steps: int = 80, rate: float = 0.05, l2: float = 1e-5) -> tuple[np.ndarray, float]:
    """Full-batch Adam with class weights that even out the two classes."""
    share = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    w, m, v, b, mb, vb = np.zeros(size), np.zeros(size), np.zeros(size), 0.0, 0.0, 0.0
    for t in range(1, steps + 1):
        r = (sigmoid(x.dot(w) + b) - y) * share
        g, gb = x.back(r, size) + l2 * w, r.sum()
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g, 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        c, d = 1 - 0.9**t, 1 - 0.999**t
        w -= rate * (m / c) / (np.sqrt(v / d) + 1e-8)
        b -= rate * (mb / c) / (np.sqrt(vb / d) + 1e-8)
    return w, b


def platt(score: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """(a, b) such that sigmoid(a * score + b) is calibrated, with Platt's smoothed targets."""
    up, down = (y == 1).sum(), (y == 0).sum()
    target = np.where(y == 1, (up + 1) / (up + 2), 1 / (down + 2))
    spread = score.std() or 1.0
    z, middle = (score - score.mean()) / spread, score.mean()
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = sigmoid(a * z + b)
        r, q = p - target, np.maximum(p * (1 - p), 1e-9)
        g = np.array([(r * z).sum() + 1e-3 * a, r.sum()])
        h = np.array([[(q * z * z).sum() + 1e-3, (q * z).sum()], [(q * z).sum(), q.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        a, b = a - np.clip(step[0], -2, 2), b - np.clip(step[1], -2, 2)
    return a / spread, b - a * middle / spread


def texts_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(x) for x in raw], dtype=np.int64)))


def near_copies(texts: list[str | None]) -> np.ndarray:
    """True for rows that share one of four minima of 5-word shingles with an earlier row: copies would fake evidence."""
    seen: set[tuple[int, int]] = set()
    out = np.zeros(len(texts), bool)
    for i, text in enumerate(texts):
        data, offsets = texts_of([text])
        starts, ends, _ = K.words(data, offsets)
        h = K.gram_hash(K.prefix(K.span_hash(K.byte_prefix(data), starts, ends)), 5)
        if len(h):
            marks = {(k, int((h * K.U(2 * k + 0x9E3779B97F4A7C15)).min())) for k in range(4)}
            out[i] = bool(marks & seen)
            seen |= marks
    return out
