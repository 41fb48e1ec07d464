"""Toxicity: cumulative-link ordinal regression over sparse word features.

One weight vector is shared by all thresholds: P(grade > j) = sigmoid(x . w - t_j) with t_1 < t_2 < ...
The expected severity is the sum of these probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import kernels as K
from . import linear as L
from .common import clean_texts, map_arrow
from .quality import labelled

#: Labelled rows of each class that training reads at most; scoring covers every row.
SAMPLE = 2000
GRADES = 4
#: Documents whose expected severity is higher count as toxic.
THRESHOLD = 0.3
#: A word is a feature if it is in at least so many rows of the sample, and the likelihood-ratio statistic of its association with toxic rows is at least MIN_G.
MIN_ROWS, MIN_G = 3, 11.0

_LETTERS = K.LOWER.copy()
_LETTERS[[c for c in range(128) if not chr(c).isalnum()]] = 0x20


@dataclass
class Model:
    keys: np.ndarray  # sorted hashes of the feature words
    weights: np.ndarray
    cuts: np.ndarray

    def severity(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Expected severity and the most probable grade."""
        row, column, count = features(data, offsets, self.keys)
        x = np.bincount(row, np.log1p(count) * self.weights[column], len(offsets) - 1)
        over = L.sigmoid(x[:, None] - self.cuts)
        each = np.diff(-over, axis=1, prepend=-1, append=0)
        return over.sum(axis=1), each.argmax(axis=1)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words (punctuation parts them), and each row's first."""
    plain = _LETTERS[data]
    starts, ends, first = K.words(plain, offsets)
    return K.span_hash(K.byte_prefix(plain), starts, ends), first


def runs(texts: list[str | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of whole texts of about a piece's size, so that training holds no array over all the bytes."""
    low, held = 0, 0
    for i, text in enumerate(texts):
        held += len(text or "")
        if held >= K.PIECE or i + 1 == len(texts):
            yield low, *L.texts_of(texts[low : i + 1])
            low, held = i + 1, 0


def features_of(texts: list[str | None], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, count) of the feature words in each text."""
    parts = [(low + row, column, count) for low, data, offsets in runs(texts) for row, column, count in [features(data, offsets, keys)]]
    return tuple(np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.int64),) * 3


def features(data: np.ndarray, offsets: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, count) of the feature words in each row."""
    h, first = word_hashes(data, offsets)
    if not len(keys) or not len(h):
        return (np.zeros(0, np.int64),) * 3
    may = np.zeros(1 << 16, bool)
    may[keys >> K.U(48)] = True
    at = np.flatnonzero(may[h >> K.U(48)])
    column = np.minimum(np.searchsorted(keys, h[at]), len(keys) - 1)
    good = keys[column] == h[at]
    row = np.searchsorted(first, at[good], "right") - 1
    pair, count = np.unique(row * len(keys) + column[good], return_counts=True)
    return pair // len(keys), pair % len(keys), count


def lexicon(texts: list[str | None], y: np.ndarray) -> np.ndarray:
    """Hashes of words associated with toxic rows: at least twice as frequent in them as in clean rows, whatever the classes' shares of the sample."""
    parts = [(np.zeros(0, np.uint64), np.zeros(0, np.int64))]
    for low, data, offsets in runs(texts):
        h, first = word_hashes(data, offsets)
        row = K.rows_of(first)
        order = np.lexsort((row, h))
        h, row = h[order], row[order]
        fresh = np.ones(len(h), bool)
        fresh[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
        parts.append((h[fresh], low + row[fresh]))
    h, row = (np.concatenate(x) for x in zip(*parts))
    keys, where = np.unique(h, return_inverse=True)
    bad = np.bincount(where, y[row], len(keys))
    total = np.bincount(where, minlength=len(keys))
    n, n1 = len(y), max(1, y.sum())
    g = np.zeros(len(keys))
    for seen, expect in ((bad, total * n1 / n), (total - bad, total * (n - n1) / n), (n1 - bad, (n - total) * n1 / n), (n - n1 - total + bad, (n - total) * (n - n1) / n)):
        g += 2 * np.where(seen > 0, seen * np.log(np.maximum(seen, 1e-9) / np.maximum(expect, 1e-9)), 0)
    return keys[(total >= MIN_ROWS) & (g >= MIN_G) & (bad * max(1, n - n1) > 2 * (total - bad) * n1)] if n else keys


def grades(count: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ordered grades of labelled rows: 0 for clean rows, and 1 to GRADES - 1 for toxic ones, by thirds of their number of lexicon words."""
    hit = count[(y == 1) & (count > 0)]
    cuts = np.quantile(hit, np.arange(1, GRADES - 1) / (GRADES - 1)) if len(hit) else np.zeros(GRADES - 2)
    return np.where(y == 1, 1 + (count[:, None] > cuts).sum(axis=1), 0)


def fit(texts: list[str | None], y: np.ndarray, whole: tuple[int, int] | None = None) -> Model | None:
    """None with fewer than 8 rows of a class, or if no word is associated with toxic rows: a model without features would judge all texts alike.

    ``whole``: numbers of clean and toxic rows among all labels; rows weigh as their class does there, not in the sample.
    Near copies are left out of training: they would fake evidence.
    """
    fresh = ~L.near_copies(texts)
    texts, y = [t for t, f in zip(texts, fresh) if f], y[fresh]
    if min((y == 1).sum(), (y == 0).sum(), len(y)) < 8:
        return None
    keys = lexicon(texts, y)
    if not len(keys):
        return None
    row, column, count = features_of(texts, keys)
    grade = grades(np.bincount(row, count, len(y)), y)
    weight = np.ones(len(y))
    if whole and min(whole):
        weight = np.where(y == 1, whole[1] / (y == 1).sum(), whole[0] / (y == 0).sum())
    return Model(keys, *cumulative_link(row, column, np.log1p(count), grade, len(keys), weight))


def cumulative_link(row, column, value, grade, width, weight=None, steps: int = 600, rate: float = 0.05, l2: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds, by Adam on the weighted mean negative log-likelihood; thresholds are t_1 and positive gaps."""
    n, cuts = len(grade), GRADES - 1
    share = np.full(n, 1 / n) if weight is None else weight / weight.sum()
    theta = np.concatenate((np.zeros(width), [1.0], np.full(cuts - 1, np.log(0.5))))
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, steps + 1):
        gap = np.exp(theta[width + 1 :])
        cut = np.concatenate(([theta[width]], theta[width] + np.cumsum(gap)))
        s = np.bincount(row, value * theta[column], n)
        up = np.column_stack((np.ones(n), L.sigmoid(s[:, None] - cut), np.zeros(n)))
        at = np.arange(n)
        a, b = up[at, grade], up[at, grade + 1]
        p = np.maximum(a - b, 1e-9)
        da, db = share * a * (1 - a) / p, share * b * (1 - b) / p
        g = np.zeros_like(theta)
        g[:width] = np.bincount(column, value * (db - da)[row], width)
        gc = np.array([da[grade == j + 1].sum() - db[grade == j].sum() for j in range(cuts)])
        g[width] = gc.sum()
        g[width + 1 :] = np.cumsum(gc[::-1])[::-1][1:] * gap
        g[:width] += l2 * theta[:width]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return theta[:width], np.concatenate(([theta[width]], theta[width] + np.cumsum(np.exp(theta[width + 1 :]))))


def train(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    rows, whole = labelled(documents, labels, "toxic", sample)
    return fit([t for t, _ in rows], np.array([y for _, y in rows], int), whole)


SCHEMA = "doc_id long, severity double, grade int, toxic boolean"


def score(documents: DataFrame, model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, expected severity (0 to GRADES - 1), most probable grade, and whether the severity is over the threshold.

    One row per input row. Null and empty texts have no features and get the grade of a text without any; without a
    model severity is null, grade null and toxic false. Repeated rows and ids are scored row by row.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch):
        for low, high, data, offsets in K.pieces(batch.column(1)):
            ids, n = batch.column(0).slice(low, high - low), high - low
            if shared.value is None:
                columns = [ids, pa.nulls(n, pa.float64()), pa.nulls(n, pa.int32()), pa.array(np.zeros(n, bool))]
            else:
                severity, grade = shared.value.severity(data, offsets)
                columns = [ids, pa.array(severity), pa.array(grade.astype(np.int32)), pa.array(severity > threshold)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "severity", "grade", "toxic"])

    return map_arrow(clean_texts(documents), SCHEMA, run)
