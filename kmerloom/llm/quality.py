"""Quality rules: heuristic counts, and a hashed word and character n-gram logistic regression.

The model is trained on a bounded sample of labelled rows, calibrated on held-out ones (Platt), and scored in
Arrow batches against a fixed threshold.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from . import linear as L
from .common import clean_texts, map_arrow

SPEC = L.Spec()
#: Labelled rows of each class that training reads at most; scoring covers every row.
SAMPLE = 400
#: Documents whose calibrated probability of being good is lower go.
THRESHOLD = 0.5

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True


@dataclass
class Model:
    weights: np.ndarray
    a: float
    b: float

    def probability(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return L.sigmoid(self.a * L.raw_scores(data, offsets, SPEC, self.weights) + self.b)


def labelled(documents: DataFrame, labels: DataFrame, label: str, limit: int) -> tuple[list[tuple[str, int]], tuple[int, int]]:
    """Texts and labels of at most ``limit`` documents of either class, chosen by hash of the id, and the numbers of all labels 0 and 1.

    Documents that share an id count once, with their least text.
    """
    ids = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).alias("y"))
    draw = [ids.where(F.col("y") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit) for c in (0, 1)]
    chosen = draw[0].unionAll(draw[1])
    found = clean_texts(documents).join(F.broadcast(chosen), "doc_id")  # at most 2 * limit rows
    rows = found.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y")).collect()
    whole = {int(r["y"]): r["n"] for r in ids.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    return [(r["text"], int(r["y"])) for r in sorted(rows, key=lambda r: r["doc_id"])], (whole.get(0, 0), whole.get(1, 0))


def train(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    """None if the labels hold a class with fewer than 8 rows: then no row is rejected by the model."""
    rows, whole = labelled(documents, labels, "quality", sample)
    return fit([t for t, _ in rows], np.array([y for _, y in rows], int), whole)


def fit(texts: list[str], y: np.ndarray, whole: tuple[int, int] | None = None) -> Model | None:
    """``whole``: numbers of bad and good rows among all labels; probabilities are calibrated to their shares, not to the sample's."""
    if min((y == 0).sum(), (y == 1).sum(), len(y)) < 8:
        return None
    held = np.where(y == 1, np.cumsum(y == 1), np.cumsum(y == 0)) % 4 == 0  # a quarter of each class
    size = SPEC.families << SPEC.bits
    data, offsets = L.texts_of([t for t, h in zip(texts, held) if not h])
    w, _ = L.fit_logistic(L.matrix(data, offsets, SPEC), y[~held], size)
    weights = w.reshape(SPEC.families, -1).astype(np.float32)
    data, offsets = L.texts_of([t for t, h in zip(texts, held) if h])
    a, b = L.platt(L.raw_scores(data, offsets, SPEC, weights), y[held])
    if whole and min(whole):
        b += np.log(whole[1] / whole[0]) - np.log((y == 1).sum() / (y == 0).sum())
    return Model(weights, a, b)


def counts(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The heuristic counts of each row; see ``score``."""
    n = len(offsets) - 1
    starts, ends, first = K.words(data, offsets)
    sums = K.byte_prefix(data)
    out = {"n_words": np.diff(first)}
    out["word_chars"] = K.row_sums(K.WORDY[data] & ((data & 0xC0) != 0x80), offsets)
    out["n_symbols"] = K.row_sums(SYMBOLS[data], offsets)

    inner = np.zeros(len(data) + 1, bool)
    inner[np.flatnonzero(data == 10) + 1] = True
    inner[offsets] = True
    low = np.flatnonzero(inner)
    low = low[low < len(data)]
    high = np.append(low[1:], len(data)) if len(low) else low
    row = np.searchsorted(offsets, low, "right") - 1
    high = np.where((high > low) & (data[np.maximum(high, 1) - 1] == 10) & (high <= offsets[row + 1]), high - 1, high) if len(low) else high
    used = np.searchsorted(starts, high) > np.searchsorted(starts, low)
    low, high, row = low[used], high[used], row[used]
    h = K.span_hash(sums, low, high)
    order = np.lexsort((h, row))
    again = np.zeros(len(order), bool)
    again[1:] = (h[order][1:] == h[order][:-1]) & (row[order][1:] == row[order][:-1])
    out["n_dup_lines"] = np.bincount(row[order][again], minlength=n)

    gram = K.gram_hash(K.prefix(K.span_hash(sums, starts, ends)), 5)
    row = K.rows_of(first)
    at = np.flatnonzero(row[4:] == row[:-4]) if len(row) > 4 else np.zeros(0, np.int64)
    key = gram[at] ^ K.mix(row[at].astype(np.uint64) + K.U(1))
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(order), bool)
    twice[1:] |= same
    twice[:-1] |= same
    hit = at[order][twice]
    edge = np.bincount(hit, minlength=len(row) + 6) - np.bincount(hit + 5, minlength=len(row) + 6)
    out["n_repeat_words"] = K.row_sums(np.cumsum(edge)[: len(row)] > 0, first)
    return out


SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, quality double, kept boolean"


def score(documents: DataFrame, model: Model | None, threshold: float = THRESHOLD, schema: str | None = None) -> DataFrame:
    """One row per input row, with SCHEMA's columns.

    Words are [^\\x20\\x09-\\x0D]+. word_chars: code points in words. n_symbols: characters of ``#*$%&|<>``.
    n_dup_lines: lines with a word that equal an earlier line. n_repeat_words: words inside 5-word windows found twice
    or more. base_failed: under 10 words, or over 20 % of words repeat. quality: calibrated probability that the text
    is good (null without a model). kept: not base_failed and quality at or over the threshold.
    Null and empty texts have zero counts and fail the base; repeated ids are scored row by row; a null id stays null.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch):
        for low, high, data, offsets in K.pieces(batch.column(1)):
            c = counts(data, offsets)
            failed = (c["n_words"] < 10) | (100 * c["n_repeat_words"] > 20 * c["n_words"])
            p = shared.value.probability(data, offsets) if shared.value is not None else None
            kept = ~failed if p is None else ~failed & (p >= threshold)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(low, high - low), *(pa.array(c[k].astype(np.int64)) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), pa.array(failed), pa.array(p) if p is not None else pa.nulls(high - low, pa.float64()), pa.array(kept)],
                names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "quality", "kept"],
            )

    return map_arrow(clean_texts(documents), SCHEMA, run)


def filter_documents(documents: DataFrame, model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    """The rows that the rules keep, with all their columns. The text is scored where it is read: no join, no shuffle."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    at = documents.columns.index("text")

    def run(batch: pa.RecordBatch):
        for low, high, data, offsets in K.pieces(batch.column(at)):
            c = counts(data, offsets)
            kept = ~((c["n_words"] < 10) | (100 * c["n_repeat_words"] > 20 * c["n_words"]))
            if shared.value is not None:
                kept &= shared.value.probability(data, offsets) >= threshold
            yield batch.slice(low, high - low).filter(pa.array(kept))

    return map_arrow(documents, documents.schema, run)
