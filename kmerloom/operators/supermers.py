"""Minimizers and supermers, vectorised over Arrow batches.

A supermer is a run of neighbouring k-mers with one minimizer, within windows of 32 - k k-mers of its read, so that it
fits 32 bases. Invalid k-mers (with N) break it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import arrow as A
from ..plans.session import importable

GPU = np.array([1, 0, 3, 2], np.uint8)  # code of A, C, G, T in the order C, A, T, G


def _minimizers(code: np.ndarray, k: int, m: int, inclusive: bool, gpu: bool) -> np.ndarray:
    """Least m-mer of each window of k bases; starts 0 to k - m - 1, and k - m if inclusive."""
    base = GPU[code & 3] if gpu else code & 3
    return A.sliding_min(A.packed_windows(base, m), k - m + inclusive)


def minimizers(reads: DataFrame, k: int, m: int, inclusive: bool = False, gpu: bool = False) -> DataFrame:
    """read_id, pos, minimizer (packed in the chosen letter order) of each valid k-mer."""
    importable(reads.sparkSession)

    def run(batches):
        for batch in batches:
            for low, high, data, offsets in A.pieces(batch.column(1)):
                code = A.CODE[data]
                at = A.valid_starts(code, offsets, k)
                row = np.searchsorted(offsets, at, "right") - 1
                ids = batch.column(0).slice(low, high - low).take(pa.array(row))
                low_m = _minimizers(code, k, m, inclusive, gpu)[at] if len(at) else at
                yield pa.RecordBatch.from_arrays([ids, pa.array((at - offsets[row]).astype(np.int32)), pa.array(low_m.astype(np.int64))], names=["read_id", "pos", "minimizer"])

    return reads.select(F.col("read_id").cast("long"), F.col("seq").cast("string")).mapInArrow(run, "read_id long, pos int, minimizer long")


def supermers(reads: DataFrame, k: int, m: int, window: int | None = None, with_bases: bool = False) -> DataFrame:
    """read_id, start, slen, minimizer (packed), and the bases if asked for."""
    importable(reads.sparkSession)
    width = 32 - k if window is None else window
    schema = "read_id long, start int, slen int, minimizer long" + (", bases string" if with_bases else "")
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        for batch in batches:
            for low, high, data, offsets in A.pieces(batch.column(1)):
                code = A.CODE[data]
                at = A.valid_starts(code, offsets, k)
                if not len(at):
                    continue
                row = np.searchsorted(offsets, at, "right") - 1
                pos = at - offsets[row]
                least = _minimizers(code, k, m, False, False)[at]
                fresh = np.ones(len(at), bool)
                fresh[1:] = (row[1:] != row[:-1]) | (pos[1:] != pos[:-1] + 1) | (pos[1:] // width != pos[:-1] // width) | (least[1:] != least[:-1])
                first = np.flatnonzero(fresh)
                size = np.diff(np.append(first, len(at))) + k - 1
                ids = batch.column(0).slice(low, high - low).take(pa.array(row[first]))
                columns = [ids, pa.array(pos[first].astype(np.int32)), pa.array(size.astype(np.int32)), pa.array(least[first].astype(np.int64))]
                if with_bases:
                    cut = np.concatenate(([0], np.cumsum(size)))
                    take = np.arange(cut[-1]) + np.repeat(at[first] - cut[:-1], size)
                    columns.append(pa.Array.from_buffers(pa.string(), len(first), [None, pa.py_buffer(cut.astype(np.int32).tobytes()), pa.py_buffer(data[take].tobytes())]))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return reads.select(F.col("read_id").cast("long"), F.col("seq").cast("string")).mapInArrow(run, schema)


def expand(bases: DataFrame, k: int) -> DataFrame:
    """minimizer and packed k-mer of each k-mer of the supermers."""
    importable(bases.sparkSession)

    def run(batches):
        for batch in batches:
            for low, high, data, offsets in A.pieces(batch.column(1)):
                code = A.CODE[data]
                at = A.valid_starts(code, offsets, k)
                row = np.searchsorted(offsets, at, "right") - 1
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low).take(pa.array(row)), pa.array(A.packed_windows(code, k)[at])], names=["minimizer", "packed"])

    return bases.select("minimizer", "bases").mapInArrow(run, "minimizer long, packed long")


def packed_supermers(reads: DataFrame, k: int, m: int) -> DataFrame:
    """minimizer, bits (2 a base, right-aligned, 32 bases at most), slen, n: supermers in 8 bytes, equal ones of a piece counted together."""
    importable(reads.sparkSession)
    width = 32 - k

    def run(batches):
        for batch in batches:
            for _, _, data, offsets in A.pieces(batch.column(0)):
                code = A.CODE[data]
                at = A.valid_starts(code, offsets, k)
                if not len(at):
                    continue
                row = np.searchsorted(offsets, at, "right") - 1
                pos = at - offsets[row]
                least = _minimizers(code, k, m, False, False)[at]
                fresh = np.ones(len(at), bool)
                fresh[1:] = (row[1:] != row[:-1]) | (pos[1:] != pos[:-1] + 1) | (pos[1:] // width != pos[:-1] // width) | (least[1:] != least[:-1])
                first = np.flatnonzero(fresh)
                more = np.diff(np.append(first, len(at))) - 1  # bases beyond the first k-mer
                bits = A.packed_windows(code, k)[at[first]].view(np.uint64)
                for j in range(int(more.max()) + 1):
                    own = more > j
                    bits[own] = (bits[own] << np.uint64(2)) | code[at[first[own]] + k + j]
                order = np.lexsort((more, bits))
                bits, more, low = bits[order], more[order], least[first][order]
                head = np.flatnonzero(np.concatenate(([True], (bits[1:] != bits[:-1]) | (more[1:] != more[:-1]))))
                n = np.diff(np.append(head, len(bits)))
                yield pa.RecordBatch.from_arrays([pa.array(low[head].astype(np.int64)), pa.array(bits[head].view(np.int64)), pa.array((more[head] + k).astype(np.int32)), pa.array(n)], names=["minimizer", "bits", "slen", "n"])

    return reads.select(F.col("seq").cast("string")).mapInArrow(run, "minimizer long, bits long, slen int, n long")


def count(reads: DataFrame, k: int, m: int) -> DataFrame:
    """packed, cnt by way of supermers: they are shuffled by minimizer, in fewer bytes than k-mers, cut into k-mers by expressions, and counted where they land.

    A k-mer's minimizer is a function of the k-mer, so grouping by both needs no second exchange, and Spark's own
    aggregation spills where a partition holds many k-mers.
    """
    dealt = packed_supermers(reads, k, m).repartition("minimizer")
    mask = F.lit((1 << 2 * k) - 1)
    cut = F.transform(F.sequence(F.lit(0), F.col("slen") - k), lambda i: F.call_function("shiftrightunsigned", F.col("bits"), i * 2).bitwiseAND(mask))
    each = dealt.select("minimizer", "n", F.explode(cut).alias("packed"))
    return each.groupBy("minimizer", "packed").agg(F.sum("n").alias("cnt")).select("packed", "cnt")
