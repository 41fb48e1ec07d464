"""k-mers of reads: generation, counts, filters, histograms.

Reads are frames with read_id and seq. Substrings are cut from the binary form: on strings each cut would walk from the
start of the read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import arrow as A
from ..functions import dna
from ..plans.session import importable


def _windows(seq: Column, k: int) -> Column:
    return F.sequence(F.lit(1), F.length(seq) - k + 1)


#: Rows of one batch of occurrences.
ROWS = 1 << 17


def occurrences(reads: DataFrame, k: int) -> DataFrame:
    """read_id, pos (from 0), kmer of each window of k bases without N. Lower-case bases are bases."""
    importable(reads.sparkSession)
    upper, stop = np.arange(256, dtype=np.uint8), np.zeros(256, np.uint8)
    upper[97:123] -= 32
    stop[list(b"Nn")] = 4

    def run(batches):
        for batch in batches:
            for low, high, data, offsets in A.pieces(batch.column(1)):
                found = A.valid_starts(stop[data], offsets, k)
                cuts = np.lib.stride_tricks.sliding_window_view(upper[data], k) if len(found) else None
                ids = batch.column(0).slice(low, high - low)
                for i in range(0, len(found), ROWS):
                    at = found[i : i + ROWS]
                    row = np.searchsorted(offsets, at, "right") - 1
                    ends = np.arange(0, k * len(at) + 1, k, dtype=np.int32)
                    text = pa.Array.from_buffers(pa.string(), len(at), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(cuts[at]))])
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(row)), pa.array((at - offsets[row]).astype(np.int32)), text], names=["read_id", "pos", "kmer"])

    kind = reads.schema["read_id"].dataType.simpleString()
    return reads.select("read_id", F.col("seq").cast("string")).mapInArrow(run, f"read_id {kind}, pos int, kmer string")


def kmers(reads: DataFrame, k: int) -> DataFrame:
    """One column kmer: reads are split at N first, so no window has to be tested."""
    runs = reads.select(F.explode(F.split(F.upper("seq"), "N+")).alias("run")).where(F.length("run") >= k)
    at = runs.select(F.encode("run", "utf-8").alias("b"), F.explode(_windows(F.col("run"), k)).alias("p"))
    return at.select(F.substr("b", "p", F.lit(k)).cast("string").alias("kmer"))


def packed_kmers(reads: DataFrame, k: int, canonical: bool = False, with_place: bool = False) -> DataFrame:
    """Packed k-mers (k up to 31) by vectorised rolling codes in Arrow batches: 8 bytes a k-mer go to the shuffle."""
    importable(reads.sparkSession)
    schema = ("read_id long, pos int, " if with_place else "") + "packed long"

    def run(batches):
        for batch in batches:
            for low, high, data, offsets in A.pieces(batch.column(1)):
                at, packed = A.packed_valid(A.CODE[data], offsets, k, canonical)
                if with_place:
                    row = np.searchsorted(offsets, at, "right") - 1
                    ids = batch.column(0).slice(low, high - low).take(pa.array(row))
                    yield pa.RecordBatch.from_arrays([ids, pa.array((at - offsets[row]).astype(np.int32)), pa.array(packed)], names=["read_id", "pos", "packed"])
                else:
                    yield pa.RecordBatch.from_arrays([pa.array(packed)], names=["packed"])

    return reads.select(F.col("read_id").cast("long"), F.col("seq").cast("string")).mapInArrow(run, schema)


def letters(frame: DataFrame, k: int, column: str = "packed", name: str = "kmer") -> DataFrame:
    """Replaces a packed column by its string, in Arrow batches."""
    importable(frame.sparkSession)
    rest = [c for c in frame.columns if c != column]
    schema = ", ".join([f"{name} string", *(f"`{c}` {frame.schema[c].dataType.simpleString()}" for c in rest)])

    def run(batches):
        for batch in batches:
            packed = batch.column(0).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([A.letters(packed, k), *batch.columns[1:]], names=[name, *rest])

    return frame.select(column, *rest).mapInArrow(run, schema)


#: Windows that are counted together before they leave a task.
CHUNK = 1 << 20


def _tallied(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of a sorted array, and how often each is there."""
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.diff(np.append(first, len(keys)))


def _counts(reads: DataFrame, k: int, canonical: bool) -> DataFrame:
    """packed, n: counts of bounded chunks of windows; a frequent k-mer leaves a chunk as one row."""
    importable(reads.sparkSession)

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for _, _, data, offsets in A.pieces(batch.column(0)):
                held.append(A.packed_valid(A.CODE[data], offsets, k, canonical)[1])
                size += len(held[-1])
                if size >= CHUNK:
                    yield flush(held)
                    held, size = [], 0
        if size:
            yield flush(held)

    def flush(held):
        keys, n = _tallied(np.sort(np.concatenate(held)))
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], names=["packed", "n"])

    return reads.select(F.col("seq").cast("string")).mapInArrow(run, "packed long, n long")


def count_packed(reads: DataFrame, k: int, canonical: bool = False) -> DataFrame:
    """packed, cnt: windows are counted chunk by chunk where they are read, so frequent k-mers don't make hot partitions; one shuffle."""
    return _counts(reads, k, canonical).groupBy("packed").agg(F.sum("n").alias("cnt"))


def count(reads: DataFrame, k: int, canonical: bool = False) -> DataFrame:
    """kmer, cnt. For k up to 31 the keys are packed; else they are strings."""
    if k <= 31:
        return letters(count_packed(reads, k, canonical), k)
    found = kmers(reads, k)
    key = dna.canonical(F.col("kmer")) if canonical else F.col("kmer")
    return found.select(key.alias("kmer")).groupBy("kmer").agg(F.count(F.lit(1)).alias("cnt"))


def reliable(counts: DataFrame, low: int, high: int) -> DataFrame:
    return counts.where(F.col("cnt").between(low, high))


def histogram(counts: DataFrame) -> DataFrame:
    return counts.groupBy("cnt").agg(F.count(F.lit(1)).alias("n"))


def totals(counts: DataFrame) -> DataFrame:
    return counts.agg(F.count(F.lit(1)).alias("distinct_kmers"), F.coalesce(F.sum("cnt"), F.lit(0)).alias("total_kmers"))


def ideal_total(reads: DataFrame, k: int) -> DataFrame:
    """Number of valid windows, from run lengths only."""
    runs = F.transform(F.split("seq", "[Nn]+"), lambda r: F.greatest(F.lit(0), F.length(r) - F.lit(k - 1)))
    return reads.select(F.aggregate(runs, F.lit(0).cast("long"), lambda a, x: a + x).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("ideal_total"))


def top(counts: DataFrame, n: int = 40, item: str = "kmer") -> DataFrame:
    return counts.orderBy(F.desc("cnt"), F.desc(item)).limit(n)


def reliable_places(reads: DataFrame, k: int, low: int, high: int) -> DataFrame:
    """packed (canonical), cnt and the sorted array of places (read_id, pos) of the k-mers whose count is in range.

    One pass and one exchange: each task passes on at most high + 1 places of a k-mer, so a frequent one meets as few
    rows as there are tasks, and no list is longer than high + 1.
    """
    place = Window.partitionBy("packed").orderBy("read_id", "pos")
    some = packed_kmers(reads, k, True, True).withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= high + 1)
    lists = some.groupBy("packed").agg(F.count(F.lit(1)).alias("cnt"), F.collect_list(F.struct("read_id", "pos")).alias("places"))
    return lists.where(F.col("cnt").between(low, high)).withColumn("places", F.sort_array("places"))


def occurrence_lists(reads: DataFrame, k: int, low: int, high: int) -> DataFrame:
    """The same as ``reliable_places``: only reliable k-mers have lists, so none is longer than ``high``."""
    return reliable_places(reads, k, low, high)


def packed_extensions(reads: DataFrame, k: int) -> DataFrame:
    """packed, ext, n: counts (by chunks) of k-mers with the bases beside them; ext is 5 * left + right, in order of A, C, G, T and none; k up to 29."""
    importable(reads.sparkSession)

    def run(batches):
        for batch in batches:
            for _, _, data, offsets in A.pieces(batch.column(0)):
                code = A.CODE[data]
                at, packed = A.packed_valid(code, offsets, k)
                row = np.searchsorted(offsets, at, "right") - 1
                left = np.where(at > offsets[row], code[at - 1], 4)
                right = np.where(at + k < offsets[row + 1], code[np.minimum(at + k, len(code) - 1)], 4)
                ext = np.minimum(left, 4).astype(np.int64) * 5 + np.minimum(right, 4)
                key, n = _tallied(np.sort((packed << 5) | ext))
                yield pa.RecordBatch.from_arrays([pa.array(key >> 5), pa.array((key & 31).astype(np.int8)), pa.array(n.astype(np.int32))], names=["packed", "ext", "n"])

    return reads.select(F.col("seq").cast("string")).mapInArrow(run, "packed long, ext tinyint, n int")


def extension_counts(reads: DataFrame, k: int) -> DataFrame:
    """kmer, how often A, C, G, T stand before it (la..lt) and after it (ra..rt), and cnt."""
    if k > 29:
        return _extension_counts_of_text(reads, k)
    found = packed_extensions(reads, k).repartition("packed")  # rows are counts already
    side = {"l": F.floor(F.col("ext") / 5), "r": F.col("ext") % 5}
    sums = [F.sum(F.when(side[s] == i, F.col("n")).otherwise(0)).alias(s + b.lower()) for s in "lr" for i, b in enumerate("ACGT")]
    return letters(found.groupBy("packed").agg(*sums, F.sum("n").alias("cnt")), k)


def _extension_counts_of_text(reads: DataFrame, k: int) -> DataFrame:
    at = reads.where(F.length("seq") >= k).select(F.encode(F.upper("seq"), "utf-8").alias("b"), F.length("seq").alias("n"), F.explode(_windows(F.col("seq"), k)).alias("p"))
    one = lambda p: F.substr("b", p, F.lit(1)).cast("string")
    cut = at.select(F.substr("b", "p", F.lit(k)).cast("string").alias("kmer"), F.when(F.col("p") > 1, one(F.col("p") - 1)).alias("l"), F.when(F.col("p") + k <= F.col("n"), one(F.col("p") + k)).alias("r"))
    sums = [F.count(F.when(F.col(s) == b, 1)).alias(s + b.lower()) for s in "lr" for b in "ACGT"]
    return cut.where(F.instr("kmer", "N") == 0).groupBy("kmer").agg(*sums, F.count(F.lit(1)).alias("cnt"))


def load_imbalance(counts: DataFrame, parts: int) -> DataFrame:
    """Largest over average number of distinct k-mers per owner (packed value modulo parts)."""
    per = counts.groupBy(F.pmod("packed", F.lit(parts)).alias("o")).agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.max("n").alias("largest"), F.sum("n").alias("total"), F.lit(parts).cast("long").alias("parts"))
