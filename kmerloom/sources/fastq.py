"""FASTQ, FASTA and file-of-filenames sources, and text sinks.

The FASTQ source splits plain files into byte ranges; each range starts at the first record that begins in it. Gzip files
are one range. Paths go through Arrow's file systems, so any store that these reach will do.
"""

from __future__ import annotations

import gzip
import io

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..plans.session import importable, saved

SCHEMA = "id string, seq string, qual string"
SPLIT = 32 << 20


def _opened(path: str):
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path)


def _files(path: str) -> list[str]:
    """The path itself, or the files of the folder that it names (but for hidden ones)."""
    from pyarrow import fs

    system, inner = _opened(path)
    if system.get_file_info(inner).type != fs.FileType.Directory:
        return [path]
    found = system.get_file_info(fs.FileSelector(inner))
    return [f"{path.rstrip('/')}/{x.base_name}" for x in sorted(found, key=lambda x: x.path) if x.is_file and x.base_name[0] not in "._"]


class Range(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


def resync(stream, start: int, end: int) -> int | None:
    """Offset of the first record that begins in [start, end): a line that starts with @, whose next but one starts with + and whose last is as long as the second. A quality line may start with @ too; it fails this test."""
    if start == 0:
        return 0
    stream.seek(start - 1)
    stream.readline()
    offset = stream.tell()
    lines = [(offset, stream.readline())]
    while lines[0][0] < end and lines[0][1]:
        while len(lines) < 4:
            lines.append((stream.tell(), stream.readline()))
        head, seq, plus, qual = (x.rstrip(b"\r\n") for _, x in lines)
        if head[:1] == b"@" and plus[:1] == b"+" and len(seq) == len(qual):
            return lines[0][0]
        lines.pop(0)
    return None


def _mate(head: bytes) -> tuple[bytes, bytes]:
    """Name without its ending, and 1 or 2, of a header like ``@x/1`` or ``@x 1:N:0:``; the end is empty without a pair."""
    name, _, rest = head.partition(b" ")
    if name[-2:] in (b"/1", b"/2"):
        return name[:-2], name[-1:]
    return name, rest[:1] if rest[1:2] == b":" and rest[:1] in (b"1", b"2") else b""


def records(stream, path: str, end: int | None, mode: str, first: bool = True):
    """(id, seq, qual) of the records that begin before ``end``; an empty line ends the file.

    Neighbouring mates of an interleaved file stay in one range: the second one goes with the first, wherever it begins.
    A range that isn't the file's ``first`` leaves a second mate at its start to the range before.
    """
    before, leading = (b"", b""), not first
    while True:
        at = stream.tell()
        late = end is not None and at >= end
        head = stream.readline().rstrip(b"\r\n")
        if not head or late and (before[1] != b"1" or _mate(head) != (before[0], b"2")):
            return
        seq, plus, qual = (stream.readline().rstrip(b"\r\n") for _ in range(3))
        if head[:1] != b"@" or plus[:1] != b"+" or len(seq) != len(qual):
            if mode == "FAILFAST":
                raise ValueError(f"improper record in {path} at {at}: {head[:60]!r}")
            if (again := resync(stream, at + 1, end if end is not None else 1 << 62)) is None:
                return
            stream.seek(again)
            continue
        before, skip, leading = _mate(head), leading and _mate(head)[1] == b"2", False
        if not skip:
            yield head.split(None, 1)[0].decode(), seq.decode(), qual.decode()


def batches(rows, size: int = 4096):
    """Arrow batches of the records."""
    names, held = ["id", "seq", "qual"], []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*held)], names=names)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*held)], names=names)


class FastqReader(DataSourceReader):
    def __init__(self, options):
        self.mode = options.get("mode", "FAILFAST").upper()
        self.paths = [p for p in options.get("paths", options.get("path", "")).split("\n") if p]
        self.split = int(options.get("splitBytes", SPLIT))

    def partitions(self):
        out = []
        for path in [p for given in self.paths for p in _files(given)]:
            system, inner = _opened(path)
            size = system.get_file_info(inner).size
            if size is None:
                raise FileNotFoundError(path)
            step = size or 1 if path.endswith(".gz") else self.split
            out += [Range(path, s, min(size, s + step)) for s in range(0, size, step)]
        return out or [Range("", 0, 0)]

    def read(self, partition):
        if not partition.path:
            return
        system, inner = _opened(partition.path)
        with system.open_input_file(inner) as raw:
            if partition.path.endswith(".gz"):
                yield from batches(records(gzip.GzipFile(fileobj=raw), partition.path, None, self.mode))
                return
            stream = io.BufferedReader(raw, 1 << 20)
            start = resync(stream, partition.start, partition.end)
            if start is not None:
                stream.seek(start)
                yield from batches(records(stream, partition.path, partition.end, self.mode, start == 0))


class Fastq(DataSource):
    """spark.read.format("fastq").load(path); options: mode FAILFAST or DROPMALFORMED, splitBytes."""

    @classmethod
    def name(cls):
        return "fastq"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return FastqReader(self.options)


def read_fastq(spark: SparkSession, paths: str | list[str], **options: str) -> DataFrame:
    importable(spark)
    spark.dataSource.register(Fastq)
    reader = spark.read.format("fastq").option("paths", paths if isinstance(paths, str) else "\n".join(paths))
    for key, value in options.items():
        reader = reader.option(key, value)
    return reader.load()


def fofn(spark: SparkSession, path: str) -> list[str]:
    """Paths listed in a file of file names, one a line (a short list, read on the driver)."""
    return [r.value.strip() for r in spark.read.text(path).collect() if r.value.strip()]


def read_fofn(spark: SparkSession, path: str, **options: str) -> DataFrame:
    return read_fastq(spark, fofn(spark, path), **options)


def numbered(reads: DataFrame) -> DataFrame:
    """Dense read ids from 1 in order of id: counts per range partition, then prefix sums over partitions; no global sort in one task.

    The places of the rows are a written table: a task that runs again reads the same ones.
    """
    spark = reads.sparkSession
    ordered = reads.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "id").sortWithinPartitions("id", "seq")
    placed = ordered.select("*", F.spark_partition_id().alias("_p"), F.monotonically_increasing_id().alias("_m"))
    placed = saved(placed, "numbered")
    sizes = sorted((r["_p"], r["n"], r["first"]) for r in placed.groupBy("_p").agg(F.count(F.lit(1)).alias("n"), F.min("_m").alias("first")).collect())
    rows, total = [], 0
    for p, n, first in sizes:
        rows.append((p, total - first))
        total += n
    shift = spark.createDataFrame(rows, "_p int, _shift long")
    return placed.join(F.broadcast(shift), "_p").select((F.col("_m") + F.col("_shift") + 1).alias("read_id"), *reads.columns)


def estimate(reads: DataFrame, size: int, sample: int | None = 1000) -> DataFrame:
    """reads and bases of a file of ``size`` bytes, from its first records (all, without ``sample``): ceil(size * n / bytes read)."""
    head = reads.limit(sample) if sample else reads
    record = F.length("id") + 2 * F.length("seq") + 5
    sums = head.agg(F.count(F.lit(1)).alias("n"), F.sum("bytes" if "bytes" in reads.columns else record).alias("b"), F.sum(F.length("seq")).alias("s"))
    whole = lambda c: F.coalesce(F.expr(f"(cast({size} as decimal(20, 0)) * {c} + b - 1) div b"), F.lit(0)).cast("long")
    return sums.select(whole("n").alias("reads"), whole("s").alias("bases"))


def write_fastq(reads: DataFrame, path: str, **options: str) -> None:
    reads.select(F.concat_ws("\n", "id", "seq", F.lit("+"), "qual").alias("value")).write.options(**options).text(path)


def write_fasta(reads: DataFrame, path: str, width: int = 50) -> None:
    folded = F.regexp_replace("seq", f"(.{{{width}}})(?=.)", "$1\n")
    reads.select(F.concat(F.lit(">"), F.regexp_replace("id", "^@", ""), F.lit("\n"), folded).alias("value")).write.text(path)


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """id and seq: records are split at line starts with >, so files split by records."""
    rows = spark.read.option("lineSep", "\n>").text(path).select(F.regexp_replace("value", "^>", "").alias("v")).where("v <> ''")
    return rows.select(F.regexp_extract("v", r"^(\S+)", 1).alias("id"), F.regexp_replace(F.regexp_replace("v", r"^[^\n]*\n?", ""), r"\s", "").alias("seq"))


def write_counts(counts: DataFrame, path: str, threshold: int = 0, limit: int | None = None) -> None:
    """Lines ``kmer, tab, tab, count`` of the k-mers with more than ``threshold``."""
    out = counts.where(F.col("cnt") > threshold)
    out = out.limit(limit) if limit else out
    out.select(F.concat("kmer", F.lit("\t\t"), F.col("cnt").cast("string")).alias("value")).write.text(path)


def write_tsv(frame: DataFrame, path: str) -> None:
    frame.write.option("sep", "\t").csv(path)


def stage_in(frame: DataFrame) -> DataFrame:
    """Keeps a read set at hand across queries: in memory, on disk where it doesn't fit."""
    from pyspark import StorageLevel

    return frame.persist(StorageLevel.MEMORY_AND_DISK)


def stage_out(frame: DataFrame) -> None:
    frame.unpersist()


def write_table(frame: DataFrame, path: str) -> None:
    """Binary form of counts, places or extension tables."""
    frame.write.parquet(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_extensions(codes: DataFrame, path: str, limit: int | None = None) -> DataFrame:
    """Lines of k-mer, tab, extended code; returns the least and the largest count of what was written."""
    out = codes.limit(limit).persist() if limit else codes
    out.select(F.concat_ws("\t", "kmer", "extended").alias("value")).write.text(path)
    return out.agg(F.min("cnt").alias("least"), F.max("cnt").alias("most"))


# Leading columns of the tab-separated interval formats.
BED = "chrom string, start long, end long, name string, score string, strand string"
GFF = "seqid string, source string, type string, start long, end long, score string, strand string, phase string, attributes string"


def read_intervals(spark: SparkSession, path: str, schema: str = BED) -> DataFrame:
    """BED or GFF rows; comment lines are left out."""
    return spark.read.schema(schema).option("sep", "\t").option("comment", "#").csv(path)
