"""Statistics from job logs: one row a file, one column a field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_INT, _DEC, _NAME = r"([0-9]+)", r"([0-9]*\.?[0-9]+)", r"([\w.\-]+)"
_ANY = r"[0-9.]+"

# Labels of the logs, and names of the fields.
FIELDS: dict[str, str] = {
    "Val_k": r"(?:-k |K-mer length = |K-mer \(minimum seed\) length = )" + _INT,
    "Val_internal_k_max": r"Max k-mer length \(internal\) = " + _INT,
    "Val_reliable_min": r"-e " + _INT,
    "Val_reliable_max": r"(?:-h |-u |Reliable k-mer max = )" + _INT,
    "Num_total_mpi_tasks": r"-n " + _INT,
    "Num_mpi_tasks_per_node": r"-N " + _INT,
    "Num_tasks_per_numa": r"-S " + _INT,
    "Estimated_cardinality": r"Estimated our cardinality: " + _INT,
    "Total_reads": r"totalReads: " + _INT,
    "Total_bases": r"totalBases: " + _INT,
    "Bloom_bits": r"Table size is: " + _INT + " bits",
    "Bloom_hashes": r"Optimal number of hash functions is : " + _INT,
    "Time_cardinality": r"Stage 1 - Cardinality: " + _DEC,
    "Time_exchange_insert": r"Stage 2 - Exchange and Insert: " + _DEC,
    "Time_count": r"Stage 3 Count " + _DEC,
    "Time_load_imbalance": r"Stage 4 - loadImbalance: " + _DEC,
    "Time_file_io": r"Stage 6 - FileIO: " + _DEC,
    "Num_distinct": r"Kmerscount hash includes " + _INT + " distinct elements",
    "Num_retained": r"Total count is " + _INT,
    "Global_max_count": r"Global max count is " + _INT,
    "Load_imbalance": r"Load imbalance for final k-mer counts is " + _DEC,
    "Time_overall": r"Overall time for \S+ is " + _DEC,
    "Time_transform": r"transforming local map .*: " + _DEC + " s",
    "Time_packing": r"Average packing time: " + _DEC,
    "Time_storage": r"Average storage time: " + _DEC,
    "Time_id_exchange_avg": r"for ReadId pair exchange: " + _ANY + r" \(min\), " + _ANY + r" \(max\), " + _DEC + r" \(avg\)",
    "Time_additional_io": r"Additional I/O time: " + _DEC,
    "Num_alignments": r"global elapsed\) time for " + _INT + " total attempted alignments",
    "Time_alignments": r"total attempted alignments is " + _DEC,
    "Time_overlap_loading": r"Loaded overlaps in " + _DEC + " s",
    "Num_algn_avg": r"local alignments computed: " + _ANY + ", " + _ANY + ", " + _INT,
    "Time_algn_io_avg": r"for alignment IO: " + _ANY + ", " + _ANY + ", " + _DEC,
    "Input_list": r"input fastq file list: " + _NAME,
    "Output_file": r"output file name: " + _NAME,
    "Run_directory": r"Run directory is: ([^\n]*)",
}


def fields(text: Column, wanted: dict[str, str] = FIELDS) -> list[Column]:
    """First match of each field; the least reliable count is 2 where it isn't given."""
    found = [F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")).alias(name) for name, pattern in wanted.items()]
    return [F.coalesce(c, F.lit("2")).alias("Val_reliable_min") if name == "Val_reliable_min" else c for c, name in zip(found, wanted)]


def parse_logs(spark: SparkSession, path: str) -> DataFrame:
    logs = spark.read.text(path, wholetext=True).select(F.col("value"), F.col("_metadata.file_name").alias("Job_out_filename"))
    return logs.select("Job_out_filename", *fields(F.col("value")))


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.option("header", "true").csv(path)
