"""The registered queries, each over whole tables, and their SQL for DuckDB.

Reads are the documents' texts projected to DNA; k = 17, minimizers of 7, reliable counts 2 to 8.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dna, hashes
from ..operators import align, kmers, overlap, read_cells, sketches, supermers, tables, variants
from .session import dealt, scratch
from ..sources import fastq, runlog, synthetic

K, M, LOW, HIGH, DMIN, PARTS = 17, 7, 2, 8, 2, 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dealt(table(spark, sf_dir, "documents").select("doc_id", "text")).select((F.col("doc_id") + 1).alias("read_id"), dna.text_to_dna(F.col("text")).alias("seq"))


def _count(r: DataFrame) -> DataFrame:
    return kmers.count_packed(r, K)


def kmer_neighbors(r: DataFrame) -> DataFrame:
    kept = kmers.letters(kmers.reliable(kmers.count_packed(r, K, True), LOW, HIGH).select("packed"), K)
    return kept.select("kmer", F.posexplode(dna.links(F.col("kmer"))).alias("i", "link")).select("kmer", F.col("i").cast("long").alias("i"), "link")


def occurrences_text(places: Column) -> Column:
    return F.array_join(F.transform(places, lambda p: F.concat(p["read_id"].cast("string"), F.lit(":"), p["pos"].cast("string"))), ",")


def kmer_reads_list(r: DataFrame) -> DataFrame:
    lists = kmers.occurrence_lists(r, K, LOW, HIGH)
    return kmers.letters(lists.select("packed", "cnt", occurrences_text(F.col("places")).alias("places")), K)


def minimizer_counts(r: DataFrame, gpu: bool) -> DataFrame:
    counts = supermers.minimizers(r, K, M, gpu=gpu).groupBy("minimizer").agg(F.count(F.lit(1)).alias("n"))
    mer = dna.unpack(F.col("minimizer"), M)
    return counts.select((F.translate(mer, "ACGT", "ABCD") if gpu else mer).alias("minimizer"), "n")


def supermer_rows(r: DataFrame) -> DataFrame:
    return supermers.supermers(r, K, M).select("read_id", F.col("start").cast("long").alias("start"), F.col("slen").cast("long").alias("slen"), dna.unpack(F.col("minimizer"), M).alias("minimizer"))


def overlaps(r: DataFrame, k: int = K) -> DataFrame:
    return overlap.read_overlaps(r, k, LOW, HIGH)


def overlap_positions(r: DataFrame) -> DataFrame:
    text = F.array_join(F.transform("seeds", lambda s: F.concat(s["pos1"].cast("string"), F.lit("-"), s["pos2"].cast("string"))), ",")
    return overlap.overlap_positions(r, K, LOW, HIGH).select("r1", "r2", text.alias("seeds"))


def overlap_minus(r: DataFrame) -> DataFrame:
    found = overlaps(r)
    return overlap.minus(found, found.where("shared >= 10"))


def tag_relabel(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tags = docs.select((F.col("doc_id") + 1).alias("id"), F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("tag"))
    return overlap.relabel(overlaps(reads(spark, sf_dir)), tags).select("tag_r1", "tag_r2", "shared")


def read_owner_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select((F.col("doc_id") + 1).alias("read_id"))
    sizes = docs.groupBy(((F.col("read_id") * 7) % PARTS).alias("owner")).agg(F.count(F.lit(1)).alias("n"))
    return overlap.owner_of(docs, overlap.owner_bounds(sizes)).select("read_id", "owner")


def ufx_codes(r: DataFrame) -> DataFrame:
    return variants.ufx(kmers.extension_counts(r, K), DMIN)


def snp_trio(r: DataFrame) -> DataFrame:
    third = lambda i: variants.with_twins(kmers.count(r.where(F.col("read_id") % 3 == i), 11))
    return variants.trio_snps(third(0), third(1), third(2), 1, 50)


def heavy_hitter_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("item")).agg(F.count(F.lit(1)).alias("cnt"))
    return kmers.top(counts, 100, "item")


def heavy_hitter_anti(r: DataFrame) -> DataFrame:
    counts = kmers.count_packed(r, K)
    heavy = kmers.top(counts, 40, "packed")
    return counts.join(F.broadcast(heavy.select("packed")), "packed", "left_anti")  # 40 rows


def heavy_hitter_recall(r: DataFrame) -> DataFrame:
    """6-mers (up to 4096 kinds) that a Misra-Gries sketch of 256 counters must hold (over N / 256 of the rows), and how many of them it holds: all."""
    packed = kmers.packed_kmers(r, 6)
    sketch = sketches.misra_gries(packed, "packed", 256).withColumnRenamed("item", "packed")
    exact = kmers.count_packed(r, 6)
    total = exact.agg(F.sum("cnt").alias("total"))
    must = exact.join(F.broadcast(total), F.col("cnt") * 256 > F.col("total"))  # one row on the right
    return must.join(sketch, "packed", "left").agg(F.count(F.lit(1)).alias("heavy"), F.count("estimate").alias("found"))


def top100_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall of the exact top 100 of the mixture stream (as many numbers as the lines table has rows, from each part) by two sketches."""
    n = table(spark, sf_dir, "lineitem").count()
    stream = synthetic.mixture(spark, n)
    best = kmers.top(stream.groupBy("value").agg(F.count(F.lit(1)).alias("cnt")), 100, "value").select("value")
    ours = sketches.misra_gries(stream, "value", 10_000).select(F.col("item").alias("value"), F.lit(1).alias("ours"))
    own = sketches.built_in_top(stream, "value", 100).select(F.col("item").alias("value"), F.lit(1).alias("own"))
    both = best.join(F.broadcast(ours), "value", "left").join(F.broadcast(own), "value", "left")  # at most 10,000 rows
    return both.agg(F.count(F.lit(1)).alias("top"), F.count("ours").alias("misra_gries"), F.count("own").alias("built_in"))


def hll_vs_exact(r: DataFrame) -> DataFrame:
    packed = kmers.packed_kmers(r, K)
    estimate = sketches.hyperloglog(packed, "packed")
    exact = kmers.count_packed(r, K).agg(F.count(F.lit(1)).alias("distinct_kmers"))
    return exact.crossJoin(F.broadcast(estimate)).select("distinct_kmers", (F.abs(F.col("estimate") / F.col("distinct_kmers") - 1) < 0.05).alias("within"))


def bloom_semi(r: DataFrame) -> DataFrame:
    """Two passes: candidates by Bloom filter, then exact counts of the candidates only."""
    packed = kmers.packed_kmers(r, K, True)
    seen = sketches.repeated_by_bloom(packed, "packed").distinct()
    counts = packed.join(seen, "packed", "left_semi").groupBy("packed").agg(F.count(F.lit(1)).alias("cnt"))
    return counts.where("cnt >= 2")


def size_estimate(r: DataFrame) -> DataFrame:
    """Reads and bases of a file of twice the reads' bytes, with all reads as the sample."""
    rows = r.select(F.concat(F.lit("@"), F.col("read_id").cast("string")).alias("id"), "seq")
    total = rows.agg(F.sum(F.length("id") + 2 * F.length("seq") + 5)).first()[0]
    return fastq.estimate(rows, 2 * (total or 0), None)


def _records(r: DataFrame) -> DataFrame:
    """FASTQ records of the reads that have letters."""
    return r.where("seq <> ''").select(F.concat(F.lit("@r"), F.col("read_id").cast("string")).alias("id"), "seq", F.regexp_replace("seq", ".", "I").alias("qual"))


def fastq_round_trip(r: DataFrame) -> DataFrame:
    path = scratch(r.sparkSession, "fastq")
    fastq.write_fastq(_records(r), path)
    return fastq.read_fastq(r.sparkSession, path)


def fasta_round_trip(r: DataFrame) -> DataFrame:
    path = scratch(r.sparkSession, "fasta")
    fastq.write_fasta(_records(r), path)
    return fastq.read_fasta(r.sparkSession, path)


def numbered_reads(r: DataFrame) -> DataFrame:
    return fastq.numbered(_records(r)).select("read_id", "id")


def count_text_round_trip(r: DataFrame) -> DataFrame:
    path = scratch(r.sparkSession, "counts")
    fastq.write_counts(kmers.count(r, K), path, 4)
    parts = F.split("value", "\t\t")
    return r.sparkSession.read.text(path).select(parts[0].alias("kmer"), parts[1].cast("long").alias("cnt"))


def ufx_text_round_trip(r: DataFrame) -> DataFrame:
    path = scratch(r.sparkSession, "ufx")
    fastq.write_extensions(ufx_codes(r), path)
    parts = F.split("value", "\t")
    return r.sparkSession.read.text(path).select(parts[0].alias("kmer"), parts[1].alias("extended"))


def table_round_trip(r: DataFrame) -> DataFrame:
    path = scratch(r.sparkSession, "table")
    fastq.write_table(_count(r), path)
    return fastq.read_table(r.sparkSession, path)


def headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header forms made from page ids: plain pairs, commented pairs, Casava with and without barcode, unpaired."""
    pages = table(spark, sf_dir, "pages").select("page_id")
    name = F.concat(F.lit("@p"), F.col("page_id").cast("string"))
    end = (F.col("page_id") % 2 + 1).cast("string")
    forms = [F.concat(name, F.lit("/"), end), F.concat(name, F.lit("/"), end, F.lit(" comment")), F.concat(name, F.lit(" "), end, F.lit(":N:0:ACGT")), F.concat(name, F.lit(" "), end, F.lit(":Y:0:")), F.concat(name, F.lit(" other"))]
    header = F.element_at(F.array(*forms), (F.col("page_id") % 5 + 1).cast("int"))
    rows = pages.select("page_id", header.alias("header"))
    paired = dna.pair_name(F.col("header"))
    return rows.select(
        "page_id", dna.trim_name(F.col("header")).alias("name"), paired.alias("paired"), dna.pair_base(paired).alias("base"), dna.pair_end(paired).cast("long").alias("end"),
        dna.pair_index(F.col("header")).cast("long").alias("pair_index"), dna.compact_id(paired, F.lit(11), F.col("page_id")).alias("compact"),
    )


def edit_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance of neighbouring items' whole texts, in UTF-8 bytes, as the SQL counts."""
    items = table(spark, sf_dir, "benchmark").select("item_id", F.decode(F.encode("text", "UTF-8"), "ISO-8859-1").alias("text"))
    after = items.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("next_text"))
    d = align.edit_distance(F.col("text"), F.col("next_text"))
    return items.join(after, "item_id").select("item_id", d.cast("long").alias("distance"), F.when(d <= 100, d).otherwise(-1).cast("long").alias("within_100"))


def edit_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Infix and prefix distances of 30 letters of each benchmark item (the query is a part by the modes' nature) to the whole item."""
    items = table(spark, sf_dir, "benchmark").select("item_id", F.substring("text", 11, 30).alias("q"), "text")
    infix, prefix = align.semiglobal_udf("infix")("q", "text"), align.semiglobal_udf("prefix")("q", "text")
    return items.select("item_id", infix.alias("i"), prefix.alias("p")).select("item_id", F.col("i.distance").alias("infix"), F.col("i.start").alias("start"), F.col("i.end").alias("end"), F.col("p.distance").alias("prefix"))


def _neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each benchmark item's text with the next item's."""
    items = table(spark, sf_dir, "benchmark").select("item_id", "text")
    after = items.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("next_text"))
    return dealt(items.join(after, "item_id").where("text is not null and next_text is not null"), 1 << 20)


def edit_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance and CIGAR of the best global alignment of neighbouring items' texts."""
    return _neighbours(spark, sf_dir).select("item_id", align.cigar(True)("text", "next_text").alias("a")).select("item_id", F.col("a.distance").alias("distance"), F.col("a.cigar").alias("cigar"))


def local_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of the best local alignment of neighbouring items' texts."""
    return _neighbours(spark, sf_dir).select("item_id", align.local_udf()("text", "next_text")["score"].alias("score"))


def d2_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = reads(spark, sf_dir)
    chats = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("read_id"), dna.text_to_dna(F.col("text")).alias("seq"))
    return align.d2(kmers.count_packed(docs, 8), kmers.count_packed(chats, 8)).select(F.col("d2").cast("long").alias("d2"))


def iupac_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark texts mapped to IUPAC letters, masked and counted."""
    seq = F.translate(F.regexp_replace(F.lower("text"), "[^a-z]", ""), "abcdefghijklmnopqrstuvwxyz", "ABCDGHKMNRSTUVWYACGTACGTAC")
    return table(spark, sf_dir, "benchmark").select("item_id", seq.alias("seq")).select("item_id", dna.mask_ambiguous(F.col("seq")).alias("masked"), dna.count_ambiguous(F.col("seq")).cast("long").alias("n"))


def pattern_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the reads hold a benchmark item's text as a whole."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("pattern_id"), dna.text_to_dna(F.col("text")).alias("pattern"))
    return align.find_patterns(reads(spark, sf_dir), items, 20)


def hash_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact public hashes of the region and nation names."""
    names = table(spark, sf_dir, "region").select(F.col("r_name").alias("name")).unionAll(table(spark, sf_dir, "nation").select(F.col("n_name").alias("name")))
    functions = {"murmur3_64": hashes.murmur3_64, "murmur2_64": hashes.murmur2_64, "murmur2_32": hashes.murmur2_32, "x31": hashes.x31}
    return names.select("name", *(hashes.hash_udf(f)("name").alias(n) for n, f in functions.items()))


def six_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark").select("item_id", dna.text_to_dna(F.col("text")).alias("seq"))
    return items.select("item_id", F.array_join(dna.six_frames(F.col("seq")), "|").alias("frames"))


def hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letters of each whole text that differ from the next letter: the text without its last one against the text without its first one."""
    items = table(spark, sf_dir, "benchmark").where(F.length("text") > 0).select("item_id", F.expr("left(text, length(text) - 1)").alias("a"), F.expr("substring(text, 2)").alias("b"))
    return items.select("item_id", align.hamming(F.col("a"), F.col("b")).cast("long").alias("distance"))


def seed_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.well_scored(read_cells.align_reads(reads(spark, sf_dir), K, LOW, HIGH))


def log_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log lines made from the parts table, parsed."""
    parts = table(spark, sf_dir, "part").select("p_partkey")
    key = F.col("p_partkey").cast("string")
    text = F.concat(F.lit("aprun -n "), key, F.lit(" -N 16 ./ufx -k 17 -i all.txt -h 7\nStage 3 Count 7."), key, F.lit(" s\nTotal count is "), key, F.lit("\n"))
    wanted = {n: runlog.FIELDS[n] for n in ("Val_k", "Val_reliable_min", "Val_reliable_max", "Num_total_mpi_tasks", "Time_count", "Num_retained")}
    return parts.select("p_partkey", text.alias("t")).select("p_partkey", *runlog.fields(F.col("t"), wanted))


def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..streaming import counts

    return counts.event_windows(table(spark, sf_dir, "events")).select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n")


def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of each user's events: gaps of over 30 minutes part them."""
    from ..streaming import counts

    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(c)
    return counts.sessions(table(spark, sf_dir, "events")).select("user_id", stamp("start"), stamp("end"), "n")


def item_kmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct 17-mers of the benchmark's texts, as DNA."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("read_id"), dna.text_to_dna(F.col("text")).alias("seq"))
    return kmers.count_packed(items, K).select("packed")


def table_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.lookup(_count(reads(spark, sf_dir)), item_kmers(spark, sf_dir), "packed").select("packed", F.coalesce("cnt", F.lit(0)).alias("cnt"))


def table_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.delete(_count(reads(spark, sf_dir)), item_kmers(spark, sf_dir), "packed")


def heavy_hitter_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.dense_index(heavy_hitter_exact(spark, sf_dir), "item")


def kmer_set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of intersection, difference and union of the reads' and the benchmark's k-mers."""
    a, b = _count(reads(spark, sf_dir)).select("packed"), item_kmers(spark, sf_dir)
    size = lambda f, name: f.agg(F.count(F.lit(1)).alias(name))
    return size(a.intersect(b), "common").crossJoin(F.broadcast(size(b.exceptAll(a), "missing"))).crossJoin(F.broadcast(size(a.union(b).distinct(), "either")))  # single rows


def interval_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shipped lines' days against orders' months, as intervals of days."""
    day = lambda c: F.datediff(F.col(c), F.lit("1970-01-01"))
    lines = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") * 37 % 5000).alias("lo"), (F.col("s_suppkey") * 37 % 5000 + 40).alias("hi"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), day("o_orderdate").cast("long").alias("lo"), (day("o_orderdate") + 3).cast("long").alias("hi"))
    start = orders.agg(F.min("lo").alias("first"))
    moved = lines.crossJoin(F.broadcast(start)).select("id", (F.col("lo") + F.col("first")).alias("lo"), (F.col("hi") + F.col("first")).alias("hi"))  # one row
    return tables.interval_join(moved, orders, 64).groupBy("id_a").agg(F.count(F.lit(1)).alias("n"))


def of_reads(function: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: function(reads(spark, sf_dir))


MIXES = (("jenkins_32", hashes.JENKINS_32, 32), ("jenkins_64", hashes.JENKINS_64, 64), ("wang_32", hashes.WANG_32, 32))

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "kmer_count": of_reads(lambda r: kmers.letters(_count(r), K)),
    "kmer_count_packed": of_reads(_count),
    "kmer_canonical_count": of_reads(lambda r: kmers.count(r, K, True)),
    "kmer_reliable": of_reads(lambda r: kmers.letters(kmers.reliable(kmers.count_packed(r, K, True), LOW, HIGH), K)),
    "kmer_histogram": of_reads(lambda r: kmers.histogram(_count(r))),
    "kmer_totals": of_reads(lambda r: kmers.totals(_count(r)).crossJoin(F.broadcast(kmers.ideal_total(r, K)))),
    "kmer_top40": of_reads(lambda r: kmers.letters(kmers.top(_count(r), 40, "packed"), K)),
    "kmer_occurrences": of_reads(lambda r: kmers.occurrences(r, K)),
    "kmer_reads_list": of_reads(kmer_reads_list),
    "kmer_neighbors": of_reads(kmer_neighbors),
    "minimizer": of_reads(lambda r: minimizer_counts(r, False)),
    "minimizer_gpu_order": of_reads(lambda r: minimizer_counts(r, True)),
    "supermers": of_reads(supermer_rows),
    "supermer_lengths": of_reads(lambda r: supermers.supermers(r, K, M).groupBy(F.col("slen").cast("long").alias("slen")).agg(F.count(F.lit(1)).alias("n"))),
    "supermer_expand_count": of_reads(lambda r: kmers.letters(supermers.count(r, K, M), K)),
    "read_overlap": of_reads(overlaps),
    "overlap_positions": of_reads(overlap_positions),
    "overlap_compare": of_reads(lambda r: overlap.compare_reads(r, K, 19, LOW, HIGH)),
    "overlap_minus_aligned": of_reads(overlap_minus),
    "tag_relabel": tag_relabel,
    "read_owner_range": read_owner_range,
    "ext_counts": of_reads(lambda r: kmers.extension_counts(r, K)),
    "ufx_codes": of_reads(ufx_codes),
    "snp_trio": of_reads(snp_trio),
    "heavy_hitter_exact": heavy_hitter_exact,
    "heavy_hitter_anti": of_reads(heavy_hitter_anti),
    "heavy_hitter_recall": of_reads(heavy_hitter_recall),
    "top100_recall": top100_recall,
    "hll_vs_exact": of_reads(hll_vs_exact),
    "bloom_semi": of_reads(bloom_semi),
    "count_gt_threshold": of_reads(lambda r: kmers.letters(_count(r).where("cnt > 4"), K)),
    "min_max_count": of_reads(lambda r: _count(r).agg(F.min("cnt").alias("least"), F.max("cnt").alias("most"))),
    "load_imbalance": of_reads(lambda r: kmers.load_imbalance(_count(r), PARTS)),
    "ambiguous_fraction": of_reads(lambda r: r.agg((F.sum(F.length("seq") - F.length(F.replace("seq", F.lit("N"), F.lit("")))) / F.sum(F.length("seq"))).alias("fraction"))),
    "length_stats": of_reads(lambda r: r.agg(F.max(F.length("seq")).cast("long").alias("longest"), F.count(F.lit(1)).alias("n"), F.sum(F.length("seq")).alias("bases"))),
    "size_estimate": of_reads(size_estimate),
    "fastq_round_trip": of_reads(fastq_round_trip),
    "fasta_round_trip": of_reads(fasta_round_trip),
    "numbered_reads": of_reads(numbered_reads),
    "count_text_round_trip": of_reads(count_text_round_trip),
    "ufx_text_round_trip": of_reads(ufx_text_round_trip),
    "table_round_trip": of_reads(table_round_trip),
    "integer_mixes": lambda spark, sf_dir: table(spark, sf_dir, "part").select("p_partkey", *(hashes.mix_udf(s, b)("p_partkey").alias(n) for n, s, b in MIXES)),
    "header_parse": headers,
    "fold_sequence": of_reads(lambda r: r.select("read_id", dna.fold(F.col("seq")).alias("folded"))),
    "edit_distance": edit_distance,
    "edit_modes": edit_modes,
    "edit_paths": edit_paths,
    "local_scores": local_scores,
    "d2_score": d2_score,
    "value_histogram": lambda spark, sf_dir: table(spark, sf_dir, "events").groupBy(F.floor(F.col("value") / 100).cast("long").alias("bucket")).agg(F.count(F.lit(1)).alias("n")),
    "iupac_mask": iupac_mask,
    "twin_union": of_reads(lambda r: variants.with_twins(kmers.count(r, 11))),
    "pattern_search": pattern_search,
    "hash_values": hash_values,
    "six_frames": six_frames,
    "hamming": hamming,
    "seed_alignment": seed_alignment,
    "log_fields": log_fields,
    "event_windows": event_windows,
    "event_sessions": event_sessions,
    "table_lookup": table_lookup,
    "table_delete": table_delete,
    "heavy_hitter_index": heavy_hitter_index,
    "kmer_set_operations": kmer_set_operations,
    "interval_overlaps": interval_overlaps,
    "prefix_groups": of_reads(lambda r: tables.prefix_groups(kmers.count(r, K))),
    "markov_model": of_reads(lambda r: tables.markov(kmers.count(r, 6), 6)),
    "neighbours_present": of_reads(lambda r: tables.neighbours_present(kmers.letters(kmers.reliable(_count(r), LOW, HIGH).select("packed"), K))),
    "supermer_expand_rows": of_reads(lambda r: supermers.expand(supermers.supermers(r, K, M, with_bases=True), K).groupBy("packed").agg(F.count(F.lit(1)).alias("cnt"))),
    "range_owner": of_reads(lambda r: tables.range_owners(_count(r), PARTS)),
}

_READS = "select doc_id + 1 as read_id, translate(regexp_replace(lower(text), '[^a-z]', '', 'g'), 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTANCGTACGNTACGTANCN') as seq from documents"


def _kmers(k: int = K, source: str = _READS, name: str = "kmers") -> str:
    return f"""{name} as (select * from (select read_id, pos, substr(seq, pos + 1, {k}) as kmer from
  (select read_id, seq, unnest(range(0, length(seq) - {k} + 1)) as pos from ({source}) r where length(seq) >= {k})) x where instr(kmer, 'N') = 0)"""


_PACKED = f"list_sum(list_transform(range(0, {K}), lambda i: (strpos('ACGT', substr(kmer, i + 1, 1)) - 1) * (1::bigint << (2 * ({K} - 1 - i)))))::bigint"
_REP = "least(kmer, reverse(translate(kmer, 'ACGT', 'TGCA')))"
_COUNT = "select kmer, count(*) as cnt from kmers group by kmer"
_RELIABLE = f"select {_REP} as kmer, count(*) as cnt from kmers group by 1 having count(*) between {LOW} and {HIGH}"
_MINI = f"list_min(list_transform(range(1, {K - M + 1}), lambda i: substr(kmer, i, {M})))"
_SUPER = f"""{_kmers()}, m as (select read_id, pos, pos // {32 - K} as win, {_MINI} as minimizer from kmers),
b as (select *, case when lag(minimizer) over w = minimizer and lag(pos) over w = pos - 1 then 0 else 1 end as brk from m window w as (partition by read_id, win order by pos)),
i as (select *, sum(brk) over (partition by read_id, win order by pos) as isl from b),
s as (select read_id, min(pos)::bigint as start, ({K - 1} + count(*))::bigint as slen, minimizer from i group by read_id, win, isl, minimizer)"""


def _overlaps(k: int, suffix: str = "") -> str:
    return f"""{_kmers(k, name=f'kmers{suffix}')}, reps{suffix} as (select read_id, pos, {_REP} as rep from kmers{suffix}),
good{suffix} as (select rep from reps{suffix} group by rep having count(*) between {LOW} and {HIGH}),
f{suffix} as (select reps{suffix}.* from reps{suffix} join good{suffix} using (rep)),
o{suffix} as (select a.read_id as r1, b.read_id as r2, count(*) as shared from f{suffix} a join f{suffix} b on a.rep = b.rep and a.read_id < b.read_id group by 1, 2)"""


_EXT = "select kmer, " + ", ".join(f"count(*) filter ({s} = '{b}') as {s}{b.lower()}" for s in "lr" for b in "ACGT") + ", count(*) as cnt from e group by kmer"
_EXTENDED = f"""e as (select * from (select substr(seq, pos + 1, {K}) as kmer, case when pos > 0 then substr(seq, pos, 1) end as l, case when pos + {K} < length(seq) then substr(seq, pos + {K} + 1, 1) end as r
  from (select seq, unnest(range(0, length(seq) - {K} + 1)) as pos from ({_READS}) x where length(seq) >= {K})) y where instr(kmer, 'N') = 0)"""
_SIDE = lambda s: f"list_reverse_sort([{', '.join(f"({s}{b.lower()} * 8 + {i})" for i, b in enumerate('ACGT'))}])"
_BASE = lambda s: f"substr('ACGT', ({_SIDE(s)}[1] % 8)::int + 1, 1)"
_NTH = lambda s, i: f"({_SIDE(s)}[{i}] // 8)"
_CODE = lambda s: f"case when {_NTH(s, 2)} >= {DMIN} then 'F' when {_NTH(s, 1)} < {DMIN} then 'X' else {_BASE(s)} end"

_TRIO = lambda i, name: f"""{_kmers(11, f'select * from ({_READS}) q where read_id % 3 = {i}', f'k{name}')}, {name} as (select kmer, sum(cnt)::bigint as cnt from
  (select kmer, count(*) as cnt from k{name} group by kmer union all select reverse(translate(kmer, 'ACGT', 'TGCA')), count(*) from k{name} group by kmer) t group by kmer)"""  # noqa: E731



def _distances(name: str, source: str, infix: bool) -> str:
    """Recursive tables of the rows of distances of q's beginnings to t's beginnings (in infix mode from any start), by item; the last one is of the whole q."""
    first = "list_transform(range(0, length(t) + 1), lambda j: 0)" if infix else "range(0, length(t) + 1)"
    return f"""{name}rows as (select item_id, q, t, 0 as i, {first} as row from {source} union all
  select item_id, q, t, i + 1, list_transform(range(1, len(g) + 1), lambda j: list_min(g[1:j]) + j - 1) from (select *, list_transform(range(0, length(t) + 1), lambda j: case when j = 0 then i + 1 else least(row[j + 1] + 1, row[j] + (t[j] <> q[i + 1])::bigint) end - j) as g
  from {name}rows where i < length(q)) x), {name}last as (select item_id, row from {name}rows where i = length(q))"""


def _local_rows(source: str) -> str:
    """Recursive table of the rows of local alignment scores (1, -1, -1)."""
    return f"""rows as (select item_id, q, t, 0 as i, list_transform(range(0, length(t) + 1), lambda j: 0::bigint) as row from {source} union all
  select item_id, q, t, i + 1, list_transform(range(1, len(g) + 1), lambda j: list_max(g[1:j]) - j + 1) from (select *, list_transform(range(0, length(t) + 1), lambda j: case when j = 0 then 0 else greatest(row[j + 1] - 1, row[j] + case when t[j] = q[i + 1] then 1 else -1 end, 0) end + j) as g
  from rows where i < length(q)) x)"""


# Factors of the published hashes, for their SQL on names of at most 15 bytes.
_M2, _N2, _C1, _C2, _F1, _F2 = 0xC6A4A7935BD1E995, 0x5BD1E995, 0x87C37B91114253D5, 0x4CF5AD432745937F, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53


def _little(part: str) -> str:
    return f"coalesce(list_sum(list_transform({part}, lambda x, i: (x::hugeint << (8 * (i - 1))::int)))::uhugeint, 0::uhugeint)"


def _chunks(size: int) -> str:
    return f"list_transform(range(0, n // {size}), lambda j: {_little(f'b[j * {size} + 1:j * {size} + {size}]')})"


def _tail(size: int) -> str:
    return _little(f"b[n // {size} * {size} + 1:]")


def _shifted(x: str, by: int) -> str:
    return f"xor({x}, {x} >> {by})"


def _rotated(x: str, by: int) -> str:
    return f"(({x} * {2**by}::uhugeint) % {2**64} + ({x} >> {64 - by}))"


def _signed(x: str) -> str:
    return f"case when {x} >= {2**63} then ({x}::hugeint - {2**64})::bigint else {x}::bigint end"


def _mix_sql(name: str, steps, bits: int) -> str:
    """Common table of an integer mix of the part keys, in unsigned 128-bit numbers modulo 2^bits."""
    out, most = "select p_partkey, p_partkey::uhugeint as x from part", 2**bits
    for how, shift in steps:
        shifted = f"x * {2**shift} % {most}"
        step = f"xor(x, x >> {shift})" if how == "^" else f"(x + {shifted}) % {most}" if how == "+" else f"(x + ({most - 1} - {shifted})) % {most}"
        out = f"select p_partkey, {step} as x from ({out})"
    signed = f"case when x >= {2**63} then (x::hugeint - {2**64})::bigint else x::bigint end" if bits == 64 else "x::bigint"
    return f"{name} as (select p_partkey, {signed} as {name} from ({out}))"


_ITEMS = _READS.replace("doc_id + 1", "item_id").replace("documents", "benchmark")

ORACLE: dict[str, str] = {
    "kmer_count": f"with {_kmers()} {_COUNT}",
    "kmer_count_packed": f"with {_kmers()}, c as ({_COUNT}) select {_PACKED} as packed, cnt from c",
    "kmer_canonical_count": f"with {_kmers()} select {_REP} as kmer, count(*) as cnt from kmers group by 1",
    "kmer_reliable": f"with {_kmers()} {_RELIABLE}",
    "kmer_histogram": f"with {_kmers()}, c as ({_COUNT}) select cnt, count(*) as n from c group by cnt",
    "kmer_totals": f"with {_kmers()}, c as ({_COUNT}) select count(*) as distinct_kmers, sum(cnt)::bigint as total_kmers, (select count(*) from kmers) as ideal_total from c",
    "kmer_top40": f"with {_kmers()} {_COUNT} order by cnt desc, kmer desc limit 40",
    "kmer_occurrences": f"with {_kmers()} select read_id, pos::int as pos, kmer from kmers",
    "kmer_reads_list": f"with {_kmers()} select {_REP} as kmer, count(*) as cnt, string_agg(read_id || ':' || pos, ',' order by read_id, pos) as places from kmers group by 1 having count(*) between {LOW} and {HIGH}",
    "kmer_neighbors": f"""with {_kmers()}, g as ({_RELIABLE}), i as (select kmer, unnest(range(0, 8)) as i from g)
select kmer, i, case when i < 4 then substr(kmer, 2) || substr('ACGT', (i + 1)::int, 1) else substr('ACGT', (i - 3)::int, 1) || left(kmer, {K - 1}) end as link from i""",
    "minimizer": f"with {_kmers()} select {_MINI} as minimizer, count(*) as n from kmers group by 1",
    "minimizer_gpu_order": f"with {_kmers()}, g as (select translate(kmer, 'ACGT', 'BADC') as kmer from kmers) select {_MINI} as minimizer, count(*) as n from g group by 1",
    "supermers": f"with {_SUPER} select * from s",
    "supermer_lengths": f"with {_SUPER} select slen, count(*) as n from s group by slen",
    "supermer_expand_count": f"with {_kmers()} {_COUNT}",
    "read_overlap": f"with {_overlaps(K)} select * from o",
    "overlap_positions": f"with {_overlaps(K)} select a.read_id as r1, b.read_id as r2, string_agg(a.pos || '-' || b.pos, ',' order by a.pos, b.pos) as seeds from f a join f b on a.rep = b.rep and a.read_id < b.read_id group by 1, 2",
    "overlap_compare": f"""with {_overlaps(K)}, {_overlaps(19, '2')} select count(o.shared) as total_first, count(o2.shared) as total_second, count(*) filter (o.shared is not null and o2.shared is not null) as hits,
count(*) filter (o.shared is null) as misses, count(*) filter (o.shared <> o2.shared) as mismatches from o full join o2 on o.r1 = o2.r1 and o.r2 = o2.r2""",
    "overlap_minus_aligned": f"with {_overlaps(K)} select * from o where shared < 10",
    "tag_relabel": f"with {_overlaps(K)}, t as (select doc_id + 1 as id, source || '/' || doc_id as tag from documents) select a.tag as tag_r1, b.tag as tag_r2, shared from o join t a on a.id = r1 join t b on b.id = r2",
    "read_owner_range": f"""with s as (select ((doc_id + 1) * 7) % {PARTS} as owner, count(*) as n from documents group by 1), b as (select owner, sum(n) over (order by owner) as high, n from s)
select doc_id + 1 as read_id, owner from documents join b on high - n < doc_id + 1 and doc_id + 1 <= high""",
    "ext_counts": f"with {_EXTENDED} {_EXT}",
    "ufx_codes": f"""with {_EXTENDED}, x as ({_EXT}) select kmer, cnt, {_BASE('l')} || '[' || {_NTH('l', 2)} || ',' || {_NTH('l', 1)} || ']' || {_BASE('r')} || '[' || {_NTH('r', 2)} || ',' || {_NTH('r', 1)} || ']' as extended,
({_CODE('l')}) || ({_CODE('r')}) as code from x""",
    "ufx_text_round_trip": f"""with {_EXTENDED}, x as ({_EXT}) select kmer, {_BASE('l')} || '[' || {_NTH('l', 2)} || ',' || {_NTH('l', 1)} || ']' || {_BASE('r')} || '[' || {_NTH('r', 2)} || ',' || {_NTH('r', 1)} || ']' as extended from x""",
    "snp_trio": f"""with {_TRIO(0, 'os')}, {_TRIO(1, 'pa')}, {_TRIO(2, 'pb')}, two as (select left(kmer, 10) as prefix, min(kmer) as a, max(kmer) as b from os group by 1 having count(*) = 2 and min(cnt) >= 1 and max(cnt) <= 50),
side as (select prefix, a as x, b as y from two union all select prefix, b, a from two)
select prefix, right(x, 1) as base_x, pa.cnt as p1cnt, ox.cnt as oscnt_x, right(y, 1) as base_y, pb.cnt as p2cnt, oy.cnt as oscnt_y from side join os ox on ox.kmer = x join os oy on oy.kmer = y join pa on pa.kmer = x join pb on pb.kmer = y
where y not in (select kmer from pa) and x not in (select kmer from pb)""",
    "heavy_hitter_exact": "select l_partkey as item, count(*) as cnt from lineitem group by 1 order by cnt desc, item desc limit 100",
    "heavy_hitter_anti": f"with {_kmers()}, c as ({_COUNT}), h as (select kmer from c order by cnt desc, kmer desc limit 40) select {_PACKED} as packed, cnt from c anti join h using (kmer)",
    "heavy_hitter_recall": f"with {_kmers(6)}, c as ({_COUNT}) select count(*) as heavy, count(*) as found from c where cnt * 256 > (select sum(cnt) from c)",
    "hll_vs_exact": f"with {_kmers()} select count(distinct kmer) as distinct_kmers, true as within from kmers",
    "bloom_semi": f"with {_kmers()}, c as (select {_REP} as kmer, count(*) as cnt from kmers group by 1 having count(*) >= 2) select {_PACKED} as packed, cnt from c",
    "count_gt_threshold": f"with {_kmers()} {_COUNT} having count(*) > 4",
    "min_max_count": f"with {_kmers()}, c as ({_COUNT}) select min(cnt) as least, max(cnt) as most from c",
    "load_imbalance": f"with {_kmers()}, c as ({_COUNT}), o as (select {_PACKED} % {PARTS} as o, count(*) as n from c group by 1) select max(n) as largest, sum(n)::bigint as total, {PARTS}::bigint as parts from o",
    "ambiguous_fraction": f"with r as ({_READS}) select sum(length(seq) - length(replace(seq, 'N', ''))) / sum(length(seq)) as fraction from r",
    "length_stats": f"with r as ({_READS}) select max(length(seq)) as longest, count(*) as n, sum(length(seq))::bigint as bases from r",
    "size_estimate": f"with r as ({_READS}), t as (select count(*) as n, sum(length('@' || read_id) + 2 * length(seq) + 5)::bigint as b, sum(length(seq))::bigint as s from r) select (2 * b * n + b - 1) // b as reads, (2 * b * s + b - 1) // b as bases from t",
    "header_parse": """with p as (select page_id, '@p' || page_id as n, (page_id % 2 + 1)::bigint as e, page_id % 5 as f from pages)
select page_id, case when f < 2 then n || '/' || e else n end as name, case when f < 4 then n || '/' || e else n end as paired, n as base, case when f < 4 then e else 0 end as end,
case when f < 2 then length(n) + 1 when f < 4 then length(n) + 1 else 0 end as pair_index, '@0b' || lower(hex(page_id)) || case when f < 4 then '/' || e else '' end as compact from p""",
    "fold_sequence": f"with r as ({_READS}) select read_id, regexp_replace(rtrim(regexp_replace(seq, '(.{{50}})', '\\1' || chr(10), 'g'), chr(10)), '$', '') || chr(10) as folded from r",
    "edit_distance": "with t as (select item_id, text from benchmark) select a.item_id, levenshtein(a.text, b.text) as distance, case when levenshtein(a.text, b.text) <= 100 then levenshtein(a.text, b.text) else -1 end as within_100 from t a join t b on b.item_id = a.item_id + 1",
    "d2_score": f"""with {_kmers(8)}, {_kmers(8, _READS.replace('doc_id + 1', 'conv_id').replace('documents', 'conversations'), 'chats')}, a as (select kmer, count(*) as x from kmers group by 1), b as (select kmer, count(*) as y from chats group by 1)
select sum(x * y)::bigint as d2 from a join b using (kmer)""",
    "value_histogram": "select floor(value / 100)::bigint as bucket, count(*) as n from events group by 1",
    "iupac_mask": """with r as (select item_id, translate(regexp_replace(lower(text), '[^a-z]', '', 'g'), 'abcdefghijklmnopqrstuvwxyz', 'ABCDGHKMNRSTUVWYACGTACGTAC') as seq from benchmark)
select item_id, translate(seq, 'RYKMSWBDHV', 'NNNNNNNNNN') as masked, length(regexp_replace(seq, '[^RYKMSWBDHV]', '', 'g')) as n from r""",
    "twin_union": f"with {_kmers(11)}, c as ({_COUNT}) select kmer, sum(cnt)::bigint as cnt from (select * from c union all select reverse(translate(kmer, 'ACGT', 'TGCA')), cnt from c) t group by kmer",
    "pattern_search": f"""with r as ({_READS}), p as (select item_id as pattern_id, translate(regexp_replace(lower(text), '[^a-z]', '', 'g'), 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTANCGTACGNTACGTANCN') as pattern from benchmark),
a as (select read_id, unnest(range(0, length(seq) - 19)) as pos, seq from r where length(seq) >= 20), q as (select *, left(pattern, 20) as k from p where length(pattern) >= 20)
select read_id, pattern_id, pos from a join q on substr(seq, pos + 1, 20) = k where substr(seq, pos + 1, length(pattern)) = pattern""",
    "hamming": "select item_id, coalesce(list_sum(list_transform(range(1, length(text)), lambda i: (substr(text, i, 1) <> substr(text, i + 1, 1))::int)), 0)::bigint as distance from benchmark where length(text) > 0",
    "six_frames": f"""with r as (select item_id, seq, reverse(translate(seq, 'ACGT', 'TGCA')) as rc from ({_ITEMS.replace('as read_id', 'as item_id')}) q),
f as (select item_id, [seq, seq[2:], seq[3:], rc, rc[2:], rc[3:]] as s from r)
select item_id, array_to_string(list_transform(s, lambda x: array_to_string(list_transform(range(1, length(x) - 1, 3), lambda i: case when regexp_full_match(x[i:i + 2], '[ACGT]{{3}}')
  then substr('{dna.CODONS}', (strpos('ACGT', x[i]) - 1) * 16 + (strpos('ACGT', x[i + 1]) - 1) * 4 + strpos('ACGT', x[i + 2]), 1) else 'X' end), '')), '|') as frames from f""",
    "log_fields": "select p_partkey, '17' as Val_k, '2' as Val_reliable_min, '7' as Val_reliable_max, p_partkey::varchar as Num_total_mpi_tasks, '7.' || p_partkey as Time_count, p_partkey::varchar as Num_retained from part",
    "table_lookup": f"with {_kmers()}, c as ({_COUNT}), {_kmers(K, _ITEMS, 'items')}, k as (select distinct kmer from items) select {_PACKED} as packed, coalesce(cnt, 0) as cnt from k left join c using (kmer)",
    "table_delete": f"with {_kmers()}, c as ({_COUNT}), {_kmers(K, _ITEMS, 'items')} select {_PACKED} as packed, cnt from c where kmer not in (select kmer from items)",
    "heavy_hitter_index": "select item, cnt, row_number() over (order by item) - 1 as index from (select l_partkey as item, count(*) as cnt from lineitem group by 1 order by cnt desc, item desc limit 100) t",
    "kmer_set_operations": f"""with {_kmers()}, {_kmers(K, _ITEMS, 'items')}, a as (select distinct kmer from kmers), b as (select distinct kmer from items)
select (select count(*) from a where kmer in (select kmer from b)) as common, (select count(*) from b where kmer not in (select kmer from a)) as missing, (select count(*) from (select kmer from a union select kmer from b) u) as either""",
    "interval_overlaps": """with o as (select date_diff('day', date '1970-01-01', o_orderdate::date) as lo from orders), f as (select min(lo) as first from o),
s as (select s_suppkey as id_a, s_suppkey * 37 % 5000 + first as lo, s_suppkey * 37 % 5000 + 40 + first as hi from supplier, f)
select id_a, count(*) as n from s join o on o.lo < s.hi and s.lo < o.lo + 3 group by 1""",
    "prefix_groups": f"with {_kmers()}, c as ({_COUNT}) select left(kmer, {K - 1}) as prefix, count(*) as n from c group by 1 having count(*) > 1",
    "markov_model": f"with {_kmers(6)}, c as ({_COUNT}) select left(kmer, 5) as context, right(kmer, 1) as base, cnt, cnt / sum(cnt) over (partition by left(kmer, 5)) as p from c",
    "neighbours_present": f"""with {_kmers()}, g as ({_COUNT} having count(*) between {LOW} and {HIGH}), i as (select kmer, unnest(range(0, 8)) as i from g),
l as (select kmer, case when i < 4 then substr(kmer, 2) || substr('ACGT', (i + 1)::int, 1) else substr('ACGT', (i - 3)::int, 1) || left(kmer, {K - 1}) end as link from i)
select l.kmer, count(*) as n from l join g on g.kmer = l.link group by 1""",
    "supermer_expand_rows": f"with {_kmers()}, c as ({_COUNT}) select {_PACKED} as packed, cnt from c",
    "range_owner": f"""with {_kmers()}, c as ({_COUNT}), p as (select {_PACKED}::uhugeint as x from c), a as (select xor(x, x >> 33) * 18397679294719823053 % {2**64} as x from p),
b as (select xor(x, x >> 33) * 14181476777654086739 % {2**64} as x from a), d as (select xor(x, x >> 33) as x from b) select (x * {PARTS} // {2**64})::bigint as owner, count(*) as n from d group by 1""",
    "fastq_round_trip": f"with r as ({_READS}) select '@r' || read_id as id, seq, repeat('I', length(seq)) as qual from r where seq <> ''",
    "fasta_round_trip": f"with r as ({_READS}) select 'r' || read_id as id, seq from r where seq <> ''",
    "numbered_reads": f"with r as ({_READS}) select row_number() over (order by '@r' || read_id) as read_id, '@r' || read_id as id from r where seq <> ''",
    "count_text_round_trip": f"with {_kmers()} {_COUNT} having count(*) > 4",
    "table_round_trip": f"with {_kmers()}, c as ({_COUNT}) select {_PACKED} as packed, cnt from c",
    "edit_modes": f"""
with recursive t as (select item_id, substr(text, 11, 30) as q, text as t from benchmark), {_distances('inner_', 't', True)}, {_distances('prefix_', 't', False)},
found as (select t.*, list_min(i.row) as infix, list_position(i.row, list_min(i.row)) - 1 as cut, list_min(p.row) as prefix from t join inner_last i using (item_id) join prefix_last p using (item_id)),
turned as (select item_id, reverse(q) as q, reverse(t[1:cut]) as t from found), {_distances('back_', 'turned', False)}
select item_id, infix::int as infix, case when cut = 0 then 0 else cut - (len(b.row) - list_position(list_reverse(b.row), list_min(b.row))) end::int as start, (cut - 1)::int as end, prefix::int as prefix from found join back_last b using (item_id)""",
    "local_scores": f"""
with recursive t as (select a.item_id, a.text as q, b.text as t from benchmark a join benchmark b on b.item_id = a.item_id + 1), {_local_rows('t')}
select item_id, coalesce(max(list_max(row)), 0)::int as score from rows group by item_id""",
    "hash_values": f"""
with names as (select r_name as name from region union all select n_name from nation),
b as (select name, list_transform(range(1, length(name) + 1), lambda i: ascii(substr(name, i, 1))::uhugeint) as b, length(name) as n from names),
x as (select name, list_reduce(list_prepend(0::uhugeint, b), lambda h, c: (h * 31 + c) % {2**32})::bigint as x31 from b),
m2 as (select name, {_chunks(8)} as c, {_tail(8)} as tail, n % 8 > 0 as more, xor({0x3FB0BB5F}::uhugeint, n::uhugeint * {_M2} % {2**64}) as h from b),
m2a as (select *, list_reduce(list_prepend(h, c), lambda h, k: xor(h, {_shifted(f'(k * {_M2} % {2**64})', 47)} * {_M2} % {2**64}) * {_M2} % {2**64}) as g from m2),
m2b as (select name, case when more then xor(g, tail) * {_M2} % {2**64} else g end as g from m2a),
m2c as (select name, {_shifted('g', 47)} * {_M2} % {2**64} as g from m2b),
m2d as (select name, {_signed(_shifted('g', 47))} as murmur2_64 from m2c),
n2 as (select name, {_chunks(4)} as c, {_tail(4)} as tail, n % 4 > 0 as more, xor({0x3FB0BB5F}::uhugeint, n::uhugeint) as h from b),
n2a as (select *, list_reduce(list_prepend(h, c), lambda h, k: xor(h * {_N2} % {2**32}, {_shifted(f'(k * {_N2} % {2**32})', 24)} * {_N2} % {2**32})) as g from n2),
n2b as (select name, case when more then xor(g, tail) * {_N2} % {2**32} else g end as g from n2a),
n2c as (select name, {_shifted('g', 13)} * {_N2} % {2**32} as g from n2b),
n2d as (select name, {_shifted('g', 15)}::bigint as murmur2_32 from n2c),
m3 as (select name, n, {_little('b[1:8]')} as k1, {_little('b[9:15]')} as k2 from b where n < 16),
m3a as (select name, n, xor(313::uhugeint, {_rotated(f'(k1 * {_C1} % {2**64})', 31)} * {_C2} % {2**64}) as h1, case when n > 8 then xor(313::uhugeint, {_rotated(f'(k2 * {_C2} % {2**64})', 33)} * {_C1} % {2**64}) else 313::uhugeint end as h2 from m3),
m3b as (select name, (xor(h1, n::uhugeint) + xor(h2, n::uhugeint)) % {2**64} as h1, xor(h2, n::uhugeint) as h2 from m3a),
m3c as (select name, h1, (h1 + h2) % {2**64} as h2 from m3b),
m3d as (select name, {_shifted('h1', 33)} * {_F1} % {2**64} as h1, {_shifted('h2', 33)} * {_F1} % {2**64} as h2 from m3c),
m3e as (select name, {_shifted('h1', 33)} * {_F2} % {2**64} as h1, {_shifted('h2', 33)} * {_F2} % {2**64} as h2 from m3d),
m3f as (select name, ({_shifted('h1', 33)} + {_shifted('h2', 33)}) % {2**64} as h from m3e),
m3g as (select name, {_signed('h')} as murmur3_64 from m3f)
select * from m3g join m2d using (name) join n2d using (name) join x using (name)""",
    "integer_mixes": "with " + ", ".join(_mix_sql(n, steps, bits) for n, steps, bits in MIXES) + " select * from jenkins_32 join jenkins_64 using (p_partkey) join wang_32 using (p_partkey)",
    "event_sessions": """
        with m as (select user_id, ts, case when ts <= lag(ts) over (partition by user_id order by ts) + interval 30 minutes then 0 else 1 end as fresh from events where ts is not null),
        s as (select user_id, ts, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as k from m)
        select user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') as start, strftime(max(ts) + interval 30 minutes, '%Y-%m-%d %H:%M:%S.%f') as "end", count(*) as n from s group by user_id, k""",
    "event_windows": "select strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') as start, event_type, count(*) as n from events group by 1, 2",
}
