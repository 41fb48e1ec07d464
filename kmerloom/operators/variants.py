"""Extension codes and trio SNP candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dna


def best_extension(counts: dict[str, Column]) -> Column:
    """Struct (base, second, best): most frequent base and the two largest counts; ties go to the later letter."""
    order = F.sort_array(F.array(*(F.struct(c.cast("long").alias("n"), F.lit(b).alias("base")) for b, c in counts.items())), asc=False)
    return F.struct(order[0]["base"].alias("base"), order[1]["n"].alias("second"), order[0]["n"].alias("best"))


def extended_code(left: Column, right: Column) -> Column:
    """Like ``G[2,10]C[3,14]``."""
    part = lambda e: F.concat(e["base"], F.lit("["), e["second"].cast("string"), F.lit(","), e["best"].cast("string"), F.lit("]"))
    return F.concat(part(left), part(right))


def code(extension: Column, dmin: int) -> Column:
    """F if the second count reaches dmin, X if the best one doesn't, else the base."""
    return F.when(extension["second"] >= dmin, "F").when(extension["best"] < dmin, "X").otherwise(extension["base"])


def ufx(extensions: DataFrame, dmin: int) -> DataFrame:
    left = best_extension({b: F.col(f"l{b.lower()}") for b in "ACGT"})
    right = best_extension({b: F.col(f"r{b.lower()}") for b in "ACGT"})
    both = extensions.select("kmer", "cnt", left.alias("l"), right.alias("r"))
    return both.select("kmer", "cnt", extended_code(F.col("l"), F.col("r")).alias("extended"), F.concat(code(F.col("l"), dmin), code(F.col("r"), dmin)).alias("code"))


def with_twins(counts: DataFrame) -> DataFrame:
    """k-mers and their reverse complements, counts added where both were there."""
    both = counts.unionAll(counts.select(dna.reverse_complement(F.col("kmer")).alias("kmer"), "cnt"))
    return both.groupBy("kmer").agg(F.sum("cnt").alias("cnt"))


def trio_snps(offspring: DataFrame, first: DataFrame, second: DataFrame, low: int = 40, high: int = 50) -> DataFrame:
    """prefix, base_x, p1cnt, oscnt_x, base_y, p2cnt, oscnt_y.

    Exactly two k-mers of the offspring share all bases but the last, both counts are in [low, high]; one is in the
    first parent only, the other in the second only. Frames have kmer and cnt.
    """
    pair = offspring.select(F.expr("left(kmer, length(kmer) - 1)").alias("prefix"), F.struct(F.expr("right(kmer, 1)").alias("base"), "kmer", "cnt").alias("x"))
    two = pair.groupBy("prefix").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("a"), F.max("x").alias("b"))
    two = two.where((F.col("n") == 2) & F.col("a.cnt").between(low, high) & F.col("b.cnt").between(low, high))
    sides = two.select("prefix", F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("y")), F.struct(F.col("b").alias("x"), F.col("a").alias("y")))).alias("s")).select("prefix", "s.*")
    sides = sides.select("prefix", "x", "y", F.col("x.kmer").alias("kx"), F.col("y.kmer").alias("ky"))
    p1, p2 = first.select(F.col("kmer").alias("k1"), F.col("cnt").alias("p1cnt")), second.select(F.col("kmer").alias("k2"), F.col("cnt").alias("p2cnt"))
    found = sides.join(p1, F.col("kx") == F.col("k1")).join(p2, F.col("ky") == F.col("k2"))
    found = found.join(p1.select("k1").withColumnRenamed("k1", "k3"), F.col("ky") == F.col("k3"), "left_anti").join(p2.select("k2").withColumnRenamed("k2", "k4"), F.col("kx") == F.col("k4"), "left_anti")
    return found.select("prefix", F.col("x.base").alias("base_x"), "p1cnt", F.col("x.cnt").alias("oscnt_x"), F.col("y.base").alias("base_y"), "p2cnt", F.col("y.cnt").alias("oscnt_y"))
