"""Synthetic heavy-hitter stream: exponential (mean 1.8) and two normal (5, 1 and 7.5, 1) parts, times 1000, cut to whole positive numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def mixture(spark: SparkSession, n: int, seed: int = 1) -> DataFrame:
    rows = spark.range(n)
    parts = [-F.log(1 - F.rand(seed)) * 1.8, F.randn(seed + 1) + 5, F.randn(seed + 2) + 7.5]
    values = rows.select(F.explode(F.array(*((p * 1000).cast("long") for p in parts))).alias("value"))
    return values.where("value > 0")
