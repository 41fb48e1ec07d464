"""Session helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.session import importable, mark, release, saved  # noqa: F401


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def map_arrow(frame: DataFrame, schema: str, function: Callable[[pa.RecordBatch], Iterator[dict | pa.RecordBatch]]) -> DataFrame:
    """mapInArrow of a function that turns one batch into record batches."""

    def run(batches):
        for batch in batches:
            yield from function(batch)

    return stream_arrow(frame, schema, run)


def stream_arrow(frame: DataFrame, schema: str, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """mapInArrow of a function that turns a partition's batches into record batches."""
    importable(frame.sparkSession)
    return frame.mapInArrow(function, schema)


def clean_texts(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Id as long and text as string under fixed names, whatever other columns there are."""
    return documents.select(F.col(f"`{id_column}`").cast("long").alias("doc_id"), F.col(f"`{text_column}`").cast("string").alias("text"))


def joined(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """A sort-merge join: for sides that grow with the corpus, so that none is ever broadcast."""
    return left.join(right.hint("merge"), on, how)


def of_groups(rows: DataFrame, groups: DataFrame, keys: list[str], n: int) -> DataFrame:
    """Rows with the columns of their group (keys, size, ...); rows without one go.

    Groups of over 1/n of all rows are n at most: they are broadcast, so that no task gathers one. The rest is a sort-merge join.
    """
    total = rows.count()
    hot, rest = F.broadcast(groups.where(F.col("size") * n > total)), groups.where(F.col("size") * n <= total)
    return rows.join(hot, keys).unionByName(joined(rows.join(hot.select(*keys), keys, "left_anti"), rest, keys))
