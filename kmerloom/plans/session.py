"""Session helpers."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parents[2])


def importable(spark: SparkSession) -> None:
    """Lets Python workers on this machine import the package from where the driver has it.

    On a cluster whose workers lack this path, ship the package with ``--py-files`` or install it.
    """
    environment = spark.sparkContext.environment
    known = environment.get("PYTHONPATH", "")
    if ROOT not in known.split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join(x for x in (known, ROOT) if x)


def session(name: str = "kmerloom", cpus: str = "*", **conf: str) -> SparkSession:
    """A local session with the settings that the queries assume: UTC, adaptive execution, few shuffle partitions."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(name)
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"} | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    importable(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster; a local one only where none is set and the master is local (tests, local runs)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        context = spark.sparkContext
        kept = context._jsc.sc().getCheckpointDir()
        found = kept.get() if kept.isDefined() else None
        if not found:
            if not re.match(r"local(\[|$)", context.master):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            found = tempfile.mkdtemp(prefix="checkpoints-")
            context.setCheckpointDir(found)
    return found


_written: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, known to ``release``."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def saved(frame: DataFrame, name: str) -> DataFrame:
    """The frame, written to the shared folder and read again: cuts lineage and survives lost executors."""
    spark = frame.sparkSession
    path = scratch(spark, name)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def dealt(frame: DataFrame, least: int = 32 << 20) -> DataFrame:
    """The rows of a scan of under ``least`` bytes a core, dealt over the cores: a small file of one row group would be read by one task. Larger scans stay as they are, without a shuffle."""
    spark = frame.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = int(str(frame._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return frame.repartition(cores) if size < least * cores else frame


def mark() -> int:
    """A place in the list of tables written so far, for ``release``."""
    return len(_written)


def release(spark: SparkSession, since: int = 0, keep: int = 0) -> None:
    """Deletes the tables written since a mark, but for the last ``keep``. Results that still read them must have been written before."""
    gone = _written[since : len(_written) - keep]
    for path in gone:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    del _written[since : len(_written) - keep]
