"""Session helpers: settings for local runs and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, partitions: int = 8) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("labelloom")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named in spark.checkpoint.dir, set here only for local runs."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    current = context.getCheckpointDir()
    if current is None:
        if named is None:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a shared folder")
            named = tempfile.mkdtemp(prefix="labelloom-")
        context.setCheckpointDir(named)
        current = context.getCheckpointDir()
    return named or current


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the checkpoint folder, visible to every executor."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write the frame once to the shared folder and read it back.

    Cuts the lineage and survives lost executors as a checkpoint does, but computes
    the input once instead of twice and stays columnar, with known size and counts.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    if _OPEN:
        _OPEN[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


# Scratch tables of the calls to `settle` that are running.
_OPEN: list[list[str]] = []


def settle(spark: SparkSession, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """Write the frame that `make` builds, then remove the scratch tables it was built on.

    For a narrow result of wide intermediate tables. Nothing else that `make` builds may
    be used afterwards.
    """
    _OPEN.append([])
    try:
        frame = make()
        path = scratch_path(spark, name)
        frame.write.parquet(path)
    finally:
        for old in _OPEN.pop():
            remove_table(spark, old)
    if _OPEN:
        _OPEN[-1].append(path)
    return spark.read.schema(frame.schema).parquet(path)


def remove_table(spark: SparkSession, path: str) -> None:
    """Delete a table's folder, on any Hadoop file system."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    system.delete(folder, True)
