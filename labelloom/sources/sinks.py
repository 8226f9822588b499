"""Parquet tables, JSON documents, and building an output only once."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, path: str, *, spread: bool = False) -> DataFrame:
    """Parquet; `spread` is for work per row that is heavy against reading the row.

    It shuffles a table stored in fewer pieces than there are cores. A large table
    has more pieces than that and is left as it is.
    """
    table = spark.read.parquet(path)
    cores = spark.sparkContext.defaultParallelism
    if spread and table.rdd.getNumPartitions() < cores:
        return table.repartition(cores)
    return table


def write_table(
    df: DataFrame,
    path: str,
    *,
    partition_by: Sequence[str] = (),
    mode: str = "overwrite",
) -> None:
    """Parquet; the writer creates missing parent folders."""
    df.write.mode(mode).partitionBy(*partition_by).parquet(path)


def write_document(df: DataFrame, path: str, *, mode: str = "overwrite") -> None:
    """JSON lines in one file, for documents of a few rows: reports, manifests."""
    df.coalesce(1).write.mode(mode).option("ignoreNullFields", "false").json(path)


def is_built(spark: SparkSession, path: str) -> bool:
    """True when a finished job left its success marker, on any Hadoop file system."""
    jvm = spark.sparkContext._jvm
    marker = jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/_SUCCESS")
    system = marker.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return system.exists(marker)


def build_once(
    spark: SparkSession,
    path: str,
    build: Callable[[], DataFrame],
    *,
    partition_by: Sequence[str] = (),
    again: bool = False,
) -> DataFrame:
    """Build and write the table unless a finished one is already there, or `again`."""
    if again or not is_built(spark, path):
        write_table(build(), path, partition_by=partition_by)
    return read_table(spark, path)


def as_json(df: DataFrame, column: str = "document") -> DataFrame:
    """One JSON string per row."""
    return df.select(
        F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias(column)
    )
