"""Partition counts and cut lineage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from pactline.session import scratch_path


def spread(df: DataFrame, task_bytes: int | None = None) -> DataFrame:
    """Use all cores for per-row work on an input with few splits.

    A large input has many more splits than cores and is returned as it is, so nothing shuffles at
    scale; a few small files are redistributed once, before the expensive expressions. For very
    expensive ones, ``task_bytes`` is what a task gets of an input with few splits for each core: the
    larger the input, the more tasks, none of them longer.
    """
    if df.isStreaming:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    wanted, enough = cores, cores
    if task_bytes is not None:
        size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        wanted = max(cores, -(-size // task_bytes))
        enough = min(wanted, 4 * cores)
    return df.repartition(wanted) if df.rdd.getNumPartitions() < enough else df


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared scratch folder and continue from there.

    The plan starts anew at a scan with known size and column pruning, and a lost executor costs at
    most the step that is running.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, *keys: str) -> DataFrame:
    """As :func:`cut`, in as many buckets of the keys as a shuffle has partitions.

    Rows that a shuffle by these keys has dealt are not moved for it, and joins and aggregations by
    the keys read the table without a shuffle.
    """
    spark = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex}"
    number = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.bucketBy(number, *keys).format("parquet").option("compression", "zstd").option(
        "path", scratch_path(spark, name)).saveAsTable(table)
    rows = spark.table(table)
    spark.sql(f"DROP TABLE {table}")  # from the catalog; the files stay
    return rows
