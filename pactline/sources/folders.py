"""Numbered folders of a table, finished or not, on any file system Spark can write to."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Written last, by us, so that it does not depend on the committer of the data files.
MARK = "_DONE"


def _path(spark: SparkSession, path: str):
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def mark(spark: SparkSession, path: str, name: str = MARK) -> None:
    """Say that a folder is finished, or something else that the name tells."""
    file, files = _path(spark, f"{path}/{name}")
    files.create(file, True).close()


def count_marks(spark: SparkSession, path: str, prefix: str) -> int:
    """How many marks of a folder begin with ``prefix``."""
    folder, files = _path(spark, path)
    return sum(f.getPath().getName().startswith(prefix) for f in files.listStatus(folder))


def finished(spark: SparkSession, path: str) -> bool:
    file, files = _path(spark, f"{path}/{MARK}")
    return files.exists(file)


def children(spark: SparkSession, path: str, key: str) -> dict[int, str]:
    """Number to path of the folders ``key=number`` in a folder."""
    folder, files = _path(spark, path)
    if not files.exists(folder):
        return {}
    found = [status.getPath() for status in files.listStatus(folder)]
    numbers = [(p.getName().partition(f"{key}=")[2], p.toString()) for p in found]
    return {int(number): name for number, name in numbers if number.removeprefix("-").isdigit()}


def finished_children(spark: SparkSession, path: str, key: str) -> dict[int, str]:
    return {n: p for n, p in children(spark, path, key).items() if finished(spark, p)}


def delete(spark: SparkSession, path: str) -> None:
    folder, files = _path(spark, path)
    files.delete(folder, True)
