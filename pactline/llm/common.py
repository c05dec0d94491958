"""Helpers shared by the operators: Arrow tasks, word hashes, tables in the shared folder."""

from __future__ import annotations

import atexit
import ctypes
import hashlib
import os
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pactline.session import scratch_path

Batches = Iterator[pa.RecordBatch]

# Spark holds a batch for a task twice outside its heap, and the worker once more. A little less than
# what `slices` makes of one.
BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "7m"

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once for each application, as a zip file Spark serves."""
    context = spark.sparkContext
    if getattr(context, "_pactline_shipped", False):
        return
    root = Path(__file__).resolve().parent.parent
    handle, name = tempfile.mkstemp(prefix="pactline-", suffix=".zip")
    os.close(handle)
    atexit.register(lambda: os.path.exists(name) and os.remove(name))
    with zipfile.ZipFile(name, "w") as package:
        for path in sorted(root.rglob("*.py")):
            package.write(path, path.relative_to(root.parent))
    context.addPyFile(name)
    context._pactline_shipped = True


# What a worker remembers from task to task, by name, and how it is cleared.
MEMORIES: dict[str, Callable[[], None]] = {}


def forget_others(memory: str | None) -> None:
    """Clear what this worker remembers for tasks of other kinds."""
    for name, clear in MEMORIES.items():
        if name != memory:
            clear()


def hand_back() -> None:
    """Return freed memory to the system; a worker waits for its next task with all of it otherwise."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


def mapped(df: DataFrame, task: Callable[[Batches], Batches], schema: str,
           memory: str | None = None) -> DataFrame:
    """`mapInArrow` with the package on the executors, and with bounded memory there.

    Batches have some 7 MB of data unless the session has a limit of its own (Spark's default, 64 MB,
    is a whole task of documents). `memory` names the one of `MEMORIES` that stays; a worker that has come
    from other operators clears the rest first, and hands back what is free at the end.
    """
    spark = df.sparkSession
    ship_package(spark)
    if spark.conf.get(BATCH_SETTING, None) is None:
        spark.conf.set(BATCH_SETTING, BATCH_BYTES)

    def run(batches: Batches) -> Batches:
        forget_others(memory)
        yield from task(batches)
        hand_back()

    return df.mapInArrow(run, schema)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared folder and read it back: computed once, survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    """Delete a table of `scratch_path` that nothing reads any more."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def attached(rows: DataFrame, lookup: DataFrame, keys: list[str], member: list[str],
             how: str = "inner") -> DataFrame:
    """`rows` with the columns of `lookup` (one row a key), without a hot task for a frequent key.

    The rows of a key are dealt into as many parts as the shuffle has, by a hash of `member`. Only
    the distinct pairs of key and part meet the lookup by key, and the rows meet those by both.
    `rows` is read twice, so it should be stored or cheap.
    """
    (part,) = fresh_names(rows, "_part")
    number = partitions(rows.sparkSession)
    dealt = rows.withColumn(part, F.pmod(F.xxhash64(*member), F.lit(number)).cast("int"))
    spread = dealt.select(*keys, part).distinct().join(lookup, keys)
    return dealt.join(spread, [*keys, part], how).drop(part)


def text_rows(docs: DataFrame, *more: Column) -> DataFrame:
    """Only the columns the operators read, so that other columns cannot clash with theirs."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.col("text").cast("string").alias("text"), *more)


def fresh_names(docs: DataFrame, *names: str) -> list[str]:
    """The names, with underscores in front until none is a column of `docs`."""
    taken = {c.lower() for c in docs.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
    return out


def text_bytes(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column."""
    return column.cast(pa.large_binary()).to_pylist()


def slices(batches: Batches, size: int = 8 << 20) -> Batches:
    """Parts of the batches with about `size` bytes each, but whole rows; bounds a task's memory."""
    for batch in batches:
        rows = max(1, batch.num_rows * size // max(batch.nbytes, 1))
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    arrays = [c if isinstance(c, pa.Array) else pa.array(c, f.type)
              for c, f in zip(columns, schema, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


class WordHashes(dict):
    """64-bit hashes of words (bytes), remembered up to a number of words."""

    def __init__(self, limit: int = 200_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        value = self[word] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > self.limit:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


# One memory for all operators: a worker that runs several stages keeps each word once.
WORD_HASHES = WordHashes()
MEMORIES["words"] = WORD_HASHES.clear


def mixed(values: np.ndarray) -> np.ndarray:
    """Spread each 64-bit value over all its bits."""
    out = values ^ (values >> np.uint64(33))
    out *= np.uint64(0xFF51AFD7ED558CCD)
    out ^= out >> np.uint64(33)
    out *= np.uint64(0xC4CEB9FE1A85EC53)
    return out ^ (out >> np.uint64(33))


def rolling(values: np.ndarray, length: int) -> np.ndarray:
    """Polynomial (Rabin-Karp) hash modulo 2^64 of every window of `length` values.

    Windows of doubling lengths are combined: hash(uv) = hash(u) * multiplier^len(v) + hash(v).
    """
    if len(values) < length:
        return np.empty(0, np.uint64)
    whole, covered = None, 0
    power, width = values, 1
    factor = int(MULTIPLIER)
    while True:
        if length & width:
            if whole is None:
                whole, covered = power, width
            else:  # the shorter window so far stands to the left of this one
                n = len(values) - covered - width + 1
                whole = whole[:n] * np.uint64(factor) + power[covered:covered + n]
                covered += width
        if width * 2 > length:
            return mixed(whole)
        power = power[:-width] * np.uint64(factor) + power[width:]
        factor = factor * factor % (1 << 64)
        width *= 2


def gapless(rows: DataFrame, key: str, order: list[str], name: str, bins: int = 256) -> DataFrame:
    """Number the rows of each key from 0 without gaps.

    A key's rows are numbered in `bins` parts by a hash of the order columns, and the counts of the
    parts (at most `bins` for each key) tell where each starts, so a frequent key is not one task.
    `rows` must give the same rows again, so it should be stored.
    """
    placed = rows.withColumn("_bin", F.pmod(F.xxhash64(*order), F.lit(bins)))
    counts = placed.groupBy(key, "_bin").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(key).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(key, "_bin", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy(key, "_bin").orderBy(*order)
    return (placed.withColumn("_place", F.row_number().over(within) - 1).join(starts, [key, "_bin"])
            .withColumn(name, (F.col("_start") + F.col("_place")).cast("long"))
            .select(*rows.columns, name))
