"""The consumer-edge table as files: compacted buckets, and small files of what came after them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pactline import types as t
from pactline.operators.lineage import EDGE_KEY, edge_versions, newest_edges
from pactline.sources import folders

_SCHEMA = T.StructType([*t.REGISTRY["lineage_edges"].fields, T.StructField("seq", T.LongType())])


@dataclass(frozen=True)
class EdgeTable:
    """Merge on read: ``changes/batch_id=N/bucket=B`` has what a batch saw, ``base/upto=N/bucket=B``
    all of a bucket up to a batch. An edge lies in the bucket of its key's hash, so a batch writes
    files in the buckets of its edges alone. A reader takes the newest version of each edge from the
    newest base of each bucket and the changes after it. Folders count once they are marked, and
    none is written again, so a reader that has begun finds its files.

    ``buckets`` must stay the same for a table. A bucket is compacted when it has ``merge_after``
    files of changes; :meth:`expire` deletes what the last but one base of a bucket replaced.
    """

    spark: SparkSession
    root: str
    buckets: int = 64
    merge_after: int = 8

    @property
    def _home(self) -> str:
        return f"{self.root.rstrip('/')}/buckets={self.buckets}"

    def _check(self) -> None:
        others = set(folders.children(self.spark, self.root, "buckets")) - {self.buckets}
        if others:
            raise ValueError(f"the table has {sorted(others)} buckets, not {self.buckets}")

    def _write(self, rows: DataFrame, path: str) -> None:
        bucket = F.pmod(F.xxhash64(*EDGE_KEY), F.lit(self.buckets)).cast("int")
        rows.select(*_SCHEMA.fieldNames(), bucket.alias("bucket")).repartition("bucket").write.mode(
            "overwrite").partitionBy("bucket").parquet(path)
        folders.mark(self.spark, path)

    def _parts(self, kind: str, key: str) -> dict[int, list[tuple[int, str]]]:
        """Bucket to (number, path) of its finished folders, oldest first."""
        out: dict[int, list[tuple[int, str]]] = {}
        found = folders.finished_children(self.spark, f"{self._home}/{kind}", key)
        for number in sorted(found):
            for bucket, path in folders.children(self.spark, found[number], "bucket").items():
                out.setdefault(bucket, []).append((number, path))
        return out

    def files(self) -> dict[int, list[str]]:
        """Bucket to the folders a reader takes: the newest base first, then the changes after it."""
        self._check()
        bases, changes = self._parts("base", "upto"), self._parts("changes", "batch_id")
        out = {}
        for bucket in sorted({*bases, *changes}):
            upto, base = bases.get(bucket, [(-1, "")])[-1]
            later = [path for number, path in changes.get(bucket, []) if number > upto]
            out[bucket] = ([base] if base else []) + later
        return out

    def _newest(self, paths: list[str]) -> DataFrame:
        if not paths:
            return self.spark.createDataFrame([], _SCHEMA)
        return newest_edges(self.spark.read.schema(_SCHEMA).parquet(*paths))

    def read(self) -> DataFrame:
        """The edges, each in its newest version."""
        return self._newest([p for paths in self.files().values() for p in paths]).drop("seq")

    def append(self, observations: DataFrame, batch_id: int) -> None:
        """Add what a batch saw (see :func:`upsert_edges`); a batch that is there already is left."""
        self._check()
        path = f"{self._home}/changes/batch_id={batch_id}"
        if not folders.finished(self.spark, path):
            self._write(newest_edges(edge_versions(observations), with_ids=False), path)

    def load(self, edges: DataFrame) -> None:
        """Begin the table with known edges, which keep their ids."""
        self._check()
        self._write(edges.withColumn("seq", F.lit(-1).cast("bigint")), f"{self._home}/base/upto=-1")

    def compact(self) -> list[int]:
        """Rewrite the buckets with many files of changes, and leave the others alone."""
        due = {b: paths for b, paths in self.files().items() if len(paths) > self.merge_after}
        batches = folders.finished_children(self.spark, f"{self._home}/changes", "batch_id")
        if due:
            rows = self._newest([p for paths in due.values() for p in paths])
            self._write(rows, f"{self._home}/base/upto={max(batches)}")
        return sorted(due)

    def expire(self) -> None:
        """Delete the files that readers have not needed since the last but one base."""
        changes = self._parts("changes", "batch_id")
        for bucket, bases in self._parts("base", "upto").items():
            if len(bases) < 2:
                continue
            for number, path in changes.get(bucket, []):
                if number <= bases[-2][0]:
                    folders.delete(self.spark, path)
            for _, path in bases[:-2]:
                folders.delete(self.spark, path)
