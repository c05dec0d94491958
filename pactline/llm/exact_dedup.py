"""Exact duplicates by a persistent index of text digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pactline.llm.common import fresh_names, stored, text_rows

HOT_SHARE = 1000


class DigestIndex:
    """A table of text digests at a path, bucketed and sorted by digest, one row for each text.

    Columns: digest (SHA-256), keep_id, batch. New rows are deduplicated among themselves by an
    aggregation (partial counts in each task, so a text of any frequency costs one row for each
    task), then by a sort-merge anti-join that reads the index in its buckets without a shuffle,
    and what remains is appended as new files of the same buckets. The number of buckets is fixed
    when an index is made. A session that does not know the table registers it again.

    A batch that runs again, or again after it was stopped in the middle of its append, gives the
    same result: what its own number has written does not count as known, and is not written again.
    """

    def __init__(self, spark: SparkSession, table: str, path: str, buckets: int = 32):
        self.spark, self.table, self.buckets = spark, table, buckets
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {table} (digest BINARY, keep_id BIGINT, batch INT) "
            f"USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS "
            f"LOCATION '{path}'")

    def read(self) -> DataFrame:
        return self.spark.table(self.table)

    def next_batch(self) -> int:
        """The number after the last batch that has written."""
        return self.read().agg(F.coalesce(F.max("batch") + 1, F.lit(0))).first()[0]

    def _without(self, groups: DataFrame, batches: Column) -> DataFrame:
        known = self.read().where(batches).select("digest").hint("merge")
        return groups.join(known, "digest", "left_anti")

    def fresh(self, groups: DataFrame, batch: int) -> DataFrame:
        """The groups (digest, keep_id, ...) whose text no other batch has brought."""
        return self._without(groups, F.col("batch") != batch)

    def append(self, fresh: DataFrame, batch: int) -> None:
        """Add the texts that this batch has not added yet."""
        (self._without(fresh, F.col("batch") == batch).select("digest", "keep_id", F.lit(batch).alias("batch"))
         .repartition(self.buckets, "digest").write.insertInto(self.table))

    def forget(self) -> None:
        """Take the table from the session's catalog; its files stay at the path."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")


def digests(docs: DataFrame) -> DataFrame:
    """doc_id and the SHA-256 of each text; null counts as empty."""
    rows = text_rows(docs)
    return rows.select("doc_id", F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("digest"))


def groups_of(hashed: DataFrame) -> DataFrame:
    """For each text: the largest doc_id, the number of rows, and of rows with that doc_id."""
    each = hashed.groupBy("digest", "doc_id").agg(F.count("*").alias("rows"))
    return each.groupBy("digest").agg(
        F.max("doc_id").alias("keep_id"), F.sum("rows").alias("group_size"),
        F.max_by("rows", F.coalesce("doc_id", F.lit(-(1 << 63)))).alias("keep_rows"))


def with_groups(hashed: DataFrame, groups: DataFrame) -> DataFrame:
    """Join the rows to their groups; rows of hot texts (over a thousandth of all rows, so fewer
    than a thousand texts) take theirs from a broadcast, so no text meets in one task."""
    total = groups.agg(F.sum("group_size").alias("total"))
    hot = (groups.join(F.broadcast(total)).where(F.col("group_size") * HOT_SHARE > F.col("total"))
           .select(groups.columns))
    columns = ["doc_id", *groups.columns]
    at_once = hashed.join(F.broadcast(hot), "digest").select(columns)
    rest = hashed.join(F.broadcast(hot.select("digest")), "digest", "left_anti")
    return at_once.unionByName(rest.join(groups.hint("merge"), "digest").select(columns))


def exact_duplicates(docs: DataFrame, index: DigestIndex | None = None,
                     batch: int | None = None) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, known.

    Of equal texts in `docs` the row with the largest doc_id stays, unless `index` already has the
    text from another batch (`known`); `batch` is the number of this one, a new one if not given, and a
    repeated number repeats its result. Null texts equal empty ones. Null doc_ids are smaller than
    all others. Of rows that repeat both doc_id and text one stays. An empty table gives an empty one.
    The texts that stay are appended to the index.
    """
    hashed = stored(digests(docs), "digests")
    groups = groups_of(hashed)
    if index is None:
        groups = stored(groups.withColumn("known", F.lit(False)), "digest-groups")
    else:
        groups = stored(groups, "digest-groups")
        batch = index.next_batch() if batch is None else batch
        fresh = stored(index.fresh(groups, batch), "digest-fresh")
        index.append(fresh, batch)
        new = fresh.select("digest", F.lit(True).alias("new"))
        groups = groups.join(new, "digest", "left").select(
            *groups.columns, F.col("new").isNull().alias("known"))
    rows = with_groups(hashed, groups)
    is_kept = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    once = rows.where(~is_kept | (F.col("keep_rows") == 1)).withColumn("first", is_kept)
    # Rows that repeat the kept doc_id and text: as many rows again, of which the first stays.
    again = (rows.where(is_kept & (F.col("keep_rows") > 1))
             .groupBy(rows.columns).agg(F.count("*").alias("copies"))
             .select(*rows.columns, F.explode(F.sequence(F.lit(1), "copies")).alias("copy"))
             .withColumn("first", F.col("copy") == 1).drop("copy"))
    return once.unionByName(again).select(
        "doc_id", "keep_id", "group_size", (F.col("first") & ~F.col("known")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"), "known")


def exact_filter(docs: DataFrame, index: DigestIndex | None = None,
                 batch: int | None = None) -> DataFrame:
    """The documents whose text no other has, and of equal texts the row with the largest doc_id,
    with all their columns. Of rows that repeat doc_id and text one stays. Null texts equal empty
    ones, null doc_ids are smaller than all others, an empty table gives an empty one. With an
    `index`, texts that another batch brought go too, and those that stay are appended to it."""
    own, doc, digest, keep, times = fresh_names(
        docs, "own_digest", "own_id", "group_digest", "group_keep", "group_rows")
    groups = groups_of(stored(digests(docs), "digests"))
    if index is not None:
        batch = index.next_batch() if batch is None else batch
        groups = stored(index.fresh(groups, batch), "digest-fresh")
        index.append(groups, batch)
    kept = groups.select(
        F.col("digest").alias(digest), F.col("keep_id").alias(keep), F.col("keep_rows").alias(times))
    hashed = F.unhex(F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256))
    marked = docs.withColumn(own, hashed).withColumn(doc, F.col("doc_id").cast("long"))
    chosen = marked.join(kept, (F.col(own) == F.col(digest)) & F.col(doc).eqNullSafe(F.col(keep)))
    once, repeated = chosen.where(F.col(times) == 1), chosen.where(F.col(times) > 1)
    return once.select(docs.columns).unionByName(repeated.dropDuplicates([own]).select(docs.columns))
