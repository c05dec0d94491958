"""Lookup joins whose broadcast side is measured first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_BYTES = 64 << 20
BROADCAST_ROWS = 2_000_000
HASH_BYTES = 32 << 20  # of rows hashed by a task
SALTS = 32


def measure(df: DataFrame) -> tuple[int, int]:
    """Rows and bytes (as text) of a table, from one distributed aggregate."""
    width = F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])))
    rows, size = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(width), F.lit(0))).first()
    return rows, size


def fits_broadcast(
    df: DataFrame, max_bytes: int = BROADCAST_BYTES, max_rows: int = BROADCAST_ROWS
) -> bool:
    """Is the table, as measured, safe to send to every executor?"""
    rows, size = measure(df)
    return rows <= max_rows and size <= max_bytes


def stored_bytes(df: DataFrame) -> int:
    """Bytes of a table as Spark estimates them from its files, without reading it; times four, as files
    are compressed."""
    return 4 * int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def hashed(df: DataFrame, size: int) -> DataFrame:
    """The smaller side of a join by shuffle: hashed, if what a task gets of it is small.

    Then neither side is sorted; names with a long common beginning are slow to sort. A side that is
    larger stays with the sort-merge join, which can spill; a tiny one is left to Spark.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    fits = BROADCAST_BYTES < size <= parts * HASH_BYTES
    return df.hint("shuffle_hash") if fits else df


def lookup_join(
    facts: DataFrame,
    lookup: DataFrame,
    on: str | list[str],
    how: str = "left",
    *,
    spread_by: list[str] | None = None,
    max_bytes: int = BROADCAST_BYTES,
    salts: int = SALTS,
) -> DataFrame:
    """Join a large table to a lookup table that holds each key once.

    A lookup of proven small size is broadcast, so the large side never moves. Beyond that size both
    sides shuffle; each key is split into ``salts`` parts by a hash of ``spread_by`` (stable across
    retries), so that a key with a third of all rows spreads over many tasks. No row is lost in
    either way. Without ``spread_by`` the skew handling of adaptive execution does the splitting.
    """
    keys = [on] if isinstance(on, str) else list(on)
    if fits_broadcast(lookup, max_bytes):
        return facts.join(F.broadcast(lookup), keys, how)
    if not spread_by:
        return facts.join(lookup, keys, how)
    salt = "__salt"
    salted_facts = facts.withColumn(
        salt, F.pmod(F.xxhash64(*spread_by), F.lit(salts)).cast("int")
    )
    copies = F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    return salted_facts.join(lookup.withColumn(salt, copies), [*keys, salt], how).drop(salt)
