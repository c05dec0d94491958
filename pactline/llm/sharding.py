"""Shards of nearly equal bytes by a k-d tree over the metadata of the documents."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pactline.llm.common import gapless, stored, text_rows

ROW_OVERHEAD = 16
# A dimension is an attribute in the upper 30 bits and a hash of the row in the lower 32.
_LOW_BITS, _DIGIT = 32, 10
# How far the attributes can reach.
_RANGES = {"by_size": 60 << 24, "by_source": 1 << 30, "by_lang": 1 << 30}


DIMENSIONS = ("by_size", "by_source", "by_lang")


@dataclass
class Node:
    """An open or finished leaf of the tree; its shards are `first_shard` and the next ones."""

    number: int
    leaves: int
    first_shard: int


def metadata(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32 and the dimensions of each document as whole numbers below 2^62.

    A dimension has the attribute in its upper 30 bits and a hash of the row below, so equal values
    (a hot source) can be divided between shards like all others.
    """
    columns = docs.columns
    text = F.col("text")
    rows = text_rows(docs, *(
        (F.col(c) if c in columns else F.lit(None)).cast("string").alias(c) for c in ("source", "lang")))
    # A byte count, not a character count: the length of the binary form.
    size = F.coalesce(F.length(text.cast("binary")), F.lit(0)).cast("long") + ROW_OVERHEAD
    low = F.xxhash64("doc_id", "text_crc32").bitwiseAND(F.lit((1 << _LOW_BITS) - 1))

    def dimension(value: Column) -> Column:
        return F.shiftleft(F.least(value, F.lit((1 << 30) - 1)).cast("long"), _LOW_BITS) + low

    def name_code(name: str) -> Column:
        return F.xxhash64(name).bitwiseAND(F.lit((1 << 30) - 1))

    return rows.select(
        "doc_id", size.alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"), "source", "lang",
    ).select(
        "doc_id", "size", "text_crc32",
        dimension(F.log2(F.col("size").cast("double")) * (1 << 24)).alias("by_size"),
        dimension(name_code("source")).alias("by_source"),
        dimension(name_code("lang")).alias("by_lang"))


_CUTS = "node, dimension, cut, below, above"


def _table(spark: SparkSession, rows: list[tuple[int, ...]], columns: str) -> DataFrame:
    values = ", ".join(str(row) for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t({columns})")


def _value() -> Column:
    return F.element_at(F.array(*DIMENSIONS), F.col("dimension") + 1)


def _descend(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    """One level down the tree; `cuts` has a row for each node that was split, fewer than shards."""
    node = (F.when(F.col("cut").isNull(), F.col("node"))
            .when(_value() < F.col("cut"), F.col("below")).otherwise(F.col("above")))
    return rows.join(F.broadcast(cuts), "node", "left").select(
        *(c for c in rows.columns if c != "node"), node.alias("node"))


def _widest(rows: DataFrame) -> dict[int, tuple[int, int]]:
    """For each node its widest dimension (by the share of the whole range) and its bytes."""
    bounds = [f(d).alias(f"{name}_{d}") for d in DIMENSIONS for name, f in (("lo", F.min), ("hi", F.max))]
    out = {}
    for row in rows.groupBy("node").agg(F.sum("size").alias("bytes"), *bounds).collect():
        shares = [((row[f"hi_{d}"] - row[f"lo_{d}"]) >> _LOW_BITS) / _RANGES[d] for d in DIMENSIONS]
        out[row["node"]] = (shares.index(max(shares)), row["bytes"])
    return out


def _medians(rows: DataFrame, chosen: dict[int, tuple[int, int]], wanted: dict[int, float],
             slack: float) -> dict[int, int]:
    """For each node of `wanted` a cut with nearly the wanted bytes below it.

    Radix search: every round sums the bytes of 1024 equal ranges inside the range that holds the
    cut, for all nodes at once, so at most nodes x 1024 sums reach the driver. A node is done when
    its range holds no more than `slack` bytes.
    """
    spark = rows.sparkSession
    low, below = dict.fromkeys(wanted, 0), dict.fromkeys(wanted, 0)
    searching, shift = set(wanted), 62 - _DIGIT
    while searching and shift >= 2:
        starts = _table(spark, [(n, chosen[n][0], low[n]) for n in sorted(searching)],
                        "node, dimension, low")
        digit = F.shiftright(_value() - F.col("low"), shift)
        sums = (rows.join(F.broadcast(starts), "node")
                .select("node", digit.alias("digit"), "size")
                .where(F.col("digit").between(0, (1 << _DIGIT) - 1))
                .groupBy("node", "digit").agg(F.sum("size").alias("bytes")).collect())
        ranges: dict[int, list] = {n: [] for n in searching}
        for row in sums:
            ranges[row["node"]].append((row["digit"], row["bytes"]))
        for n, found in ranges.items():
            for place, size in sorted(found):
                if below[n] + size > wanted[n]:
                    low[n] += place << shift
                    if size <= slack:
                        searching.discard(n)
                        if wanted[n] - below[n] > size / 2:
                            low[n] += 1 << shift
                    break
                below[n] += size
            else:
                searching.discard(n)
        shift -= _DIGIT
    return low


def split_to_shards(rows: DataFrame, shards: int) -> DataFrame:
    """`rows` with their shard. All leaves of a level are split at once, so the number of passes
    grows with the depth of the tree only. With an odd number of shards the cut lies not in the
    middle but in proportion to the shards on both sides, so all get the same bytes."""
    spark = rows.sparkSession
    total, count = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    slack = max(total / shards / 500, 2 * total / max(count, 1))
    placed, leaves, made = rows.withColumn("node", F.lit(0)), [Node(0, shards, 0)], 1
    while total and any(n.leaves > 1 for n in leaves):
        chosen = _widest(placed)
        split = [n for n in leaves if n.leaves > 1 and n.number in chosen]
        if not split:
            break
        wanted = {n.number: chosen[n.number][1] * (n.leaves // 2) / n.leaves for n in split}
        cuts = _medians(placed, chosen, wanted, slack)
        table, below = [], []
        for n in split:
            left = n.leaves // 2
            below += [Node(made, left, n.first_shard), Node(made + 1, n.leaves - left, n.first_shard + left)]
            table.append((n.number, chosen[n.number][0], cuts[n.number], made, made + 1))
            made += 2
        placed = _descend(placed, _table(spark, table, _CUTS))
        leaves = below + [n for n in leaves if n.leaves == 1]
    names = _table(spark, [(n.number, n.first_shard) for n in leaves], "node, shard")
    return placed.join(F.broadcast(names), "node").drop("node")


def shards_for(docs_bytes: int, target_bytes: int) -> int:
    return max(1, math.ceil(docs_bytes / target_bytes))


def kd_shards(docs: DataFrame, shards: int | None = None, target_bytes: int = 1 << 30) -> DataFrame:
    """Put every document into a shard; doc_id, size, text_crc32, law, shard, slot, grown_shard.

    `size` is the text's UTF-8 bytes (null: none) plus 16. The tree splits at weighted medians
    of size, source or language, whichever is widest, until its leaves reach `target_bytes`, or
    until there are `shards` leaves of equal bytes. `slot` numbers a shard's rows without gaps.

    Null attributes are a value like others; rows that repeat an id and text share a place in the
    tree; columns other than doc_id, text, source and lang are not read (a missing source or
    language counts as null); an empty table gives an empty one.
    """
    rows = stored(metadata(docs), "shard-metadata")
    if shards is None:
        shards = shards_for(rows.agg(F.sum("size")).first()[0] or 0, target_bytes)
    placed = split_to_shards(rows, shards).select("doc_id", "size", "text_crc32", "shard")
    return gapless(placed, "shard", ["doc_id", "text_crc32"], "slot").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))
