"""Documents packed into sequences of a fixed length, best fit first, in bulk."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pactline.llm.common import Batches, batch, mapped, ship_package, slices, stored, text_rows
from pactline.llm.encoding import encoder

_PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long, ids binary"


def pieces(docs: DataFrame, tokenizer: str, separator: str, end_id: int, capacity: int,
           with_ids: bool = False) -> DataFrame:
    """The ids of each whole text and an end id, cut into pieces only where they exceed the capacity:
    doc_id, piece, start, length, ids_crc32, ids (little-endian 32-bit; null unless asked for)."""
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()),
                        ("length", pa.int32()), ("ids_crc32", pa.int64()), ("ids", pa.binary())])

    def task(batches: Batches) -> Batches:
        tool, end = encoder(tokenizer, separator), np.array([end_id], "<u4").tobytes()
        for some in slices(batches):
            out = []
            texts = some.column(1).to_pylist()
            for doc, ids in zip(some.column(0).to_pylist(), tool.encode(texts)):
                ids += end
                for number, start in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[start:start + 4 * capacity]
                    out.append((doc, number, start // 4, len(part) // 4, zlib.crc32(part),
                                part if with_ids else None))
            yield batch(schema, *(list(c) for c in zip(*out)))

    return mapped(text_rows(docs), task, _PIECES, "tokens")


GAP, PIECE, PLACED = 0, 1, 2
_ROUND = "kind int, id long, size int, sequence_id long, offset long"


def _sweep(capacity: int, open_all: bool):
    """Best fit inside one range of pieces and gaps: the longest piece chooses first (ties: the smaller
    id), takes the smallest gap that is large enough, and the gap goes back with the space it has left.

    A piece without a gap stays, or opens a sequence named after itself: any piece with `open_all`,
    else only as many as the pieces of the range exceed its gaps by in whole sequences.
    """
    def task(table: pa.Table) -> pa.Table:
        kind, size, ids = (table.column(n).to_numpy() for n in ("kind", "size", "id"))
        is_gap = kind == GAP
        free: dict[int, list[int]] = defaultdict(list)
        for space, sequence in sorted(zip(size[is_gap].tolist(), ids[is_gap].tolist())):
            free[space].append(sequence)
        spaces = sorted(free)
        lengths, keys = size[~is_gap], ids[~is_gap]
        over = max(0, int(lengths.sum()) - int(size[is_gap].sum()))
        fresh = len(keys) if open_all else over // capacity
        out: list[tuple] = []
        order = np.lexsort((keys, -lengths))
        for length, key in zip(lengths[order].tolist(), keys[order].tolist()):
            at = bisect_left(spaces, length)
            if at < len(spaces):
                space = spaces[at]
                sequence = free[space].pop()
                if not free[space]:
                    del free[space], spaces[at]
            elif fresh:
                fresh, space, sequence = fresh - 1, capacity, key
            else:
                out.append((PIECE, key, length, None, None))
                continue
            out.append((PLACED, key, length, sequence, capacity - space))
            rest = space - length
            if rest:
                if rest not in free:
                    insort(spaces, rest)
                free[rest].append(sequence)
        out += [(GAP, sequence, space, None, None) for space in spaces for sequence in free[space]]
        columns = zip(*out) if out else [[]] * 5
        types = (pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
        return pa.table([pa.array(list(c), t) for c, t in zip(columns, types)],
                        names=["kind", "id", "size", "sequence_id", "offset"])

    return task


def _ranges(rows: DataFrame, range_rows: int) -> DataFrame:
    """`rows` with the number of their range, from the largest pieces and gaps to the smallest.

    Range i holds the pieces from i to i + 1 parts of all pieces' tokens, and the gaps from i to i + 1
    parts of all gaps' space. Rows of equal size lie on a line by a hash of their id, so a frequent
    size is cut into ranges like any other. The borders come from the counts by kind and size, at most
    2 x capacity rows whatever the corpus, which is what makes their broadcast safe.
    """
    counts = rows.groupBy("kind", "size").agg(F.count("*").alias("_n"))
    weight = F.col("_n") * F.col("size")
    kind = Window.partitionBy("kind")
    larger = kind.orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, -1)
    borders = counts.select(
        "kind", "size", (F.coalesce(F.sum(weight).over(larger), F.lit(0)) / F.sum(weight).over(kind)).alias("_first"),
        (weight / F.sum(weight).over(kind)).alias("_share"),
        F.ceil(F.sum("_n").over(Window.partitionBy()) / range_rows).alias("_ranges"))
    line = F.pmod(F.xxhash64("id"), F.lit(1 << 52)) / F.lit(float(1 << 52))
    place = F.floor((F.col("_first") + F.col("_share") * line) * F.col("_ranges"))
    return rows.join(F.broadcast(borders), ["kind", "size"]).select(
        F.least(place, F.col("_ranges") - 1).alias("range"), *rows.columns)


def match(items: DataFrame, capacity: int, range_rows: int = 20_000) -> DataFrame:
    """id, sequence_id, offset for pieces of (id long, size int), ids unique, 1 <= size <= capacity.

    Bulk-synchronous best fit. Pieces above half the capacity open a sequence each. The others follow
    in waves of falling length (a quarter of the bound each), so that small pieces are left for the
    gaps that the large ones leave. A round sorts the wave's pieces and the gaps that can take one
    into ranges, about `range_rows` rows each, and every range is swept on its own: a gap is in one
    range, and pieces that want the same one are ranked by length. Gaps are updated, and pieces without
    a gap go to a second round, against what is left, in ranges 16 times as large, where they open
    sequences if again nothing fits. So there are at most two rounds a wave, whatever the number
    of pieces: twice the logarithm to base 4 of the capacity / 64, and two more.

    A range is the largest thing in one task. `items` is read in each wave, so it should be stored.
    """
    spark = items.sparkSession
    ship_package(spark)
    large = F.col("size") > capacity // 2
    placed = items.filter(large).select("id", F.col("id").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    gaps = items.filter(large & (F.col("size") < capacity)).select(
        F.lit(GAP).alias("kind"), "id", (F.lit(capacity) - F.col("size")).cast("int").alias("size"))
    upper = capacity // 2
    while upper:
        lower = upper // 4 if upper > 64 else 0
        left = items.filter(F.col("size").between(lower + 1, upper)).select(
            F.lit(PIECE).alias("kind"), "id", F.col("size").cast("int").alias("size"))
        for rows, open_all in ((range_rows, False), (16 * range_rows, True)):
            if left.isEmpty():
                break
            usable = F.col("size") > lower
            ranged = _ranges(gaps.filter(usable).unionByName(left), rows)
            swept = stored(ranged.groupBy("range").applyInArrow(_sweep(capacity, open_all), _ROUND), "packed")
            gaps = gaps.filter(~usable).unionByName(swept.filter(F.col("kind") == GAP).select("kind", "id", "size"))
            left = swept.filter(F.col("kind") == PIECE).select("kind", "id", "size")
            placed = placed.unionByName(
                swept.filter(F.col("kind") == PLACED).select("id", "sequence_id", "offset"))
        upper = lower
    return placed


def pack_documents(docs: DataFrame, tokenizer: str, separator: str, end_id: int,
                   capacity: int = 4096, with_ids: bool = False, range_rows: int = 20_000) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, ids, sequence_id, offset.

    Pieces are cut and stored, `match` finds their sequences from their lengths alone, and they meet
    their places by a number given to each. A sequence is named by the number of the piece that opened
    it and has no gaps but at its end.

    Null texts count as empty and have the end id only; doc_id may be null or repeated; longer
    documents are cut into full pieces and a rest; other columns are not read; an empty table gives
    an empty one. `separator` is a token that the encoder may use between words (see TextEncoder).
    """
    cut = stored(pieces(docs, tokenizer, separator, end_id, capacity, with_ids)
                 .withColumn("id", F.monotonically_increasing_id()), "pieces")
    places = match(cut.select("id", F.col("length").alias("size")), capacity, range_rows)
    return cut.join(places, "id").drop("id")


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id and its ids in order, from pieces packed with their ids; at most `capacity` ids
    meet in a row."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("parts")).select(
        "sequence_id", F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["ids"])).alias("ids"))
