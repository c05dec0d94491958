"""Token ids in files of fixed-width bits, in document order, with random access."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pactline.llm.common import Batches, batch, mapped, partitions, slices, text_rows
from pactline.llm.encoding import encoder

BLOCK_IDS = 1 << 16

_BLOCKS = "part int, block int, first_id long, bits int, n_ids long, doc_ids binary, no_id binary, " \
          "ends binary, packed binary"


def pack(ids: np.ndarray, bits: int) -> bytes:
    """`ids` with `bits` bits each, lowest bit first, filled up to whole bytes."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    each = (ids[:, None] >> np.arange(bits, dtype=np.uint32)) & 1
    return np.packbits(each.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(data: bytes, bits: int, start: int, stop: int) -> np.ndarray:
    """The ids from `start` to `stop` of packed data; reads only the bytes that hold them."""
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}")[start:stop].astype(np.uint32)
    first = start * bits // 8
    some = np.frombuffer(data, np.uint8)[first:(stop * bits + 7) // 8]
    each = np.unpackbits(some, bitorder="little")[start * bits - first * 8:]
    each = each[:(stop - start) * bits].reshape(-1, bits).astype(np.uint32)
    return (each << np.arange(bits, dtype=np.uint32)).sum(axis=1, dtype=np.uint32)


def _block_writer(path: str, end_id: int, bits: int, block_ids: int) -> Callable[[Batches], Batches]:
    schema = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("first_id", pa.int64()),
                        ("bits", pa.int32()), ("n_ids", pa.int64()), ("doc_ids", pa.binary()),
                        ("no_id", pa.binary()), ("ends", pa.binary()), ("packed", pa.binary())])

    def task(batches: Batches) -> Batches:
        from pyspark import TaskContext

        part, tool = TaskContext.get().partitionId(), encoder(path)
        end = np.array([end_id], "<u4").tobytes()
        docs, held, size, block, first = [], [], 0, 0, 0

        def flush() -> pa.RecordBatch:
            lengths = np.array([len(x) // 4 for x in held], "<i8")
            numbers = np.array([0 if d is None else d for d in docs], "<i8")
            null = np.array([d is None for d in docs], np.uint8)
            packed = pack(np.frombuffer(b"".join(held), "<u4"), bits)
            return batch(schema, [part], [block], [first], [bits], [int(lengths.sum())],
                         [numbers.tobytes()], [null.tobytes()],
                         [np.cumsum(lengths).astype("<i8").tobytes()], [packed])

        for some in slices(batches):
            for doc, ids in zip(some.column(0).to_pylist(), tool.encode(some.column(1).to_pylist())):
                docs.append(doc)
                held.append(ids + end)
                size += len(ids) // 4 + 1
                if size >= block_ids:
                    yield flush()
                    docs, held, first, size, block = [], [], first + size, 0, block + 1
        if docs:
            yield flush()

    return task


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int, vocabulary: int,
                      block_ids: int = BLOCK_IDS) -> None:
    """Encode all texts and write their ids, each with an end id, in ascending order of doc_id.

    The files are Parquet; a row is a block of whole documents: `packed` holds the ids with the
    fewest bits that `vocabulary` ids need, `ends` the position after each document's last id.
    `part` (the range of doc_id) and `block` order the blocks, `first_id` counts the ids of the part
    before the block. A block has at least `block_ids`
    ids, but for the last of a part; a longer document is a block by itself.

    Null texts count as empty (an end id only); null doc_ids come first; rows with the same
    doc_id are ordered by text; an empty table gives an empty one. `tokenizer` must be a path that
    the executors can read.
    """
    spark = docs.sparkSession
    bits = max(1, (vocabulary - 1).bit_length())
    ordered = (text_rows(docs).repartitionByRange(partitions(spark), "doc_id")
               .sortWithinPartitions("doc_id", "text"))
    blocks = mapped(ordered, _block_writer(tokenizer, end_id, bits, block_ids), _BLOCKS, "tokens")
    blocks.write.option("compression", "zstd").parquet(path)


def _block_reader(batches: Batches) -> Batches:
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()),
                        ("ids_crc32", pa.int64())])
    for some in slices(batches):
        for row in some.to_pylist():
            ends = np.frombuffer(row["ends"], "<i8")
            starts = np.append(0, ends[:-1])
            ids = unpack(row["packed"], row["bits"], 0, row["n_ids"]).astype("<u4").tobytes()
            sums = [zlib.crc32(ids[a * 4:b * 4]) for a, b in zip(starts.tolist(), ends.tolist())]
            yield batch(schema,
                        pa.array(np.frombuffer(row["doc_ids"], "<i8"),
                                 mask=np.frombuffer(row["no_id"], bool)),
                        starts + row["start"], ends - starts, sums)


def read_token_digests(spark, path: str) -> DataFrame:
    """Read the files back: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    blocks = spark.read.schema(_BLOCKS).parquet(path)
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("ids"))
    # One row for each part, so as few as the files were written with partitions.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = parts.select("part", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("base"))
    rows = (blocks.join(F.broadcast(bases), "part")
            .select("bits", "n_ids", "doc_ids", "no_id", "ends", "packed",
                    (F.col("base") + F.col("first_id")).alias("start")))
    return mapped(rows, _block_reader, "doc_id long, start long, n_tokens long, ids_crc32 long", "tokens")


def ids_between(spark, path: str, part: int, block: int, start: int, stop: int) -> np.ndarray:
    """Random access: the ids `start` to `stop` of one block, found by its number."""
    rows = (spark.read.schema(_BLOCKS).parquet(path)
            .where((F.col("part") == part) & (F.col("block") == block)).limit(1).collect())
    if not rows:
        raise KeyError((part, block))
    return unpack(rows[0]["packed"], rows[0]["bits"], start, stop)
