"""Removal of passages that occur earlier in the corpus, by hashes of all word windows."""

from __future__ import annotations

import hashlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactline.llm.common import (WORD_HASHES, Batches, batch, fresh_names, mapped, mixed, partitions,
                                 rolling, slices, stored, text_bytes, text_rows)

_CHUNK_WINDOWS = 1_500_000
_HELD_FLAGS = 1_000_000
_SALT = np.uint64(0xD6E8FEB86659FD93)
_TASK_BYTES = 64 << 20  # of text whose windows a task compares
_FILTER_BITS, _MAP_BITS = 1 << 26, 1 << 15  # the filter of documents, and its rows

_ENTRIES = "bucket int, n int, tag binary, doc binary, at binary"
_FLAGS = "bin int, n int, doc binary, at binary"


def _planes(values: np.ndarray) -> bytes:
    """Eight byte planes of the differences between 64-bit integers; equal bytes lie together."""
    steps = np.diff(values, prepend=np.int64(0)).astype("<i8")
    steps = (steps << 1) ^ (steps >> 63)  # small numbers for small steps of either sign
    return np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes()


def _values(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(8, n)
    steps = np.ascontiguousarray(planes.T).reshape(-1).view("<u8")
    steps = (steps >> np.uint64(1)).astype(np.int64) ^ -(steps & np.uint64(1)).astype(np.int64)
    return np.cumsum(steps)


def _hash_bytes(first: np.ndarray, second: np.ndarray) -> bytes:
    """Ten bytes of hash for each window."""
    out = np.empty((len(first), 10), np.uint8)
    out[:, :8] = first.astype("<u8").view(np.uint8).reshape(-1, 8)
    out[:, 8:] = second.astype("<u2").view(np.uint8).reshape(-1, 2)
    return out.tobytes()


def _split_by(keys: np.ndarray, number: int):
    """(key, positions in their order) for each key below `number` that occurs."""
    order = np.argsort(keys, kind="stable")
    stops = np.cumsum(np.bincount(keys, minlength=number))
    start = 0
    for key in np.flatnonzero(np.diff(stops, prepend=0)).tolist():
        yield key, order[start:stops[key]]
        start = stops[key]


def _hashes(words: list[bytes]) -> np.ndarray:
    """By the worker's one memory of words; a task that named it itself would be sent with a copy."""
    return WORD_HASHES.of(words)


def _windows(docs: list[int], words: list[np.ndarray], length: int):
    """Two hashes, document and start of every window, in the order of the documents given; the
    words of a document come as hashes."""
    counts = np.array([len(w) for w in words], np.int64)
    values = np.concatenate(words) if words else np.empty(0, np.uint64)
    n = len(values) - length + 1
    if n < 1:
        return None
    stops = np.cumsum(counts)
    text = np.repeat(np.arange(len(words)), counts)[:n]
    places = np.arange(n)
    whole = places + length <= stops[text]
    first = rolling(values, length)[whole]
    second = rolling(mixed(values ^ _SALT), length)[whole]
    at = (places - (stops - counts)[text])[whole]
    return first, second, np.array(docs, np.int64)[text[whole]], at


def _without_leader(rows: np.ndarray, head: np.ndarray, doc: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The rows of each group (from one `head` to the next) but its first, which is the earliest.
    Rows that repeat a doc_id are one document: an equal place is not an earlier one."""
    if not len(rows):
        return rows
    leader = rows[np.maximum.accumulate(np.where(head, np.arange(len(rows)), 0))]
    return rows[(doc[rows] != doc[leader]) | (at[rows] != at[leader])]


def _entry_task(length: int, buckets: int):
    schema = pa.schema([("bucket", pa.int32()), ("n", pa.int32()), ("tag", pa.binary()),
                        ("doc", pa.binary()), ("at", pa.binary())])

    def task(batches: Batches) -> Batches:
        docs: list[int] = []
        words: list[np.ndarray] = []
        held = 0

        def flush():
            order = sorted(range(len(docs)), key=docs.__getitem__)
            found = _windows([docs[i] for i in order], [words[i] for i in order], length)
            docs.clear()
            words.clear()
            if found is None:
                return
            first, second, doc, at = found
            # Of windows that repeat in here the first stands for all, and the second tells the
            # others that they are repeated: what a frequent window costs does not grow further.
            ranked = np.lexsort((second, first))
            head = np.ones(len(first), bool)
            head[1:] = ((first[ranked[1:]] != first[ranked[:-1]])
                        | (second[ranked[1:]] != second[ranked[:-1]]))
            once = np.zeros(len(first), bool)
            once[ranked[head]] = True
            repeated = np.zeros(len(first), bool)
            repeated[_without_leader(ranked, head, doc, at)] = True
            if repeated.any():
                yield batch(schema, [-1], [int(repeated.sum())], [b""], [_planes(doc[repeated])],
                            [_planes(at[repeated])])
            first, second, doc, at = first[once], second[once], doc[once], at[once]
            bucket = (second >> np.uint64(32)) % np.uint64(buckets)
            for key, rows in _split_by(bucket.astype(np.int64), buckets):
                yield batch(schema, [key], [len(rows)], [_hash_bytes(first[rows], second[rows])],
                            [_planes(doc[rows])], [_planes(at[rows])])

        for some in slices(batches):
            for doc, data in zip(some.column(0).to_pylist(), text_bytes(some.column(1))):
                split = data.split()
                if len(split) < length:
                    continue
                docs.append(doc)
                words.append(_hashes(split))
                held += len(split)
                if held >= _CHUNK_WINDOWS:
                    yield from flush()
                    held = 0
        yield from flush()

    return task


def _later(entries: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    """Document and start of all windows of a bucket but the first of each hash."""
    tags = np.concatenate([np.frombuffer(e["tag"], np.uint8).reshape(-1, 10) for e in entries])
    doc = np.concatenate([_values(e["doc"], e["n"]) for e in entries])
    at = np.concatenate([_values(e["at"], e["n"]) for e in entries])
    first = np.ascontiguousarray(tags[:, :8]).view("<u8").ravel()
    second = np.ascontiguousarray(tags[:, 8:]).view("<u2").ravel()
    order = np.argsort(first, kind="stable")
    near = first[order[1:]] == first[order[:-1]]
    some = np.zeros(len(order), bool)  # only hashes that occur again need the full order
    some[1:] = near
    some[:-1] |= near
    rows = order[some]
    rows = rows[np.lexsort((at[rows], doc[rows], second[rows], first[rows]))]
    same = (first[rows[1:]] == first[rows[:-1]]) & (second[rows[1:]] == second[rows[:-1]])
    head = np.ones(len(rows), bool)
    head[1:] = ~same
    rows = _without_leader(rows, head, doc, at)
    return doc[rows], at[rows]


def _rows(batches: Batches):
    for some in slices(batches):
        yield from some.to_pylist()


def _flag_task(bins: int):
    schema = pa.schema([("bin", pa.int32()), ("n", pa.int32()), ("doc", pa.binary()),
                        ("at", pa.binary())])

    def flags(doc: np.ndarray, at: np.ndarray):
        order = np.lexsort((at, doc))
        doc, at = doc[order], at[order]
        bin_of = (mixed(doc.astype(np.uint64)) % np.uint64(bins)).astype(np.int64)
        for key, rows in _split_by(bin_of, bins):
            yield batch(schema, [key], [len(rows)], [_planes(doc[rows])], [_planes(at[rows])])

    def task(batches: Batches) -> Batches:
        bucket, held, found = None, [], []
        for row in chain(_rows(batches), [None]):
            if row is not None and row["bucket"] == -1:
                found.append((_values(row["doc"], row["n"]), _values(row["at"], row["n"])))
            elif held and (row is None or row["bucket"] != bucket):
                found.append(_later(held))
                held = []
            if row is not None and row["bucket"] != -1:
                bucket = row["bucket"]
                held.append(row)
            # The flags of several buckets go out together, else there are rows for all buckets
            # times all bins.
            size = sum(len(doc) for doc, _ in found)
            if found and (row is None or size >= _HELD_FLAGS):
                yield from flags(*(np.concatenate(part) for part in zip(*found)))
                found = []

    return task


def _interval_task(length: int):
    schema = pa.schema([("doc_id", pa.int64()), ("starts", pa.list_(pa.int64())),
                        ("stops", pa.list_(pa.int64()))])

    def intervals(held: list[dict]):
        doc = np.concatenate([_values(r["doc"], r["n"]) for r in held])
        at = np.concatenate([_values(r["at"], r["n"]) for r in held])
        order = np.lexsort((at, doc))
        doc, at = doc[order], at[order]
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (at[1:] > at[:-1] + length)
        heads = np.flatnonzero(new)
        tails = np.append(heads[1:], len(doc)) - 1
        owner, starts, stops = doc[heads], at[heads], at[tails] + length
        fresh = np.ones(len(owner), bool)
        fresh[1:] = owner[1:] != owner[:-1]
        offsets = np.append(np.flatnonzero(fresh), len(owner)).astype(np.int32)
        yield batch(schema, owner[fresh],
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(starts)),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(stops)))

    def task(batches: Batches) -> Batches:
        bin_, held = None, []
        for some in slices(batches):
            for row in some.to_pylist():
                if row["bin"] != bin_:
                    if held:
                        yield from intervals(held)
                    bin_, held = row["bin"], []
                held.append(row)
        if held:
            yield from intervals(held)

    return task


def removal_intervals(docs: DataFrame, length: int = 20) -> DataFrame:
    """doc_id and the maximal runs of words (`starts`, `stops`) to remove, for documents with any.

    A window of `length` words is removed if its words also start earlier: in a document with a
    smaller doc_id, or further left in the same one. Tasks hash all windows of their rows (rolling
    hashes, 80 bits and those that choose the bucket), keep the first of each hash, and send hash,
    document and start to the hash's bucket, packed in one row for each task and bucket. There all
    but the earliest are flagged, and the flags are gathered by document and merged.

    Rows without a doc_id or a text take no part. Rows that repeat a doc_id count as one document.
    The number of buckets follows the bytes of text. Windows are equal if 80 bits of hash and the
    bucket agree: among 10^12 windows less than one false pair is expected.
    """
    spark = docs.sparkSession
    rows = text_rows(docs).where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    number = max(partitions(spark), size // _TASK_BYTES)
    # Several buckets for each partition even out what the partitions get; a task holds one at a time.
    entries = mapped(rows, _entry_task(length, 4 * number), _ENTRIES, "words")
    # What a task has found by itself goes to any partition.
    place = F.when(F.col("bucket") == -1, F.xxhash64("doc", "at")).otherwise(F.col("bucket"))
    dealt = entries.repartition(number, place).sortWithinPartitions("bucket")
    flags = mapped(dealt, _flag_task(number), _FLAGS)
    gathered = flags.repartition(number, "bin").sortWithinPartitions("bin")
    return mapped(gathered, _interval_task(length),
                  "doc_id long, starts array<long>, stops array<long>")


def _cut(words: list[bytes], starts: list[int] | None, stops: list[int] | None) -> tuple[list[bytes], int]:
    """The words outside the intervals, and how many lie inside."""
    if not starts:
        return words, 0
    kept, at = [], 0
    for start, stop in zip(starts, stops):
        kept += words[at:start]
        at = stop
    kept += words[at:]
    return kept, len(words) - len(kept)


def _filtered(docs: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The documents that may have intervals, and those that have none.

    A filter of at most 8 MB, one bit for each of 2^26 hashes of a doc_id, goes to all tasks as rows
    of bits. The more documents have intervals the more others pass as well; the join tells them.
    """
    def place(doc_id: Column) -> Column:
        return F.pmod(F.xxhash64(doc_id.cast("long")), F.lit(_FILTER_BITS))

    row, bits, test = fresh_names(docs, "filter_row", "filter_bits", "filter_test")
    at = place(F.col("doc_id"))
    maps = found.select(at.alias("at")).groupBy(F.floor(F.col("at") / _MAP_BITS).alias(row)).agg(
        F.bitmap_construct_agg(F.col("at") % _MAP_BITS).alias(bits))
    bit = at % _MAP_BITS
    byte = F.conv(F.hex(F.substring(F.col(bits), F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10)
    known = F.getbit(byte.cast("long"), (bit % 8).cast("int")) == 1
    tested = docs.withColumn(row, F.floor(at / _MAP_BITS)).join(F.broadcast(maps), row, "left").withColumn(
        test, F.col("doc_id").isNotNull() & F.col(bits).isNotNull() & F.coalesce(known, F.lit(False)))
    return (tested.where(F.col(test)).select(docs.columns), tested.where(~F.col(test)).select(docs.columns))


def with_intervals(docs: DataFrame, length: int = 20) -> DataFrame:
    """The documents with their removal intervals (null for none). Only texts that may have any are
    shuffled to meet them."""
    name, starts, stops = fresh_names(docs, "removal_id", "removal_starts", "removal_stops")
    found = stored(removal_intervals(docs, length), "removal-intervals")
    some, others = _filtered(docs, found)
    found = found.select(F.col("doc_id").alias(name), F.col("starts").alias(starts),
                         F.col("stops").alias(stops))
    met = some.join(found, F.col("doc_id").cast("long") == F.col(name), "left").drop(name)
    none = F.lit(None).cast("array<long>")
    return met.unionByName(others.withColumn(starts, none).withColumn(stops, none))


def substring_duplicates(docs: DataFrame, length: int = 20) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256 (of the kept words, joined by
    one space), intervals as `starts` and `stops`.

    A null text has no words and loses none. A row without doc_id keeps all its words. Rows that
    repeat a doc_id count as one document: the same place in both is not a repetition, and what is
    removed from one is removed from all. Texts shorter than a window stay whole. Other columns
    are not read. An empty table gives an empty one.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()),
                        ("kept_sha256", pa.string()), ("starts", pa.list_(pa.int64())),
                        ("stops", pa.list_(pa.int64()))])

    def task(batches: Batches) -> Batches:
        for some in slices(batches):
            out = []
            for data, starts, stops in zip(text_bytes(some.column(1)), some.column(2).to_pylist(),
                                           some.column(3).to_pylist()):
                words = (data or b"").split()
                kept, removed = _cut(words, starts, stops)
                out.append((len(words), removed, hashlib.sha256(b" ".join(kept)).hexdigest()))
            yield batch(schema, some.column(0), *(list(c) for c in zip(*out)), some.column(2),
                        some.column(3))

    return mapped(with_intervals(text_rows(docs), length), task,
                  "doc_id long, n_words long, n_removed long, kept_sha256 string, "
                  "starts array<long>, stops array<long>")


def remove_substrings(docs: DataFrame, length: int = 20) -> DataFrame:
    """The documents without repeated passages: changed texts are their kept words joined by one
    space, others stay as they are; documents of which nothing is left go. An `n_chars` column is
    brought up to date."""
    at = docs.columns.index("text")
    schema = docs.schema

    def task(batches: Batches) -> Batches:
        for some in slices(batches):
            texts, left = some.column(at).to_pylist(), []
            for i, (starts, stops) in enumerate(zip(some.column(len(schema)).to_pylist(),
                                                    some.column(len(schema) + 1).to_pylist())):
                if starts:
                    kept, removed = _cut(texts[i].encode().split(), starts, stops)
                    texts[i] = b" ".join(kept).decode() if removed else texts[i]
                left.append(not starts or bool(texts[i]))
            columns = some.columns[:len(schema)]
            columns[at] = pa.array(texts, some.schema.field(at).type)
            out = pa.RecordBatch.from_arrays(columns, names=schema.names)
            yield out.filter(pa.array(left, pa.bool_()))

    cut = mapped(with_intervals(docs, length), task, schema)
    if "n_chars" in docs.columns:
        kind = schema["n_chars"].dataType
        cut = cut.withColumn("n_chars", F.char_length("text").cast(kind))
    return cut
