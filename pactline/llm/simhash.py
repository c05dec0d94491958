"""SimHash fingerprints, and all pairs of them within two bits by covering hash tables."""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pactline.llm.common import Batches, attached, batch, mapped, slices, stored, text_bytes, text_rows
from pactline.llm.components import connected_components

RADIUS = 2
_HELD = 1 << 16
_digest = partial(xxhash.xxh64_intdigest, seed=42)


def fingerprint(data: bytes, length: int = 3) -> int:
    """64 bits, each set if more than half of the hashes of the text's shingles have it.

    A-Z count as a-z. A text with fewer words than a shingle has is one shingle; without words the
    fingerprint is zero.
    """
    words = data.lower().split()
    if not words:
        return 0
    if len(words) < length:
        return _digest(b" ".join(words))
    counts, n = np.zeros(64, np.int64), len(words) - length + 1
    for start in range(0, n, _HELD):
        part = words[start:start + _HELD + length - 1]
        some = map(b" ".join, zip(*(part[i:] for i in range(length))))
        values = np.fromiter(map(_digest, some), "<u8", len(part) - length + 1)
        bits = np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(2 * counts > n).tolist())


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed 64-bit integer; a null text counts as empty."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def task(batches: Batches) -> Batches:
        for some in slices(batches):
            found = np.array([fingerprint(x or b"") for x in text_bytes(some.column(1))], np.uint64)
            yield batch(schema, some.column(0), found.view(np.int64))

    return mapped(text_rows(docs), task, "doc_id long, fp long")


def covering_masks(radius: int = RADIUS) -> list[int]:
    """Masks of which one hides all differing bits of any two fingerprints within the radius.

    Each bit i has a nonzero vector m(i) of radius + 1 bits, and each nonzero vector v gives the
    mask of the bits with m(i) . v = 1. Up to `radius` vectors m(i) cannot span all radius + 1
    dimensions, so some v is orthogonal to all of them: its mask leaves their bits out.
    """
    vectors = (1 << radius + 1) - 1
    return [sum(1 << i for i in range(64) if ((1 + i % vectors) & v).bit_count() & 1)
            for v in range(1, vectors + 1)]


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def links(distinct: DataFrame) -> DataFrame:
    """Links (a, b) between different fingerprints `fp` that connect all those within two bits.

    Seven covering tables give every fingerprint seven keys; a pair within two bits shares one. How
    many share a key is only counted, never listed: a fingerprint with company in a table goes on
    to its neighbours at one of the bits which that table hides (27 or 28, at most 64 in all
    tables), and to itself. Two fingerprints within two bits have such a neighbour in common, and
    all that share one are within two bits of each other, so one link to the smallest of them is
    enough. At most 65 fingerprints share a neighbour, whatever the data.
    """
    tables = F.array(*(F.struct(F.lit(i).alias("table"),
                                F.col("fp").bitwiseAND(F.lit(_signed(mask))).alias("key"),
                                F.lit(_signed(~mask & (1 << 64) - 1)).alias("hidden"))
                       for i, mask in enumerate(covering_masks())))
    dealt = distinct.select("fp", F.inline(tables))
    shared = dealt.groupBy("table", "key").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    met = attached(dealt, shared, ["table", "key"], ["fp"])
    hidden = met.groupBy("fp").agg(F.bit_or("hidden").alias("hidden"))
    neighbours = F.expr("""concat(array(fp), transform(
        filter(sequence(0, 63), i -> getbit(hidden, i) = 1), i -> fp ^ shiftleft(1L, i)))""")
    near = hidden.select("fp", F.explode(neighbours).alias("near"))
    balls = near.groupBy("near").agg(F.array_sort(F.collect_list("fp")).alias("fps")).where(
        F.size("fps") > 1)
    return balls.select(F.col("fps")[0].alias("a"), F.explode(F.expr("slice(fps, 2, 64)")).alias(
        "b")).distinct()


def simhash_groups(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id.

    Documents are linked if their fingerprints differ in at most two bits; component_id is the
    smallest doc_id that links reach, the own one included. Equal fingerprints go on as one, and no
    group of documents, fingerprints or keys meets in one task.

    Texts without words have fingerprint zero and are linked like others; null counts as empty. A
    row without doc_id has a fingerprint and the smallest doc_id it reaches, null if none. Rows that
    repeat a doc_id are documents of their own. Other columns are not read; an empty table gives an
    empty one.
    """
    rows = stored(fingerprints(docs), "fingerprints")
    distinct = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("own")), "distinct-fingerprints")
    found = connected_components(links(distinct.select("fp"))).select(
        F.col("node").alias("fp"), "component")
    members = stored(found.join(distinct, "fp"), "fingerprint-components")
    lowest = members.groupBy("component").agg(F.min("own").alias("lowest"))
    linked = attached(members, lowest, ["component"], ["fp"]).select("fp", "lowest")
    ids = distinct.join(linked, "fp", "left").select(
        "fp", F.coalesce("lowest", "own").alias("component_id"))
    return attached(rows, ids, ["fp"], ["doc_id"]).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
