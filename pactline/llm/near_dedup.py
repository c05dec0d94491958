"""Near-duplicates: bottom-k sketches find candidates, full shingle sets confirm them."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pactline.llm.common import (WORD_HASHES, Batches, batch, fresh_names, mapped, partitions, rolling,
                                 slices, stored, text_bytes, text_rows)
from pactline.llm.components import connected_components



@dataclass(frozen=True)
class NearRules:
    """Sets of `shingle` words are linked if `percent` * union <= 100 * intersection.

    A sketch has the `sketch` smallest hashes of a set. Two sets at the limit (85 %) share fewer than
    `least_shared` of 48 sketch values with a probability below 2e-6, so pairs below that are left
    out. `block`: how many sets are compared at once in a task.
    """

    shingle: int = 5
    percent: int = 85
    sketch: int = 48
    least_shared: int = 28
    block: int = 512


def shingles(data: bytes | None, length: int) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles; A-Z count as a-z. Fewer words than a
    shingle has are one shingle; no words give an empty set."""
    words = (data or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    values = WORD_HASHES.of(words)
    if len(words) < length:
        whole = hashlib.blake2b(b" ".join(words), digest_size=8, key=b"short").digest()
        return np.frombuffer(whole, "<u8").astype(np.uint64)
    return np.unique(rolling(values, length))


_SKETCHES = "doc_id long, n_shingles long, digest binary, sketch binary"


def sketches(docs: DataFrame, rules: NearRules) -> DataFrame:
    """doc_id, n_shingles, digest (of the whole set) and sketch (its smallest hashes, in order)."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()),
                        ("sketch", pa.binary())])

    def task(batches: Batches) -> Batches:
        for some in slices(batches):
            sets = [shingles(x, rules.shingle) for x in text_bytes(some.column(1))]
            yield batch(schema, some.column(0), [len(s) for s in sets],
                        [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets],
                        [s[:rules.sketch].astype("<u8").tobytes() for s in sets])

    return mapped(text_rows(docs), task, _SKETCHES, "words")


def _value_task(batches: Batches) -> Batches:
    """The values of each sketch as rows (set, value)."""
    schema = pa.schema([("rep", pa.int64()), ("set", pa.int64()), ("kept_values", pa.int32()),
                        ("value", pa.int64())])
    for some in slices(batches, 1 << 20):
        values = [np.frombuffer(x, "<i8") for x in some.column(2).to_pylist()]
        lengths = [len(v) for v in values]
        yield batch(schema, np.repeat(some.column(0).to_numpy(), lengths),
                    np.repeat(some.column(1).to_numpy(), lengths),
                    np.repeat(np.array(lengths, np.int32), lengths), np.concatenate(values))


def _prefixes(sets: DataFrame, rules: NearRules) -> DataFrame:
    """rep, set, value: inverted lists of sketch values, shortened without losing a pair.

    Sets that share `wanted` values of their sketches share one of the others' first
    size - wanted + 1, whatever common order the values have. Rare ones come first, so what many
    texts have in common makes no long list unless the texts have little else. A value of one set
    alone needs no list.
    """
    values = mapped(sets.select("rep", "set", "sketch"), _value_task,
                    "rep long, set long, kept_values int, value long")
    counts = values.groupBy("value").agg(F.count("*").alias("times")).where("times > 1")
    shared = values.join(stored(counts, "sketch-counts"), "value")
    # Windows over the values of one set, at most as many as a sketch has.
    one = Window.partitionBy("rep", "set")
    wanted = F.least(F.lit(rules.least_shared), F.ceil(F.col("kept_values") * 6 / 10))
    alone = F.col("kept_values") - F.count("*").over(one)  # the rarest of all: in no other set
    place = F.row_number().over(one.orderBy("times", "value"))
    return (shared.withColumn("place", place + alone)
            .where(F.col("place") <= F.col("kept_values") - wanted + 1)
            .select("rep", "set", "value"))


def blocked(rows: DataFrame, key: str, member: str, block: int) -> DataFrame:
    """Rows of each key dealt out for comparing all of them, in tasks of two blocks at most.

    A key with more than `block` rows is divided into blocks, and every row goes to the pairs that
    its block makes with all blocks, itself included. Adds left and right (the pair of blocks) and
    mine (the row's own block). Keys with one row are left out.
    """
    sizes = rows.groupBy(key).agg(F.count("*").alias("rows_of_key")).where("rows_of_key > 1")
    return (rows.join(sizes, key)
            .withColumn("blocks", F.ceil(F.col("rows_of_key") / block).cast("int"))
            .withColumn("mine", F.pmod(F.xxhash64(member), F.col("blocks")).cast("int"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            .withColumn("left", F.least("mine", "other")).withColumn("right", F.greatest("mine", "other"))
            .drop("other", "rows_of_key", "blocks"))


def _groups(batches: Batches, columns: int):
    """Rows of equal keys, which are the first `columns` columns; the rows come sorted by them."""
    key, held = None, []
    for some in slices(batches):
        for row in zip(*(c.to_pylist() for c in some.columns)):
            if row[:columns] != key:
                if held:
                    yield key, held
                key, held = row[:columns], []
            held.append(row[columns:])
    if held:
        yield key, held


def _counts(sets: list[np.ndarray], others: list[np.ndarray]) -> np.ndarray:
    """How many values each of `sets` shares with each of `others`: a product of 0/1 matrices of
    the values that occur in several of them, some columns at a time."""
    both = sets + others
    owner = np.repeat(np.arange(len(both)), [len(s) for s in both])
    values = np.concatenate(both)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    column = np.cumsum(new) - 1
    common = np.bincount(column) > 1
    use = common[column]
    owner, column = owner[use], (np.cumsum(common) - 1)[column[use]]
    out = np.zeros((len(sets), len(others)), np.float32)
    columns = int(common.sum())
    width = min(columns, max(256, (4 << 20) // len(both)))
    for start in range(0, columns, width):
        a, b = np.searchsorted(column, (start, start + width))
        part = np.zeros((len(both), width), np.float32)
        part[owner[a:b], column[a:b] - start] = 1
        out += part[:len(sets)] @ part[len(sets):].T
    return out.astype(np.int64)


def _spanning(near: np.ndarray, ids: list[int], others: list[int]) -> list[tuple[int, int]]:
    """Links (smallest, other) that connect what `near` (ids by others) connects."""
    names = ids + others
    left, links = np.ones(len(names), bool), []
    for start in sorted(range(len(names)), key=names.__getitem__):
        if not left[start]:
            continue
        left[start] = False
        front = np.array([start])
        while len(front):
            rows, columns = front[front < len(ids)], front[front >= len(ids)] - len(ids)
            reached = np.concatenate([near[:, columns].any(axis=1), near[rows].any(axis=0)]) & left
            front = np.flatnonzero(reached)
            left[front] = False
            links += [(names[start], names[i]) for i in front.tolist()]
    return links


def _pair_task(near_of):
    """Links of the blocks of each key; `near_of` tells from two lists of rows which are linked."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def task(batches: Batches) -> Batches:
        for (_, left, right), rows in _groups(batches, 3):
            first = [r for r in rows if r[0] == left]
            second = first if left == right else [r for r in rows if r[0] == right]
            if not first or not second:
                continue
            links = _spanning(near_of(first, second), [r[1] for r in first], [r[1] for r in second])
            links = [(a, b) for a, b in links if a != b]
            if links:
                yield batch(schema, [a for a, _ in links], [b for _, b in links])

    return task


def _estimate(rules: NearRules):
    """Candidates by the sketch of the union.

    Below the smaller of both sketches' ends all values of both sets are known: there the union has
    at least as many values as a sketch, and the share of those in both estimates the similarity.
    """
    def ends(sets: list[np.ndarray]) -> np.ndarray:
        whole = np.iinfo(np.uint64).max
        return np.array([s[-1] if len(s) >= rules.sketch else whole for s in sets], np.uint64)

    def near(first: list[tuple], second: list[tuple]) -> np.ndarray:
        sets, others = ([np.frombuffer(r[3], "<u8") for r in rows] for rows in (first, second))
        sizes, more = (np.array([r[2] for r in rows], np.int64) for rows in (first, second))
        shared = _counts(sets, others)
        known = np.array([np.searchsorted(s, ends(others), "right") for s in sets])
        known = np.minimum(known, np.array([len(s) for s in sets])[:, None])
        known_more = np.array([np.searchsorted(s, ends(sets), "right") for s in others]).T
        union = known + known_more - shared
        fits = 100 * np.minimum(sizes[:, None], more) >= rules.percent * np.maximum(sizes[:, None], more)
        return fits & (shared * rules.sketch >= rules.least_shared * union) & (shared > 0)

    return near


def _exact(rules: NearRules):
    def near(first: list[tuple], second: list[tuple]) -> np.ndarray:
        sets = [shingles(r[2], rules.shingle) for r in first]
        others = sets if second is first else [shingles(r[2], rules.shingle) for r in second]
        shared = _counts(sets, others)
        sizes, more = (np.array([len(s) for s in x], np.int64) for x in (sets, others))
        return (shared > 0) & (100 * shared >= rules.percent * (sizes[:, None] + more - shared))

    return near


def _compared(rows: DataFrame, key: str, near) -> DataFrame:
    number = partitions(rows.sparkSession)
    columns = [key, "left", "right", "mine", *(c for c in rows.columns
                                               if c not in (key, "left", "right", "mine"))]
    dealt = (rows.select(columns).repartition(number, key, "left", "right")
             .sortWithinPartitions(key, "left", "right"))
    return mapped(dealt, _pair_task(near), "a long, b long", "words")


def near_duplicates(docs: DataFrame, rules: NearRules | None = None) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Documents are linked if their shingle sets are similar enough; a component has all that links
    reach, its id is the smallest doc_id, and that document is kept. Steps:

    1. A sketch and a digest of each whole set; equal sets go on as one.
    2. Inverted lists of sketch values give sets with an overlap; the union's sketch decides which
       may be similar. A list's tasks return links that connect these, not all pairs.
    3. Connected by such links, sets form families; no link leaves its family.
    4. Within each family the full sets of the whole texts are compared, all with all in blocks.
       The confirmed links give the components.

    Texts without words have no shingles and no links. A row without doc_id takes no part: its
    component is null and it is kept. Rows that repeat a doc_id are one document, linked by any of
    its texts. Other columns are not read. An empty table gives an empty one.
    """
    rules = rules or NearRules()
    sketched = stored(sketches(docs, rules), "sketches")
    usable = sketched.where(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    sets = stored(usable.groupBy("digest").agg(
        F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"),
        F.first("sketch").alias("sketch")).select(
        "rep", F.xxhash64("digest").alias("set"), "digest", "n_shingles", "sketch"), "shingle-sets")
    lists = blocked(_prefixes(sets, rules), "value", "set", rules.block)
    lists = lists.join(sets.select("rep", "set", "n_shingles", "sketch"), ["rep", "set"]).drop("set")
    candidates = _compared(lists.select("value", "left", "right", "mine", "rep", "n_shingles", "sketch"),
                           "value", _estimate(rules))
    families = stored(connected_components(candidates), "families")
    members = blocked(families, "component", "node", rules.block)
    texts = text_rows(docs).where(F.col("text").isNotNull())
    # Merged at every size: the members grow with the corpus.
    compared = members.hint("merge").join(texts, members["node"] == texts["doc_id"]).select(
        "component", "left", "right", "mine", "node", "text")
    links = _compared(compared.withColumn("text", F.col("text").cast("binary")), "component",
                      _exact(rules))
    equal = usable.select("digest", "doc_id").join(sets.select("digest", "rep"), "digest").where(
        "doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    found = connected_components(links.unionByName(equal))
    rows = sketched.select("doc_id", "n_shingles").join(
        found.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    component = F.coalesce("component", "doc_id")
    return rows.select("doc_id", "n_shingles", component.alias("component_id"),
                       F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def near_filter(docs: DataFrame, rules: NearRules | None = None) -> DataFrame:
    """The documents that are kept, one for each component, with all their columns."""
    (name,) = fresh_names(docs, "gone_id")
    gone = near_duplicates(docs, rules).where(~F.col("kept")).select(
        F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, F.col("doc_id").cast("long") == F.col(name), "left_anti")
