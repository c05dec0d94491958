"""Selection by importance: how much likelier good texts make a document than all texts do."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pactline.llm.common import (WORD_HASHES, Batches, batch, mapped, rolling, slices, stored,
                                 text_bytes)

_PART = 1024


@dataclass(frozen=True)
class ImportanceRules:
    """`features` buckets for hashed words and word pairs; `prior` is added to each count; the
    Gumbel noise (of scale `noise`) depends on `seed` and doc_id only. `labelled`: at most so many
    good documents make the target model (all when there are fewer; those with the smallest hash).
    `share` of all documents is selected; None: the share of good ones among the labelled."""

    features: int = 1 << 16
    prior: float = 1.0
    noise: float = 1.0
    seed: int = 17
    labelled: int = 1_000_000
    share: float | None = None


def _features(data: bytes | None, number: int) -> np.ndarray:
    """The buckets of a text's words and word pairs; A-Z count as a-z."""
    values = WORD_HASHES.of((data or b"").lower().split())
    # Scrambled once more, so single words and pairs fall into all buckets.
    return np.concatenate([rolling(values, 1), rolling(values, 2)]) % np.uint64(number)


def _count_task(rules: ImportanceRules):
    """Each task's sums: rows of 1024 buckets of the raw (0) and target (1) model."""
    schema = pa.schema([("model", pa.int32()), ("part", pa.int32()), ("counts", pa.binary())])

    def task(batches: Batches) -> Batches:
        sums = np.zeros((2, rules.features), np.int64)
        for some in slices(batches):
            for data, good in zip(text_bytes(some.column("text")), some.column("good").to_pylist()):
                counts = np.bincount(_features(data, rules.features).astype(np.int64),
                                     minlength=rules.features)
                sums[0] += counts
                if good:
                    sums[1] += counts
        for model in (0, 1):
            for part in range(rules.features // _PART):
                some = sums[model, part * _PART:(part + 1) * _PART]
                if some.any():
                    yield batch(schema, [model], [part], [some.astype("<i8").tobytes()])

    return task


def _add_task(batches: Batches) -> Batches:
    schema = pa.schema([("model", pa.int32()), ("part", pa.int32()), ("counts", pa.binary())])
    sums: dict[tuple[int, int], np.ndarray] = {}
    for some in batches:
        for row in some.to_pylist():
            key = row["model"], row["part"]
            sums[key] = sums.get(key, 0) + np.frombuffer(row["counts"], "<i8")
    for (model, part), counts in sums.items():
        yield batch(schema, [model], [part], [counts.astype("<i8").tobytes()])


def _score_task(rules: ImportanceRules, ratios: np.ndarray):
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("key", pa.float64())])

    def task(batches: Batches) -> Batches:
        for some in slices(batches):
            scores = [float(ratios[_features(x, rules.features).astype(np.int64)].sum())
                      for x in text_bytes(some.column("text"))]
            yield batch(schema, some.column("doc_id"), scores, scores)

    return task


def _kth_largest(rows: DataFrame, order: str, k: int, bits: int = 62, digit: int = 12) -> int:
    """The k-th largest of a column of whole numbers below 2^62: counts of 4096 ranges at a time."""
    low, shift, above = 0, bits, 0
    while shift > 0:
        step = min(digit, shift)
        shift -= step
        place = F.shiftright(F.col(order) - low, shift)
        found = (rows.where((F.col(order) >= low) & (place < (1 << step))).groupBy(place.alias("place"))
                 .count().collect())
        for row in sorted(found, key=lambda r: -r["place"]):
            if above + row["count"] >= k:
                low += row["place"] << shift
                break
            above += row["count"]
    return low


def importance_sample(docs: DataFrame, labels: DataFrame, rules: ImportanceRules | None = None) -> DataFrame:
    """One row per document: doc_id, score, key, kept.

    Two models of hashed words and word pairs are counted: one of all documents, one of those with
    the label quality = 1. `score` is the log of the ratio of both likelihoods; `key` adds Gumbel
    noise, and the rows with the largest keys are kept: a sample without replacement in proportion
    to the ratio. Rows that repeat a doc_id and score are kept or left together.

    Null and empty texts score 0. A null doc_id is a value like others. A document labelled several
    times is good if one label says so. Without labels or without good ones all scores are 0 and,
    unless a share is given, all rows are kept. Other columns are not read; an empty table gives an
    empty one.
    """
    rules = rules or ImportanceRules()
    votes = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"))
    votes = stored(votes, "votes")
    all_votes, good_votes = votes.agg(
        F.count("*"), F.coalesce(F.sum(F.col("good").cast("long")), F.lit(0))).first()
    target = votes.where("good").select("doc_id", F.lit(True).alias("good"))
    if good_votes > rules.labelled:
        chance = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(rules.labelled / good_votes * (1 << 20))
        target = target.where(chance)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                        F.col("text").cast("string").alias("text"))
    # Merged at every size: the labels grow with the corpus.
    marked = texts.join(target.hint("merge"), "doc_id", "left").select(
        "doc_id", "text", F.coalesce("good", F.lit(False)).alias("good"))
    parts = mapped(marked.select("text", "good"), _count_task(rules), "model int, part int, counts binary",
                   "words")
    summed = mapped(parts.repartition("model", "part"), _add_task, "model int, part int, counts binary")
    counts = np.zeros((2, rules.features), np.int64)
    for row in summed.collect():  # 2 x features numbers
        start = row["part"] * _PART
        counts[row["model"], start:start + _PART] = np.frombuffer(row["counts"], "<i8")
    ratios = np.zeros(rules.features)
    if counts[1].sum():
        raw, good = np.log(counts + rules.prior) - np.log(
            (counts + rules.prior).sum(axis=1, keepdims=True))
        ratios = good - raw
    scored = mapped(texts, _score_task(rules, ratios), "doc_id long, score double, key double", "words")
    # A uniform number from 53 bits of a hash, never 0 or 1.
    uniform = (F.shiftrightunsigned(F.xxhash64(F.lit(rules.seed), "doc_id"), 11) + 0.5) / float(1 << 53)
    noisy = F.col("score") - rules.noise * F.ln(-F.ln(uniform))
    # Keys as whole numbers in the same order: steps of 2^-20 within +-2^40.
    whole = F.round((F.greatest(F.least("key", F.lit(2.0 ** 40)), F.lit(-(2.0 ** 40))) + 2.0 ** 40) * (1 << 20))
    rows = stored(scored.withColumn("key", noisy).withColumn("order", whole.cast("long")), "scores")
    total = rows.count()
    share = rules.share if rules.share is not None else (good_votes / all_votes if good_votes else 1.0)
    k = round(total * share)
    kept = F.lit(False) if k < 1 else F.col("order") >= _kth_largest(rows, "order", k)
    return rows.select("doc_id", "score", "key", kept.alias("kept"))
