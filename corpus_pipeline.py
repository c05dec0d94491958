"""From raw documents to packed training sequences: quality, deduplication, packing.

Every stage takes (spark, docs, sf_dir) and returns the documents it keeps with the columns they
came with; the last one returns the pieces of packed sequences. `run` writes each stage's result
to the shared checkpoint folder and reads it back as the next one's input.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pactline.llm.common import stored
from pactline.llm.exact_dedup import DigestIndex, exact_filter
from pactline.llm.near_dedup import near_filter
from pactline.llm.packing import pack_documents
from pactline.llm.repetition import quality_filter
from pactline.llm.substring_dedup import remove_substrings
from pactline.session import scratch_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: documents that the quality rules reject go."""
    return quality_filter(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: of equal texts the one with the largest doc_id stays, by an index of digests."""
    index = DigestIndex(spark, f"digests_{uuid.uuid4().hex}", scratch_path(spark, "digest-index"))
    kept = exact_filter(docs, index)
    index.forget()
    return kept


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: of each group of near-duplicates the one with the smallest doc_id stays."""
    return near_filter(docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: passages that occur earlier in the corpus are cut out."""
    return remove_substrings(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: tokens in sequences of at most 4096."""
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), "~", 1).drop("ids")


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("substrings", substrings),
          ("packing", packing)]

# Tokens and suffix arrays are beyond SQL; the tests compare with a version in plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
