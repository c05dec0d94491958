"""One query for each operator of this subpackage, over whole tables, with their digest columns."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pactline.llm import (bpe, chat, clustering, exact_dedup, importance, near_dedup, packing, repetition,
                          sharding, simhash, substring_dedup, token_files, turn_repair)
from pactline.llm.common import stored
from pactline.session import scratch_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet")


@query
def op1_kd_sharding(spark, sf):
    return sharding.kd_shards(documents(spark, sf), shards=40)


@query
def op2_token_files(spark, sf):
    path = scratch_path(spark, "token-files")
    token_files.write_token_files(documents(spark, sf), path,
                                  public_tokenizers.path("byte_bpe_50k.json"), 2, 50_257)
    return token_files.read_token_digests(spark, path)


@query
def op3_chat_format(spark, sf):
    text = "</s>[INST] ok [/INST]"
    rows = spark.createDataFrame([(-1, 0, "user", text), (-1, 1, "assistant", text)],
                                 "conv_id long, turn long, role string, text string")
    turns = spark.read.parquet(f"{sf}/conversations.parquet").select(rows.columns).union(rows)
    formatted = stored(chat.format_conversations(turns), "chats")
    read = chat.read_conversations(formatted)
    listed = F.array_join(F.transform(
        F.arrays_zip("roles", "texts"),
        lambda t: F.concat(t["roles"], F.lit("\n"), t["texts"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("roles").cast("long").alias("n_turns"), F.sha2(listed, 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"), "formatted_chars")


@query
def op4_near_dedup(spark, sf):
    return near_dedup.near_duplicates(documents(spark, sf))


@query
def op5_exact_dedup(spark, sf):
    name = uuid.uuid4().hex
    index = exact_dedup.DigestIndex(spark, f"digests_{name}", scratch_path(spark, "digest-index"))
    rows = exact_dedup.exact_duplicates(documents(spark, sf), index).drop("known")
    index.forget()
    return rows


@query
def op6_best_fit_packing(spark, sf):
    return packing.pack_documents(documents(spark, sf), public_tokenizers.path("word_bpe_49k.json"),
                                  "~", 1).drop("ids")


@query
def op7_importance(spark, sf):
    return importance.importance_sample(documents(spark, sf), spark.read.parquet(f"{sf}/labels.parquet"))


@query
def op8_substring_dedup(spark, sf):
    return substring_dedup.substring_duplicates(documents(spark, sf)).drop("starts", "stops")


@query
def op9_quality_rules(spark, sf):
    return repetition.quality_measures(documents(spark, sf))


@query
def op10_byte_bpe(spark, sf):
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    encoded = bpe.encode_texts(documents(spark, sf), path, pattern)
    return bpe.decode_ids(encoded, path).select(
        "doc_id", F.expr("length(ids) div 4").cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op11_centroids(spark, sf):
    return clustering.cluster_vectors(spark.read.parquet(f"{sf}/embeddings.parquet"))


@query
def op12_simhash(spark, sf):
    return simhash.simhash_groups(documents(spark, sf))


@query
def op13_turn_repair(spark, sf):
    turns = spark.read.parquet(f"{sf}/conversations.parquet")
    conversations, edits = turn_repair.repair_conversations(turn_repair.damaged(turns))
    digests = turn_repair.repaired_digests(edits)
    ids = turns.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    rows = ids.alias("i").join(conversations.alias("c"), F.expr("i.conv_id <=> c.conv_id"), "left").join(
        digests.alias("d"), F.expr("i.conv_id <=> d.conv_id"), "left")
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return rows.select("i.conv_id", *(F.coalesce(c, F.lit(0)).alias(c) for c in counts),
                       F.coalesce("audit", F.lit("")).alias("audit"),
                       F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
