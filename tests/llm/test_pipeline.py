"""The pipeline's stages against plain Python, and the registered queries."""

from __future__ import annotations

import pickle
from collections import Counter

import pyarrow as pa
import pytest
from pyspark import cloudpickle

import __spark_entry__
import corpus_pipeline
from pactline.llm import common, exact_dedup, importance, near_dedup, repetition, substring_dedup
from pactline.llm.common import WORD_HASHES, WordHashes, stored
from pactline.session import scratch_path
from tests.llm.conftest import SCHEMA, rows
from tests.llm.test_operators import WORDS, components_of, ids_of, removed_by_brute_force, shingle_sets


def test_stages(spark, docs):
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality", "exact", "near", "substrings", "packing"]
    left, texts = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        left = stored(stage(spark, left, ""), f"test-{name}")
        if name != "packing":
            assert left.columns == docs.columns
            texts[name] = {r.doc_id: r.text for r in left.collect()}
    given = {d: x for d, x, *_ in rows()}
    # Short, empty, null and looping texts go; the hot text and the repeated row are short.
    assert set(texts["quality"]) == {1, 2, 3, 8, 9, 11, *range(200, 230)}
    assert set(texts["exact"]) == set(texts["quality"]) - {1}
    near = components_of(shingle_sets(texts["exact"].items()))
    assert set(texts["near"]) == {d for d, c in near.items() if d == c}
    cut = removed_by_brute_force(texts["near"].items(), 20)
    assert texts["substrings"] == {
        d: b" ".join(kept).decode() if removed else given[d] for d, (kept, removed) in cut.items() if kept}
    pieces = left.collect()
    lengths = Counter()
    for r in pieces:
        lengths[r.doc_id] += r.length
    assert lengths == {d: len(ids_of(WORDS, x)) + 1 for d, x in texts["substrings"].items()}


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_of_an_empty_table(spark, empty, name, stage):
    left = stage(spark, empty, "")
    assert left.count() == 0
    if name != "packing":
        assert left.columns == empty.columns


def test_the_exact_stage_works_by_the_digest_index(spark, docs, monkeypatch):
    appended, append = [], exact_dedup.DigestIndex.append
    monkeypatch.setattr(exact_dedup.DigestIndex, "append", lambda index, fresh, batch: (
        append(index, fresh, batch), appended.append((batch, index.read().count())))[0])
    kept = corpus_pipeline.exact(spark, docs, "").count()
    assert appended == [(0, kept)]


def test_the_exact_filter_drops_texts_of_other_batches(spark):
    frame = lambda *r: spark.createDataFrame(list(r), "doc_id long, text string")
    index = exact_dedup.DigestIndex(spark, "test_filtered", scratch_path(spark, "test-index"), buckets=4)
    ids = lambda df, batch: sorted(r.doc_id for r in exact_dedup.exact_filter(df, index, batch).collect())
    assert ids(frame((1, "a"), (2, "a"), (3, None)), 1) == [2, 3]
    assert ids(frame((4, "a"), (5, "c"), (6, "")), 2) == [5]
    assert ids(frame((4, "a"), (5, "c"), (6, "")), 2) == [5]
    assert index.read().count() == 3
    index.forget()


def test_every_document_may_go(spark, tmp_path):
    """Short, blank, null and looping texts only: nothing passes the first stage."""
    short = [(1, "few words", "en", "a", 9), (2, None, None, None, None), (3, " ", "en", "a", 1),
             (4, "loop it again and again " * 60, "en", "a", 1), (None, "", "en", "a", 0)]
    spark.createDataFrame(short, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.count() == 0
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


def test_every_operator_is_registered():
    names = set(__spark_entry__.queries())
    assert "pipeline" in names
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 14))


def test_stages_remember_words_once():
    operators = importance, near_dedup, repetition, substring_dedup
    memories = {id(x) for m in operators for x in vars(m).values() if isinstance(x, WordHashes)}
    assert memories == {id(WORD_HASHES)}


def test_a_sent_task_uses_the_memory_of_its_worker():
    task = pickle.loads(cloudpickle.dumps(substring_dedup._entry_task(3, 4)))
    WORD_HASHES.clear()
    words = [f"word{i}" for i in range(50)]
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([" ".join(words)])], ["doc_id", "text"])
    assert sum(b.num_rows for b in task(iter([batch]))) > 0
    assert set(WORD_HASHES) == {w.encode() for w in words}
    WORD_HASHES.clear()


def test_workers_get_small_batches_and_forget_other_operators(spark, monkeypatch):
    """A task's input comes in parts, whatever the setting's default; one that remembers nothing clears
    the words and tokens of earlier ones."""
    def sizes(batches):
        from pactline.llm import encoding
        from pactline.llm.common import WORD_HASHES
        held = len(WORD_HASHES) + len(encoding._LOADED)
        WORD_HASHES.of([b"some", b"words"])
        encoding._LOADED["some"] = None
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes]), pa.array([held])], ["bytes", "held"])

    texts = spark.range(0, 6000, 1, 1).selectExpr("repeat('0123456789', 500) as text")  # 30 MB in one task
    found = common.mapped(texts, sizes, "bytes long, held long").collect()
    assert len(found) >= 4 and max(r.bytes for r in found) <= 8 << 20
    assert max(r.held for r in common.mapped(texts, sizes, "bytes long, held long").collect()) == 0
    monkeypatch.setattr(common, "MEMORIES", {"a": (kept := {1: 2}).clear, "b": (gone := {1: 2}).clear})
    common.forget_others("a")
    assert kept and not gone
