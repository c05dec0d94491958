"""How inputs are dealt over tasks."""

from __future__ import annotations

from pyspark.sql import functions as F

from pactline.operators.partitions import spread
from workload import queries as q


def test_larger_inputs_have_more_tasks(spark, tmp_path):
    spark.range(400_000).coalesce(1).write.parquet(str(tmp_path / "rows"))
    rows = spark.read.parquet(str(tmp_path / "rows"))
    cores = spark.sparkContext.defaultParallelism
    assert spread(rows).rdd.getNumPartitions() == cores
    assert spread(rows, 100_000).rdd.getNumPartitions() > cores
    assert spread(rows.repartition(4 * cores), 100_000).rdd.getNumPartitions() == 4 * cores


def test_a_batch_of_a_large_stream_has_several_files(spark, tmp_path):
    events = spark.range(90_000).selectExpr("id as event_id")
    events.write.parquet(str(tmp_path / "events.parquet"))
    seen = []
    q._stream_with_repeats(spark, str(tmp_path), "events").writeStream.foreachBatch(
        lambda batch, n: seen.append((batch.select(F.input_file_name()).distinct().count(), batch.count()))
    ).option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start().awaitTermination()
    assert [files for files, _ in seen] == [3] * 6
    assert sum(n for _, n in seen) > 90_000
    assert q._files_of_a_batch(events.limit(10), 6) == 1
