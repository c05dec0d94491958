"""Message streams: Kafka when its connector is installed, else files of the same shape."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pactline import types as t


def read_message_stream(
    spark: SparkSession,
    topics: list[str],
    *,
    starting: str = "earliest",
    bootstrap_servers: str | None = None,
    path: str | None = None,
    max_per_trigger: int | None = None,
    file_format: str = "parquet",
) -> DataFrame:
    """A stream of consumed messages of several topics, from the earliest offset.

    With ``bootstrap_servers`` it subscribes to Kafka; with ``path`` it follows files whose columns
    are those of ``types.CONSUMED``. Progress lives in the checkpoint of the query that uses it.
    ``max_per_trigger`` limits offsets (Kafka) or files per micro-batch.
    """
    if bootstrap_servers is not None:
        reader = (
            spark.readStream.format("kafka")
            .option("kafka.bootstrap.servers", bootstrap_servers)
            .option("subscribe", ",".join(topics))
            .option("startingOffsets", starting)
            .option("includeHeaders", "true")
        )
        if max_per_trigger:
            reader = reader.option("maxOffsetsPerTrigger", max_per_trigger)
        return reader.load()
    if path is None:
        raise ValueError("read_message_stream needs bootstrap_servers or path")
    reader = spark.readStream.schema(t.CONSUMED).format(file_format)
    if max_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_per_trigger)
    return reader.load(path).filter(F.col("topic").isin(*topics))
