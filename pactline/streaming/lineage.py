"""Lineage events and consumer edges from message streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pactline.operators.joins import BROADCAST_BYTES, fits_broadcast
from pactline.operators.lineage import OFFSET_KEY, lineage_events
from pactline.operators.partitions import cut
from pactline.sources import folders
from pactline.sources.edge_table import EdgeTable

_BLOCK = 1 << 15  # offsets in one map of written ones, which takes 4 KB at most
_PLACE = ["topic", "partition", "block"]


def _offsets(rows: DataFrame) -> DataFrame:
    return rows.withColumns(
        {
            "block": F.floor(F.col("offset") / _BLOCK),
            "bit": F.pmod(F.col("offset"), F.lit(_BLOCK)).cast("int"),
        }
    )


def written_offsets(rows: DataFrame) -> DataFrame:
    """(topic, partition, block, bits, n): which offsets the rows have, a bit for each, and how many
    rows there are."""
    return _offsets(rows.select(*OFFSET_KEY)).groupBy(*_PLACE).agg(
        F.bitmap_construct_agg(F.col("bit").cast("bigint")).alias("bits"),
        F.count(F.lit(1)).alias("n"),
    )


def not_written(batch: DataFrame, own: DataFrame, maps: DataFrame) -> DataFrame:
    """The messages of a batch whose offset is in none of the maps.

    The maps of the batch's ``own`` blocks are looked up, by broadcast if they are measured small;
    then no message moves.
    """
    seen = cut(
        maps.join(own.select(*_PLACE), _PLACE, "left_semi").groupBy(*_PLACE).agg(
            F.bitmap_or_agg("bits").alias("bits")
        ),
        "written-offsets",
    )
    blocks = seen.count()
    if blocks == 0:
        return batch
    few = blocks * _BLOCK // 8 <= BROADCAST_BYTES
    joined = _offsets(batch).join(F.broadcast(seen) if few else seen, _PLACE, "left")
    place = F.floor(F.col("bit") / 8).cast("int") + 1
    byte = F.conv(F.hex(F.substring(F.col("bits"), place, F.lit(1))), 16, 10)
    written = F.getbit(byte.cast("bigint"), F.col("bit") % 8) == 1
    return joined.filter(F.col("bits").isNull() | ~written).select(*batch.columns)


def _once(batch: DataFrame, events_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The run events of a batch, each offset once; only those whose offset comes again are moved.

    Such offsets are found among the messages, which are small, so that no event is stored for it.
    """
    again = cut(
        batch.groupBy(*OFFSET_KEY).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"),
        "repeated-offsets",
    )
    side = F.broadcast(again) if fits_broadcast(again) else again
    repeated = events_of(batch.join(side, OFFSET_KEY, "left_semi").select(*batch.columns))
    single = events_of(batch.join(side, OFFSET_KEY, "left_anti").select(*batch.columns))
    return single.unionByName(repeated.dropDuplicates(OFFSET_KEY))


def _new_events(
    batch: DataFrame, batch_id: int, root: str, violation_topic: str, namespace: str, dataset: str
) -> DataFrame:
    """The run events of those messages of a batch that no finished batch below ``root`` has had.

    Leaves the map of the batch's offsets below ``root``.
    """
    spark = batch.sparkSession
    done = folders.finished_children(spark, root, "batch_id")
    written = f"{root}/_written/batch_id={batch_id}"
    written_offsets(batch).write.mode("overwrite").parquet(written)
    own = spark.read.parquet(written)
    blocks, repeated = own.agg(
        F.count(F.lit(1)), F.coalesce(F.sum(F.col("n") - F.bitmap_count("bits")), F.lit(0))
    ).first()
    fresh = batch
    if done and blocks:
        maps = spark.read.parquet(*(f"{root}/_written/batch_id={n}" for n in done))
        fresh = not_written(batch, own, maps)
    events_of = lambda rows: lineage_events(rows, violation_topic, namespace, dataset)
    # Within the batch; otherwise nothing is shuffled.
    return _once(fresh, events_of) if repeated else events_of(fresh)


def lineage_stream(
    messages: DataFrame,
    violation_topic: str,
    path: str,
    checkpoint: str,
    *,
    namespace: str,
    dataset: str = "topic",
    trigger: dict | None = None,
) -> StreamingQuery:
    """Consume, route, extract and emit, losing nothing however late a message is.

    Every micro-batch has its own folder below ``path``, marked when it is finished; a repeated batch
    is left or written anew. Next to the events lies a map of the offsets written, one bit each, so
    offsets that come again in later batches are left out when they are written: a batch looks up
    the maps of its own blocks of offsets, and messages stay where they are.
    """
    root = path.rstrip("/")

    def emit(batch: DataFrame, batch_id: int) -> None:
        home = f"{root}/batch_id={batch_id}"
        if not folders.finished(batch.sparkSession, home):
            events = _new_events(batch, batch_id, root, violation_topic, namespace, dataset)
            events.write.mode("overwrite").parquet(home)
            folders.mark(batch.sparkSession, home)

    return (
        messages.writeStream.foreachBatch(emit)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def read_lineage_events(spark: SparkSession, path: str) -> DataFrame:
    """The events of the finished batches of a lineage stream, each offset and event type once."""
    done = folders.finished_children(spark, path, "batch_id")
    if not done:
        raise ValueError(f"no finished batch in {path}")
    return spark.read.parquet(*done.values())


def write_lines(events: DataFrame, path: str) -> None:
    """The usual delivery: one JSON text a line, gzipped, a folder a batch, written anew when tried again."""
    events.select("value").write.mode("overwrite").option("compression", "gzip").text(path)


def deliver_pending(
    spark: SparkSession,
    outbox: str,
    path: str,
    send: Callable[[DataFrame, str], None] = write_lines,
    log: str | None = None,
) -> list[int]:
    """Send what waits in an outbox, oldest batch first, and return the batches that arrived.

    The first failure ends the round, so batches arrive in their order; it counts as an attempt of
    that batch and nothing is lost. A batch leaves the outbox once it has arrived. If the driver stops
    in between, the batch is sent again to the same folder with the same run ids.
    """
    arrived = []
    for number, home in sorted(folders.finished_children(spark, f"{outbox}/pending", "batch_id").items()):
        attempt = folders.count_marks(spark, home, "_ATTEMPT") + 1
        events = spark.read.schema("value string").parquet(home)
        try:
            send(events, f"{path}/batch_id={number}")
            delivered = True
        except Exception:  # whatever a sink raises is a failed delivery, never the end of the stream
            folders.mark(spark, home, f"_ATTEMPT-{attempt}")
            delivered = False
        if log is not None:
            row = events.agg(F.lit(delivered).alias("delivered"), F.count(F.lit(1)).alias("n"))
            row.write.mode("overwrite").parquet(f"{log}/batch_id={number}/attempt={attempt}")
        if not delivered:
            break
        folders.delete(spark, home)
        arrived.append(number)
    return arrived


def lineage_delivery_stream(
    messages: DataFrame,
    violation_topic: str,
    path: str,
    outbox: str,
    checkpoint: str,
    *,
    namespace: str,
    dataset: str = "topic",
    send: Callable[[DataFrame, str], None] = write_lines,
    log: str | None = None,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Emit run events to a sink that may fail.

    A micro-batch is stored in ``outbox`` first, without the offsets that came before, and then
    everything that waits there is sent (:func:`deliver_pending`): a batch whose delivery fails stays
    and goes first with the next one. :func:`deliver_pending` also empties the outbox after the last batch.
    ``log`` takes one row per attempt (batch_id, attempt): whether it arrived, and its number of events.
    """
    root = outbox.rstrip("/")

    def emit(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        stored, waiting = f"{root}/batch_id={batch_id}", f"{root}/pending/batch_id={batch_id}"
        if not folders.finished(spark, stored):
            events = _new_events(batch, batch_id, root, violation_topic, namespace, dataset)
            events.select("value").write.mode("overwrite").option("compression", "zstd").parquet(waiting)
            folders.mark(spark, waiting)
            folders.mark(spark, stored)
        deliver_pending(spark, root, path, send, log)

    return (
        messages.writeStream.foreachBatch(emit)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def edge_stream(
    observations: DataFrame,
    root: str,
    checkpoint: str,
    *,
    buckets: int = 64,
    merge_after: int = 8,
    on_batch: Callable[[DataFrame, int], None] | None = None,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Keep the consumer-edge table current: a batch writes its own edges and nothing else.

    Read it with ``EdgeTable(spark, root, buckets).read()``. A repeated batch changes nothing.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        table = EdgeTable(batch.sparkSession, root, buckets, merge_after)
        table.append(batch, batch_id)
        if table.compact():
            table.expire()
        if on_batch is not None:
            on_batch(batch, batch_id)

    return (
        observations.writeStream.foreachBatch(merge)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
