"""Continuous validation and masking of produced messages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from pactline.plans.contract_check import contract_outcomes
from pactline.sources.sinks import write_outcomes


def contract_stream(
    messages: DataFrame,
    load_enforcement: Callable[[], DataFrame],
    load_keys: Callable[[], DataFrame],
    path: str,
    checkpoint: str,
    *,
    extra: tuple[str, ...] = (),
    partitions: int | None = None,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Validate, mask and split a stream of messages.

    Each micro-batch reads the contracts again, so a new version takes effect with the next batch,
    and writes all outcomes in one pass to its own folder. A batch repeated after a failure
    overwrites that folder: every message ends up in the output exactly once.

    Messages are not moved unless ``partitions`` asks for it: give it when a batch has fewer splits
    than the cluster has cores and the source cannot be told to split it further.
    """
    root = path.rstrip("/")

    def process(batch: DataFrame, batch_id: int) -> None:
        given = batch if partitions is None else batch.repartition(partitions)
        rows = contract_outcomes(given, load_enforcement(), load_keys(), *extra)
        write_outcomes(rows, f"{root}/batch_id={batch_id}")

    return (
        messages.writeStream.foreachBatch(process)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
