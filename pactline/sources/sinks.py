"""Outputs of the message pipelines.

Accepted, rejected and failed messages leave in one pass over the data, as partitions of one table,
because filtering one branch after the other would parse and mask everything again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pactline import types as t
from pactline.functions.text import rejection_detail
from pactline.operators.partitions import cut

_ENVELOPE = ["topic", "contract_id", "contract_version", "producer_id", "key"]


def outcome_rows(processed: DataFrame, *extra: str) -> DataFrame:
    """One shape for all outcomes: ``outcome`` is ACCEPTED, REJECTED or ERROR.

    Only accepted rows carry a payload: the masked one if masking ran, else the original text. A
    message that could not be masked is an ERROR without payload.
    """
    masked = "masked_payload" in processed.columns
    blocked = F.col("masking_error").isNotNull() if masked else F.lit(False)
    accepted = F.col("status") == t.ACCEPTED
    outcome = F.when(accepted & blocked, t.ERROR).otherwise(F.col("status"))
    payload = F.col("masked_payload" if masked else "payload")
    error = F.coalesce(F.col("error"), F.col("masking_error")) if masked else F.col("error")
    none = F.lit(None)
    return processed.select(
        *_ENVELOPE,
        *extra,
        F.when(accepted & ~blocked, payload).alias("payload"),
        F.when(F.col("status") == t.REJECTED, F.col("violations")).alias("violations"),
        F.when(F.col("status") == t.REJECTED, rejection_detail(F.col("violations")))
        .alias("detail"),
        F.when(outcome == t.ERROR, error).alias("error"),
        (F.col("fields_transformed") if masked else none.cast("array<string>"))
        .alias("fields_transformed"),
        "version_mismatch",
        outcome.alias("outcome"),
    )


def write_outcomes(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    rows.write.mode(mode).partitionBy("outcome").parquet(path)


def accepted_rows(rows: DataFrame) -> DataFrame:
    """What goes on to the topic: key and payload."""
    return rows.filter(F.col("outcome") == t.ACCEPTED).select(
        "topic", "key", F.col("payload").alias("value")
    )


def rejected_rows(rows: DataFrame) -> DataFrame:
    """Structured rejections with all violations."""
    return rows.filter(F.col("outcome") == t.REJECTED).select(
        *_ENVELOPE, "violations", "detail"
    )


def write_accepted(rows: DataFrame, path: str | None = None, **kafka: str) -> None:
    """Forward accepted messages keyed by ``key``, to Parquet or (with options) to Kafka."""
    out = accepted_rows(rows)
    if kafka:
        out.write.format("kafka").options(**kafka).save()
    else:
        out.write.mode("append").parquet(path)


def write_rejected(rows: DataFrame, path: str) -> None:
    rejected_rows(rows).write.mode("append").parquet(path)


def write_run_events(events: DataFrame, path: str, fallback: str | None = None) -> bool:
    """Write run events (JSON text in ``value``) as lines; True when they arrived at ``path``.

    The events are computed first, so only a failed write counts as a failed delivery. One does not
    stop the stream if ``fallback`` takes the events instead.
    """
    lines = cut(events.select("value"), "run-events")
    try:
        lines.write.mode("overwrite").text(path)
        return True
    except Exception:
        if fallback is None:
            raise
        lines.write.mode("overwrite").text(fallback)
        return False
