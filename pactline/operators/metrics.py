"""Counters and histograms over validated, masked, gated and traced messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactline import types as t

# Histogram bounds (milliseconds for the first two, seconds for the others).
VALIDATION_MS = (1, 2, 5, 10, 25, 50, 100, 250)
MASKING_MS = (0.5, 1, 2, 5, 10, 25)
LINEAGE_SECONDS = (0.01, 0.05, 0.1, 0.5, 1.0, 5.0)
ANALYSIS_SECONDS = (0.1, 0.5, 1.0, 2.0, 5.0, 10.0, 30.0)


def _count(df: DataFrame, *by: str | Column) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


def accepted_by_topic(validated: DataFrame) -> DataFrame:
    return _count(validated.filter(F.col("status") == t.ACCEPTED), "topic")


def rejected_by_topic(validated: DataFrame) -> DataFrame:
    """Rejections per topic and type of the first violation."""
    first = F.get("violations", F.lit(0))["type"].alias("violation_type")
    return _count(validated.filter(F.col("status") == t.REJECTED), "topic", first)


def version_mismatches(validated: DataFrame) -> DataFrame:
    return validated.groupBy("topic").agg(F.count_if("version_mismatch").alias("n"))


def processing_errors(validated: DataFrame) -> DataFrame:
    """Processing errors by reason, and messages whose contract was not found."""
    counted = validated.groupBy("error").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("contract").isNull() & F.col("error").isNull()).alias("lookup_errors"),
    )
    return counted


def masking_totals(masked: DataFrame) -> DataFrame:
    """Per topic: transformed fields, blocked messages, advisory detections."""
    return masked.groupBy("topic").agg(
        F.coalesce(F.sum(F.size("fields_transformed")), F.lit(0)).alias("fields_transformed"),
        F.count_if(F.col("masking_error").isNotNull()).alias("failures"),
        F.coalesce(F.sum(F.size("pattern_detections")), F.lit(0)).alias("pattern_warnings"),
    )


def processed_and_failed(traced: DataFrame) -> DataFrame:
    """Lineage messages per topic and failure reason (NULL reason = processed)."""
    return _count(traced, "topic", "failure")


def run_events_by_type(events: DataFrame) -> DataFrame:
    return _count(events, "event_type")


def edge_upserts_by_type(observations: DataFrame) -> DataFrame:
    return _count(observations, "consumer_type")


def histogram(
    df: DataFrame, value: str, buckets: tuple[float, ...], by: str | None = None
) -> DataFrame:
    """Cumulative bucket counts in long form: (by, le, n), plus count and sum per group.

    All buckets come from one aggregation; the last bound is ``+Inf``.
    """
    keys = [by] if by else []
    observed = F.col(value)
    aggregated = df.groupBy(*keys).agg(
        F.array(
            *[
                F.struct(F.lit(str(b)).alias("le"), F.count_if(observed <= b).alias("n"))
                for b in buckets
            ],
            F.struct(F.lit("+Inf").alias("le"), F.count(observed).alias("n")),
        ).alias("buckets"),
        F.count(observed).alias("count"),
        F.sum(observed).alias("sum"),
    )
    return aggregated.select(*keys, F.inline("buckets"), "count", "sum")
