"""Texts, identifiers and small set helpers used in results."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pactline import types as t


def quoted(text: Column) -> Column:
    """Double-quoted text with backslashes, quotes and line breaks escaped."""
    escaped = text
    for raw, shown in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        escaped = F.replace(escaped, F.lit(raw), F.lit(shown))
    return F.concat(F.lit('"'), escaped, F.lit('"'))


def message_id(topic: Column, partition: Column, offset: Column) -> Column:
    """topic:partition:offset"""
    return F.concat_ws(":", topic, partition.cast("string"), offset.cast("string"))


def uuid_from(text: Column) -> Column:
    """A UUID-shaped identifier that depends only on the text."""
    digest = F.left(F.sha2(text, 256), F.lit(32))
    return F.regexp_replace(digest, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def rejection_detail(violations: Column) -> Column:
    """``field: message`` parts joined by ``; `` (``message`` stands in for a missing field)."""
    label = lambda v: F.when(F.coalesce(v["field"], F.lit("")) == "", F.lit("message")).otherwise(
        v["field"]
    )
    return F.array_join(
        F.transform(violations, lambda v: F.concat(label(v), F.lit(": "), v["message"])), "; "
    )


def classify_dataset(name: Column) -> Column:
    """Dataset type from naming conventions.

    The ``iceberg.`` prefix is tested before the dotted-name rule; otherwise no such name could
    ever be a table.
    """
    return (
        F.when(name.startswith("iceberg."), t.ICEBERG_TABLE)
        .when(name.contains(".") & ~name.startswith("db."), t.KAFKA_TOPIC)
        .when(name.endswith("_table"), t.ICEBERG_TABLE)
        .otherwise(t.UNKNOWN)
    )


def fields_overlap(used: Column, changed: Column) -> Column:
    """Sorted intersection of two field sets."""
    return F.sort_array(F.array_intersect(used, changed))


def rank_of(value: Column, ranks: dict[str, int]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in ranks.items() for x in kv]), value)


def name_of_rank(rank: Column, ranks: dict[str, int]) -> Column:
    pairs = [F.lit(x) for name, number in ranks.items() for x in (number, name)]
    return F.try_element_at(F.create_map(*pairs), rank)


def report_summary(
    topic: Column,
    changed_fields: Column,
    affected: Column,
    critical: Column,
    high: Column,
    direct: Column,
    top_critical: Column,
) -> Column:
    """One or more sentences about an impact report."""
    fields = F.array_join(changed_fields, ", ")
    calm = F.concat(
        F.lit("No downstream consumers are impacted by changes to "), fields,
        F.lit(" in "), topic, F.lit("."),
    )
    lead = F.concat(
        F.lit("Changing "), fields, F.lit(" in "), topic, F.lit(" affects "),
        affected.cast("string"), F.lit(" downstream consumer(s)."),
    )
    more = F.when(
        critical > 3, F.concat(F.lit(" and "), (critical - 3).cast("string"), F.lit(" more"))
    ).otherwise("")
    breaks = F.when(
        critical > 0,
        F.concat(
            critical.cast("string"), F.lit(" CRITICAL: "), F.array_join(top_critical, ", "),
            more, F.lit(" will break."),
        ),
    )
    notify = F.when(
        high > 0,
        F.concat(high.cast("string"), F.lit(" HIGH impact consumer(s) require notification.")),
    )
    reads = F.when(
        direct > 0,
        F.concat(direct.cast("string"), F.lit(" consumer(s) read this topic directly.")),
    )
    return F.when(affected == 0, calm).otherwise(F.concat_ws(" ", lead, breaks, notify, reads))


def no_lineage_summary(topic: Column) -> Column:
    return F.concat(
        F.lit("No lineage found for topic "), topic,
        F.lit(". This may indicate the topic has no recorded consumers yet."),
    )
