"""Message streams to field metadata, lineage run events and the consumer-edge table.

Input rows have the shape of Spark's Kafka source with headers (``types.CONSUMED``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactline import types as t
from pactline.functions.documents import (
    described_fields,
    extract_fields,
    is_object_text,
    let,
    object_listing,
    top_level_keys,
    with_parsed,
)
from pactline.functions.rows import bind
from pactline.functions.text import message_id, uuid_from

NAMESPACE = "pactline"
OFFSET_KEY = ["topic", "partition", "offset"]
PRODUCER_URL = "https://github.com/OpenLineage/OpenLineage"
# Public OpenLineage facet schemas.
_FACETS = "https://openlineage.io/spec/facets/1-0-0"
DOCUMENTATION_FACET = f"{_FACETS}/DocumentationJobFacet.json"
ERROR_FACET = f"{_FACETS}/ErrorMessageRunFacet.json"
SCHEMA_FACET = f"{_FACETS}/SchemaDatasetFacet.json"
COLUMN_LINEAGE_FACET = f"{_FACETS}/ColumnLineageDatasetFacet.json"
OFFSET_FACET = "kafka-offset/v1"


def message_header(headers: Column, key: str, default: str | None = None) -> Column:
    """First non-empty header with that key; undecodable bytes are replaced."""
    hits = F.filter(
        headers, lambda h: (h["key"] == key) & (F.octet_length(h["value"]) > 0)
    )
    text = F.make_valid_utf8(F.get(hits, F.lit(0))["value"].cast("string"))
    return F.coalesce(text, F.lit(default)) if default is not None else text


def route_by_topic(df: DataFrame, violation_topic: str) -> tuple[DataFrame, DataFrame]:
    """(audit branch, violation branch) of one source."""
    is_violation = F.col("topic") == violation_topic
    return df.filter(~is_violation), df.filter(is_violation)


def subscribed_topics(topics: list[str], audit_topic: str, violation_topic: str) -> list[str]:
    """Configured topics and the two fixed ones, each once."""
    return list(dict.fromkeys([*topics, audit_topic, violation_topic]))


def with_metadata(
    df: DataFrame, value: str = "value", max_segments: int | None = None
) -> DataFrame:
    """Add ``fields``, ``top_level_keys``, ``failure`` and ``truncated`` for the body in ``value``.

    A body that is not JSON, or not an object, has no fields; a tombstone is a failure. Fields of any
    depth are listed unless ``max_segments`` limits it; ``truncated`` says that it left some out.
    """
    raw = F.col(value)
    text = F.when(F.is_valid_utf8(raw.cast("string")), raw.cast("string"))
    parsed = with_parsed(df.withColumn("__text", text), "__text", "__doc")
    is_object = F.col("__doc").isNotNull() & is_object_text(F.col("__text"))
    empty = F.array().cast(t.FIELD_METADATA)
    keys = F.when(is_object, top_level_keys(F.col("__text")))
    found = let(
        object_listing(F.col("__doc"), F.col("__text"), max_segments),
        lambda listed: F.struct(
            described_fields(listed["done"]).cast(t.FIELD_METADATA).alias("fields"),
            listed["cut"].alias("cut"),
        ),
    )
    return (
        bind(parsed, {"__listed": F.when(is_object, found)})
        .withColumns(
            {
                "fields": F.coalesce("__listed.fields", empty),
                "truncated": F.coalesce("__listed.cut", F.lit(False)),
                "top_level_keys": F.coalesce(keys, F.array().cast("array<string>")),
                "failure": F.when(raw.isNull(), F.lit("TypeError")),
            }
        )
        .drop("__text", "__doc", "__listed")
    )


def parse_violation(df: DataFrame, value: str = "value") -> DataFrame:
    """Violation bodies with defaults for missing parts.

    Text that is not JSON is dropped; JSON that is not an object is kept with ``failure`` set.
    """
    raw = F.col(value)
    text = raw.cast("string")
    parsed = with_parsed(df.withColumn("__text", text), "__text", "__doc")
    garbled = ~F.is_valid_utf8(F.col("__text"))
    is_object = F.col("__doc").isNotNull() & is_object_text(F.col("__text"))
    part = lambda name, default: F.coalesce(
        F.try_variant_get("__doc", f"$.{name}", "string"), F.lit(default)
    )
    failure = F.when(garbled, F.lit("UnicodeDecodeError")).when(
        ~is_object, F.lit("AttributeError")
    )
    return (
        parsed.filter(F.col("__doc").isNotNull() | garbled)
        .withColumns(
            {
                "violation_topic": part("topic", "unknown"),
                "violation_producer": part("producer_id", "unknown"),
                "violation_type": part("violation_type", "UNKNOWN"),
                "failure": failure,
            }
        )
        .drop("__text", "__doc")
    )


# ---------------------------------------------------------------------------------------------
# run events


def schema_facet(fields: Column, producer_url: str = PRODUCER_URL) -> Column:
    """Field names and types; NULL (left out of the JSON) when there are none."""
    listed = F.transform(
        fields, lambda f: F.struct(f["path"].alias("name"), f["value_type"].alias("type"))
    )
    return F.when(
        F.size(fields) > 0,
        F.struct(
            F.lit(producer_url).alias("_producer"),
            F.lit(SCHEMA_FACET).alias("_schemaURL"),
            listed.alias("fields"),
        ),
    )


def column_lineage_facet(
    fields: Column, dataset: Column, namespace: str, producer_url: str = PRODUCER_URL
) -> Column:
    """Every field comes unchanged from the same field of the producer's dataset."""
    source = lambda path: F.struct(
        F.lit(namespace).alias("namespace"),
        F.concat(F.lit("producer."), dataset).alias("dataset"),
        path.alias("field"),
    )
    entries = F.transform(
        F.array_distinct(F.transform(fields, lambda f: f["path"])),
        lambda path: F.struct(
            path,
            F.struct(
                F.array(source(path)).alias("inputFields"),
                F.lit("direct").alias("transformationDescription"),
                F.lit("IDENTITY").alias("transformationType"),
            ),
        ),
    )
    return F.when(
        F.size(fields) > 0,
        F.struct(
            F.lit(producer_url).alias("_producer"),
            F.lit(COLUMN_LINEAGE_FACET).alias("_schemaURL"),
            F.map_from_entries(entries).alias("fields"),
        ),
    )


def column_lineage_rows(df: DataFrame, *keys: str, dataset: str = "topic") -> DataFrame:
    """Column lineage as rows: output field, input dataset, input field, kind."""
    paths = F.array_distinct(F.transform("fields", lambda f: f["path"]))
    return df.select(*keys, dataset, F.explode(paths).alias("output_field")).select(
        *keys,
        F.col(dataset).alias("output_dataset"),
        "output_field",
        F.concat(F.lit("producer."), F.col(dataset)).alias("input_dataset"),
        F.col("output_field").alias("input_field"),
        F.lit("IDENTITY").alias("transformation_type"),
    )


def _event_time(time: Column) -> Column:
    return F.date_format(F.to_utc_timestamp(time, F.current_timezone()),
                         "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")


def complete_event(
    namespace: str, dataset: Column, fields: Column, producer: Column, run_id: Column,
    producer_url: str = PRODUCER_URL,
) -> Column:
    """COMPLETE event of an accepted message; reads topic, partition, offset and timestamp."""
    offset_facet = F.struct(
        F.lit(producer_url).alias("_producer"),
        F.lit(OFFSET_FACET).alias("_schemaURL"),
        "topic", "partition", "offset",
    )
    documentation = F.struct(
        F.lit(producer_url).alias("_producer"),
        F.lit(DOCUMENTATION_FACET).alias("_schemaURL"),
        F.concat(F.lit("Producer writing to "), dataset).alias("description"),
    )
    output = F.struct(
        F.lit(namespace).alias("namespace"),
        dataset.alias("name"),
        F.struct(
            schema_facet(fields, producer_url).alias("schema"),
            column_lineage_facet(fields, dataset, namespace, producer_url).alias("columnLineage"),
        ).alias("facets"),
    )
    return F.struct(
        F.lit(t.COMPLETE).alias("eventType"),
        _event_time(F.col("timestamp")).alias("eventTime"),
        F.struct(
            run_id.alias("runId"), F.struct(offset_facet.alias("kafkaOffset")).alias("facets")
        ).alias("run"),
        F.struct(
            F.lit(namespace).alias("namespace"),
            producer.alias("name"),
            F.struct(documentation.alias("documentation")).alias("facets"),
        ).alias("job"),
        F.array().cast("array<string>").alias("inputs"),
        F.array(output).alias("outputs"),
    )


def fail_event(
    namespace: str, dataset: Column, producer: Column, violation: Column, run_id: Column,
    producer_url: str = PRODUCER_URL,
) -> Column:
    """FAIL event of a rejected message."""
    error = F.struct(
        F.lit(producer_url).alias("_producer"),
        F.lit(ERROR_FACET).alias("_schemaURL"),
        F.concat(F.lit("Contract violation: "), violation).alias("message"),
        F.lit("N/A").alias("programmingLanguage"),
    )
    no_facets = F.struct(F.lit(None).cast("string").alias("none")).alias("facets")
    named = lambda name: F.struct(
        F.lit(namespace).alias("namespace"), name.alias("name"), no_facets
    )
    return F.struct(
        F.lit(t.FAIL).alias("eventType"),
        _event_time(F.col("timestamp")).alias("eventTime"),
        F.struct(
            run_id.alias("runId"), F.struct(error.alias("errorMessage")).alias("facets")
        ).alias("run"),
        named(producer).alias("job"),
        F.array().cast("array<string>").alias("inputs"),
        F.array(named(dataset)).alias("outputs"),
    )


def run_id() -> Column:
    """Depends only on topic, partition and offset, so a replay repeats the same id."""
    return uuid_from(message_id(F.col("topic"), F.col("partition"), F.col("offset")))


def complete_events(
    df: DataFrame,
    namespace: str = NAMESPACE,
    dataset: str = "topic",
    producer_header: str = "x-producer-id",
) -> DataFrame:
    """COMPLETE events for rows of :func:`with_metadata` without failure.

    The output dataset is the data topic named by the column ``dataset``; the consumed topic stays
    in the offset facet.
    """
    named = df.filter(F.col("failure").isNull()).withColumns(
        {
            "run_id": run_id(),
            "producer_id": message_header(F.col("headers"), producer_header, "unknown"),
        }
    )
    event = complete_event(
        namespace, F.col(dataset), F.col("fields"), F.col("producer_id"), F.col("run_id")
    )
    return named.withColumn("event", event)


def fail_events(df: DataFrame, namespace: str = NAMESPACE) -> DataFrame:
    """FAIL events for rows of :func:`parse_violation` without failure."""
    event = fail_event(
        namespace, F.col("violation_topic"), F.col("violation_producer"),
        F.col("violation_type"), F.col("run_id"),
    )
    return (
        df.filter(F.col("failure").isNull())
        .withColumn("run_id", run_id())
        .withColumn("event", event)
    )


def traced_messages(
    messages: DataFrame, violation_topic: str, namespace: str, dataset: str = "topic"
) -> DataFrame:
    """Every consumed message with its outcome, in one pass over the source.

    ``failure`` holds the reason of a processing failure, ``dropped`` marks violation bodies that
    are not JSON, ``event_type`` and ``value`` (JSON text) describe the run event of all others.
    Both branches share one parse, and a stateful step upstream runs once.
    """
    raw = F.col("value").cast("string")
    is_violation = F.col("topic") == violation_topic
    valid = F.is_valid_utf8(raw)
    parsed = with_parsed(
        messages.withColumn("__text", F.when(valid, raw)), "__text", "__doc"
    )
    is_object = F.coalesce(
        F.col("__doc").isNotNull() & is_object_text(F.col("__text")), F.lit(False)
    )
    part = lambda name, default: F.coalesce(
        F.try_variant_get("__doc", f"$.{name}", "string"), F.lit(default)
    )
    failure = F.when(
        is_violation,
        F.when(~valid, "UnicodeDecodeError").when(
            F.col("__doc").isNotNull() & ~is_object, "AttributeError"
        ),
    ).otherwise(F.when(F.col("value").isNull(), "TypeError"))
    dropped = is_violation & F.coalesce(valid, F.lit(True)) & F.col("__doc").isNull()
    fields = F.when(
        is_object & ~is_violation, extract_fields(F.col("__doc"), F.col("__text"))
    ).otherwise(F.array().cast(t.FIELD_METADATA))
    described = bind(parsed, {"fields": fields.cast(t.FIELD_METADATA)}).withColumns(
        {"failure": failure, "dropped": dropped, "run_id": run_id()}
    )
    done = complete_event(
        namespace, F.col(dataset), F.col("fields"),
        message_header(F.col("headers"), "x-producer-id", "unknown"), F.col("run_id"),
    )
    rejected = fail_event(
        namespace, part("topic", "unknown"), part("producer_id", "unknown"),
        part("violation_type", "UNKNOWN"), F.col("run_id"),
    )
    emitted = F.col("failure").isNull() & ~F.col("dropped")
    kind = F.when(is_violation, t.FAIL).otherwise(t.COMPLETE)
    text = F.when(is_violation, event_json(rejected)).otherwise(event_json(done))
    return described.select(
        *OFFSET_KEY, "failure", "dropped", "run_id",
        F.when(emitted, kind).alias("event_type"),
        F.when(emitted, text).alias("value"),
    )


def lineage_events(
    messages: DataFrame, violation_topic: str, namespace: str = NAMESPACE, dataset: str = "topic"
) -> DataFrame:
    """Run events of a batch or stream: COMPLETE for audit, FAIL for violation messages."""
    traced = traced_messages(messages, violation_topic, namespace, dataset)
    return traced.filter(F.col("event_type").isNotNull()).select(
        *OFFSET_KEY, "run_id", "event_type", "value"
    )


def event_json(event: Column | str = "event") -> Column:
    """The event as JSON text; facets without content appear as ``{}``."""
    return F.to_json(event)


# ---------------------------------------------------------------------------------------------
# consumer edges

EDGE_KEY = ["source_topic", "consumer_name"]


def edge_versions(observations: DataFrame) -> DataFrame:
    """Observations (edge columns, ``seen_at``, optional ``seq``) as versions of edges without id."""
    seq = F.col("seq") if "seq" in observations.columns else F.lit(0)
    return observations.select(
        F.lit(None).cast("string").alias("id"), *EDGE_KEY, "consumer_type", "consumer_team",
        F.col("seen_at").alias("last_seen_at"), seq.cast("bigint").alias("seq"),
    )


def newest_edges(versions: DataFrame, with_ids: bool = True) -> DataFrame:
    """The newest version of each edge, with a known id if there is one.

    Of equally new versions that with the greater ``seq``, then type and team. One aggregation with
    partial results before the shuffle.
    """
    order = F.struct("last_seen_at", "seq", "consumer_type", "consumer_team")
    merged = versions.groupBy(*EDGE_KEY).agg(
        F.max("id").alias("id"), F.max(order).alias("__newest")
    )
    new_id = uuid_from(F.concat_ws("\u0000", *EDGE_KEY))
    return merged.select(
        (F.coalesce("id", new_id) if with_ids else F.col("id")).alias("id"),
        *EDGE_KEY, "__newest.consumer_type", "__newest.consumer_team", "__newest.last_seen_at",
        "__newest.seq",
    )


def upsert_edges(edges: DataFrame, observations: DataFrame) -> DataFrame:
    """The edge table after seeing ``observations`` (edge columns, ``seen_at``, optional ``seq``).

    The newest observation of an edge sets type and team, also to NULL, and the time it was last
    seen. Known edges keep their id; among equally new versions they count as the oldest.
    """
    fresh = edge_versions(observations)
    known = edges.withColumn("seq", F.lit(-1).cast("bigint")).select(*fresh.columns)
    return newest_edges(known.unionByName(fresh)).drop("seq")


def stale_edges(edges: DataFrame, cutoff: Column) -> DataFrame:
    """Edges not seen since the cutoff; nothing is deleted."""
    return edges.filter(F.col("last_seen_at") < cutoff)
