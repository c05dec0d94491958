"""One query per operator, over whole driver tables; result columns are flat."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pactline import types as t
from pactline.functions import documents, masks, semver, text
from pactline.operators import evolution, impact, lineage, masking, metrics, quality, registry
from pactline.operators import validation
from pactline.operators.joins import hashed, stored_bytes
from pactline.operators.partitions import spread
from pactline.plans import blast_radius as blast
from pactline.plans import change_gate
from pactline.plans.contract_check import check_and_mask, contract_outcomes
from pactline.session import scratch_path
from pactline.sources import graph
from pactline.sources.edge_table import EdgeTable
from pactline.sources.registry import read_registry
from pactline.sources.sinks import accepted_rows, rejected_rows, write_accepted, write_rejected
from pactline.streaming.contracts import contract_stream
from pactline.streaming.lineage import (
    edge_stream,
    lineage_delivery_stream,
    lineage_stream,
    read_lineage_events,
    write_lines,
)
from workload import derive as d

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def joined(array: Column, sep: str = ",") -> Column:
    return F.array_join(array, sep)


def _validated(spark: SparkSession, sf: str) -> DataFrame:
    return validation.validate(d.messages(spark, sf), d.event_enforcement(spark))


def _checked(spark: SparkSession, sf: str) -> DataFrame:
    return check_and_mask(d.messages(spark, sf), d.event_enforcement(spark), d.event_keys(spark))


def _kinds(violations: Column) -> Column:
    return joined(F.transform(violations, lambda v: F.concat_ws(":", v["type"], v["field"])))


# --- validation -------------------------------------------------------------------------------


@query
def validate_events(spark, sf):
    return _validated(spark, sf).select(
        "event_id", "topic", "status", "error", "version_mismatch",
        _kinds(F.col("violations")).alias("violations"),
        text.rejection_detail(F.col("violations")).alias("detail"),
    )


@query
def contract_check_summary(spark, sf):
    """Messages per topic, status and first violation: the flagship."""
    first = validation.first_violation(F.col("violations"))
    return _validated(spark, sf).groupBy(
        "topic", "status", first["type"].alias("first_violation")
    ).agg(F.count(F.lit(1)).alias("n"))


@query
def first_violation(spark, sf):
    v = _validated(spark, sf).select(
        "event_id", validation.first_violation(F.col("violations")).alias("v")
    )
    return v.select("event_id", F.col("v.type").alias("type"), F.col("v.field").alias("field"),
                    F.col("v.message").alias("message"))


@query
def accepted_by_topic(spark, sf):
    return metrics.accepted_by_topic(_validated(spark, sf))


@query
def rejected_by_topic(spark, sf):
    return metrics.rejected_by_topic(_validated(spark, sf))


@query
def version_mismatch(spark, sf):
    return metrics.version_mismatches(_validated(spark, sf))


@query
def processing_errors(spark, sf):
    return metrics.processing_errors(_validated(spark, sf))


@query
def attach_contract(spark, sf):
    m = validation.attach_contract(d.messages(spark, sf), d.event_enforcement(spark))
    return m.groupBy("topic").agg(
        F.count(F.lit(1)).alias("messages"),
        F.count("contract").alias("with_contract"),
        F.coalesce(F.max(F.size("contract.fields")), F.lit(0)).alias("rules"),
        F.max("contract.version").alias("version"),
    )


@query
def freshness(spark, sf):
    """Contracts fetched when their topic was last seen, judged at the end of the data."""
    events = d.table(spark, sf, "events")
    seen = events.groupBy(F.concat(F.lit("events."), "event_type").alias("topic")).agg(
        F.max("ts").alias("fetched_at"))
    now = events.agg(F.max("ts").alias("now"))
    e = d.event_enforcement(spark).withColumn(
        "fail_open", F.col("topic").isin("events.click", "events.view"))
    latest = now.first()["now"]
    fresh = validation.apply_freshness(
        e.join(seen, "topic"), F.col("fetched_at"), F.lit(latest), ttl_seconds=600)
    rules = fresh.drop("fetched_at")
    v = validation.validate(d.messages(spark, sf), rules)
    return v.groupBy("topic").agg(
        F.count_if(F.col("contract").isNotNull()).alias("with_contract"),
        F.count_if("contract.stale").alias("stale"),
        F.count_if(F.col("status") == t.REJECTED).alias("rejected"),
    )


@query
def parse_envelope(spark, sf):
    e = validation.require_envelope_fields(validation.parse_envelope(d.envelopes(spark, sf)))
    p = documents.with_document(e, "payload", "doc")
    return p.select("event_id", "topic", "producer_id", "key", "envelope_error",
                    F.try_variant_get("doc", "$.event_id", "bigint").alias("inner_id"),
                    F.try_variant_get("doc", "$.amount", "double").alias("amount"))


@query
def outcome_split(spark, sf):
    """Accepted and rejected rows as they reach the sinks, counted per topic."""
    rows = contract_outcomes(
        d.messages(spark, sf), d.event_enforcement(spark), d.event_keys(spark), "event_id")
    accepted = accepted_rows(rows).select("topic", F.lit("forwarded").alias("sink"))
    rejected = rejected_rows(rows).select("topic", F.lit("rejected").alias("sink"))
    return accepted.unionByName(rejected).groupBy("topic", "sink").agg(
        F.count(F.lit(1)).alias("n"))


@query
def written_outcomes(spark, sf):
    """Accepted and rejected rows written each to its own table, and read back."""
    rows = contract_outcomes(
        d.messages(spark, sf), d.event_enforcement(spark), d.event_keys(spark), "event_id")
    out = scratch_path(spark, "outcomes")
    write_accepted(rows, f"{out}/forwarded")
    write_rejected(rows, f"{out}/rejected")
    read = lambda name: spark.read.parquet(f"{out}/{name}").select("topic", F.lit(name).alias("sink"))
    return read("forwarded").unionByName(read("rejected")).groupBy("topic", "sink").agg(
        F.count(F.lit(1)).alias("n"))


# --- documents --------------------------------------------------------------------------------


def _documents(spark, sf):
    return documents.with_document(d.messages(spark, sf), "payload", "doc")


@query
def json_presence(spark, sf):
    """Presence, null and kind at several paths, the paths being data."""
    names = ("amount", "user.email", "user.none", "tags", "tags.pan", "event_id.x", "props.k")
    paths = F.explode(F.array(*[F.lit(n) for n in names])).alias("path")
    at = documents.path_get(F.col("doc"), F.col("path"))
    return _documents(spark, sf).select("event_id", "doc", paths).withColumn("v", at).select(
        "event_id", "path",
        F.col("v").isNotNull().alias("present"),
        F.coalesce(F.is_variant_null("v"), F.lit(False)).alias("is_null"),
        documents.json_kind(F.col("v")).alias("kind"),
    )


@query
def path_set(spark, sf):
    """Replace a nested value, then read the whole branch back."""
    out = documents.path_set(
        F.col("doc"), F.lit("user.email"), F.lit("hidden").cast("variant"))
    return _documents(spark, sf).withColumn("out", out).select(
        "event_id",
        F.try_variant_get("out", "$.user.email", "string").alias("email"),
        F.try_variant_get("out", "$.user.id", "string").alias("user_id"),
        F.try_variant_get("out", "$.event_id", "bigint").alias("inner_id"),
    )


@query
def collect_paths(spark, sf):
    paths = documents.object_paths(F.col("doc"), F.col("payload"))
    return _documents(spark, sf).select("event_id", F.explode(paths).alias("path"))


@query
def extract_fields(spark, sf):
    fields = documents.extract_fields(F.col("doc"), F.col("payload"))
    return _documents(spark, sf).select("event_id", F.inline(fields))


@query
def deep_fields(spark, sf):
    """Bodies of two to nine levels: all fields, and what a limit of five leaves and reports."""
    value = F.concat(F.lit('{"id":1,"d":'), F.expr("repeat('{\"d\":', cast(event_id % 8 as int))"),
                     F.col("event_id").cast("string"), F.expr("repeat('}', cast(event_id % 8 as int))"),
                     F.lit("}"))
    bodies = d.table(spark, sf, "events").select("event_id", value.alias("value"))
    whole = lineage.with_metadata(bodies).select(
        "event_id", "value", F.size("fields").cast("bigint").alias("n"),
        F.element_at("fields", -2)["path"].alias("deepest"), F.col("truncated").alias("whole_cut"))
    return lineage.with_metadata(whole, max_segments=5).select(
        "event_id", "n", "deepest", "whole_cut",
        F.size("fields").cast("bigint").alias("n_at_five"), "truncated")


@query
def top_level_keys(spark, sf):
    keys = F.sort_array(documents.top_level_keys(F.col("payload")))
    return _documents(spark, sf).select(
        "event_id", joined(F.when(F.col("doc").isNotNull(), keys)).alias("keys"))


@query
def canonical_compare(spark, sf):
    """Schema bodies equal by value, whatever their blanks and key order.

    The other text has its keys in another order; every third one also has another type name.
    """
    p = d.proposals(spark, sf)
    number = F.regexp_extract("change_id", "[0-9]+", 0).cast("long")
    turned = F.replace("proposed_schema", F.lit('"type":"record", "name":"Order"'),
                       F.lit('"name" : "Order","type" : "record"'))
    other = F.when(number % 3 == 0, F.replace(turned, F.lit('"Order"'), F.lit('"order"')))
    spaced = p.withColumn("other", F.coalesce(other, turned))
    both = documents.with_parsed(
        documents.with_parsed(spaced, "proposed_schema", "a"), "other", "b")
    same = documents.canonical_json(F.col("a")) == documents.canonical_json(F.col("b"))
    return both.select("change_id", same.alias("same"))


# --- masking ----------------------------------------------------------------------------------


@query
def value_masks(spark, sf):
    c = d.table(spark, sf, "customer")
    key = masks.TokenKey.from_secret(d.SECRET)
    name = F.col("c_name")
    return c.select(
        "c_custkey",
        masks.redact(F.when(F.col("c_acctbal") > 0, name)).alias("redacted"),
        masks.mask(name).alias("masked"),
        masks.mask(F.col("c_nationkey").cast("string")).alias("short"),
        masks.tokenize(name, F.col("c_mktsegment"), key).alias("token"),
    )


@query
def contract_outcomes_rows(spark, sf):
    rows = contract_outcomes(
        d.messages(spark, sf), d.event_enforcement(spark), d.event_keys(spark), "event_id")
    parsed = documents.with_document(rows, "payload", "doc")
    at = lambda p: F.try_variant_get("doc", p, "string")
    return parsed.select(
        "event_id", "outcome", "error", "detail",
        joined(F.col("fields_transformed")).alias("transformed"),
        at("$.user.email").alias("email"), at("$.user.id").alias("user_id"),
        F.when(F.col("topic") == "events.view", at("$.user")).alias("user"),
    )


@query
def masking_totals(spark, sf):
    return metrics.masking_totals(_checked(spark, sf))


@query
def scan_pii(spark, sf):
    return _checked(spark, sf).select("event_id", F.inline("pattern_detections"))


@query
def detect_pii(spark, sf):
    """The name detector on free text: the first keyword group found in each document."""
    docs = spread(d.table(spark, sf, "documents"))
    return docs.select("doc_id", masks.detect_pii(F.col("text")).alias("pii_class"))


# --- registry ---------------------------------------------------------------------------------


@query
def active_version(spark, sf):
    active = registry.active_version(d.versions(spark, sf), d.contracts(spark, sf))
    return active.select("topic", "id", "version", "status")


@query
def list_active_versions(spark, sf):
    return registry.list_active_versions(d.versions(spark, sf)).select(
        "id", "contract_id", "version")


def _placed(df, key):
    """The place of each row among those of its key, in the order in which the rows are."""
    order = Window.partitionBy(key).orderBy("at")
    return df.withColumn("at", F.monotonically_increasing_id()).withColumn(
        "place", F.row_number().over(order).cast("bigint")).drop("at")


@query
def ranked_active_versions(spark, sf):
    """The order of the list of active versions, by the place of each among those of its contract."""
    listed = registry.list_active_versions(d.versions(spark, sf)).select("id", "contract_id")
    return _placed(listed, "contract_id")


@query
def latest_version(spark, sf):
    return registry.latest_version(d.versions(spark, sf)).select(
        "contract_id", "id", "version", "status")


@query
def contract_by_name(spark, sf):
    names = d.proposals(spark, sf).select(F.col("contract_name").alias("name"))
    return registry.contract_by_name(d.contracts(spark, sf), names).select(
        "id", "name", "topic", "owner_team")


@query
def downstream_edges(spark, sf):
    return registry.downstream_edges(d.lineage_edges(spark, sf), "orders.1")


@query
def field_policies(spark, sf):
    """Policies derived from suppliers, looked up for one contract."""
    s = d.table(spark, sf, "supplier").select(
        F.col("s_nationkey").cast("string").alias("contract_id"),
        F.lower("s_name").alias("field_path"),
        F.when(F.col("s_acctbal") > 0, t.MASK).otherwise(t.REDACT).alias("policy_type"),
    )
    return registry.field_policies(s, "7")


@query
def enforcement_rules(spark, sf):
    """The rules of every customer's active version: policies come from the order priorities."""
    o = d.table(spark, sf, "orders")
    policies = o.groupBy("o_custkey", "o_orderpriority").agg(
        F.min("o_orderdate").cast("timestamp").alias("created_at")
    ).select(
        F.col("o_custkey").cast("string").alias("contract_id"),
        F.lower(F.substring("o_orderpriority", 3, 20)).alias("field_path"),
        F.when(F.left("o_orderpriority", F.lit(1)) < "3", t.MASK)
        .otherwise(t.AUDIT_LOG).alias("policy_type"),
        F.lit('{"required":true,"pii_class":"PERSONAL"}').alias("policy_config"),
        "created_at",
    )
    e = registry.enforcement_contracts(d.versions(spark, sf), d.contracts(spark, sf), policies)
    return e.select("topic", "version", "fail_open", F.inline("fields"))


@query
def activate_version(spark, sf):
    """Activate the newest version of every contract."""
    v = d.versions(spark, sf)
    wanted = registry.latest_version(v).select("contract_id", F.col("id").alias("version_id"))
    return registry.activate_version(v, wanted).select("id", "contract_id", "status")


@query
def insert_version(spark, sf):
    """Versions of cheap orders arrive in a table of those of expensive ones."""
    v = d.versions(spark, sf).join(
        d.table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("id"),
                                            "o_totalprice"), "id")
    stored = v.filter("o_totalprice >= 250000")
    fresh = registry.new_versions(stored, v.filter("o_totalprice < 250000"))
    return fresh.select("id", "contract_id", "version")


def _as_table(df, name):
    """The columns of a registry table; those the data does not have are NULL."""
    return df.select(*(
        (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in t.REGISTRY[name]))


@query
def registry_round_trip(spark, sf):
    """Tables written to a registry, approval events appended in two parts, all read again."""
    root = scratch_path(spark, "registry")
    events = d.table(spark, sf, "orders").select(
        F.concat(F.lit("ev-"), F.col("o_orderkey").cast("string")).alias("id"),
        F.col("o_orderkey").cast("string").alias("contract_version_id"),
        F.lit("reviewer").alias("actor"),
        F.when(F.col("o_totalprice") >= 100000, "APPROVED").otherwise("REJECTED").alias("action"))
    written = {"contracts": d.contracts(spark, sf), "contract_versions": d.versions(spark, sf)}
    for name in t.REGISTRY:
        rows = written.get(name, events.limit(0))
        _as_table(rows, name).write.parquet(f"{root}/{name}")
    for half in (0, 1):
        part = events.where(F.pmod(F.col("contract_version_id").cast("long"), F.lit(2)) == half)
        registry.append_approval_event(_as_table(part, "approval_events"), f"{root}/approval_events")
    tables = read_registry(spark, root)
    joined_rows = tables["contract_versions"].withColumnRenamed("id", "version_id").join(
        tables["contracts"].select(F.col("id").alias("contract_id"), "topic"), "contract_id").join(
        tables["approval_events"].select("contract_version_id", "action"),
        F.col("version_id") == F.col("contract_version_id"), "left")
    return joined_rows.groupBy("topic").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("action") == "APPROVED").alias("approved"),
        F.count_if(F.col("action") == "REJECTED").alias("rejected"))


# --- semantic versions ------------------------------------------------------------------------


@query
def semver_parts(spark, sf):
    v = d.versions(spark, sf).select(
        "id", F.when(F.col("status") == t.DRAFT, F.concat("version", F.lit("-rc")))
        .otherwise(F.col("version")).alias("version"))
    parsed = v.withColumn("p", semver.parse_semver(F.col("version")))
    return parsed.select(
        "id", F.col("p.major").alias("major"), F.col("p.minor").alias("minor"),
        F.col("p.patch").alias("patch"), semver.format_semver(F.col("p")).alias("formatted"))


@query
def version_steps(spark, sf):
    h = evolution.evolution_history(d.versions(spark, sf))
    return h.select("id", "previous_version", "version", "bump", "bump_error")


# --- schema evolution -------------------------------------------------------------------------


@query
def history_changes(spark, sf):
    """Schema changes between consecutive versions of each contract."""
    h = evolution.evolution_history(d.versions(spark, sf))
    return evolution.change_rows(h, "id")


@query
def history_classes(spark, sf):
    h = evolution.evolution_history(d.versions(spark, sf))
    return h.filter("previous_version is not null").groupBy("classification").agg(
        F.count(F.lit(1)).alias("n"))


@query
def indexed_fields(spark, sf):
    """Fields by name where a schema holds one name twice: the last one counts."""
    c = d.table(spark, sf, "customer")
    again = F.when(F.col("c_nationkey") < 12, F.lit('"long"')).otherwise(F.lit('"string"'))
    body = F.concat(
        F.lit('{"type":"record","name":"R","fields":[{"name":"a","type":"int"},'
              '{"name":"b","type":"string","default":""},{"name":"a","type":'), again,
        F.when(F.col("c_acctbal") > 0, ',"default":null').otherwise(""), F.lit("}]}"))
    listed = evolution.with_schema_fields(
        c.select("c_custkey", body.alias("body"), F.lit(t.AVRO).alias("format")),
        "body", "format", "fields")
    return listed.select("c_custkey", F.inline("fields")).select(
        "c_custkey", "name", F.regexp_replace("type", '"', "").alias("type"), "has_default")


def _gate(spark, sf, strict=False):
    return change_gate.run_gate(
        d.proposals(spark, sf), d.contracts(spark, sf), d.versions(spark, sf),
        d.lineage_edges(spark, sf), strict)


@query
def gate_decisions(spark, sf):
    return _gate(spark, sf).decisions.select(
        "change_id", "classification", "error", F.col("n_changes").cast("bigint").alias("n_changes"),
        "n_consumers", "requires_approval", joined(F.col("approval_from_teams")).alias("teams"))


@query
def gate_changes(spark, sf):
    return _gate(spark, sf).changes


@query
def gate_changes_strict(spark, sf):
    return _gate(spark, sf, strict=True).changes


@query
def gate_consumers(spark, sf):
    return _gate(spark, sf).consumers.select(
        "change_id", "source_topic", "consumer_name", "consumer_type", "consumer_team")


@query
def gate_outcomes(spark, sf):
    return evolution.gate_outcomes(_gate(spark, sf).decisions)


# --- lineage ----------------------------------------------------------------------------------


@query
def run_events(spark, sf):
    """COMPLETE events, flattened."""
    audit, _ = lineage.route_by_topic(d.consumed(spark, sf), d.VIOLATION_TOPIC)
    e = lineage.complete_events(lineage.with_metadata(audit), d.NAMESPACE, "data_topic")
    output = F.get("event.outputs", F.lit(0))
    return e.select(
        F.col("event.run.facets.kafkaOffset.offset").alias("offset"),
        F.col("event.eventType").alias("event_type"),
        F.col("event.job.name").alias("job"),
        F.col("event.job.facets.documentation.description").alias("description"),
        output["name"].alias("dataset"),
        F.coalesce(F.size(output["facets"]["schema"]["fields"]), F.lit(0)).cast("bigint")
        .alias("n_fields"),
        F.col("event.run.runId").alias("run_id"),
    )


@query
def fail_events(spark, sf):
    _, bad = lineage.route_by_topic(d.consumed(spark, sf), d.VIOLATION_TOPIC)
    e = lineage.fail_events(lineage.parse_violation(bad), d.NAMESPACE)
    return e.select(
        "offset",
        F.col("event.eventType").alias("event_type"),
        F.col("event.job.name").alias("job"),
        F.get("event.outputs", F.lit(0))["name"].alias("dataset"),
        F.col("event.run.facets.errorMessage.message").alias("message"),
    )


@query
def message_header(spark, sf):
    return d.consumed(spark, sf).select(
        "offset",
        lineage.message_header(F.col("headers"), "x-producer-id", "unknown").alias("producer"),
        lineage.message_header(F.col("headers"), "x-contract-id", "").alias("contract"))


@query
def schema_facet(spark, sf):
    audit, _ = lineage.route_by_topic(d.consumed(spark, sf), d.VIOLATION_TOPIC)
    facet = lineage.schema_facet(F.col("fields"))
    return lineage.with_metadata(audit).select(
        "offset", F.inline(facet["fields"]))


@query
def column_lineage(spark, sf):
    audit, _ = lineage.route_by_topic(d.consumed(spark, sf), d.VIOLATION_TOPIC)
    return lineage.column_lineage_rows(
        lineage.with_metadata(audit), "offset", dataset="data_topic")


@query
def column_lineage_emitted(spark, sf):
    """The column-lineage facet as it stands in the JSON of the emitted events."""
    audit, _ = lineage.route_by_topic(d.consumed(spark, sf), d.VIOLATION_TOPIC)
    e = lineage.complete_events(lineage.with_metadata(audit), d.NAMESPACE, "data_topic")
    kind = ("struct<inputFields array<struct<namespace string, dataset string, field string>>, "
            "transformationDescription string, transformationType string>")
    entries = F.from_json(
        F.get_json_object(F.to_json("event"), "$.outputs[0].facets.columnLineage.fields"),
        f"map<string, {kind}>")
    listed = e.select("offset", F.explode(entries).alias("output_field", "entry"))
    return listed.select(
        "offset", "output_field", F.inline("entry.inputFields"),
        F.col("entry.transformationDescription").alias("description"),
        F.col("entry.transformationType").alias("kind"))


@query
def processed_and_failed(spark, sf):
    traced = lineage.traced_messages(d.consumed(spark, sf), d.VIOLATION_TOPIC, d.NAMESPACE)
    return metrics.processed_and_failed(traced)


@query
def run_events_by_type(spark, sf):
    events = lineage.lineage_events(
        d.consumed(spark, sf), d.VIOLATION_TOPIC, d.NAMESPACE, "data_topic")
    return metrics.run_events_by_type(events)


@query
def message_ids(spark, sf):
    return d.consumed(spark, sf).select(
        "offset", text.message_id(F.col("topic"), F.col("partition"), F.col("offset")).alias("id"))


# --- consumer edges ---------------------------------------------------------------------------


def _stored_edges(spark, sf):
    edges = d.lineage_edges(spark, sf)
    return edges.select(
        F.concat_ws("/", "source_topic", "consumer_name").alias("id"), "source_topic",
        "consumer_name", "consumer_type", "consumer_team",
        F.to_timestamp(F.lit("1990-01-01")).alias("last_seen_at"))


@query
def upsert_edges(spark, sf):
    known = _stored_edges(spark, sf).filter(F.col("consumer_type") == "FLINK_JOB")
    e = lineage.upsert_edges(known, d.edge_observations(spark, sf))
    is_known = F.col("id").contains("/")
    return e.select(
        F.when(is_known, F.col("id")).alias("known_id"), "source_topic", "consumer_name",
        "consumer_type", "consumer_team",
        F.date_format("last_seen_at", "yyyy-MM-dd").alias("last_seen"))


@query
def stale_edges(spark, sf):
    stale = lineage.stale_edges(d.lineage_edges(spark, sf), F.to_timestamp(F.lit("1998-01-01")))
    return stale.select("source_topic", "consumer_name",
                        F.date_format("last_seen_at", "yyyy-MM-dd").alias("last_seen"))


@query
def edge_upserts_by_type(spark, sf):
    return metrics.edge_upserts_by_type(d.edge_observations(spark, sf))


# --- impact -----------------------------------------------------------------------------------


def _located(spark, sf):
    return impact.find_source_node(
        d.nodes(spark, sf), d.change_requests(spark, sf), d.NAMESPACE)


def _scored(spark, sf):
    return blast.scored_consumers(_located(spark, sf), d.nodes(spark, sf), d.edges(spark, sf))


@query
def find_source_node(spark, sf):
    return _located(spark, sf).select("change_id", "source")


@query
def bfs_reachable(spark, sf):
    r = impact.reachable(d.edges(spark, sf), _located(spark, sf))
    return r.select("source", "node", F.col("depth").cast("bigint").alias("depth"),
                    joined(F.col("path"), ">").alias("path"))


@query
def truncated_walks(spark, sf):
    """Whether a walk of two hops has missed nodes."""
    return impact.walk(d.edges(spark, sf), _located(spark, sf), 2).truncated()


@query
def scored_consumers(spark, sf):
    return impact.affected(_scored(spark, sf)).select(
        "change_id", "name", "node_type", "owner_team", "impact",
        joined(F.col("affected_fields")).alias("affected_fields"),
        F.col("depth").cast("bigint").alias("depth"), "is_direct")


@query
def ranked_consumers(spark, sf):
    """The order of a report's consumers, by the place of each in its report."""
    ordered = impact.sort_consumers(impact.affected(_scored(spark, sf)))
    return _placed(ordered.select("change_id", "name", "impact"), "change_id")


@query
def blast_radius_report(spark, sf):
    r = blast.blast_radius(
        d.change_requests(spark, sf), d.nodes(spark, sf), d.edges(spark, sf), d.NAMESPACE).reports
    return r.select(
        "change_id", "total_consumers_affected", "n_critical", "n_high", "n_direct",
        "worst_impact", joined(F.col("required_approvals")).alias("approvals"), "summary", "error")


@query
def approvals(spark, sf):
    return impact.approvals(_scored(spark, sf))


@query
def consumer_buckets(spark, sf):
    return impact.bucket_consumers(_scored(spark, sf))


@query
def top_critical(spark, sf):
    return impact.top_critical(_scored(spark, sf)).select(
        "change_id", joined(F.col("top_critical")).alias("names"))


def _customer_requests(spark, sf):
    customer = d.table(spark, sf, "customer")
    return customer.select(
        F.concat(F.lit("customer-"), "c_custkey").alias("change_id"),
        F.concat(F.lit("customer."), "c_custkey").alias("topic"),
        F.array(F.lit("totalprice"), F.lit("status")).alias("changed_fields"), "c_mktsegment")


@query
def declared_impact(spark, sf):
    """Who is impacted when the contracts of finished orders declare consumers: an audit job which
    lineage never saw, and the order's first line, which it saw without the field."""
    finished = d.table(spark, sf, "orders").filter("o_orderstatus = 'F'")
    audit = finished.select(
        F.concat(F.lit("order."), "o_orderkey").alias("topic"),
        F.concat(F.lit("audit."), "o_custkey").alias("name"), F.lit("audit").alias("team"),
        F.lit("KAFKA_CONSUMER").alias("type"), F.array(F.lit("totalprice")).alias("fields_used"))
    line = audit.select(
        "topic", F.concat(F.regexp_replace("topic", "^order", "line"), F.lit("-1")).alias("name"),
        F.lit("billing").alias("team"), F.lit("ICEBERG_TABLE").alias("type"),
        F.array(F.lit("status")).alias("fields_used"))
    contracts = audit.unionByName(line).select(
        "topic", F.array(F.struct("name", "team", "type", "fields_used")).alias("consumers"))
    nodes, edges = impact.merged_graph(
        d.nodes(spark, sf), d.edges(spark, sf), *quality.declared_consumers(contracts, d.NAMESPACE))
    consumers = blast.blast_radius(
        _customer_requests(spark, sf), nodes, edges, d.NAMESPACE).consumers
    known = nodes.select(F.col("id").alias("node"), "provenance")
    return consumers.join(hashed(known, stored_bytes(known)), "node").select(
        "change_id", "name", "node_type", "owner_team", "impact", "provenance",
        joined(F.col("affected_fields")).alias("affected_fields"),
        F.col("depth").cast("bigint").alias("depth"))


@query
def empty_graph_report(spark, sf):
    """Reports where a namespace without lineage, unknown topics and known ones come together."""
    segment = F.col("c_mktsegment")
    requests = _customer_requests(spark, sf).withColumns({
        "namespace": F.when(segment == "MACHINERY", "idle").otherwise(d.NAMESPACE),
        "topic": F.when(segment == "BUILDING", F.concat(F.lit("old."), "topic"))
        .otherwise(F.col("topic"))})
    r = blast.blast_radius(
        requests, d.nodes(spark, sf), d.edges(spark, sf), d.NAMESPACE).reports
    total = F.col("total_consumers_affected")
    return r.select("change_id", total, "worst_impact", "error",
                    F.when(total == 0, F.col("summary")).alias("summary"))


@query
def bare_nodes(spark, sf):
    """Attributes of what two hops reach when the graph does not list the lines."""
    listed = d.nodes(spark, sf).filter(~F.col("name").startswith("line."))
    requests = impact.find_source_node(listed, _customer_requests(spark, sf), d.NAMESPACE)
    reached = impact.walk(d.edges(spark, sf), requests, 2).nodes()
    return impact.with_node_attributes(reached, listed).select(
        "source", "node", F.col("depth").cast("bigint").alias("depth"), "name", "node_type",
        "owner_team", joined(F.col("fields")).alias("fields"))


@query
def classify_dataset(spark, sf):
    """Dataset types of names built from parts."""
    p = d.table(spark, sf, "part")
    name = (
        F.when(F.col("p_type") == "ECONOMY", F.concat(F.lit("iceberg."), "p_name"))
        .when(F.col("p_type") == "SMALL", F.concat(F.lit("db."), "p_name", F.lit("_table")))
        .when(F.col("p_size") < 10, F.concat_ws(".", "p_type", "p_name"))
        .otherwise(F.col("p_name"))
    )
    return p.select("p_partkey", text.classify_dataset(name).alias("dataset_type"))


def _lineage_documents(spark, sf):
    """One lineage API document per nation: its suppliers and customers."""
    part = lambda name, rows, key: F.concat(
        F.lit('{"id":"job:'), rows, F.lit('","type":"JOB","data":{"name":"'), name,
        F.lit('","facets":{"ownership":{"owners":['), key, F.lit(']}}},"inEdges":[{"origin":"n'),
        F.col("n").cast("string"), F.lit('"}],"outEdges":[{"destination":"sink.'),
        F.col("n").cast("string"), F.lit('"}]}'))
    c = d.table(spark, sf, "customer").select(
        F.col("c_nationkey").alias("n"),
        F.col("c_name").alias("name"),
        F.when(F.col("c_acctbal") > 0, F.concat(F.lit('{"name":"'), "c_mktsegment", F.lit('"}')))
        .otherwise("").alias("owner"))
    jobs = c.select("n", part(F.col("name"), F.col("name"), F.col("owner")).alias("j"))
    s = d.table(spark, sf, "supplier").select(
        F.col("s_nationkey").alias("n"),
        F.concat(
            F.lit('{"id":"dataset:'), "s_name", F.lit('","type":"DATASET","data":{"name":"s.'),
            "s_name",
            F.lit('","facets":{"schema":{"fields":[{"name":"acctbal"},{"name":""},{"name":"key"}]}'
                  '}},"inEdges":[],"outEdges":[{"destination":"n'),
            F.col("s_nationkey").cast("string"), F.lit('"}]}')).alias("j"))
    one = jobs.unionByName(s)
    return one.select(F.concat(F.lit('{"graph":['), "j", F.lit("]}")).alias("value"))


@query
def lineage_graph_nodes(spark, sf):
    n, _ = graph.lineage_graph_from_json(_lineage_documents(spark, sf), d.NAMESPACE)
    return n.select("id", "node_type", "name", "dataset_type", "owner_team",
                    joined(F.col("fields")).alias("fields"))


@query
def lineage_graph_edges(spark, sf):
    _, e = graph.lineage_graph_from_json(_lineage_documents(spark, sf), d.NAMESPACE)
    return e


# --- histograms, quality, drift ---------------------------------------------------------------


@query
def histogram(spark, sf):
    e = d.table(spark, sf, "events").withColumn(
        "value", F.col("value").cast("decimal(18,4)"))
    h = metrics.histogram(e, "value", metrics.VALIDATION_MS, "event_type")
    return h.withColumn("sum", F.col("sum").cast("double"))


def _quality_rules() -> dict[str, Column]:
    return {
        "quantity_range": quality.in_range(F.col("l_quantity"), 5, 45),
        "flag_enum": quality.in_enum(F.col("l_returnflag"), ["A", "N"]),
        "partner_not_null": quality.not_null(
            F.when(F.col("l_discount") > 0.02, F.col("l_suppkey"))),
        "id_uuid": quality.uuid_format(F.col("trace_id")),
    }


def _traced_lines(spark, sf):
    lines = spread(d.table(spark, sf, "lineitem"))
    digest = F.md5(F.concat_ws("-", F.col("l_orderkey").cast("string"),
                               F.col("l_linenumber").cast("string")))
    shaped = F.regexp_replace(digest, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    trace = F.when(F.col("l_tax") > 0.05, digest).otherwise(shaped)
    return lines.withColumn("trace_id", trace)


@query
def quality_rules(spark, sf):
    return quality.quality_totals(_traced_lines(spark, sf), _quality_rules(), "l_linestatus")


@query
def quality_failures(spark, sf):
    judged = quality.evaluate(_traced_lines(spark, sf), _quality_rules())
    return judged.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                         joined(F.col("failed_rules")).alias("failed_rules"))


@query
def sampled_quality(spark, sf):
    o = quality.sampled(d.table(spark, sf, "orders"), F.col("o_orderkey"), 10)
    return quality.quality_totals(
        o, {"price_range": quality.in_range(F.col("o_totalprice"), 1000, 400000)},
        "o_orderstatus")


@query
def violation_log(spark, sf):
    log = quality.violation_log(_validated(spark, sf), F.col("ts").cast("timestamp"))
    return log.select("topic", "producer_id", "violation_type", F.date_format(
        "occurred_at", "yyyy-MM-dd HH:mm:ss").alias("occurred_at"))


@query
def violation_rate(spark, sf):
    log = quality.violation_log(_validated(spark, sf), F.col("ts").cast("timestamp"))
    rate = quality.violation_rate(log)
    return rate.withColumn("bucket", F.date_format("bucket", "yyyy-MM-dd"))


@query
def schema_drift(spark, sf):
    audit, _ = lineage.route_by_topic(d.consumed(spark, sf), d.VIOLATION_TOPIC)
    traced = lineage.with_metadata(audit.withColumn("topic", F.col("data_topic")))
    declared = d.event_enforcement(spark).select(
        "topic", F.explode(F.transform("fields", lambda f: f["path"])).alias("path"))
    drift = quality.schema_drift(traced, declared)
    return drift.select("topic", "path", joined(F.col("kinds")).alias("kinds"), "n",
                        F.round("null_rate", 6).alias("null_rate"), "declared")


@query
def declared_consumers(spark, sf):
    """Declared consumers of customer topics join the graph and add fields to the impact."""
    listed = d.lineage_edges(spark, sf).groupBy("source_topic", "consumer_type").agg(
        F.min("consumer_name").alias("name"), F.min("consumer_team").alias("team"))
    declared = listed.select(
        F.col("source_topic").alias("topic"),
        F.array(F.struct(
            "name", "team", F.col("consumer_type").alias("type"),
            F.array(F.lit("total"), F.lit("note")).alias("fields_used"))).alias("consumers"))
    n, e = quality.declared_consumers(declared, d.NAMESPACE)
    return n.join(e, n["id"] == e["dst"]).select(
        "src", "dst", "node_type", "owner_team", joined(F.col("fields")).alias("fields"))


@query
def audit_log(spark, sf):
    contracts, _, policies = d.event_registry(spark)
    log = quality.audit_log(_validated(spark, sf), policies, contracts)
    return log.select("topic", "producer_id", "key",
                      joined(F.col("audited_fields")).alias("audited_fields"))


@query
def missing_approvals(spark, sf):
    """Required teams per breaking proposal minus the teams whose members approved it."""
    decisions = _gate(spark, sf).decisions
    required = decisions.filter("requires_approval").select(
        F.col("change_id").alias("contract_version_id"),
        F.explode("approval_from_teams").alias("team"))
    approved = d.table(spark, sf, "supplier").select(
        F.col("s_suppkey").cast("string").alias("actor"),
        d.consumer_team(F.col("s_nationkey")).alias("team")).filter("team is not null")
    c = d.table(spark, sf, "customer")
    n_suppliers = d.table(spark, sf, "supplier").count()
    events = c.select(
        F.concat(F.lit("chg-"), F.col("c_custkey").cast("string")).alias("contract_version_id"),
        F.pmod(F.col("c_custkey"), F.lit(n_suppliers)).cast("string").alias("actor"),
        F.when(F.col("c_acctbal") > 4000, "APPROVED").otherwise("REJECTED").alias("action"))
    return quality.missing_approvals(required, events, approved)


# --- streams: same input as the batch queries, run to completion -------------------------------


def _stream_of(spark, sf, name):
    schema = d.table(spark, sf, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf)


@query
def stream_validate(spark, sf):
    out = scratch_path(spark, "contract-stream")
    stream = contract_stream(
        d.as_messages(_stream_of(spark, sf, "events")),
        lambda: d.event_enforcement(spark), lambda: d.event_keys(spark),
        f"{out}/rows", f"{out}/checkpoint", extra=("event_id",),
        partitions=spark.sparkContext.defaultParallelism)
    stream.awaitTermination()
    return spark.read.parquet(f"{out}/rows").select(
        "event_id", "outcome", "error", "detail",
        joined(F.col("fields_transformed")).alias("transformed"))


@query
def stream_contract_change(spark, sf):
    """Messages in six batches; after the third the contract of one topic is no longer active."""
    out = scratch_path(spark, "contract-change")
    events = d.table(spark, sf, "events")
    contracts = d.event_enforcement(spark)
    for half, active in enumerate((contracts, contracts.filter("topic <> 'events.signup'"))):
        rows = events.filter(F.col("event_id") % 2 == half)
        each = _files_of_a_batch(rows, 3)
        rows.repartition(3 * each, "event_id").write.mode("append").parquet(f"{out}/in")
        stored = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", each)
        contract_stream(
            d.as_messages(stored.parquet(f"{out}/in")), lambda: active,
            lambda: d.event_keys(spark), f"{out}/rows", f"{out}/checkpoint", extra=("event_id",),
        ).awaitTermination()
    return spark.read.parquet(f"{out}/rows").select(
        "event_id", F.col("batch_id").cast("bigint").alias("batch_id"), "outcome", "error", "detail"
    ).withColumn("half", F.floor(F.col("batch_id") / 3)).drop("batch_id")


def _files_of_a_batch(rows, batches, at_least=5_000):
    """So many files that each has some thousand rows and a batch keeps all cores busy: a batch of one
    file would be one task, whatever the input."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return max(1, min(4 * cores, rows.count() // (batches * at_least)))


def _stream_with_repeats(spark, sf, name, again=1):
    """The table as six batches of files in no order of time; every tenth row comes again."""
    rows = d.table(spark, sf, name).withColumn("copy", F.lit(0))
    tenth = rows.where(F.pmod(F.xxhash64("event_id"), F.lit(10)) == 0)
    repeats = tenth.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(again)))) if again else (
        tenth.limit(0))
    path = scratch_path(spark, "repeated-files")
    both = rows.unionByName(repeats)
    each = _files_of_a_batch(both, 6)
    both.repartition(6 * each, "event_id", "copy").drop("copy").write.parquet(path)
    schema = d.table(spark, sf, name).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", each).parquet(path)


@query
def stream_lineage(spark, sf):
    out = scratch_path(spark, "lineage-stream")
    stream = lineage_stream(
        d.as_consumed(_stream_with_repeats(spark, sf, "events")), d.VIOLATION_TOPIC,
        f"{out}/events", f"{out}/checkpoint", namespace=d.NAMESPACE, dataset="data_topic")
    stream.awaitTermination()
    return read_lineage_events(spark, f"{out}/events").groupBy("topic", "event_type").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("run_id").alias("runs"))


@query
def stream_deliveries(spark, sf):
    """Run events delivered and not delivered, by the log of a stream over several batches."""
    out = scratch_path(spark, "delivery-stream")
    stream = lineage_delivery_stream(
        d.as_consumed(_stream_with_repeats(spark, sf, "events", again=0)), d.VIOLATION_TOPIC,
        f"{out}/lines", f"{out}/spare", f"{out}/checkpoint", namespace=d.NAMESPACE,
        dataset="data_topic", log=f"{out}/log")
    stream.awaitTermination()
    return spark.read.parquet(f"{out}/log").groupBy("delivered").agg(F.sum("n").alias("n"))


@query
def outbox_deliveries(spark, sf):
    """Run events that arrived although the sink was down at first, with repeated messages."""
    out, tries = scratch_path(spark, "outbox-stream"), []

    def send(events, path):
        tries.append(path)
        if len(tries) <= 2:
            raise OSError("the sink is down")
        write_lines(events, path)

    lineage_delivery_stream(
        d.as_consumed(_stream_with_repeats(spark, sf, "events")), d.VIOLATION_TOPIC,
        f"{out}/lines", f"{out}/box", f"{out}/checkpoint", namespace=d.NAMESPACE,
        dataset="data_topic", send=send).awaitTermination()
    lines = spark.read.text(f"{out}/lines")
    return lines.groupBy(F.get_json_object("value", "$.eventType").alias("event_type")).agg(
        F.count(F.lit(1)).alias("n"),
        F.countDistinct(F.get_json_object("value", "$.run.runId")).alias("runs"))


@query
def stream_upsert(spark, sf):
    """Users seen per event type, kept as an edge table over six batches in no order of time."""
    out = scratch_path(spark, "edge-stream")
    e = _stream_with_repeats(spark, sf, "events").select(
        F.concat(F.lit("events."), "event_type").alias("source_topic"),
        F.col("user_id").cast("string").alias("consumer_name"),
        F.lit("UNKNOWN").alias("consumer_type"),
        F.when(F.col("value") > 10, F.lit("heavy")).alias("consumer_team"),
        F.col("ts").cast("timestamp").alias("seen_at"),
        F.col("event_id").alias("seq"))
    edge_stream(e, f"{out}/edges", f"{out}/checkpoint", buckets=8, merge_after=3).awaitTermination()
    return EdgeTable(spark, f"{out}/edges", 8).read().select("source_topic", "consumer_name", "consumer_type", "consumer_team",
                        F.date_format("last_seen_at", "yyyy-MM-dd HH:mm:ss").alias("last_seen"))
