"""Declared quality rules, violation log, schema drift and approval completeness."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactline import types as t
from pactline.functions.text import uuid_from
from pactline.operators.joins import lookup_join

_UUID = "^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"


def in_range(value: Column, low, high) -> Column:
    """Both ends included; a missing value is not judged."""
    return F.coalesce(value.between(low, high), F.lit(True))


def not_null(value: Column) -> Column:
    return value.isNotNull()


def uuid_format(value: Column) -> Column:
    return F.coalesce(value.rlike(_UUID), F.lit(True))


def in_enum(value: Column, allowed: Sequence[str]) -> Column:
    return F.coalesce(value.isin(*allowed), F.lit(True))


def evaluate(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Add one boolean per rule and ``failed_rules``."""
    judged = df.withColumns({name: holds for name, holds in rules.items()})
    failed = F.array_compact(F.array(*[F.when(~F.col(n), F.lit(n)) for n in rules]))
    return judged.withColumn("failed_rules", failed)


def quality_totals(df: DataFrame, rules: dict[str, Column], *by: str) -> DataFrame:
    """Checked and failed rows per rule, all rules in one pass."""
    counts = F.array(
        *[
            F.struct(F.lit(name).alias("rule"), F.count_if(~holds).alias("failed"))
            for name, holds in rules.items()
        ]
    )
    return (
        df.groupBy(*by)
        .agg(F.count(F.lit(1)).alias("checked"), counts.alias("__rules"))
        .select(*by, F.inline("__rules"), "checked")
    )


def sampled(df: DataFrame, key: Column, one_in: int) -> DataFrame:
    """A stable sample of messages for runtime checks: the same key always gives the same answer."""
    bucket = F.conv(F.left(F.md5(key.cast("string")), F.lit(8)), 16, 10).cast("bigint")
    return df.filter(F.pmod(bucket, F.lit(one_in)) == 0)


def declared_consumers(contracts: DataFrame, namespace: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of consumers a contract declares, to union with the observed graph.

    ``contracts`` has ``topic`` and ``consumers ARRAY<STRUCT<name, team, type, fields_used>>``.
    """
    listed = contracts.select("topic", F.inline("consumers"))
    is_table = F.col("type") == t.ICEBERG_TABLE
    kind = F.when(is_table, F.lit("dataset")).otherwise(F.lit("job"))
    node_id = F.concat(kind, F.lit(f":{namespace}:"), F.col("name"))
    named = listed.select(
        node_id.alias("id"),
        F.when(is_table, t.DATASET).otherwise(t.JOB).alias("node_type"),
        "name", "team", F.explode_outer("fields_used").alias("field"),
    )
    # A consumer may be declared by many contracts: distinct fields first, then one row per node.
    nodes = (
        named.groupBy("id", "node_type", "name", "field").agg(F.max("team").alias("team"))
        .groupBy("id", "node_type", "name")
        .agg(
            F.max("team").alias("owner_team"),
            F.sort_array(F.collect_list("field")).alias("fields"),
        )
        .select(
            "id", "node_type", "name",
            F.lit(namespace).alias("namespace"),
            F.when(F.col("node_type") == t.DATASET, t.ICEBERG_TABLE).alias("dataset_type"),
            "owner_team", "fields",
        )
    )
    edges = listed.select(
        F.concat(F.lit(f"dataset:{namespace}:"), F.col("topic")).alias("src"),
        node_id.alias("dst"),
    ).distinct()
    return nodes, edges


def violation_log(validated: DataFrame, occurred_at: Column, version_id: Column | None = None
                  ) -> DataFrame:
    """Rows for the violation log: one per violation, with the log's own type names."""
    kinds = F.create_map(*[F.lit(x) for kv in t.VIOLATION_LOG_TYPE.items() for x in kv])
    exploded = validated.filter(F.col("status") == t.REJECTED).select(
        "topic", "contract_id", "producer_id",
        (version_id if version_id is not None else F.lit(None).cast("string"))
        .alias("contract_version_id"),
        occurred_at.alias("occurred_at"),
        F.coalesce("key", F.lit("")).alias("__key"),
        F.md5(F.coalesce("payload", F.lit(""))).alias("__digest"),
        F.posexplode("violations").alias("__at", "__v"),
    )
    identity = F.concat_ws(
        "\u0000", "topic", "producer_id", "__key", "__digest", F.col("occurred_at").cast("string"),
        F.col("__at").cast("string"), F.col("__v.field"),
    )
    return exploded.select(
        uuid_from(identity).alias("id"),
        "contract_id", "contract_version_id", "producer_id", "topic",
        F.try_element_at(kinds, F.col("__v.type")).alias("violation_type"),
        F.to_json("__v").alias("violation_detail"),
        "occurred_at",
    )


def violation_rate(log: DataFrame, width: str = "1 day") -> DataFrame:
    """Violations per time bucket, topic and type."""
    return log.groupBy(
        F.window("occurred_at", width)["start"].alias("bucket"), "topic", "violation_type"
    ).agg(F.count(F.lit(1)).alias("n"))


def schema_drift(
    traced: DataFrame, declared: DataFrame | None = None
) -> DataFrame:
    """Observed kinds and null share per (topic, path), with a flag for undeclared paths.

    First counted per kind, so a busy topic is reduced before rows of one path meet; the kinds of a
    path are at most six. ``declared`` has (topic, path).
    """
    exploded = traced.select("topic", F.inline("fields"))
    per_kind = exploded.groupBy("topic", "path", "value_type").agg(
        F.count(F.lit(1)).alias("__n"), F.count_if("nullable").alias("__nulls")
    )
    observed = per_kind.groupBy("topic", "path").agg(
        F.sort_array(F.collect_list("value_type")).alias("kinds"),
        F.sum("__n").alias("n"),
        (F.sum("__nulls") / F.sum("__n")).alias("null_rate"),
    )
    if declared is None:
        return observed
    flagged = declared.select("topic", "path").distinct().withColumn("__known", F.lit(True))
    return observed.join(flagged, ["topic", "path"], "left").withColumn(
        "declared", F.coalesce("__known", F.lit(False))
    ).drop("__known")


def audit_log(validated: DataFrame, policies: DataFrame, contracts: DataFrame) -> DataFrame:
    """Accepted messages of topics with an AUDIT_LOG policy, without their payload.

    Lists the audited paths that the contract names; the set per contract is bounded by its fields.
    """
    audited = (
        policies.filter(F.col("policy_type") == t.AUDIT_LOG)
        .join(contracts.select(F.col("id").alias("contract_id"), "topic"), "contract_id")
        .groupBy("topic")
        .agg(F.sort_array(F.collect_set("field_path")).alias("audited_fields"))
    )
    accepted = validated.filter(F.col("status") == t.ACCEPTED)
    return lookup_join(accepted, audited, "topic", "inner", spread_by=["key", "payload"]).select(
        "topic", "contract_id", "producer_id", "key", "audited_fields"
    )


def missing_approvals(
    required: DataFrame, events: DataFrame, actor_teams: DataFrame
) -> DataFrame:
    """Required teams (version id, team) without an APPROVED event of one of their members."""
    approved = (
        events.filter(F.col("action") == "APPROVED")
        .join(actor_teams, "actor")
        .select("contract_version_id", "team")
    )
    return required.join(approved, ["contract_version_id", "team"], "left_anti")
