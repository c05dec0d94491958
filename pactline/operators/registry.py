"""Contract registry: lookups, the enforcement view, and table changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pactline import types as t
from pactline.functions.documents import with_parsed
from pactline.operators.joins import lookup_join
from pactline.operators.partitions import cut

_VERSION = ["id", "contract_id", "version", "schema_format", "schema_body", "compatibility",
            "status", "registry_id", "authored_by", "created_at"]


def _newest(df: DataFrame, key: str) -> DataFrame:
    """One row per key: newest created_at, smallest id on a tie.

    A rank filter lets Spark keep one candidate per key and task before the shuffle.
    """
    order = Window.partitionBy(key).orderBy(F.col("created_at").desc(), F.col("id"))
    return df.withColumn("__rank", F.row_number().over(order)).filter("__rank = 1").drop("__rank")


def join_contracts(versions: DataFrame, contracts: DataFrame, *columns: str) -> DataFrame:
    """Versions with columns of their contract."""
    picked = contracts.select(F.col("id").alias("contract_id"), *columns)
    return lookup_join(versions, picked, "contract_id", "inner")


def active_version(versions: DataFrame, contracts: DataFrame) -> DataFrame:
    """Per topic the newest ACTIVE version."""
    active = versions.filter(F.col("status") == t.ACTIVE)
    return _newest(join_contracts(active, contracts, "topic"), "topic")


def list_active_versions(versions: DataFrame) -> DataFrame:
    """All ACTIVE versions, newest first."""
    return versions.filter(F.col("status") == t.ACTIVE).orderBy(F.col("created_at").desc(), "id")


def contract_by_name(contracts: DataFrame, names: DataFrame | str) -> DataFrame:
    """Contracts with the given unique name, or with the names of a one-column table."""
    if isinstance(names, str):
        return contracts.filter(F.col("name") == names)
    return contracts.join(names.select("name").distinct(), "name", "left_semi")


def latest_version(versions: DataFrame) -> DataFrame:
    """The newest version per contract, whatever its status."""
    return _newest(versions, "contract_id")


def field_policies(policies: DataFrame, contract_id: str | Column) -> DataFrame:
    """All policies of a contract."""
    return policies.filter(F.col("contract_id") == contract_id)


def downstream_edges(edges: DataFrame, topic: str | Column) -> DataFrame:
    """Direct consumers of a topic."""
    return edges.filter(F.col("source_topic") == topic).select(
        "consumer_name", "consumer_type", "consumer_team"
    )


def enforcement_contracts(
    versions: DataFrame, contracts: DataFrame, policies: DataFrame
) -> DataFrame:
    """One row per topic with the rules a message of that topic must satisfy.

    Joins the active version with its contract and field policies. Rule order: the ``required`` list
    of a JSON Schema first, in its own order, then policies by age and path. ``policy_config`` may
    carry ``required`` and ``pii_class``; a schema requirement on the same path is merged in.
    The rules of one contract form one array, bounded by the unique (contract, path) key.
    """
    extra = [c for c in ("fail_open",) if c in contracts.columns]
    active = join_contracts(
        versions.filter(F.col("status") == t.ACTIVE), contracts, "name", "topic", *extra
    )
    active = with_parsed(_newest(active, "topic"), "schema_body", "__schema")
    listed = F.when(
        F.col("schema_format") == t.JSON_SCHEMA,
        F.try_variant_get("__schema", "$.required", "array<string>"),
    )
    required = F.coalesce(listed, F.array().cast("array<string>"))
    head = active.select(
        "contract_id", "name", "topic", "version",
        required.alias("__required"),
        F.coalesce(F.col(extra[0]) if extra else F.lit(None), F.lit(False)).alias("fail_open"),
    )

    config = with_parsed(policies, "policy_config", "__config")
    operation = F.when(F.col("policy_type").isin(*t.MASKING_OPERATIONS), F.col("policy_type"))
    rule = F.struct(
        "created_at",
        F.col("field_path").alias("path"),
        F.coalesce(F.try_variant_get("__config", "$.required", "boolean"), F.lit(False))
        .alias("required"),
        F.coalesce(F.try_variant_get("__config", "$.pii_class", "string"), F.lit(""))
        .alias("pii_class"),
        F.coalesce(operation, F.lit("")).alias("masking_op"),
    )
    per_contract = config.groupBy("contract_id").agg(
        F.sort_array(F.collect_list(rule)).alias("__policies")
    )

    joined = head.join(per_contract, "contract_id", "left")
    policy_paths = F.coalesce(
        F.transform("__policies", lambda p: p["path"]), F.array().cast("array<string>")
    )
    from_schema = F.transform(
        F.array_except("__required", policy_paths),
        lambda p: F.struct(
            p.alias("path"),
            F.lit(True).alias("required"),
            F.lit("").alias("pii_class"),
            F.lit("").alias("masking_op"),
        ),
    )
    from_policies = F.transform(
        "__policies",
        lambda p: F.struct(
            p["path"].alias("path"),
            (p["required"] | F.array_contains(F.col("__required"), p["path"])).alias("required"),
            p["pii_class"].alias("pii_class"),
            p["masking_op"].alias("masking_op"),
        ),
    )
    fields = F.concat(from_schema, F.coalesce(from_policies, F.array().cast(t.RULES)))
    return joined.select(
        "contract_id", "name", "topic", "version", fields.cast(t.RULES).alias("fields"), "fail_open"
    )


# ---------------------------------------------------------------------------------------------
# table changes: plain Parquet has no row updates, so changed tables are written as new snapshots


def new_versions(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Rows to append: those whose (contract_id, version) is new, one row per key."""
    key = ["contract_id", "version"]
    first = Window.partitionBy(*key).orderBy("id")
    once = incoming.withColumn("__n", F.row_number().over(first)).filter("__n = 1").drop("__n")
    return once.join(existing.select(*key), key, "left_anti").select(*incoming.columns)


def duplicate_versions(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Rows that :func:`new_versions` refuses."""
    return incoming.join(new_versions(existing, incoming).select("id"), "id", "left_anti")


def insert_version(existing: DataFrame, incoming: DataFrame, path: str) -> DataFrame:
    """Append new versions and return the refused rows: a repeated (contract_id, version) is not
    written. The refused rows are stored before the table changes."""
    refused = cut(duplicate_versions(existing, incoming), "refused-versions")
    new_versions(existing, incoming).select(*_VERSION).write.mode("append").parquet(path)
    return refused


def append_approval_event(events: DataFrame, path: str) -> None:
    """Append immutable audit rows."""
    columns = t.REGISTRY["approval_events"].fieldNames()
    events.select(*columns).write.mode("append").parquet(path)


def activate_version(versions: DataFrame, requests: DataFrame) -> DataFrame:
    """The version table after activation requests (contract_id, version_id).

    The target becomes ACTIVE, other ACTIVE versions of the same contract become DEPRECATED, in one
    new table. Requests hold one row per contract.
    """
    wanted = requests.select("contract_id", F.col("version_id").alias("__target"))
    joined = lookup_join(versions, wanted, "contract_id", "left")
    replaced = F.col("__target").isNotNull() & (F.col("status") == t.ACTIVE)
    status = (
        F.when(F.col("id") == F.col("__target"), t.ACTIVE)
        .when(replaced, t.DEPRECATED)
        .otherwise(F.col("status"))
    )
    return joined.withColumn("status", status).select(*versions.columns)


def _folder(spark: SparkSession, path: str):
    """A folder and its file system, of any kind Spark can write to."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def snapshot_ids(spark: SparkSession, root: str) -> list[int]:
    """The completely written snapshots, oldest first, from folder names alone."""
    folder, files = _folder(spark, root)
    if not files.exists(folder):
        return []
    found = [status.getPath() for status in files.listStatus(folder)]
    marks = [(path.getName().partition("snapshot_id=")[2], path) for path in found]
    done = lambda path: files.exists(_folder(spark, f"{path.toString()}/_SUCCESS")[0])
    return sorted(int(number) for number, path in marks if number.isdigit() and done(path))


def publish_snapshot(df: DataFrame, root: str, snapshot_id: int, keep: int = 2) -> None:
    """Write a whole new version of a keyed table, then remove all but the newest ``keep``."""
    spark, root = df.sparkSession, root.rstrip("/")
    df.write.mode("overwrite").parquet(f"{root}/snapshot_id={snapshot_id}")
    for old in snapshot_ids(spark, root)[:-max(keep, 1)]:
        folder, files = _folder(spark, f"{root}/snapshot_id={old}")
        files.delete(folder, True)


def current_snapshot(
    spark: SparkSession, root: str, schema: T.StructType, before: int | None = None
) -> DataFrame | None:
    """The newest snapshot (older than ``before``), or None when there is none yet."""
    ids = [i for i in snapshot_ids(spark, root) if before is None or i < before]
    if not ids:
        return None
    return spark.read.schema(schema).parquet(f"{root.rstrip('/')}/snapshot_id={ids[-1]}")
