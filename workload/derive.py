"""Inputs of the operators, derived by Spark from the driver tables.

Every derived table has one row (or more) per row of its source table, so the work of a query grows
with the data. Presence, nulls and defects follow from the values themselves.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pactline import types as t
from pactline.functions.masks import token_keys
from pactline.operators.partitions import cut, spread
from pactline.operators.registry import enforcement_contracts
from pactline.session import configure, scratch_path

TASK_BYTES = 256 << 10  # of events, whose messages are parsed and turned into other texts
SECRET = "workload-demo-key"
NAMESPACE = "tpch"
AUDIT_TOPIC = "governance.audit"
VIOLATION_TOPIC = "governance.violations"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    configure(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------------------------------------
# messages


def payload_of(value: Column, user_id: Column, event_id: Column, props: Column) -> Column:
    amount = (
        F.when(value < 5, "")
        .when(value >= 60, ',"amount":null')
        .otherwise(F.concat(F.lit(',"amount":'), value.cast("string")))
    )
    user = user_id.cast("string")
    body = F.concat(
        F.lit('{"event_id":'), event_id.cast("string"),
        F.lit(',"user":{"id":"u'), user,
        F.lit('","email":"u'), user, F.lit('@example.com"},"tags":[{"pan":1}]'),
        amount,
        F.lit(',"props":'), props,
        F.lit("}"),
    )
    broken = (value >= 30) & (value < 31)
    trailing = (value >= 31) & (value < 31.5)
    return F.when(broken, F.lit("{broken")).when(trailing, F.concat(body, body)).otherwise(body)


def as_messages(events: DataFrame) -> DataFrame:
    """Produce requests from events; works on streams too."""
    value = F.col("value")
    declared = F.when(value < 20, "").when(value < 50, "1.0.0").otherwise("0.9.0")
    return events.select(
        "event_id",
        "ts",
        F.concat(F.lit("events."), "event_type").alias("topic"),
        F.concat(F.lit("c-"), "event_type").alias("contract_id"),
        declared.alias("contract_version"),
        F.when((value >= 2) & (value < 2.5), "")
        .otherwise(F.concat(F.lit("svc-"), F.col("user_id").cast("string")))
        .alias("producer_id"),
        F.col("user_id").cast("string").alias("key"),
        payload_of(value, F.col("user_id"), F.col("event_id"), F.col("props")).alias("payload"),
    )


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_messages(spread(table(spark, sf_dir, "events"), TASK_BYTES))


def envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Produce requests as the JSON text a producer sends."""
    m = messages(spark, sf_dir)
    text = F.concat(
        F.lit('{"topic":"'), "topic", F.lit('","contract_id":"'), "contract_id",
        F.lit('","contract_version":"'), "contract_version",
        F.lit('","producer_id":"'), "producer_id", F.lit('","key":"'), "key",
        F.lit('","payload":'), "payload", F.lit("}"),
    )
    return m.select("event_id", text.alias("value"))


def event_registry(spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Contracts, versions and policies of four event topics; ``events.error`` has no contract."""
    required = {
        "click": ["event_id", "amount"],
        "purchase": ["user.email", "amount"],
        "signup": [],
        "view": ["props.k"],
    }
    policies = {
        "purchase": [("user.email", t.AUDIT_LOG, {"pii_class": t.PERSONAL})],
        "signup": [
            ("user.email", t.MASK, {"pii_class": t.PERSONAL, "required": True}),
            ("user.id", t.TOKENIZE, {"pii_class": t.FINANCIAL}),
            ("user.phone", t.REDACT, {"pii_class": t.PERSONAL}),
        ],
        "view": [
            ("amount", t.TOKENIZE, {"required": True}),
            ("user", t.REDACT, {}),
            ("event_id", t.AUDIT_LOG, {}),
        ],
    }
    contracts, versions, rules = [], [], []
    for kind, names in required.items():
        contract = f"c-{kind}"
        contracts.append((contract, f"events-{kind}", f"events.{kind}", "events-team"))
        for number, status, day in (("0.9.0", t.DEPRECATED, 1), ("1.0.0", t.ACTIVE, 2)):
            body = json.dumps({"type": "object", "required": names})
            versions.append(
                (f"{contract}-{number}", contract, number, t.JSON_SCHEMA, body, t.BACKWARD,
                 status, "events-team", f"2024-01-0{day}")
            )
        for at, (path, kind_, config) in enumerate(policies.get(kind, [])):
            rules.append(
                (f"{contract}-{at}", contract, path, kind_, json.dumps(config),
                 f"2024-01-01 00:00:0{at}")
            )
    frame = spark.createDataFrame
    c = frame(contracts, "id string, name string, topic string, owner_team string")
    v = frame(
        versions,
        "id string, contract_id string, version string, schema_format string, schema_body string, "
        "compatibility string, status string, authored_by string, created_at string",
    ).withColumn("registry_id", F.lit(None).cast("int"))
    p = frame(
        rules,
        "id string, contract_id string, field_path string, policy_type string, "
        "policy_config string, created_at string",
    )
    stamp = lambda df: df.withColumn("created_at", F.col("created_at").cast("timestamp"))
    return c, stamp(v), stamp(p)


_STORED: dict[tuple[str, ...], str] = {}


def stored(spark: SparkSession, name: str, sf_dir: str, build) -> DataFrame:
    """Write a derived input once per session to the shared scratch folder and read it back.

    Graphs and compiled contracts are tables in practice; deriving them again in every hop or
    query would only measure the derivation.
    """
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _STORED:
        path = scratch_path(spark, name)
        build().write.parquet(path)
        _STORED[key] = path
    return spark.read.parquet(_STORED[key])


def event_enforcement(spark: SparkSession) -> DataFrame:
    configure(spark)
    contracts, versions, policies = event_registry(spark)
    return stored(
        spark, "enforcement", "", lambda: enforcement_contracts(versions, contracts, policies)
    )


def event_keys(spark: SparkSession) -> DataFrame:
    return token_keys(spark, {"default": SECRET})


def as_consumed(events: DataFrame) -> DataFrame:
    """What a message bus delivers: audit copies, and violation reports for ``error`` events."""
    value, kind = F.col("value"), F.col("event_type")
    is_violation = kind == "error"
    report = F.concat(
        F.lit('{"producer_id":"svc-'), F.col("user_id").cast("string"), F.lit('"'),
        F.when(value >= 5, F.lit(',"topic":"events.error"')).otherwise(""),
        F.when(value >= 10, F.lit(',"violation_type":"TYPE_MISMATCH"')).otherwise(""),
        F.lit("}"),
    )
    # The value column of violation reports covers non-objects and text that is not JSON, too.
    odd = F.when((value >= 40) & (value < 45), "[1]").when((value >= 45) & (value < 50), "{x")
    body = F.when(is_violation, F.coalesce(odd, report)).otherwise(
        payload_of(value, F.col("user_id"), F.col("event_id"), F.col("props"))
    )
    tombstone = ~is_violation & (value >= 50) & (value < 55)
    producer = F.concat(F.lit("svc-"), F.col("user_id").cast("string"))
    header = lambda k, v: F.struct(F.lit(k).alias("key"), F.to_binary(v, F.lit("utf-8")).alias("value"))
    return events.select(
        F.to_binary(F.col("user_id").cast("string"), F.lit("utf-8")).alias("key"),
        F.when(~tombstone, F.to_binary(body, F.lit("utf-8"))).alias("value"),
        F.when(is_violation, VIOLATION_TOPIC).otherwise(AUDIT_TOPIC).alias("topic"),
        F.lit(0).alias("partition"),
        F.col("event_id").alias("offset"),
        F.col("ts").cast("timestamp").alias("timestamp"),
        F.array(
            header("x-producer-id", F.lit("")),
            header("x-producer-id", F.when(value < 3, "").otherwise(producer)),
        ).alias("headers"),
        F.concat(F.lit("events."), kind).alias("data_topic"),
    )


def consumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_consumed(spread(table(spark, sf_dir, "events"), TASK_BYTES))


# ---------------------------------------------------------------------------------------------
# registry: one contract per customer, one version per order


def contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    key = F.col("c_custkey").cast("string")
    return c.select(
        key.alias("id"),
        F.col("c_name").alias("name"),
        F.concat(F.lit("orders."), key).alias("topic"),
        F.col("c_mktsegment").alias("owner_team"),
    )


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spread(table(spark, sf_dir, "orders"))
    status, price = F.col("o_orderstatus"), F.col("o_totalprice")
    level = F.left("o_orderpriority", F.lit(1)).cast("int")
    total_type = F.when(price < 300000, '"double"').otherwise('["null", "double"]')
    body = F.concat(
        F.lit('{"type":"record","name":"Order","fields":[{"name":"order_id","type":"long"},'),
        F.lit('{"name":"total","type":'), total_type,
        F.when(status == "O", ',"default":null').otherwise(""), F.lit("}"),
        F.when(
            level <= 3,
            F.concat(
                F.lit(',{"name":"priority","type":"string"'),
                F.when(status == "F", ',"default":"none"').otherwise(""), F.lit("}"),
            ),
        ).otherwise(""),
        F.lit('],"properties":{"order_id":{"type":"integer"},"total":{"type":"number"}'),
        F.when(level <= 3, ',"priority":{"type":"string"}').otherwise(""),
        F.lit('},"required":["order_id"'),
        F.when(price >= 200000, ',"total"').otherwise(""),
        F.lit("]}"),
    )
    mode = F.element_at(
        F.array(*[F.lit(m) for m in (t.BACKWARD, t.FORWARD, t.FULL, t.BACKWARD_TRANSITIVE,
                                     t.NONE_MODE)]),
        level,
    )
    patch = F.when(status == "F", 0).when(status == "O", 1).otherwise(2)
    number = F.concat_ws(
        ".", (F.year("o_orderdate") - 1990).cast("string"), (level - 1).cast("string"),
        patch.cast("string"),
    )
    return o.select(
        F.col("o_orderkey").cast("string").alias("id"),
        F.col("o_custkey").cast("string").alias("contract_id"),
        number.alias("version"),
        F.lit(t.AVRO).alias("schema_format"),
        body.alias("schema_body"),
        mode.alias("compatibility"),
        F.when(status == "F", t.DEPRECATED).when(status == "O", t.ACTIVE).otherwise(t.DRAFT)
        .alias("status"),
        F.lit(None).cast("int").alias("registry_id"),
        F.lit("loader").alias("authored_by"),
        F.col("o_orderdate").cast("timestamp").alias("created_at"),
    )


def proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spread(table(spark, sf_dir, "customer"))
    balance, nation, segment = F.col("c_acctbal"), F.col("c_nationkey"), F.col("c_mktsegment")
    unknown = (segment == "HOUSEHOLD") & (balance >= 9000)
    form = (
        F.when(balance >= 2000, t.AVRO)
        .when(balance >= 0, t.JSON_SCHEMA)
        .when(nation < 10, t.PROTOBUF)
        .otherwise("THRIFT")
    )
    body = F.concat(
        F.lit('{"type":"record", "name":"Order", "fields":[{"name":"order_id", "type":'),
        F.when(nation < 20, '"long"').otherwise('"string"'), F.lit("}"),
        F.when(
            balance < 8000,
            F.concat(
                F.lit(',{"name":"total","type": "double"'),
                F.when(segment.isin("BUILDING", "AUTOMOBILE"), ', "default": 0').otherwise(""),
                F.lit("}"),
            ),
        ).otherwise(""),
        F.when(nation >= 5, ',{"name":"priority","type":"string"}').otherwise(""),
        F.lit(',{"name":"note","type":"string"'),
        F.when(balance < 5000, ',"default":""').otherwise(""),
        F.lit('}],"properties":{"order_id":{"type":"integer"}'),
        F.when(nation >= 5, ',"priority":{"type":"string"}').otherwise(""),
        F.when(segment != "FURNITURE", ',"total":{"type":"number"}').otherwise(""),
        F.lit(',"note":{"type":"string"}},"required":["order_id"'),
        F.when(segment == "MACHINERY", ',"priority","total"').otherwise(""),
        F.when(balance < 500, ',"note"').otherwise(""),
        F.lit("]}"),
    )
    malformed = (balance >= 3000) & (balance < 3200)
    return c.select(
        F.concat(F.lit("chg-"), F.col("c_custkey").cast("string")).alias("change_id"),
        F.when(unknown, F.concat(F.lit("unknown-"), "c_name")).otherwise(F.col("c_name"))
        .alias("contract_name"),
        form.alias("schema_format"),
        F.when(malformed, "[]").otherwise(body).alias("proposed_schema"),
    )


def consumer_team(nation: Column) -> Column:
    return F.when(nation < 5, None).when(nation < 8, "").otherwise(
        F.concat(F.lit("team-"), nation.cast("string"))
    )


def edge_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sighting per line item: the supplier reads the topic of the order's customer."""
    lines = table(spark, sf_dir, "lineitem")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    joined = lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"]).join(
        suppliers, lines["l_suppkey"] == suppliers["s_suppkey"]
    )
    kind = F.when(F.col("l_returnflag") == "A", "FLINK_JOB").when(
        F.col("l_returnflag") == "N", "ICEBERG_TABLE"
    ).otherwise("KAFKA_CONSUMER")
    return joined.select(
        F.concat(F.lit("orders."), F.col("o_custkey").cast("string")).alias("source_topic"),
        F.col("s_name").alias("consumer_name"),
        kind.alias("consumer_type"),
        consumer_team(F.col("s_nationkey")).alias("consumer_team"),
        F.col("l_shipdate").cast("timestamp").alias("seen_at"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"),
    )


def lineage_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct (topic, consumer) pairs of the observations, with type and team by supplier."""
    return stored(spark, "lineage_edges", sf_dir, lambda: _build_lineage_edges(spark, sf_dir))


_KINDS = ["FLINK_JOB", "ICEBERG_TABLE", "KAFKA_CONSUMER"]  # in the order of their names


def _build_lineage_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs of :func:`edge_observations`, from keys: a line moves as numbers of fixed width, which
    aggregate by hashing, and texts come back to the pairs alone."""
    suppliers = table(spark, sf_dir, "supplier").select(
        "s_suppkey", "s_name", consumer_team(F.col("s_nationkey")).alias("team"))
    names = cut(suppliers.select("s_name").distinct().withColumn(
        "name_id", F.monotonically_increasing_id()), "supplier-names")
    # One row for each team of the suppliers; a larger number is a greater name.
    teams = cut(_ranked_values(suppliers, "team", "team_id"), "supplier-teams")
    keyed = suppliers.join(names, suppliers["s_name"].eqNullSafe(names["s_name"])).join(
        teams, "team", "left").select("s_suppkey", "name_id", "team_id")
    lines = spread(table(spark, sf_dir, "lineitem"))
    flag = F.col("l_returnflag")
    kind = F.when(flag == "A", 0).when(flag == "N", 1).otherwise(2)
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    sighted = lines.join(keyed, lines["l_suppkey"] == keyed["s_suppkey"]).select(
        "l_orderkey", "name_id", "team_id", kind.alias("kind"), "l_shipdate")
    pairs = sighted.join(orders, sighted["l_orderkey"] == orders["o_orderkey"]).groupBy(
        "o_custkey", "name_id").agg(
        F.min("kind").alias("kind"), F.max("team_id").alias("team_id"),
        F.max("l_shipdate").alias("seen"))
    return pairs.join(names, "name_id").join(F.broadcast(teams), "team_id", "left").select(
        F.concat(F.lit("orders."), F.col("o_custkey").cast("string")).alias("source_topic"),
        F.col("s_name").alias("consumer_name"),
        F.element_at(F.array(*[F.lit(k) for k in _KINDS]), F.col("kind") + 1).alias("consumer_type"),
        F.col("team").alias("consumer_team"),
        F.col("seen").cast("timestamp").alias("last_seen_at"),
    )


# ---------------------------------------------------------------------------------------------
# lineage graph: region -> nation -> {customer -> order -> line, supplier -> line}


def _strings(*names: str) -> Column:
    return F.array(*[F.lit(n) for n in names]).cast("array<string>")


def _node(kind: str, prefix: str, key: Column, owner: Column, fields: Column) -> list[Column]:
    label = "dataset" if kind == t.DATASET else "job"
    name = F.concat(F.lit(f"{prefix}."), key.cast("string"))
    return [
        F.concat(F.lit(f"{label}:{NAMESPACE}:"), name).alias("id"),
        F.lit(kind).alias("node_type"),
        name.alias("name"),
        F.lit(NAMESPACE).alias("namespace"),
        owner.cast("string").alias("owner_team"),
        fields.alias("fields"),
    ]


def _line_key() -> Column:
    return F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, "nodes", sf_dir, lambda: _build_nodes(spark, sf_dir))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, "edges", sf_dir, lambda: _build_edges(spark, sf_dir))


def _ranked_values(values: DataFrame, column: str, rank: str) -> DataFrame:
    """The few values of a column that are not null, numbered in their order."""
    place = F.row_number().over(Window.orderBy(column))
    return values.select(column).distinct().filter(F.col(column).isNotNull()).withColumn(rank, place)


def _distinct_lines(lines: DataFrame) -> DataFrame:
    """A row for each line key: the greatest status, and whether any of its rows was returned.

    Grouped by numbers of fixed width, so by hashing. A key with a missing part is named by the other.
    """
    statuses = cut(_ranked_values(lines, "l_linestatus", "status"), "line-statuses")
    order, number = F.col("l_orderkey"), F.col("l_linenumber").cast("long")
    whole = order.isNotNull() & number.isNotNull()
    keyed = lines.join(F.broadcast(statuses), "l_linestatus", "left").select(
        F.coalesce(order, number).alias("l_orderkey"), F.when(whole, number).alias("l_linenumber"),
        "status", F.coalesce(F.col("l_returnflag") == "R", F.lit(False)).alias("returned"))
    return keyed.groupBy("l_orderkey", "l_linenumber").agg(
        F.max("status").alias("status"), F.max("returned").alias("returned")).join(
        F.broadcast(statuses), "status", "left")


def _build_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    tab = lambda name: table(spark, sf_dir, name)
    none = F.array().cast("array<string>")
    segment = F.col("c_mktsegment")
    parts = [
        tab("region").select(
            *_node(t.DATASET, "region", F.col("r_name"), F.lit("geo"), _strings("name"))),
        tab("nation").select(
            *_node(t.JOB, "nation", F.col("n_name"), F.lit("geo"), none)),
        tab("customer").select(
            *_node(t.JOB, "customer", F.col("c_custkey"), segment,
                   F.when(segment == "HOUSEHOLD", none)
                   .when(segment == "BUILDING", _strings("name", "acctbal"))
                   .otherwise(_strings("name")))),
        tab("supplier").select(
            *_node(t.JOB, "supplier", F.col("s_suppkey"),
                   consumer_team(F.col("s_nationkey")), _strings("acctbal"))),
        tab("orders").select(
            *_node(t.DATASET, "order", F.col("o_orderkey"), F.col("o_orderpriority"),
                   F.when(F.col("o_orderstatus") == "F", _strings("totalprice", "status"))
                   .otherwise(_strings("status")))),
        _distinct_lines(spread(tab("lineitem"))).select(
            *_node(t.DATASET, "line", _line_key(), F.col("l_linestatus"),
                   F.when(F.col("returned"), _strings("quantity", "tax")).otherwise(none))),
    ]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def _build_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    tab = lambda name: table(spark, sf_dir, name)
    ref = lambda kind, prefix, key: F.concat(F.lit(f"{kind}:{NAMESPACE}:{prefix}."),
                                             key.cast("string"))
    regions = tab("region").select("r_regionkey", "r_name")
    nations = tab("nation")
    line = ref("dataset", "line", _line_key())
    lines = spread(tab("lineitem"))
    nation = ref("job", "nation", F.col("n_name"))
    customers, suppliers = tab("customer"), tab("supplier")
    parts = [
        nations.join(regions, nations["n_regionkey"] == regions["r_regionkey"]).select(
            ref("dataset", "region", F.col("r_name")).alias("src"), nation.alias("dst")),
        customers.join(nations, customers["c_nationkey"] == nations["n_nationkey"]).select(
            nation.alias("src"), ref("job", "customer", F.col("c_custkey")).alias("dst")),
        suppliers.join(nations, suppliers["s_nationkey"] == nations["n_nationkey"]).select(
            nation.alias("src"), ref("job", "supplier", F.col("s_suppkey")).alias("dst")),
        tab("orders").select(
            ref("job", "customer", F.col("o_custkey")).alias("src"),
            ref("dataset", "order", F.col("o_orderkey")).alias("dst")),
        lines.select(
            ref("dataset", "order", F.col("l_orderkey")).alias("src"), line.alias("dst")),
        lines.select(
            ref("job", "supplier", F.col("l_suppkey")).alias("src"), line.alias("dst")),
    ]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def change_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A change per region (found by canonical id) and per nation (found by name)."""
    key = F.col("r_regionkey")
    changed = (
        F.when(key == 0, _strings("totalprice"))
        .when(key == 1, _strings("acctbal", "quantity"))
        .when(key == 2, _strings("tax"))
        .when(key == 3, _strings("name"))
        .otherwise(_strings("missing_field"))
    )
    regions = table(spark, sf_dir, "region").select(
        F.concat(F.lit("region-"), key.cast("string")).alias("change_id"),
        F.concat(F.lit("region."), "r_name").alias("topic"),
        changed.alias("changed_fields"),
    )
    nation = F.col("n_nationkey")
    nations = table(spark, sf_dir, "nation").select(
        F.concat(F.lit("nation-"), nation.cast("string")).alias("change_id"),
        F.when(nation == 24, "nation.nowhere").otherwise(F.concat(F.lit("nation."), "n_name"))
        .alias("topic"),
        _strings("acctbal", "status").alias("changed_fields"),
    )
    return regions.unionByName(nations)
