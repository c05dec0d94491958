"""Enumerations and table schemas shared by all operators."""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values: literal strings written to tables and metric labels; keep them stable ---

MISSING_REQUIRED_FIELD = "MISSING_REQUIRED_FIELD"
TYPE_MISMATCH = "TYPE_MISMATCH"
NO_CONTRACT_FOR_TOPIC = "NO_CONTRACT_FOR_TOPIC"
SCHEMA_INVALID = "SCHEMA_INVALID"
POLICY_BREACH = "POLICY_BREACH"

ACCEPTED = "ACCEPTED"
REJECTED = "REJECTED"
ERROR = "ERROR"

AVRO = "AVRO"
JSON_SCHEMA = "JSON_SCHEMA"
PROTOBUF = "PROTOBUF"

BACKWARD = "BACKWARD"
FORWARD = "FORWARD"
FULL = "FULL"
BACKWARD_TRANSITIVE = "BACKWARD_TRANSITIVE"
NONE_MODE = "NONE"

DRAFT = "DRAFT"
PENDING_APPROVAL = "PENDING_APPROVAL"
ACTIVE = "ACTIVE"
DEPRECATED = "DEPRECATED"

SAFE = "SAFE"
COMPATIBLE = "COMPATIBLE"
BREAKING = "BREAKING"
CLASSIFICATION_RANK = {SAFE: 0, COMPATIBLE: 1, BREAKING: 2}

FIELD_REMOVED = "FIELD_REMOVED"
FIELD_ADDED = "FIELD_ADDED"
TYPE_CHANGED = "TYPE_CHANGED"
DEFAULT_REMOVED = "DEFAULT_REMOVED"
REQUIRED_ADDED = "REQUIRED_ADDED"

REDACT = "REDACT"
TOKENIZE = "TOKENIZE"
MASK = "MASK"
AUDIT_LOG = "AUDIT_LOG"
MASKING_OPERATIONS = (REDACT, TOKENIZE, MASK)

PERSONAL = "PERSONAL"
FINANCIAL = "FINANCIAL"
HEALTH = "HEALTH"
IDENTIFIER = "IDENTIFIER"

DATASET = "DATASET"
JOB = "JOB"
KAFKA_TOPIC = "KAFKA_TOPIC"
ICEBERG_TABLE = "ICEBERG_TABLE"
UNKNOWN = "UNKNOWN"

CRITICAL = "CRITICAL"
HIGH = "HIGH"
MEDIUM = "MEDIUM"
NONE = "NONE"
IMPACT_RANK = {CRITICAL: 4, HIGH: 3, MEDIUM: 2, NONE: 1}

APPROVAL_ACTIONS = ("SUBMITTED", "APPROVED", "REJECTED", "SUPERSEDED")
CONSUMER_TYPES = ("FLINK_JOB", "ICEBERG_TABLE", "KAFKA_CONSUMER", "UNKNOWN")

COMPLETE = "COMPLETE"
FAIL = "FAIL"

# Validation outcome -> type column of the violation log, which has its own shorter list.
VIOLATION_LOG_TYPE = {
    MISSING_REQUIRED_FIELD: "MISSING_FIELD",
    TYPE_MISMATCH: "TYPE_ERROR",
    POLICY_BREACH: "POLICY_VIOLATION",
    NO_CONTRACT_FOR_TOPIC: "SCHEMA_MISMATCH",
    SCHEMA_INVALID: "SCHEMA_MISMATCH",
}

# --- table schemas ---

VIOLATION = "struct<type:string,field:string,message:string>"
VIOLATIONS = f"array<{VIOLATION}>"
RULE = "struct<path:string,required:boolean,pii_class:string,masking_op:string>"
RULES = f"array<{RULE}>"
FIELD_METADATA = "array<struct<path:string,value_type:string,nullable:boolean,present:boolean>>"


TEXT, BYTES, TIME = T.StringType(), T.BinaryType(), T.TimestampType()
INT, LONG, FLAG = T.IntegerType(), T.LongType(), T.BooleanType()
TEXTS = T.ArrayType(TEXT)
HEADERS = T.ArrayType(T.StructType().add("key", TEXT).add("value", BYTES))
RULE_ROWS = T.ArrayType(
    T.StructType().add("path", TEXT).add("required", FLAG).add("pii_class", TEXT)
    .add("masking_op", TEXT)
)


def _table(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


# The columns of messages, registry tables and the lineage graph.
MESSAGES = _table(
    topic=TEXT, contract_id=TEXT, contract_version=TEXT, producer_id=TEXT, key=TEXT,
    payload=TEXT,
)

# The shape of Spark's Kafka source with headers switched on.
CONSUMED = _table(
    key=BYTES, value=BYTES, topic=TEXT, partition=INT, offset=LONG, timestamp=TIME,
    headers=HEADERS,
)

ENFORCEMENT = _table(
    contract_id=TEXT, name=TEXT, topic=TEXT, version=TEXT, fields=RULE_ROWS, fail_open=FLAG,
)

REGISTRY = {
    "contracts": _table(
        id=TEXT, name=TEXT, topic=TEXT, owner_team=TEXT, description=TEXT, created_at=TIME,
        updated_at=TIME,
    ),
    "contract_versions": _table(
        id=TEXT, contract_id=TEXT, version=TEXT, schema_format=TEXT, schema_body=TEXT,
        compatibility=TEXT, status=TEXT, registry_id=INT, authored_by=TEXT, created_at=TIME,
    ),
    "approval_events": _table(
        id=TEXT, contract_version_id=TEXT, actor=TEXT, action=TEXT, comment=TEXT,
        created_at=TIME,
    ),
    "field_policies": _table(
        id=TEXT, contract_id=TEXT, field_path=TEXT, policy_type=TEXT, policy_config=TEXT,
        created_at=TIME,
    ),
    "lineage_edges": _table(
        id=TEXT, source_topic=TEXT, consumer_name=TEXT, consumer_type=TEXT, consumer_team=TEXT,
        last_seen_at=TIME,
    ),
    "contract_violations": _table(
        id=TEXT, contract_id=TEXT, contract_version_id=TEXT, producer_id=TEXT, topic=TEXT,
        violation_type=TEXT, violation_detail=TEXT, occurred_at=TIME,
    ),
}

NODES = _table(
    id=TEXT, node_type=TEXT, name=TEXT, namespace=TEXT, dataset_type=TEXT, owner_team=TEXT,
    fields=TEXTS,
)
EDGES = _table(
    src=TEXT, dst=TEXT,
)
