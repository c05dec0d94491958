"""Check JSON messages against the active contract of their topic.

Rules are data: the contract row carries an array of rules, evaluated per message by one
higher-order expression. The messages therefore never shuffle, however many contracts there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactline import types as t
from pactline.functions.documents import json_kind, let, path_get, variant_path, with_document
from pactline.functions.rows import bind
from pactline.operators.joins import BROADCAST_BYTES, lookup_join

ENVELOPE_ERROR = "topic, contract_id, and producer_id are required"
BODY_ERROR = "invalid request body"
PAYLOAD_ERROR = "validation failed"
NO_CONTRACT = "no active contract found for topic"

_TEXT_FIELDS = ("topic", "contract_id", "contract_version", "producer_id", "key")


def parse_envelope(df: DataFrame, value: str = "value") -> DataFrame:
    """Decode produce envelopes; ``envelope_error`` is set for malformed bodies.

    One parse per message. The payload comes out as canonical JSON text: same values and full
    precision, without blanks and with sorted keys. A payload that is a JSON string stays quoted, so
    it is not mistaken for a document; a missing payload is NULL. As with any stream decoder,
    whatever follows the first JSON value of the body is ignored.
    """
    text = F.col(value).cast("string")
    body = bind(df.withColumn("__text", text), {"__body": F.try_parse_json("__text")})
    field = lambda name: F.try_variant_get("__body", f"$.{name}", "variant")
    is_text = lambda name: field(name).isNull() | json_kind(field(name)).isin("string", "null")
    well_formed = F.coalesce(
        (F.left(F.ltrim("__text", F.lit(" \t\n\r")), F.lit(1)) == "{")
        | F.is_variant_null("__body"),
        F.lit(False),
    )
    for name in _TEXT_FIELDS:
        well_formed = well_formed & is_text(name)
    payload = F.to_json(field("payload"))
    texts = [
        F.coalesce(F.try_variant_get("__body", f"$.{n}", "string"), F.lit("")).alias(n)
        for n in _TEXT_FIELDS
    ]
    others = [c for c in df.columns if c not in (*_TEXT_FIELDS, "payload")]
    return body.select(
        *others,
        *texts,
        payload.alias("payload"),
        F.when(F.col("__body").isNull() | ~well_formed, F.lit(BODY_ERROR)).alias("envelope_error"),
    )


def require_envelope_fields(df: DataFrame) -> DataFrame:
    """Set ``envelope_error`` where topic, contract_id or producer_id is empty."""
    needed = ("topic", "contract_id", "producer_id")
    complete = F.lit(True)
    for name in needed:
        complete = complete & (F.length(F.coalesce(F.col(name), F.lit(""))) > 0)
    error = F.when(~complete, F.lit(ENVELOPE_ERROR))
    if "envelope_error" in df.columns:
        error = F.coalesce(F.col("envelope_error"), error)
    return df.withColumn("envelope_error", error)


def attach_contract(
    messages: DataFrame, enforcement: DataFrame, max_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """Left join with the contract of the topic; ``contract`` is NULL when there is none."""
    compiled = F.transform(
        "fields",
        lambda f: F.struct(
            *[f[n].alias(n) for n in ("path", "required", "pii_class", "masking_op")],
            variant_path(f["path"]).alias("compiled"),
        ),
    )
    extra = [c for c in enforcement.columns if c not in t.ENFORCEMENT.fieldNames()]
    lookup = enforcement.select(
        "topic",
        F.struct("contract_id", "name", "version", "fail_open", compiled.alias("fields"), *extra)
        .alias("contract"),
    )
    spread = [c for c in ("key", "payload", "producer_id") if c in messages.columns]
    return lookup_join(messages, lookup, "topic", spread_by=spread, max_bytes=max_bytes)


def version_mismatch() -> Column:
    """Declared version differs from the active one; never a reason to reject."""
    declared, active = F.coalesce(F.col("contract_version"), F.lit("")), F.col("contract.version")
    return F.coalesce((declared != "") & (declared != active), F.lit(False))


def apply_freshness(
    enforcement: DataFrame, fetched_at: Column, now: Column, ttl_seconds: int = 30
) -> DataFrame:
    """Drop contracts whose refresh failed for longer than the time to live.

    A contract older than the limit stays usable, flagged ``stale``, only if it is ``fail_open``;
    without it its messages are rejected for want of a contract.
    """
    age = now.cast("timestamp").cast("double") - fetched_at.cast("timestamp").cast("double")
    stale = age >= F.lit(float(ttl_seconds))
    return enforcement.withColumn("stale", stale).filter(~F.col("stale") | F.col("fail_open"))


def _violation(kind: str, field: Column, message: Column) -> Column:
    return F.struct(F.lit(kind).alias("type"), field.alias("field"), message.alias("message"))


def rule_violation(doc: Column, rule: Column) -> Column:
    """The violation of one rule by one document, NULL when it holds."""
    path = rule["path"]
    named = lambda before, after: F.concat(F.lit(before), path, F.lit(after))

    def judge(value: Column) -> Column:
        absent = value.isNull()
        undeclared = (F.coalesce(rule["pii_class"], F.lit("")) != "") & (
            F.coalesce(rule["masking_op"], F.lit("")) == ""
        )
        breach = F.concat(
            F.lit('field "'), path, F.lit('" is classified '), rule["pii_class"],
            F.lit(" but has no masking_op in contract"),
        )
        return (
            F.when(
                absent & rule["required"],
                _violation(
                    t.MISSING_REQUIRED_FIELD, path, named('required field "', '" is absent')
                ),
            )
            .when(absent, F.lit(None))
            .when(undeclared, _violation(t.POLICY_BREACH, path, breach))
            .when(
                rule["required"] & F.is_variant_null(value),
                _violation(t.TYPE_MISMATCH, path, named('field "', '" is required but null')),
            )
        )

    return let(path_get(doc, path, rule["compiled"]), judge)


def violations_of(doc: Column, rules: Column) -> Column:
    """All violations in rule order."""
    judged = F.transform(rules, lambda rule: rule_violation(doc, rule))
    return F.filter(judged, lambda v: v.isNotNull()).cast(t.VIOLATIONS)


def first_violation(violations: Column) -> Column:
    return F.get(violations, F.lit(0))


def validate(
    messages: DataFrame, enforcement: DataFrame, max_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """Messages with ``status``, ``violations``, ``error`` and ``version_mismatch``.

    ``ERROR`` marks processing failures (bad envelope or payload), which are not violations. The
    parsed payload stays available as ``document`` and the matched contract as ``contract``.
    """
    checked = require_envelope_fields(messages)
    joined = with_document(
        attach_contract(checked, enforcement, max_bytes), "payload", "document"
    )
    no_contract = F.array(
        _violation(t.NO_CONTRACT_FOR_TOPIC, F.lit(None).cast("string"), F.lit(NO_CONTRACT))
    ).cast(t.VIOLATIONS)
    nothing = F.array().cast(t.VIOLATIONS)
    error = F.coalesce(
        F.col("envelope_error"),
        F.when(
            F.col("contract").isNotNull() & F.col("document").isNull(), F.lit(PAYLOAD_ERROR)
        ),
    )
    violations = (
        F.when(F.col("error").isNotNull(), nothing)
        .when(F.col("contract").isNull(), no_contract)
        .otherwise(violations_of(F.col("document"), F.col("contract.fields")))
    )
    status = (
        F.when(F.col("error").isNotNull(), t.ERROR)
        .when(F.size("violations") > 0, t.REJECTED)
        .otherwise(t.ACCEPTED)
    )
    judged = bind(joined.withColumn("error", error), {"violations": violations})
    return judged.withColumns(
        {"status": status, "version_mismatch": version_mismatch()}
    ).drop("envelope_error")
