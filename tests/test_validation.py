from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from pactline import types as t
from pactline.functions.text import rejection_detail
from pactline.operators import validation
from pactline.operators.joins import lookup_join


def contract(spark, rules, topic="payments", version="1.0.0", fail_open=False):
    return spark.createDataFrame(
        [("c1", "payments", topic, version, rules, fail_open)], t.ENFORCEMENT)


def check(spark, payload, rules, topic="payments", **envelope):
    row = {"topic": topic, "contract_id": "c1", "contract_version": "1.0.0",
           "producer_id": "svc", "key": "k", "payload": payload, **envelope}
    messages = spark.createDataFrame([tuple(row[c] for c in t.MESSAGES.fieldNames())], t.MESSAGES)
    return validation.validate(messages, contract(spark, rules)).first()


REQUIRED = lambda path: (path, True, "", "")
OPTIONAL = lambda path: (path, False, "", "")


@pytest.mark.parametrize("payload, rules, status, kinds", [
    ('{"sensor":"s-17","reading":{"celsius":21.5}}',
     [REQUIRED("sensor"), REQUIRED("reading.celsius")], "ACCEPTED", []),
    ('{"reading":{"kelvin":294}}', [REQUIRED("reading.celsius")], "REJECTED",
     [t.MISSING_REQUIRED_FIELD]),
    ('{"reading":21.5}', [REQUIRED("sensor"), REQUIRED("reading.celsius")], "REJECTED",
     [t.MISSING_REQUIRED_FIELD, t.MISSING_REQUIRED_FIELD]),
    ('{"visitor":"Ada","day":3}', [OPTIONAL("day"), ("visitor", False, "PERSONAL", "")], "REJECTED",
     [t.POLICY_BREACH]),
    ('{"visitor":"Ada","day":3}', [OPTIONAL("day"), ("visitor", False, "PERSONAL", "REDACT")],
     "ACCEPTED", []),
    ('{"a":[{"b":1}]}', [REQUIRED("a.b")], "REJECTED", [t.MISSING_REQUIRED_FIELD]),
    ('{"a":null}', [REQUIRED("a")], "REJECTED", [t.TYPE_MISMATCH]),
    ('{"a":null}', [OPTIONAL("a")], "ACCEPTED", []),
    ('{"a":null}', [("a", True, "HEALTH", "")], "REJECTED", [t.POLICY_BREACH]),
    ('{}', [OPTIONAL("a")], "ACCEPTED", []),
    ('null', [REQUIRED("a")], "REJECTED", [t.MISSING_REQUIRED_FIELD]),
    ('{"a":1}', [REQUIRED("b"), REQUIRED("c"), REQUIRED("a")], "REJECTED",
     [t.MISSING_REQUIRED_FIELD, t.MISSING_REQUIRED_FIELD]),
    ('{"a":null,"a":1}', [REQUIRED("a")], "ACCEPTED", []),
    ('{"it\'s":1,"b\\"c":{"d\'\\"e":2},"":{"":3}}',
     [REQUIRED("it's"), REQUIRED("b\"c.d'\"e"), REQUIRED(".")], "ACCEPTED", []),
    ('{not valid json', [], "ERROR", []),
    ('{"a":1} trailing', [], "ERROR", []),
    ('{"a":1}{"b":2}', [], "ERROR", []),
    ('{"a":1},2', [], "ERROR", []),
    ('[1]', [], "ERROR", []),
    ('"{}"', [], "ERROR", []),
    ('', [], "ERROR", []),
    (None, [], "ERROR", []),
    (' \n {"a":1}\t', [REQUIRED("a")], "ACCEPTED", []),
])
def test_rules(spark, payload, rules, status, kinds):
    row = check(spark, payload, rules)
    assert (row.status, [v["type"] for v in row.violations]) == (status, kinds)
    assert (row.error is not None) == (status == "ERROR")


def test_messages_and_order(spark):
    row = check(spark, '{"b":null}', [REQUIRED("a"), REQUIRED("b")])
    assert [v.message for v in row.violations] == [
        'required field "a" is absent', 'field "b" is required but null']


def test_unknown_topic(spark):
    row = check(spark, "{broken", [], topic="other")
    assert row.status == "REJECTED"
    assert row.violations[0]["type"] == t.NO_CONTRACT_FOR_TOPIC


def test_envelope_fields_and_version(spark):
    assert check(spark, "{}", [], producer_id="").error == validation.ENVELOPE_ERROR
    assert check(spark, "{}", [], contract_version="").version_mismatch is False
    row = check(spark, "{}", [], contract_version="0.9.0")
    assert row.version_mismatch is True and row.status == "ACCEPTED"


def test_rejection_detail(spark):
    row = spark.createDataFrame(
        [([("X", "f", "bad"), ("Y", None, "worse")],)], f"v {t.VIOLATIONS}"
    ).select(rejection_detail(F.col("v"))).first()
    assert row[0] == "f: bad; message: worse"


@pytest.mark.parametrize("body, error, payload", [
    ('{"topic":"t","contract_id":"c","producer_id":"p","payload":{"a": 1.50}}', None, '{"a":1.5}'),
    ('{"topic":"t","contract_id":"c","producer_id":"p","payload":"{}"}', None, '"{}"'),
    ('{"topic":"t","contract_id":"c","producer_id":"p","payload":null}', None, "null"),
    ('{"topic":"t","contract_id":"c","producer_id":"p"}', None, None),
    ('{"topic":5,"contract_id":"c","producer_id":"p"}', validation.BODY_ERROR, None),
    ('{"topic":null,"contract_id":"c","producer_id":"p"}', validation.ENVELOPE_ERROR, None),
    ("[]", validation.BODY_ERROR, None),
    ("{x", validation.BODY_ERROR, None),
    (None, validation.BODY_ERROR, None),
])
def test_envelope(spark, body, error, payload):
    df = spark.createDataFrame([(body,)], "value string")
    row = validation.require_envelope_fields(validation.parse_envelope(df)).first()
    assert (row.envelope_error, row.payload) == (error, payload)


def test_freshness(spark):
    rules = spark.createDataFrame(
        [("fresh", False, 10), ("stale", False, 40), ("open", True, 40)],
        "topic string, fail_open boolean, age int")
    now = F.to_timestamp(F.lit("2024-01-01 00:01:00"))
    kept = validation.apply_freshness(
        rules, F.timestamp_seconds(F.unix_timestamp(now) - F.col("age")), now)
    assert {(r.topic, r.stale) for r in kept.collect()} == {("fresh", False), ("open", True)}


def test_lookup_join_ways_agree(spark):
    facts = spark.range(1000).select((F.col("id") % 7).alias("k"), F.col("id").alias("v"))
    lookup = spark.range(5).select(F.col("id").alias("k"), (F.col("id") * 10).alias("x"))
    small = lookup_join(facts, lookup, "k")
    salted = lookup_join(facts, lookup, "k", spread_by=["v"], max_bytes=0)
    plain = lookup_join(facts, lookup, "k", max_bytes=0)
    expected = sorted(map(tuple, small.select("k", "v", "x").collect()), key=str)
    assert len(expected) == 1000
    for other in (salted, plain):
        assert sorted(map(tuple, other.select("k", "v", "x").collect()), key=str) == expected


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_payload_is_parsed_once_even_when_filtered(spark):
    messages = spark.createDataFrame(
        [("payments", "c1", "1.0.0", "svc", "k", '{"a":1}')], t.MESSAGES)
    rejected = validation.validate(messages, contract(spark, [REQUIRED("a")])).filter(
        "status = 'REJECTED'").select("key", "violations")
    # Static invocations show as parseJson; one parse means one occurrence.
    assert _plan(rejected).count("parseJson") + _plan(rejected).count("parse_json(") == 1


def test_messages_do_not_shuffle(spark):
    messages = spark.createDataFrame(
        [("payments", "c1", "1.0.0", "svc", "k", '{"a":1}')], t.MESSAGES)
    plan = _plan(validation.validate(messages, contract(spark, [REQUIRED("a")])))
    assert "BroadcastHashJoin" in plan
    assert "hashpartitioning" not in plan
