from __future__ import annotations

import hashlib
import hmac
import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pactline import types as t
from pactline.functions import masks
from pactline.operators import masking, validation
from pactline.plans.contract_check import check_and_mask, contract_outcomes
from pactline.session import KEY_PADS, REDACTION, configure


def expected_token(key: str, namespace: str, value: str, prefix="tok_") -> str:
    digest = hmac.new(key.encode(), f"{namespace}\0{value}".encode(), hashlib.sha256)
    return prefix + digest.hexdigest()[:32]


def test_known_token(spark):
    key = masks.TokenKey.from_secret("test-key")
    token = masks.tokenize(F.lit("user-123"), F.lit("FINANCIAL"), key)
    assert spark.range(1).select(token).first()[0] == "tok_e70711a15fe4cbb68cb3c17c5ddab292"


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.too_slow])
@given(st.text(min_size=1, max_size=80).filter(lambda s: s.encode("utf-8", "ignore")),
       st.lists(st.tuples(st.text(max_size=6), st.text(max_size=12)), min_size=1, max_size=20))
def test_tokens_equal_hmac(spark, key, pairs):
    df = spark.createDataFrame(pairs, "ns string, value string")
    column = masks.tokenize(F.col("value"), F.col("ns"), masks.TokenKey.from_secret(key))
    got = [r[0] for r in df.select(column).collect()]
    assert got == [expected_token(key, ns, value) for ns, value in pairs]


@pytest.mark.parametrize("value, shown", [
    ("4242424242424242", "************4242"), ("1234", "****"), ("ab", "**"), ("", ""),
    ("ééééééé", "***éééé"), (None, None)])
def test_mask(spark, value, shown):
    df = spark.createDataFrame([(value,)], "v string")
    assert df.select(masks.mask(F.col("v"))).first()[0] == shown


def test_redact(spark):
    df = spark.createDataFrame([("x", 5), (None, None)], "a string, b int")
    rows = df.select(masks.redact(F.col("a")), masks.redact(F.col("b"))).collect()
    assert [tuple(r) for r in rows] == [("[REDACTED]", "[REDACTED]"), (None, None)]


@pytest.mark.parametrize("path, label", [
    ("user.Email", "PERSONAL"), ("cell_number", "PERSONAL"), ("company", "FINANCIAL"),
    ("iban", "FINANCIAL"), ("passport_no", "IDENTIFIER"), ("preCondition", "HEALTH"),
    ("ip_address", "PERSONAL"), ("ssn_email", "PERSONAL"), ("amount", None)])
def test_detect(spark, path, label):
    df = spark.createDataFrame([(path,)], "p string")
    row = df.select(masks.detect_pii(F.col("p")), masks.looks_sensitive(F.col("p"))).first()
    assert tuple(row) == (label, label is not None)


def masked(spark, payload, policies, key="test-key"):
    rules = [(path, False, pii, op) for path, op, pii in policies]
    contract = spark.createDataFrame([("c", "n", "t", "1", rules, False)], t.ENFORCEMENT)
    messages = spark.createDataFrame([("t", "c", "1", "p", "k", payload)], t.MESSAGES)
    keyed = masking.with_keys(contract, masks.token_keys(spark, {"default": key}))
    return masking.mask_messages(validation.attach_contract(messages, keyed)).first()


def test_policy_changes_only_its_field(spark):
    row = masked(spark, '{"transaction_id":"txn","account_id":"user-999","amount":100}',
                 [("account_id", "TOKENIZE", "FINANCIAL")])
    assert json.loads(row.masked_payload) == {
        "transaction_id": "txn", "amount": 100,
        "account_id": expected_token("test-key", "FINANCIAL", "user-999")}
    assert row.fields_transformed == ["account_id"] and row.pattern_detections == []


def test_namespace_falls_back_to_the_path(spark):
    row = masked(spark, '{"a":{"b":"v"}}', [("a.b", "TOKENIZE", "")])
    assert json.loads(row.masked_payload)["a"]["b"] == expected_token("test-key", "a.b", "v")


def test_absent_and_null_fields(spark):
    row = masked(spark, '{"transaction_id":"t","email":null}',
                 [("account_id", "REDACT", ""), ("email", "MASK", "")])
    assert row.fields_transformed == ["email"]
    assert json.loads(row.masked_payload) == {"transaction_id": "t", "email": None}


def test_no_policies_keep_the_text_and_still_scan(spark):
    text = '{"transaction_id": "t", "user": {"email":"u@example.com"}}'
    row = masked(spark, text, [])
    assert row.masked_payload == text
    assert [tuple(x) for x in row.pattern_detections] == [("user.email", "PERSONAL", True)]


def test_policies_apply_in_order(spark):
    row = masked(spark, '{"card":{"number":"4242424242"}}',
                 [("card.number", "MASK", ""), ("card", "REDACT", ""), ("card.number", "MASK", "")])
    assert json.loads(row.masked_payload) == {"card": "[REDACTED]"}
    assert row.fields_transformed == ["card.number", "card"]


@pytest.mark.parametrize("payload, operation", [
    ('{"a":5,"b":"secret"}', "MASK"), ('{"a":{"x":1},"b":"s"}', "TOKENIZE"),
    ('{"a":"text","b":"s"}', "ROT13"), ('[1]', "MASK"), ("{x", "MASK")])
def test_failures_block_the_message(spark, payload, operation):
    row = masked(spark, payload, [("b", "REDACT", ""), ("a", operation, "")])
    assert row.masking_error is not None
    assert row.masked_payload is None and row.masked_document is None
    assert row.fields_transformed is None


def test_a_missing_key_blocks_the_message(spark):
    contract = spark.createDataFrame(
        [("c", "n", "t", "1", [("a", False, "", "TOKENIZE")], False)], t.ENFORCEMENT)
    messages = spark.createDataFrame([("t", "c", "1", "p", "k", '{"a":"x"}')], t.MESSAGES)
    row = check_and_mask(messages, contract, masks.token_keys(spark, {"other": "k"})).first()
    assert row.masked_payload is None and "no key" in row.masking_error


def test_redaction_pattern_of_the_caller_stays(spark):
    before = spark.conf.get(REDACTION)
    try:
        spark.conf.set(REDACTION, "secret[0-9]+")
        configure(configure(spark))
        assert spark.conf.get(REDACTION) == f"(?:secret[0-9]+)|{KEY_PADS}"
        key = masks.TokenKey.from_secret("k")
        df = spark.range(1).select(masks.tokenize(F.lit("secret7"), F.lit("n"), key))
        assert key.ipad.hex() not in df._jdf.queryExecution().explainString(
            spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("extended")).lower()
    finally:
        spark.conf.set(REDACTION, before)


def test_redact_takes_any_type(spark):
    row = masked(spark, '{"a":{"x":[1]},"b":5}', [("a", "REDACT", ""), ("b", "REDACT", "")])
    assert json.loads(row.masked_payload) == {"a": "[REDACTED]", "b": "[REDACTED]"}


def test_outcomes_never_carry_unmasked_payloads(spark):
    rules = [("email", True, "PERSONAL", "MASK")]
    contract = spark.createDataFrame([("c", "n", "t", "1", rules, False)], t.ENFORCEMENT)
    keys = masks.token_keys(spark, {"default": "k"})
    bodies = ['{"email":"someone@example.com"}', '{"email":7}', '{"other":"someone"}', "{x"]
    messages = spark.createDataFrame(
        [("t", "c", "1", "p", str(i), b) for i, b in enumerate(bodies)], t.MESSAGES)
    rows = {r.key: r for r in contract_outcomes(messages, contract, keys).collect()}
    assert [rows[str(i)].outcome for i in range(4)] == ["ACCEPTED", "ERROR", "REJECTED", "ERROR"]
    assert [rows[str(i)].payload for i in range(1, 4)] == [None, None, None]
    assert "someone" not in rows["0"].payload


def test_key_material_is_not_in_the_plan(spark):
    contract = spark.createDataFrame(
        [("c", "n", "t", "1", [("a", False, "", "TOKENIZE")], False)], t.ENFORCEMENT)
    key = masks.TokenKey.from_secret("super-secret")
    messages = spark.createDataFrame([("t", "c", "1", "p", "k", '{"a":"x"}')], t.MESSAGES)
    df = check_and_mask(messages, contract, masks.token_keys(spark, {"default": "super-secret"}))
    plan = df._jdf.queryExecution().toString().lower()
    for secret in (key.ipad.hex(), key.opad.hex(), "super-secret"):
        assert secret not in plan
    assert "super-secret" not in repr(key) and key.ipad.hex() not in repr(key)


def test_scan_table_columns(spark):
    df = spark.sql("select 1 as id, named_struct('email', 'x', 'n', 1) as user, 'y' as passport")
    found = {tuple(r) for r in masking.scan_table_columns(spark, df).collect()}
    assert found == {("user.email", "PERSONAL"), ("passport", "IDENTIFIER")}
