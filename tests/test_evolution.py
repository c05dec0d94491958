from __future__ import annotations

import json

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from pactline import types as t
from pactline.functions import semver
from pactline.operators import evolution, registry
from pactline.plans.change_gate import run_gate


def avro(*fields) -> str:
    return json.dumps({"type": "record", "name": "R", "fields": list(fields)})


def schema(properties: dict, required=()) -> str:
    return json.dumps({"type": "object", "properties": properties, "required": list(required)})


ID = {"name": "id", "type": "string"}
AMOUNT = {"name": "amount", "type": "int"}
CURRENCY = {"name": "currency", "type": "string"}


def with_default(field, value):
    return {**field, "default": value}


def check(spark, fmt, old, new, mode="BACKWARD", strict=False):
    df = spark.createDataFrame(
        [(old, new, fmt, mode)], "cur string, new string, fmt string, mode string")
    row = evolution.with_schema_changes(df, "cur", "new", "fmt", "mode", strict).first()
    return row.classification, [(c.field, c.change_type, c.severity) for c in row.changes], \
        row.schema_error


@pytest.mark.parametrize("fmt, old, new, mode, expected, changes", [
    ("AVRO", avro(ID, AMOUNT), avro(ID, AMOUNT, with_default(CURRENCY, "USD")), "BACKWARD",
     t.COMPATIBLE, [("currency", t.FIELD_ADDED)]),
    ("AVRO", avro(ID, AMOUNT), avro(ID), "BACKWARD", t.BREAKING, [("amount", t.FIELD_REMOVED)]),
    ("AVRO", avro(ID, AMOUNT), avro(ID), "NONE", t.BREAKING, [("amount", t.FIELD_REMOVED)]),
    ("AVRO", avro(ID, with_default(AMOUNT, 0)), avro(ID), "BACKWARD", t.COMPATIBLE,
     [("amount", t.FIELD_REMOVED)]),
    ("AVRO", avro(ID, AMOUNT), avro(ID, {**AMOUNT, "type": "string"}), "BACKWARD", t.BREAKING,
     [("amount", t.TYPE_CHANGED)]),
    ("AVRO", avro(ID, AMOUNT), avro(ID, AMOUNT), "BACKWARD", t.SAFE, []),
    ("AVRO", avro(ID), avro(ID, with_default(CURRENCY, None)), "BACKWARD", t.COMPATIBLE,
     [("currency", t.FIELD_ADDED)]),
    ("AVRO", avro(ID), avro(ID, CURRENCY), "BACKWARD", t.BREAKING, [("currency", t.FIELD_ADDED)]),
    *[("AVRO", avro(ID), avro(ID, CURRENCY), mode, t.COMPATIBLE, [("currency", t.FIELD_ADDED)])
      for mode in ("FORWARD", "FULL", "BACKWARD_TRANSITIVE", "NONE", None)],
    ("AVRO", avro(with_default(ID, "x")), avro(ID), "BACKWARD", t.COMPATIBLE,
     [("id", t.DEFAULT_REMOVED)]),
    ("AVRO", avro(with_default(ID, "x")), avro({"name": "id", "type": "int"}), "BACKWARD",
     t.BREAKING, [("id", t.TYPE_CHANGED), ("id", t.DEFAULT_REMOVED)]),
    ("AVRO", avro(ID), avro({"name": "key", "type": "string", "aliases": ["id"]}), "BACKWARD",
     t.BREAKING, [("id", t.FIELD_REMOVED), ("key", t.FIELD_ADDED)]),
    ("AVRO", avro({"name": "u", "type": ["null", "string"]}),
     '{"fields" : [ {"type" : [ "null" , "string" ], "name" : "u"} ]}', "BACKWARD", t.SAFE, []),
    ("AVRO", avro({"name": "id", "type": "int"}, ID), avro(ID), "BACKWARD", t.SAFE, []),
    ("AVRO", avro({"name": "a.b'c", "type": "int"}), avro({"name": "a.b'c", "type": "long"}),
     "BACKWARD", t.BREAKING, [("a.b'c", t.TYPE_CHANGED)]),
    ("AVRO", "null", avro(with_default(ID, "")), "BACKWARD", t.COMPATIBLE,
     [("id", t.FIELD_ADDED)]),
    ("JSON_SCHEMA", schema({"id": {}}, ["id"]), schema({"id": {}, "altitude": {}}, ["id"]),
     "BACKWARD", t.COMPATIBLE, [("altitude", t.FIELD_ADDED)]),
    ("JSON_SCHEMA", schema({"id": {}}, ["id"]),
     schema({"id": {}, "station": {}}, ["id", "station"]), "BACKWARD", t.BREAKING,
     [("station", t.FIELD_ADDED)]),
    ("JSON_SCHEMA", schema({"id": {}, "x": {}}), schema({"id": {}}), "BACKWARD", t.COMPATIBLE,
     [("x", t.FIELD_REMOVED)]),
    ("JSON_SCHEMA", schema({"id": {}, "x": {}}, ["x"]), schema({"id": {}}), "BACKWARD",
     t.BREAKING, [("x", t.FIELD_REMOVED)]),
    ("JSON_SCHEMA", schema({"id": {}}), schema({"id": {}}, ["id"]), "BACKWARD", t.BREAKING,
     [("id", t.REQUIRED_ADDED)]),
    ("JSON_SCHEMA", schema({"id": {}}, ["id"]), schema({"id": {}}), "BACKWARD", t.SAFE, []),
    ("JSON_SCHEMA", schema({"id": {"type": "string"}}), schema({"id": {"type": "number"}}),
     "BACKWARD", t.SAFE, []),
    ("PROTOBUF", "not json", "message A {}", "BACKWARD", t.SAFE, []),
])
def test_changes(spark, fmt, old, new, mode, expected, changes):
    worst, found, error = check(spark, fmt, old, new, mode)
    assert (worst, [c[:2] for c in found], error) == (expected, changes, None)


def test_strict_types(spark):
    old, new = schema({"id": {"type": "string"}}), schema({"id": {"type": "number"}})
    assert check(spark, "JSON_SCHEMA", old, new, strict=True)[0] == t.BREAKING


@pytest.mark.parametrize("fmt, old, new", [
    ("THRIFT", "{}", "{}"), (None, "{}", "{}"), ("AVRO", "{x", "{}"), ("AVRO", "{}", "[]"),
    ("AVRO", "{}", '{"fields":{}}'), ("AVRO", "{}", '{"fields":[1]}'),
    ("AVRO", "{}", '{"fields":[{"name":1}]}'), ("JSON_SCHEMA", "{}", '{"required":"id"}'),
    ("JSON_SCHEMA", '{"properties":[]}', "{}"), ("JSON_SCHEMA", "{}", '{"required":[1]}')])
def test_errors_have_no_class(spark, fmt, old, new):
    worst, found, error = check(spark, fmt, old, new)
    assert worst is None and found == [] and error


def test_diff_is_symmetric(spark):
    a, b = avro(ID, AMOUNT), avro(ID, CURRENCY)
    one = {(f, k) for f, k, _ in check(spark, "AVRO", a, b)[1]}
    other = {(f, k) for f, k, _ in check(spark, "AVRO", b, a)[1]}
    turn = {t.FIELD_ADDED: t.FIELD_REMOVED, t.FIELD_REMOVED: t.FIELD_ADDED}
    assert other == {(f, turn[k]) for f, k in one}


@pytest.mark.parametrize("text, parsed", [
    ("1.2.3", (1, 2, 3)), ("+1.-2.03", (1, -2, 3)), ("1.2", None), ("1.2.3.4", None),
    ("1.2.x", None), (" 1.2.3", None), ("1..3", None), ("", None), (None, None)])
def test_semver(spark, text, parsed):
    df = spark.createDataFrame([(text,)], "v string").select(
        semver.parse_semver(F.col("v")).alias("p"))
    row = df.select("p", semver.format_semver(F.col("p"))).first()
    assert (tuple(row[0]) if row[0] else None) == parsed
    assert row[1] == (".".join(map(str, parsed)) if parsed else None)


@pytest.mark.parametrize("old, new, level", [
    ("1.2.3", "2.0.0", "MAJOR"), ("1.2.3", "1.3.0", "MINOR"), ("1.2.3", "1.2.4", "PATCH"),
    ("1.2.3", "1.2.3", None), ("1.2.3", "1.4.0", None), ("1.2.3", "2.1.0", None)])
def test_bump(spark, old, new, level):
    df = spark.createDataFrame([(old, new)], "a string, b string")
    a, b = semver.parse_semver(F.col("a")), semver.parse_semver(F.col("b"))
    row = df.select(semver.bump_level(a, b), semver.bump_error(a, b)).first()
    assert row[0] == level
    text = f"version {new} is not a valid single-level increment from {old}"
    assert row[1] == (None if level else text)


def version(id_, contract, number, body, status="ACTIVE", day=1, fmt="AVRO", mode="BACKWARD"):
    return (id_, contract, number, fmt, body, mode, status, None, "me", f"2024-01-{day:02d}")


def versions_frame(spark, rows):
    schema_ = ("id string, contract_id string, version string, schema_format string, "
               "schema_body string, compatibility string, status string, registry_id int, "
               "authored_by string, created_at string")
    return spark.createDataFrame(rows, schema_).withColumn(
        "created_at", F.col("created_at").cast("timestamp"))


def test_history(spark):
    v = versions_frame(spark, [
        version("a", "c", "1.0.0", avro(ID)),
        version("b", "c", "1.1.0", avro(ID, with_default(CURRENCY, "")), day=2),
        version("d", "c", "3.0.0", avro({**ID, "type": "int"}), day=3),
        version("e", "c", "oops", schema({}), day=4, fmt="JSON_SCHEMA")])
    rows = {r.id: r for r in evolution.evolution_history(v).collect()}
    assert [rows[i].classification for i in "abde"] == [None, t.COMPATIBLE, t.BREAKING, None]
    assert [rows[i].bump for i in "abde"] == [None, "MINOR", None, None]
    assert rows["a"].schema_error is None and rows["e"].schema_error
    assert rows["e"].bump_error == "version must be MAJOR.MINOR.PATCH"


def test_first_versions_have_no_class(spark):
    v = versions_frame(spark, [version("a", "c", "1.0.0", "x", fmt="PROTOBUF"),
                               version("b", "c", "1.0.1", "y", day=2, fmt="PROTOBUF")])
    rows = {r.id: r for r in evolution.evolution_history(v).collect()}
    assert rows["a"].classification is None and rows["a"].changes == []
    assert rows["b"].classification == t.SAFE and rows["b"].previous_version == "1.0.0"


def test_shared_schemas_are_compared_once(spark, monkeypatch):
    """Twenty contracts with the same three schemas, one of them NULL, make two pairs."""
    bodies = [avro(ID), avro(ID, with_default(CURRENCY, "")), None]
    v = versions_frame(spark, [
        version(f"{c}-{n}", f"c{c}", f"1.{n}.0", body, day=n + 1)
        for c in range(20) for n, body in enumerate(bodies)])
    stored, plain = {}, evolution.cut
    monkeypatch.setattr(
        evolution, "cut", lambda df, name: stored.setdefault(name, plain(df, name)))
    rows = evolution.evolution_history(v)
    assert stored["compared-schemas"].count() == 2
    assert stored["schema-texts"].count() == 3
    assert "schema_body" not in stored["version-pairs"].columns
    found = {(r.previous_version, r.classification, bool(r.schema_error)) for r in rows.collect()}
    assert rows.count() == 60
    assert found == {(None, None, False), ("1.0.0", t.COMPATIBLE, False), ("1.1.0", None, True)}


def test_history_in_ranges_equals_one_window_per_contract(spark):
    """Null contracts, null and equal times, null values, and a contract in several ranges."""
    rows = [(None if i % 7 == 0 else f"c{i % 5 // 4}", None if i % 11 == 0 else i // 6, f"{i:02d}",
             None if i % 3 == 0 else i) for i in range(60)]
    v = spark.createDataFrame(rows, "contract_id string, created_at int, id string, x int")
    window = Window.partitionBy("contract_id").orderBy("created_at", "id")
    plain = v.withColumn("before", F.lag("x").over(window))
    ranged = evolution.with_previous(v, F.col("x"), "before")
    assert sorted(map(str, ranged.collect())) == sorted(map(str, plain.collect()))


def test_gate(spark):
    contracts = spark.createDataFrame(
        [("c", "payments", "topic.p"), ("n", "new", "topic.n")],
        "id string, name string, topic string")
    v = versions_frame(spark, [
        version("a", "c", "1.0.0", avro(ID, AMOUNT)),
        version("b", "c", "1.1.0", avro(ID, AMOUNT, CURRENCY), status="DRAFT", day=2)])
    edges = spark.createDataFrame(
        [("topic.p", "x", "FLINK_JOB", "team-b", ["amount"]),
         ("topic.p", "y", "UNKNOWN", "team-a", []),
         ("topic.p", "z", "UNKNOWN", None, ["id"]), ("topic.p", "w", "UNKNOWN", "", []),
         ("topic.q", "x", "FLINK_JOB", "team-q", [])],
        "source_topic string, consumer_name string, consumer_type string, consumer_team string, "
        "fields_used array<string>")
    asked = spark.createDataFrame(
        [("drops", "payments", "AVRO", avro(ID)), ("same", "payments", "AVRO",
                                                     avro(ID, AMOUNT, CURRENCY)),
         ("proto", "payments", "PROTOBUF", "x"), ("bad", "payments", "AVRO", "{"),
         ("unversioned", "new", "AVRO", "{"), ("unknown", "nobody", "AVRO", "{"),
         ("nameless", "", "AVRO", "{}"), ("empty", "payments", "AVRO", "")],
        "change_id string, contract_name string, schema_format string, proposed_schema string")
    result = run_gate(asked, contracts, v, edges)
    rows = {r.change_id: r for r in result.decisions.collect()}
    assert {k: r.classification for k, r in rows.items()} == {
        "drops": t.BREAKING, "same": t.SAFE, "proto": t.SAFE, "bad": None,
        "unversioned": t.SAFE, "unknown": t.SAFE, "nameless": None, "empty": None}
    assert rows["drops"].requires_approval and rows["drops"].n_consumers == 4
    assert rows["drops"].approval_from_teams == ["team-a", "team-b"]
    assert not rows["same"].requires_approval and rows["bad"].error.startswith("schema analysis")
    assert rows["nameless"].error == rows["empty"].error and rows["empty"].error
    changes = {(r.field, r.change_type) for r in result.changes.collect()}
    assert changes == {("amount", t.FIELD_REMOVED), ("currency", t.FIELD_REMOVED)}
    impacted = {r.consumer_name: r.fields_impacted for r in result.consumers.collect()}
    assert impacted == {"x": ["amount"], "y": [], "z": [], "w": []}
    for part in (result.decisions, result.changes, result.consumers):  # nothing is parsed again
        assert "parse_json" not in part._jdf.queryExecution().optimizedPlan().toString()


def test_registry(spark, tmp_path):
    contracts = spark.createDataFrame(
        [("c", "payments", "topic.p", True)], "id string, name string, topic string, "
        "fail_open boolean")
    body = schema({"id": {}, "email": {}}, ["id", "email"])
    v = versions_frame(spark, [
        version("a", "c", "1.0.0", body, day=1, fmt="JSON_SCHEMA"),
        version("b", "c", "2.0.0", body, day=2, fmt="JSON_SCHEMA"),
        version("d", "c", "2.1.0", body, day=3, status="DRAFT", fmt="JSON_SCHEMA")])
    policies = spark.createDataFrame(
        [("c", "email", "MASK", '{"pii_class":"PERSONAL"}', "2024-01-02"),
         ("c", "note", "AUDIT_LOG", "{}", "2024-01-01")],
        "contract_id string, field_path string, policy_type string, policy_config string, "
        "created_at string").withColumn("created_at", F.col("created_at").cast("timestamp"))
    row = registry.enforcement_contracts(v, contracts, policies).first()
    assert (row.version, row.fail_open) == ("2.0.0", True)
    assert [tuple(f) for f in row.fields] == [
        ("id", True, "", ""), ("note", False, "", ""), ("email", True, "PERSONAL", "MASK")]

    assert registry.active_version(v, contracts).first().id == "b"
    assert registry.latest_version(v).first().id == "d"
    assert [r.id for r in registry.list_active_versions(v).collect()] == ["b", "a"]

    asked = spark.createDataFrame([("c", "d")], "contract_id string, version_id string")
    after = {r.id: r.status for r in registry.activate_version(v, asked).collect()}
    assert after == {"a": t.DEPRECATED, "b": t.DEPRECATED, "d": t.ACTIVE}

    more = versions_frame(spark, [
        version("x", "c", "1.0.0", body), version("y", "c", "3.0.0", body),
        version("z", "c", "3.0.0", body)])
    assert [r.id for r in registry.new_versions(v, more).collect()] == ["y"]
    assert {r.id for r in registry.duplicate_versions(v, more).collect()} == {"x", "z"}
    target = str(tmp_path / "versions")
    assert {r.id for r in registry.insert_version(v, more, target).collect()} == {"x", "z"}
    assert spark.read.parquet(target).count() == 1
    event = spark.createDataFrame([("e", "d", "me", "APPROVED", None)], "id string, "
                                  "contract_version_id string, actor string, action string, "
                                  "comment string").withColumn("created_at", F.current_timestamp())
    for _ in range(2):
        registry.append_approval_event(event, str(tmp_path / "approvals"))
    assert spark.read.parquet(str(tmp_path / "approvals")).count() == 2


def test_snapshots(spark, tmp_path):
    root, schema_ = str(tmp_path / "edges"), t.EDGES
    assert registry.current_snapshot(spark, root, schema_) is None
    for number in range(2):
        df = spark.createDataFrame([(str(number), "x")], schema_)
        registry.publish_snapshot(df, root, number)
    assert registry.current_snapshot(spark, root, schema_).first().src == "1"
    assert registry.current_snapshot(spark, root, schema_, before=1).first().src == "0"
    assert registry.current_snapshot(spark, root, schema_, before=0) is None
    registry.publish_snapshot(spark.createDataFrame([("2", "x")], schema_), root, 2)
    assert registry.snapshot_ids(spark, root) == [1, 2]
    (tmp_path / "edges" / "snapshot_id=3").mkdir()  # left by a failed write
    assert registry.current_snapshot(spark, root, schema_).first().src == "2"
