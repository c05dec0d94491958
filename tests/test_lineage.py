from __future__ import annotations

import json
import random
from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from pactline import types as t
from pactline.operators import lineage, metrics, quality
from pactline.sources.edge_table import EdgeTable
from pactline.sources.messages import read_message_stream
from pactline.sources.registry import read_registry
from pactline.sources.sinks import write_run_events
from pactline.streaming.contracts import contract_stream
from pactline.streaming.lineage import (
    deliver_pending,
    edge_stream,
    lineage_delivery_stream,
    lineage_stream,
    read_lineage_events,
    write_lines,
)

WHEN = datetime(2024, 1, 2, 3, 4, 5)
BAD = "violations"


def message(value, topic="audit", offset=0, headers=(("x-producer-id", b"svc"),)):
    body = value.encode() if isinstance(value, str) else value
    return (None, body, topic, 0, offset, WHEN, [tuple(h) for h in headers])


def consumed(spark, *rows):
    return spark.createDataFrame(list(rows), t.CONSUMED)


def events(spark, *rows):
    found = lineage.lineage_events(consumed(spark, *rows), BAD, "ns").orderBy("offset").collect()
    return [(r, json.loads(r.value)) for r in found]


def test_complete_event(spark):
    (row, event), = events(spark, message('{"id":"abc","amount":{"v":null}}', offset=42))
    assert (row.event_type, event["eventType"]) == (t.COMPLETE, t.COMPLETE)
    assert event["eventTime"] == "2024-01-02T03:04:05.000000+00:00"
    assert event["job"]["name"] == "svc" and event["inputs"] == []
    offset = event["run"]["facets"]["kafkaOffset"]
    assert (offset["topic"], offset["partition"], offset["offset"]) == ("audit", 0, 42)
    output, = event["outputs"]
    assert output["name"] == "audit"
    assert output["facets"]["schema"]["fields"] == [
        {"name": "amount", "type": "object"}, {"name": "amount.v", "type": "null"},
        {"name": "id", "type": "string"}]
    assert output["facets"]["columnLineage"]["fields"]["amount.v"] == {
        "inputFields": [{"namespace": "ns", "dataset": "producer.audit", "field": "amount.v"}],
        "transformationDescription": "direct", "transformationType": "IDENTITY"}


@pytest.mark.parametrize("body", [b"\x00\x01\x02binary", b"\xff\xfe", "[1]", "7", '{"a":1}x', "{}"])
def test_events_without_fields(spark, body):
    (_, event), = events(spark, message(body))
    assert event["outputs"][0]["facets"] == {}


def test_paths_that_collide_are_one_lineage_entry(spark):
    (_, event), = events(spark, message('{"a.b":1,"a":{"b":2}}'))
    facets = event["outputs"][0]["facets"]
    assert [f["name"] for f in facets["schema"]["fields"]] == ["a", "a.b", "a.b"]
    assert set(facets["columnLineage"]["fields"]) == {"a", "a.b"}


def test_five_segments_are_a_limit_when_asked_for(spark):
    body = '{"l1":{"l2":{"l3":{"l4":{"l5":{"l6":1}}}}}}'
    row = lineage.with_metadata(consumed(spark, message(body)), max_segments=5).first()
    assert [f.path for f in row.fields][-1] == "l1.l2.l3.l4.l5" and len(row.fields) == 5
    assert row.top_level_keys == ["l1"] and row.truncated
    whole = lineage.with_metadata(consumed(spark, message(body))).first()
    assert len(whole.fields) == 6 and not whole.truncated


def test_run_ids_repeat(spark):
    first = [r.run_id for r, _ in events(spark, message("{}", offset=1), message("{}", offset=2))]
    again = [r.run_id for r, _ in events(spark, message("{}", offset=1), message("{}", offset=2))]
    assert first == again and len(set(first)) == 2 and len(first[0]) == 36


def test_violations_and_failures(spark):
    rows = [
        message('{"topic":"t","producer_id":"p","violation_type":"TYPE_MISMATCH"}', BAD, 1),
        message("{}", BAD, 2), message("not json", BAD, 3), message("[1]", BAD, 4),
        message(b"\xff", BAD, 5), message(None, BAD, 6), message(None, "audit", 7)]
    got = {r.offset: e for r, e in events(spark, *rows)}
    assert set(got) == {1, 2}
    assert got[1]["eventType"] == t.FAIL
    assert got[1]["run"]["facets"]["errorMessage"]["message"] == "Contract violation: TYPE_MISMATCH"
    assert (got[1]["job"]["name"], got[1]["outputs"][0]["name"]) == ("p", "t")
    assert got[1]["outputs"][0]["facets"] == {} and got[1]["job"]["facets"] == {}
    assert (got[2]["job"]["name"], got[2]["outputs"][0]["name"]) == ("unknown", "unknown")
    traced = lineage.traced_messages(consumed(spark, *rows), BAD, "ns")
    assert {r.offset: r.failure for r in traced.filter("failure is not null").collect()} == {
        4: "AttributeError", 5: "UnicodeDecodeError", 7: "TypeError"}
    assert {r.offset for r in traced.filter("dropped").collect()} == {3, 6}
    single = lineage.parse_violation(consumed(spark, *rows).filter(F.col("topic") == BAD))
    assert {r.offset: r.failure for r in single.collect()} == {
        1: None, 2: None, 4: "AttributeError", 5: "UnicodeDecodeError"}


def test_headers(spark):
    odd = [("k", b""), ("other", b"x"), ("k", b"a\xffb"), ("k", b"later")]
    row = consumed(spark, message("{}", headers=odd)).select(
        lineage.message_header(F.col("headers"), "k"),
        lineage.message_header(F.col("headers"), "none", "unknown")).first()
    assert tuple(row) == ("a�b", "unknown")


def test_upsert(spark):
    edges = spark.createDataFrame(
        [("1", "t", "a", "UNKNOWN", "old", WHEN), ("2", "t", "b", "UNKNOWN", "keep", WHEN)],
        t.REGISTRY["lineage_edges"])
    seen = spark.createDataFrame(
        [("t", "a", "FLINK_JOB", None, datetime(2024, 2, 1), 1),
         ("t", "a", "FLINK_JOB", "x", datetime(2024, 1, 15), 2),
         ("t", "c", "FLINK_JOB", "new", datetime(2024, 2, 1), 1),
         ("t", "b", "FLINK_JOB", "late", datetime(2023, 1, 1), 1)],
        "source_topic string, consumer_name string, consumer_type string, consumer_team string, "
        "seen_at timestamp, seq int")
    rows = {r.consumer_name: r for r in lineage.upsert_edges(edges, seen).collect()}
    assert (rows["a"].id, rows["a"].consumer_team, rows["a"].consumer_type) == (
        "1", None, "FLINK_JOB")
    assert rows["a"].last_seen_at == datetime(2024, 2, 1)
    assert (rows["b"].id, rows["b"].consumer_team) == ("2", "keep")
    assert rows["c"].consumer_team == "new" and len(rows["c"].id) == 36
    stale = lineage.stale_edges(lineage.upsert_edges(edges, seen),
                                F.to_timestamp(F.lit("2024-01-20")))
    assert [r.consumer_name for r in stale.collect()] == ["b"]


def test_topics():
    assert lineage.subscribed_topics(["a", "audit"], "audit", BAD) == ["a", "audit", BAD]


def test_histogram(spark):
    df = spark.createDataFrame([("t", 0.5), ("t", 3.0), ("t", 400.0)], "topic string, ms double")
    rows = metrics.histogram(df, "ms", metrics.VALIDATION_MS, "topic").collect()
    assert {r.le: r.n for r in rows} == {
        "1": 1, "2": 1, "5": 2, "10": 2, "25": 2, "50": 2, "100": 2, "250": 2, "+Inf": 3}
    assert {(r["count"], r["sum"]) for r in rows} == {(3, 403.5)}


def test_quality_rules(spark):
    df = spark.createDataFrame(
        [(0, "USD", "123e4567-e89b-12d3-a456-426614174000"), (5, "XXX", "nope"), (None, None, None)],
        "amount int, currency string, id string")
    rules = {"range": quality.in_range(F.col("amount"), 1, 10),
             "enum": quality.in_enum(F.col("currency"), ["USD"]),
             "present": quality.not_null(F.col("currency")), "uuid": quality.uuid_format(F.col("id"))}
    rows = [r.failed_rules for r in quality.evaluate(df, rules).collect()]
    assert rows == [["range"], ["enum", "uuid"], ["present"]]
    totals = {r.rule: r.failed for r in quality.quality_totals(df, rules).collect()}
    assert totals == {"range": 1, "enum": 1, "present": 1, "uuid": 1}
    one = quality.sampled(spark.range(1000), F.col("id"), 4)
    assert 150 < one.count() < 350
    assert sorted(one.collect()) == sorted(quality.sampled(spark.range(1000), F.col("id"), 4).collect())


def test_missing_approvals(spark):
    required = spark.createDataFrame([("v", "a"), ("v", "b")], "contract_version_id string, team string")
    actions = spark.createDataFrame(
        [("v", "ann", "APPROVED"), ("v", "bob", "REJECTED")],
        "contract_version_id string, actor string, action string")
    teams = spark.createDataFrame([("ann", "a"), ("bob", "b")], "actor string, team string")
    left = quality.missing_approvals(required, actions, teams).collect()
    assert [r.team for r in left] == ["b"]


# --- streams ----------------------------------------------------------------------------------


def put(spark, rows, path, mode="append"):
    consumed(spark, *rows).coalesce(1).write.mode(mode).parquet(path)


def test_lineage_stream_restart_and_replay(spark, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    run = lambda: lineage_stream(
        read_message_stream(spark, ["audit", BAD], path=source, max_per_trigger=1), BAD, out,
        state, namespace="ns").awaitTermination()
    put(spark, [message('{"a":1}', offset=1), message("{}", BAD, 2), message(None, "audit", 3)], source)
    run()
    put(spark, [message('{"a":1}', offset=1), message('{"b":1}', offset=4)], source)  # 1 again
    run()
    assert spark.read.parquet(out).count() == 3  # the repeated offset is not written
    rows = read_lineage_events(spark, out).collect()
    assert sorted((r.topic, r.offset) for r in rows) == [("audit", 1), ("audit", 4), (BAD, 2)]
    batch = lineage.lineage_events(spark.read.schema(t.CONSUMED).parquet(source), BAD, "ns")
    assert {r.run_id for r in rows} == {r.run_id for r in batch.collect()}


def test_late_messages_are_not_lost(spark, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    for number, day in enumerate((3, 2, 9, 1, 5)):
        rows = consumed(spark, *[message("{}", offset=10 * number + i) for i in range(4)])
        rows.withColumn("timestamp", F.lit(datetime(2024, 1, day))).coalesce(1).write.mode(
            "append").parquet(source)
    lineage_stream(
        read_message_stream(spark, ["audit"], path=source, max_per_trigger=1), BAD, out, state,
        namespace="ns").awaitTermination()
    assert read_lineage_events(spark, out).count() == 20


def test_edges_seen_at_the_same_time_do_not_depend_on_order(spark):
    schema = ("source_topic string, consumer_name string, consumer_type string, "
              "consumer_team string, seen_at timestamp")
    rows = [("t", "a", "UNKNOWN", team, datetime(2024, 1, 1)) for team in ("x", "y")]
    none = spark.createDataFrame([], t.REGISTRY["lineage_edges"])
    for seen in (rows, rows[::-1]):
        df = spark.createDataFrame(seen, schema).coalesce(1)
        assert lineage.upsert_edges(none, df).first().consumer_team == "y"


def test_failed_delivery_keeps_the_stream_alive(spark, tmp_path):
    source, out, box, state, log = (
        str(tmp_path / n) for n in ("in", "file/x", "box", "state", "log"))
    put(spark, [message("{}", offset=1)], source)
    (tmp_path / "file").write_text("in the way")
    stream = lineage_delivery_stream(
        read_message_stream(spark, ["audit"], path=source), BAD, out, box, state,
        namespace="ns", log=log)
    stream.awaitTermination()
    assert stream.exception() is None
    assert spark.read.parquet(f"{box}/pending").count() == 1
    (tmp_path / "file").unlink()
    assert deliver_pending(spark, box, out, log=log) == [0]
    assert deliver_pending(spark, box, out, log=log) == []
    assert spark.read.text(out).count() == 1
    tries = spark.read.parquet(log).select("batch_id", "attempt", "delivered", "n").collect()
    assert set(map(tuple, tries)) == {(0, 1, False, 1), (0, 2, True, 1)}
    assert write_run_events(spark.createDataFrame([("{}",)], "value string"), str(tmp_path / "ok"))


def test_failed_batches_are_sent_first_and_once(spark, tmp_path):
    """Three runs, the sink down for the first two; offset 1 comes again in the last."""
    source, out, box, state = (str(tmp_path / n) for n in ("in", "out", "box", "state"))
    sent = []

    def send(events, path):
        sent.append(path[-1])
        if len(sent) < 3:
            raise OSError("down")
        write_lines(events, path)

    for offset in (1, 2, 3):
        put(spark, [message("{}", offset=offset), message("{}", offset=1)], source)
        lineage_delivery_stream(
            read_message_stream(spark, ["audit"], path=source), BAD, out, box, state,
            namespace="ns", send=send).awaitTermination()
    assert sent == ["0", "0", "0", "1", "2"]
    lines = [r.value for r in spark.read.text(out).collect()]
    assert len(lines) == len(set(lines)) == 3


def test_edge_stream(spark, tmp_path):
    source, root, state = (str(tmp_path / n) for n in ("in", "edges", "state"))
    schema = ("source_topic string, consumer_name string, consumer_type string, "
              "consumer_team string, seen_at timestamp")
    run = lambda: edge_stream(
        spark.readStream.schema(schema).parquet(source), root, state).awaitTermination()
    for day, team in ((1, "one"), (2, None)):
        spark.createDataFrame([("t", "a", "UNKNOWN", team, datetime(2024, 1, day))], schema
                              ).write.mode("append").parquet(source)
        run()
    table = EdgeTable(spark, root).read()
    assert [(r.consumer_name, r.consumer_team) for r in table.collect()] == [("a", None)]


SEEN = ("source_topic string, consumer_name string, consumer_type string, consumer_team string, "
        "seen_at timestamp, seq long")


def files_of(root):
    return {str(p) for p in root.rglob("*.parquet")}


def test_a_batch_writes_only_the_buckets_of_its_edges(spark, tmp_path):
    table = EdgeTable(spark, str(tmp_path), buckets=4, merge_after=2)
    known = spark.createDataFrame(
        [(f"id{i}", "t", f"c{i}", "UNKNOWN", "old", WHEN) for i in range(40)], t.REGISTRY["lineage_edges"])
    table.load(known)
    base, reader = files_of(tmp_path), table.read()
    see = lambda name, team, day, seq=0: spark.createDataFrame(
        [("t", name, "FLINK_JOB", team, datetime(2025, 1, day), seq)], SEEN)
    for number in range(3):
        before = files_of(tmp_path)
        table.append(see("c7", f"team{number}", number + 1), number)
        assert len(files_of(tmp_path) - before) == 1 and before <= files_of(tmp_path)
        table.append(see("c7", "repeated batch", 20), number)  # this number is there already
        if number < 1:
            assert table.compact() == []
    changed = table.compact()
    assert len(changed) == 1 and base <= files_of(tmp_path)
    assert len(reader.filter("consumer_team = 'old'").collect()) == 40  # began with the first base
    reader = table.read()
    rows = {r.consumer_name: r for r in reader.collect()}
    assert len(rows) == 40 and (rows["c7"].id, rows["c7"].consumer_team) == ("id7", "team2")
    assert {r.consumer_team for r in rows.values()} == {"old", "team2"}
    table.append(see("c7", "late", 2), 3)  # older than what is known
    table.append(see("c7", "first", 9, 1), 4)
    table.append(see("c7", "same time, earlier", 9, 0), 5)
    assert table.compact() == changed
    table.expire()
    assert {r.consumer_team for r in table.read().collect()} == {"old", "first"}
    assert {r.consumer_team for r in reader.collect()} == {"old", "team2"}  # the last but one base
    assert not base <= files_of(tmp_path)


def test_unfinished_changes_are_not_read(spark, tmp_path):
    table = EdgeTable(spark, str(tmp_path), buckets=2)
    assert table.read().count() == 0
    seen = spark.createDataFrame([("t", "a", "UNKNOWN", None, WHEN, 0)], SEEN)
    table.append(seen, 0)
    (mark,) = tmp_path.rglob("_DONE")
    mark.unlink()
    assert table.read().count() == 0
    table.append(seen, 0)
    assert table.read().count() == 1
    with pytest.raises(ValueError, match="buckets"):
        EdgeTable(spark, str(tmp_path), buckets=3).read()


def test_merge_on_read_equals_upserts(spark, tmp_path):
    rng = random.Random(2)
    table = EdgeTable(spark, str(tmp_path), buckets=4, merge_after=2)
    none, everything = spark.createDataFrame([], t.REGISTRY["lineage_edges"]), []
    for number in range(5):
        rows = [("t", f"c{rng.randrange(12)}", rng.choice(["UNKNOWN", "FLINK_JOB"]), rng.choice([None, "x", "y"]),
                 datetime(2024, 1, rng.randint(1, 28)), rng.randrange(1000)) for _ in range(15)]
        everything += rows
        table.append(spark.createDataFrame(rows, SEEN), number)
        table.compact()
        table.expire()
    expected = lineage.upsert_edges(none, spark.createDataFrame(everything, SEEN))
    by_name = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert by_name(table.read()) == by_name(expected)


def test_only_finished_batches_of_a_lineage_stream_are_read(spark, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    run = lambda: lineage_stream(
        read_message_stream(spark, ["audit"], path=source, max_per_trigger=1), BAD, out,
        state, namespace="ns").awaitTermination()
    put(spark, [message("{}", offset=o) for o in (1, 2, 40_000, 1)], source)
    run()
    put(spark, [message("{}", offset=o) for o in (2, 3, 32_768, 40_000, 39_999)], source)
    run()
    offsets = lambda: sorted(r.offset for r in read_lineage_events(spark, out).collect())
    assert offsets() == [1, 2, 3, 32_768, 39_999, 40_000]
    assert "Aggregate" not in read_lineage_events(spark, out)._jdf.queryExecution().toString()
    (tmp_path / "out" / "batch_id=1" / "_DONE").unlink()
    assert offsets() == [1, 2, 40_000]


def test_contract_stream_reads_new_contracts(spark, tmp_path):
    from pactline.functions.masks import token_keys

    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    rules: list = []
    contract = lambda: spark.createDataFrame([("c", "n", "t", "1", rules, False)], t.ENFORCEMENT)
    run = lambda: contract_stream(
        spark.readStream.schema(t.MESSAGES).parquet(source), contract,
        lambda: token_keys(spark, {"default": "k"}), out, state).awaitTermination()
    for path in ("a", "b"):
        spark.createDataFrame([("t", "c", "1", "p", path, '{"x":1}')], t.MESSAGES
                              ).write.mode("append").parquet(source)
        run()
        rules.append(("y", True, "", ""))
    rows = {r.key: r.outcome for r in spark.read.parquet(out).collect()}
    assert rows == {"a": "ACCEPTED", "b": "REJECTED"}


def test_registry_reader(spark, tmp_path):
    for name, schema in t.REGISTRY.items():
        spark.createDataFrame([], schema).write.parquet(str(tmp_path / name))
    tables = read_registry(spark, str(tmp_path))
    assert set(tables) == set(t.REGISTRY)
    assert tables["contract_versions"].schema["registry_id"].dataType.typeName() == "integer"


def test_events_of_repeated_offsets_are_stored_once(spark, tmp_path):
    """The outbox is the only place where a batch's events are written before they are sent."""
    from pactline.session import scratch_path

    source, out, box, state = (str(tmp_path / n) for n in ("in", "out", "box", "state"))
    scratch = Path(scratch_path(spark, "x")).parent
    stored = lambda: {p.name for p in scratch.glob("events-*")}
    before = stored()
    put(spark, [message('{"a":1}', offset=1), message('{"a":1}', offset=1), message("{}", BAD, 2),
                message("{}", offset=3), message(None, "audit", 4), message("{}", "audit", 4)], source)
    lineage_delivery_stream(
        read_message_stream(spark, ["audit", BAD], path=source), BAD, out, box, state, namespace="ns"
    ).awaitTermination()
    assert stored() == before
    runs = [r[0] for r in spark.read.text(out).select(F.get_json_object("value", "$.run.runId")).collect()]
    assert len(runs) == len(set(runs)) == 4


def test_delivered_lines_take_less_room_than_their_text(spark, tmp_path):
    rows = consumed(spark, *[message('{"a":{"b":1,"c":[1]}}', offset=i) for i in range(300)])
    events = lineage.lineage_events(rows.coalesce(1), BAD, "ns")
    write_lines(events, str(tmp_path / "out"))
    text = [r.value for r in events.collect()]
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "out")).collect()) == sorted(text)
    stored = sum(p.stat().st_size for p in (tmp_path / "out").glob("part-*"))
    assert 0 < 4 * stored < sum(map(len, text))
