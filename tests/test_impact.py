from __future__ import annotations

import json
import random
from collections import deque

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pactline import types as t
from pactline.functions.text import classify_dataset
from pactline.operators import impact, joins, quality
from pactline.plans import blast_radius as plan_module
from pactline.plans.blast_radius import blast_radius, scored_consumers
from pactline.sources.graph import lineage_graph_from_json, malformed_documents

READINGS, MEANS = "dataset:demo:sensor.readings", "dataset:demo:iceberg.daily_means"
ARCHIVE = "dataset:demo:iceberg.archive"
CLEANER, ALERTS, MAP, GHOST = (f"job:demo:{n}" for n in ("cleaner", "alerts", "map", "ghost"))


def node(id_, kind, owner, fields):
    return (id_, kind, id_.split(":", 2)[2], "demo", None, owner, fields)


@pytest.fixture
def graph(spark):
    """Two routes to the map, a cycle back from it, and an endpoint that no node describes."""
    nodes = spark.createDataFrame([
        node(READINGS, t.DATASET, "grid", ["sensor", "celsius", "taken_at"]),
        node(CLEANER, t.JOB, "weather", ["sensor", "celsius"]),
        node(ALERTS, t.JOB, "safety", ["celsius"]),
        node(MEANS, t.DATASET, "climate", ["sensor"]),
        node(ARCHIVE, t.DATASET, "safety", ["level"]),
        node(MAP, t.JOB, "safety", ["colour"])], t.NODES)
    edges = spark.createDataFrame(
        [(READINGS, CLEANER), (READINGS, ALERTS), (CLEANER, MEANS), (MEANS, MAP), (ALERTS, MAP),
         (MAP, CLEANER), (CLEANER, GHOST), (ALERTS, ARCHIVE)], t.EDGES)
    return nodes, edges


def sources(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "source string")


def walk(edges, source, limit):
    """Plain breadth-first search, smallest path at the smallest depth."""
    out: dict[str, list[str]] = {source: [source]}
    queue = deque([source])
    while queue:
        level, queue_next = {}, deque()
        for current in queue:
            if len(out[current]) > limit:
                continue
            for a, b in edges:
                if a == current and b not in out:
                    path = [*out[current], b]
                    level[b] = min(level.get(b, path), path)
        for n, path in level.items():
            out[n] = path
            queue_next.append(n)
        queue = queue_next
    return {n: p for n, p in out.items() if n != source}


def reached(df):
    got = {}
    for r in df.collect():
        assert r.depth == len(r.path) - 1
        got.setdefault(r.source, {})[r.node] = r.path
    return got


def test_fixture_graph(spark, graph):
    got = reached(impact.reachable(graph[1], sources(spark, READINGS)))[READINGS]
    assert {n: len(p) - 1 for n, p in got.items()} == {
        CLEANER: 1, ALERTS: 1, MEANS: 2, MAP: 2, GHOST: 2, ARCHIVE: 2}
    assert got[MAP] == [READINGS, ALERTS, MAP]
    near = reached(impact.reachable(graph[1], sources(spark, READINGS), max_depth=1))[READINGS]
    assert set(near) == {CLEANER, ALERTS}
    assert reached(impact.reachable(graph[1], sources(spark, "nowhere"))) == {}


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.too_slow])
@given(st.lists(st.tuples(st.sampled_from("abcdefgh"), st.sampled_from("abcdefgh")), min_size=4,
                max_size=20))
def test_against_plain_search(spark, pairs):
    df = spark.createDataFrame(pairs, t.EDGES)
    got = reached(impact.reachable(df, sources(spark, "a", "b"), max_depth=3))
    for start in "ab":
        assert got.get(start, {}) == walk(pairs, start, 3)


def test_shuffled_hops_give_the_same_result(spark, graph, monkeypatch):
    pairs = [("a", "b"), ("b", "a"), ("b", "c"), ("c", "c"), ("a", "c"), ("c", "d")]
    monkeypatch.setattr(impact, "BROADCAST_ROWS", 0)
    df = spark.createDataFrame(pairs, t.EDGES)
    assert reached(impact.reachable(df, sources(spark, "a")))["a"] == walk(pairs, "a", 5)


def hop_plan(walked):
    return walked._next_hop()._jdf.queryExecution().toString()


@pytest.mark.parametrize("rows", [0, 2_000_000])
def test_hops_carry_numbers_and_hash(spark, graph, monkeypatch, rows):
    """No array of names goes through a hop, and no aggregation of it sorts."""
    monkeypatch.setattr(impact, "BROADCAST_ROWS", rows)
    for paths in (False, True):
        plan = hop_plan(impact.walk(graph[1], sources(spark, READINGS), 1, paths))
        assert "SortAggregate" not in plan and "HashAggregate" in plan
        assert "array" not in plan.lower().replace("arraybuffer", "") and "concat(" not in plan
        assert ("BroadcastExchange" in plan) >= (rows > 0)


def test_a_walk_says_when_it_was_cut(spark, graph):
    def cut(limit, *ids):
        found = impact.walk(graph[1], sources(spark, *ids), limit).truncated().collect()
        return {r.source: r.truncated for r in found}

    assert cut(1, READINGS, ARCHIVE, "nowhere") == {READINGS: True, ARCHIVE: False, "nowhere": False}
    assert cut(2, READINGS, CLEANER) == {READINGS: False, CLEANER: False}  # only a cycle goes on
    assert cut(0, READINGS) == {READINGS: True}
    assert cut(9, READINGS) == {READINGS: False}
    short = blast_radius(requests(spark, ("1", "sensor.readings", ["sensor"]), ("2", "nope", ["x"])),
                         *graph, "demo", max_depth=1).reports
    assert {r.change_id: r.truncated for r in short.collect()} == {"1": True, "2": False}


def test_nodes_of_a_walk_are_those_of_its_paths(spark, graph):
    with_paths = impact.walk(graph[1], sources(spark, READINGS, MEANS), paths=True)
    plain = impact.walk(graph[1], sources(spark, READINGS, MEANS))
    rows = lambda df: sorted(map(tuple, df.select("source", "node", "depth").collect()))
    assert rows(plain.nodes()) == rows(with_paths.nodes()) == rows(with_paths.paths())
    with pytest.raises(ValueError):
        plain.paths()


def test_long_chains_and_smallest_paths(spark):
    """A path is the smallest as a whole, not step by step from its end."""
    pairs = [("s", "x"), ("s", "y"), ("x", "z2"), ("y", "a1"), ("z2", "t"), ("a1", "t"), ("t", "u")]
    pairs += [(f"c{i:02}", f"c{i + 1:02}") for i in range(12)]
    df = spark.createDataFrame(pairs, t.EDGES)
    got = reached(impact.reachable(df, sources(spark, "s", "c00"), max_depth=20))
    assert got["s"] == walk(pairs, "s", 20) and got["s"]["u"] == ["s", "x", "z2", "t", "u"]
    assert got["c00"] == walk(pairs, "c00", 20)


def test_source_lookup(spark, graph):
    asked = spark.createDataFrame(
        [("1", "sensor.readings"), ("2", "cleaner"), ("3", "unknown.topic")],
        "change_id string, topic string")
    found = {r.change_id: r.source
             for r in impact.find_source_node(graph[0], asked, "demo").collect()}
    assert found == {"1": READINGS, "2": CLEANER, "3": None}


@pytest.mark.parametrize("fields, depth, level, hit", [
    (["a", "amount"], 1, t.CRITICAL, ["amount"]), (["amount"], 4, t.CRITICAL, ["amount"]),
    (["a"], 1, t.HIGH, []), (["a"], 3, t.NONE, []), ([], 1, t.MEDIUM, []), ([], 3, t.NONE, []),
    (None, 1, t.MEDIUM, [])])
def test_score(spark, fields, depth, level, hit):
    df = spark.createDataFrame(
        [(fields, depth, ["amount", "x"])],
        "fields array<string>, depth int, changed_fields array<string>")
    row = impact.score(df).first()
    assert (row.impact, row.affected_fields, row.is_direct) == (level, hit, depth == 1)


def test_worst_of_nothing(spark):
    empty = spark.createDataFrame([], "impact string")
    assert empty.agg(impact.worst_impact(F.col("impact"))).first()[0] == t.NONE


def requests(spark, *rows):
    return spark.createDataFrame(
        list(rows), "change_id string, topic string, changed_fields array<string>")


def test_report(spark, graph):
    result = blast_radius(
        requests(spark, ("1", "sensor.readings", ["sensor"]),
                 ("2", "nope", ["x"]), ("3", "sensor.readings", ["other"])),
        *graph, "demo")
    rows = {r.change_id: r for r in result.reports.collect()}
    assert rows["1"].summary == (
        "Changing sensor in sensor.readings affects 3 downstream consumer(s). "
        "2 CRITICAL: cleaner, iceberg.daily_means will break. "
        "1 HIGH impact consumer(s) require notification. "
        "2 consumer(s) read this topic directly.")
    assert rows["1"].required_approvals == ["climate", "safety", "weather"]
    assert rows["2"].error == "Topic 'nope' not found in lineage graph"
    assert rows["2"].summary is None and rows["2"].worst_impact == t.NONE
    assert rows["3"].worst_impact == t.HIGH
    ordered = impact.sort_consumers(result.consumers.filter("change_id = '1'"))
    assert [r.name for r in ordered.collect()] == [
        "cleaner", "iceberg.daily_means", "alerts"]
    buckets = {(r.bucket, r.n) for r in impact.bucket_consumers(
        result.consumers.filter("change_id = '1'")).collect()}
    assert buckets == {("CRITICAL", 2), ("HIGH", 1)}


def test_no_impact_and_no_lineage(spark, graph):
    nodes, edges = graph
    quiet = blast_radius(requests(spark, ("1", "iceberg.archive", ["x"])), *graph, "demo")
    assert quiet.reports.first().summary == (
        "No downstream consumers are impacted by changes to x in iceberg.archive.")
    bare = blast_radius(requests(spark, ("1", "p", ["x"])), nodes.limit(0), edges.limit(0), "demo")
    row = bare.reports.first()
    assert row.summary == ("No lineage found for topic p. This may indicate the topic has no "
                           "recorded consumers yet.")
    assert row.error is None and row.total_consumers_affected == 0


def test_four_critical_names_are_shortened(spark):
    ids = [f"job:demo:j{i}" for i in range(5)]
    nodes = spark.createDataFrame(
        [node("dataset:demo:t", t.DATASET, None, []),
         *[node(i, t.JOB, "team", ["f"]) for i in ids]], t.NODES)
    edges = spark.createDataFrame([("dataset:demo:t", i) for i in ids], t.EDGES)
    summary = blast_radius(requests(spark, ("1", "t", ["f"])), nodes, edges, "demo"
                           ).reports.first().summary
    assert "5 CRITICAL: j0, j1, j2 and 2 more will break." in summary


def test_graph_documents(spark):
    text = json.dumps({"graph": [
        {"id": "d1", "type": "DATASET", "data": {"name": "db.t", "facets": {
            "schema": {"fields": [{"name": "a"}, {"name": ""}, {"name": "b"}]},
            "ownership": {"owners": []}}},
         "inEdges": [{"origin": "j0"}], "outEdges": [{"destination": "j1"}]},
        {"id": "j1", "type": "JOB", "data": {"facets": {"ownership": {"owners": [
            {"name": "team"}, {"name": "other"}]}}}, "inEdges": [{"origin": "d1"}]},
        {"id": "x", "type": "OTHER", "outEdges": [{"destination": "d1"}]}]})
    nodes, edges = lineage_graph_from_json(spark.createDataFrame([(text,)], "value string"), "ns")
    found = {r.id: (r.node_type, r.name, r.owner_team, r.fields) for r in nodes.collect()}
    assert found == {
        "d1": (t.DATASET, "db.t", None, ["a", "b"]), "j1": (t.JOB, "j1", "team", []),
        "j0": (t.DATASET, "j0", None, []), "x": (t.DATASET, "x", None, [])}
    assert {tuple(e) for e in edges.collect()} == {("j0", "d1"), ("d1", "j1"), ("x", "d1")}


def test_documents_that_cannot_be_read_are_listed(spark):
    good = '{"graph":[{"id":"a","type":"JOB"}]}'
    typed = '{"graph":[{"id":"a","type":"JOB","data":{"facets":"none"}}]}'
    df = spark.createDataFrame([(good,), (good[:20],), (None,), ("{}",), (typed,)], "value string")
    found = {r.value: r.error for r in malformed_documents(df).collect()}
    assert found == {good[:20]: "not a lineage document", None: "no document", "{}": "no graph",
                     typed: "not a lineage document"}


@pytest.mark.parametrize("name, kind", [
    ("sensor.readings", t.KAFKA_TOPIC), ("db.x", t.UNKNOWN), ("db.x_table", t.ICEBERG_TABLE),
    ("iceberg.x", t.ICEBERG_TABLE), ("orders_table", t.ICEBERG_TABLE), ("plain", t.UNKNOWN)])
def test_dataset_types(spark, name, kind):
    df = spark.createDataFrame([(name,)], "n string")
    assert df.select(classify_dataset(F.col("n"))).first()[0] == kind


def test_declared_consumers_join_the_graph(spark, graph):
    nodes, edges = graph
    declared = spark.createDataFrame(
        [("sensor.readings", [("nightly", "data", t.ICEBERG_TABLE, ["celsius"]),
                              ("audit", "grid", "FLINK_JOB", ["taken_at"])]),
         ("other", [("nightly", "data", t.ICEBERG_TABLE, ["id"])])],
        "topic string, consumers array<struct<name:string,team:string,type:string,"
        "fields_used:array<string>>>")
    more_nodes, more_edges = quality.declared_consumers(declared, "demo")
    known = {r.id: r.fields for r in more_nodes.collect()}
    assert known == {"dataset:demo:nightly": ["celsius", "id"], "job:demo:audit": ["taken_at"]}
    result = blast_radius(
        requests(spark, ("1", "sensor.readings", ["celsius"])),
        nodes.unionByName(more_nodes), edges.unionByName(more_edges), "demo")
    assert {r.name: r.impact for r in result.consumers.collect()} == {
        "nightly": t.CRITICAL, "cleaner": t.CRITICAL, "alerts": t.CRITICAL, "audit": t.HIGH}


def test_broadcast_limits(spark):
    df = spark.range(10)
    assert joins.fits_broadcast(df)
    assert not joins.fits_broadcast(df, max_rows=9)
    assert not joins.fits_broadcast(df, max_bytes=10)


def test_declared_consumers_join_the_graph(spark):
    nodes = spark.createDataFrame(
        [node("dataset:demo:t", t.DATASET, None, []), node("job:demo:known", t.JOB, "", ["a"]),
         node("job:demo:other", t.JOB, "ops", [])], t.NODES)
    edges = spark.createDataFrame(
        [("dataset:demo:t", "job:demo:known"), ("job:demo:known", "job:demo:other")], t.EDGES)
    contracts = spark.createDataFrame(
        [("t", [("known", "crew", "FLINK_JOB", ["b", "a"]), ("new", "lab", "FLINK_JOB", ["b"])]),
         ("u", [])],
        "topic string, consumers array<struct<name string, team string, type string, "
        "fields_used array<string>>>")
    all_nodes, all_edges = impact.merged_graph(
        nodes, edges, *quality.declared_consumers(contracts, "demo"))
    assert {(r.id, r.owner_team, tuple(r.fields), r.provenance) for r in all_nodes.collect()} == {
        ("dataset:demo:t", None, (), "observed"), ("job:demo:known", "crew", ("a", "b"), "both"),
        ("job:demo:other", "ops", (), "observed"), ("job:demo:new", "lab", ("b",), "declared")}
    assert {tuple(r) for r in all_edges.collect()} == {
        ("dataset:demo:t", "job:demo:known", "both"),
        ("job:demo:known", "job:demo:other", "observed"),
        ("dataset:demo:t", "job:demo:new", "declared")}
    found = blast_radius(requests(spark, ("1", "t", ["b"])), all_nodes, all_edges, "demo")
    assert {(r.name, r.impact) for r in found.consumers.collect()} == {
        ("known", t.CRITICAL), ("new", t.CRITICAL)}


def test_an_empty_graph_is_told_per_request(spark, graph):
    asked = requests(spark, ("1", "sensor.readings", ["sensor"]), ("2", "nope", ["x"]),
                     ("3", "sensor.readings", ["sensor"]), ("4", "nope", ["x"]))
    asked = asked.withColumn("namespace", F.when(F.col("change_id") < "3", "demo").when(
        F.col("change_id") == "3", "elsewhere"))
    rows = {r.change_id: r for r in blast_radius(asked, *graph, "demo").reports.collect()}
    assert rows["1"].total_consumers_affected == 3 and rows["1"].error is None
    assert rows["2"].error == "Topic 'nope' not found in lineage graph"
    for change in ("3", "4"):
        assert rows[change].summary.startswith("No lineage found for topic")
        assert rows[change].error is None and rows[change].total_consumers_affected == 0


@pytest.mark.parametrize("rows", [0, 2_000_000])
def test_only_nodes_with_edges_are_followed(spark, monkeypatch, rows):
    """Ends of the graph go into no hop and no sort; levels lie in buckets, so no hop moves them."""
    monkeypatch.setattr(impact, "BROADCAST_ROWS", rows)
    pairs = [("a", "b"), *(("a", f"end{i}") for i in range(50)), ("b", "c"), ("c", "last")]
    df = spark.createDataFrame(pairs, t.EDGES)
    walked = impact.walk(df, sources(spark, "a"), 5, paths=True)
    assert [{r.node for r in front.collect()} for front in walked.fronts[1:]] == [{"b"}, {"c"}, set()]
    assert reached(walked.paths())["a"] == walk(pairs, "a", 5)
    assert all("bucketed: true" in level.groupBy("source", "node").count()._jdf.queryExecution().toString().lower()
               for level in walked.levels[1:])


def random_graph(spark, n=400):
    """Layers of nodes with edges onward, back and to ends; some ends are near and far at once."""
    rng = random.Random(5)
    pairs = [(f"n{i}", f"n{rng.randrange(n)}") for i in range(n) for _ in range(2)]
    pairs += [(f"n{rng.randrange(n)}", f"end{rng.randrange(3 * n)}") for _ in range(6 * n)]
    return pairs, spark.createDataFrame(pairs, t.EDGES)


@pytest.mark.parametrize("rows", [0, 2_000_000])
def test_ends_go_into_no_hop(spark, monkeypatch, rows):
    """Hops hold nodes with edges alone (or nearly so, by bits); ends are reached in one step from all
    levels, with the smallest path of the smallest depth."""
    monkeypatch.setattr(impact, "BROADCAST_ROWS", rows)
    pairs, df = random_graph(spark)
    walked = impact.walk(df, sources(spark, "n1", "n2", "n3"), 4, paths=True)
    got = reached(walked.paths())
    plain = impact.walk(df, sources(spark, "n1", "n2", "n3"), 4)
    depths = {(r.source, r.node): r.depth for r in plain.nodes().collect()}
    for start in ("n1", "n2", "n3"):
        assert got[start] == walk(pairs, start, 4)
        assert {n: depths[start, n] for n in got[start]} == {n: len(p) - 1 for n, p in got[start].items()}
    assert len(depths) == sum(map(len, got.values()))
    for w in (walked, plain):
        held = [r.node for level in w.levels for r in level.collect()]
        ends = [n for n in held if n.startswith("end")]
        assert held and len(ends) <= len(held) * (0 if rows else 0.1)
    assert walked.inner.count() + walked.outer.count() == len(pairs)
    cut_walks = impact.walk(df, sources(spark, "n1", "n2", "n3"), 2).truncated().collect()
    assert {r.source: r.truncated for r in cut_walks} == {
        s: len(walk(pairs, s, 3)) > len(walk(pairs, s, 2)) for s in ("n1", "n2", "n3")}


def test_only_impacted_consumers_are_stored(spark, graph, monkeypatch):
    """Consumers without impact are not written for the report, and a change takes no shuffle by source."""
    result = blast_radius(requests(spark, ("1", "sensor.readings", ["sensor"])), *graph, "demo")
    plan = result.consumers._jdf.queryExecution().toString()
    assert "Filter" not in plan.split("Optimized Logical Plan")[1].split("Physical Plan")[0]
    assert {r.impact for r in result.consumers.collect()} <= {t.CRITICAL, t.HIGH, t.MEDIUM}


def test_what_no_change_touches_is_left_before_it_meets_the_changes(spark):
    df = spark.createDataFrame(
        [(f, d, c) for f in (None, [], ["a"], ["a", "b"]) for d in (1, 2, 5) for c in ([], ["a"], ["x"])],
        "fields array<string>, depth int, changed_fields array<string>")
    kept = impact.may_be_impacted(F.col("fields"), F.col("depth"))
    rows = impact.score(df).select("impact", kept.alias("kept")).collect()
    assert all(r.kept for r in rows if r.impact != t.NONE) and not all(r.kept for r in rows)


@pytest.mark.parametrize("few", [0, 2_000_000])
def test_changes_meet_rows_by_number(spark, graph, monkeypatch, few):
    """Reached rows lie by node when they get their attributes and move once at most after that."""
    monkeypatch.setattr(impact, "BROADCAST_ROWS", few)
    monkeypatch.setattr(plan_module, "BROADCAST_ROWS", few)
    asked = impact.find_source_node(graph[0], requests(
        spark, ("1", "sensor.readings", ["sensor"]), ("2", "cleaner", ["colour"])), "demo")
    scored = scored_consumers(asked, *graph)
    plan = scored._jdf.queryExecution().sparkPlan().toString()
    assert any("Join" in x and "__walk" in x for x in plan.splitlines())
    assert {(r.change_id, r.name, r.impact, r.source) for r in impact.affected(scored).collect()} == {
        ("1", "cleaner", t.CRITICAL, READINGS), ("1", "alerts", t.HIGH, READINGS),
        ("1", "iceberg.daily_means", t.CRITICAL, READINGS), ("2", "iceberg.daily_means", t.HIGH, CLEANER),
        ("2", "map", t.CRITICAL, CLEANER), ("2", GHOST, t.MEDIUM, CLEANER)}


def test_sources_are_looked_up_once(spark, graph):
    """Scoring reads the stored requests, not the lookup of their sources a second time."""
    asked = impact.find_source_node(
        graph[0], requests(spark, ("1", "sensor.readings", ["sensor"])), "demo")
    scored = scored_consumers(asked, *graph)
    assert "struct(o" not in scored._jdf.queryExecution().toString()
    assert {r.name for r in impact.affected(scored).collect()} == {"cleaner", "alerts", "iceberg.daily_means"}


def test_a_merged_graph_is_computed_once(spark, graph):
    """Nodes and edges of both sides meet in one join each, and what reads them reads files."""
    nodes, edges = graph
    declared = spark.createDataFrame(
        [("sensor.readings", [("alerts", "ops", "FLINK_JOB", ["taken_at"]), (None, "x", "FLINK_JOB", ["y"])]),
         ("sensor.readings", [("cleaner", None, "FLINK_JOB", None)])],
        "topic string, consumers array<struct<name:string,team:string,type:string,"
        "fields_used:array<string>>>")
    again = edges.unionByName(edges.filter((F.col("src") == READINGS) & (F.col("dst") == CLEANER)))
    all_nodes, all_edges = impact.merged_graph(
        nodes, again, *quality.declared_consumers(declared, "demo"))
    for merged in (all_nodes, all_edges):
        assert "Join" not in merged._jdf.queryExecution().toString()
    found = {r.id: (r.owner_team, r.fields, r.provenance) for r in all_nodes.collect()}
    assert found[ALERTS] == ("safety", ["celsius", "taken_at"], "both")
    assert found[CLEANER] == ("weather", ["celsius", "sensor"], "both")
    assert found[MEANS] == ("climate", ["sensor"], "observed")
    assert found[None] == ("x", ["y"], "declared") and len(found) == 7
    kinds = sorted(r.provenance for r in all_edges.collect())  # a repeated edge stays as it is
    assert kinds == ["both"] * 3 + ["declared"] + ["observed"] * 6
