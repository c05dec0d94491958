from __future__ import annotations

import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pactline.functions import documents as d

_keys = st.text(st.sampled_from("ab.'\"é{ "), max_size=3)
_leaf = st.one_of(st.none(), st.booleans(), st.integers(-5, 5), st.text(max_size=4), st.just(1.5))
_docs = st.dictionaries(
    _keys,
    st.recursive(
        _leaf,
        lambda inner: st.one_of(st.lists(inner, max_size=2),
                                st.dictionaries(_keys, inner, max_size=3)),
        max_leaves=8),
    max_size=4)


def kind(value) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, (int, float)):
        return "number"
    return {str: "string", list: "array", dict: "object"}[type(value)]


def walk(doc: dict, prefix: str = "", at: int = 1, limit: int | None = None):
    for key, value in doc.items():
        path = f"{prefix}.{key}" if at > 1 else key
        yield path, value
        if isinstance(value, dict) and (limit is None or at < limit):
            yield from walk(value, path, at + 1, limit)


def get(doc, path: str):
    """(value, present)"""
    node = doc
    for step in path.split("."):
        if not isinstance(node, dict) or step not in node:
            return None, False
        node = node[step]
    return node, True


def frame(spark, rows):
    df = spark.createDataFrame(rows, "text string, path string")
    return d.with_document(df, "text", "doc")


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.too_slow])
@given(st.lists(_docs, min_size=20, max_size=30))
def test_paths_against_plain_python(spark, docs):
    rows = [(json.dumps(doc), ".") for doc in docs]
    df = frame(spark, rows).select(
        d.object_paths(F.col("doc"), F.col("text")).alias("paths"),
        d.extract_fields(F.col("doc"), F.col("text"), 2).alias("fields"),
        F.coalesce(d.object_listing(F.col("doc"), F.col("text"), 2)["cut"], F.lit(False)).alias("cut"))
    for doc, row in zip(docs, df.collect()):
        assert row.paths == sorted(p for p, _ in walk(doc))
        expected = sorted((p, kind(v), v is None, True) for p, v in walk(doc, limit=2))
        assert sorted(map(tuple, row.fields)) == expected
        assert row.cut == (len(list(walk(doc))) > len(list(walk(doc, limit=2))))


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.too_slow])
@given(st.lists(st.tuples(_docs, st.text(st.sampled_from("ab.'\"é"), max_size=5)),
                min_size=20, max_size=30))
def test_path_get_against_plain_python(spark, cases):
    wanted = [(doc, path) for doc, p in cases for path in [p, *[x for x, _ in walk(doc)]]]
    df = frame(spark, [(json.dumps(doc), path) for doc, path in wanted])
    node = d.path_get(F.col("doc"), F.col("path"))
    got = df.select(F.to_json(node).alias("json"), node.isNotNull().alias("present"),
                    d.json_kind(node).alias("kind")).collect()
    for (doc, path), row in zip(wanted, got):
        value, present = get(doc, path)
        assert row.present == present
        assert row.kind == (kind(value) if present else None)
        if present:
            assert json.loads(row.json) == value


def put(doc: dict, path: str, value) -> None:
    *parents, last = path.split(".")
    for step in parents:
        doc = doc[step]
    doc[last] = value


@pytest.mark.parametrize("change", [d.path_set, d.path_replace])
def test_set_at_every_depth(spark, change):
    doc = {"a": {"b": {"c": {"d": {"e": 1, "f": None}}}, "x": [1]}, "y": 2}
    paths = ["y", "a", "a.b", "a.b.c", "a.b.c.d", "a.b.c.d.e", "a.x"]
    df = frame(spark, [(json.dumps(doc), p) for p in paths])
    out = change(F.col("doc"), F.col("path"), F.lit("new").cast("variant"))
    for path, row in zip(paths, df.select(F.to_json(out)).collect()):
        expected = json.loads(json.dumps(doc))
        put(expected, path, "new")
        assert json.loads(row[0]) == expected


def test_set_below_a_scalar_is_null(spark):
    out = d.path_set(F.col("doc"), F.col("path"), F.lit("new").cast("variant"))
    assert frame(spark, [('{"a":1}', "a.b")]).select(F.to_json(out)).first()[0] is None


def test_depth_is_not_limited(spark):
    doc: dict = {"leaf": 1}
    for _ in range(40):
        doc = {"n": doc}
    df = frame(spark, [(json.dumps(doc), "")])
    paths = df.select(d.object_paths(F.col("doc"), F.col("text"))).first()[0]
    assert len(paths) == 41 and max(p.count(".") for p in paths) == 40


def test_big_numbers_keep_their_digits(spark):
    text = '{"a":12345678901234567890123}'
    assert frame(spark, [(text, "")]).select(F.to_json("doc")).first()[0] == text


def test_top_level_keys_and_canonical_text(spark):
    df = frame(spark, [('{"id":"x", "amount" : 50}', ""), ("[1]", ""), ("{x", "")])
    rows = df.select(d.top_level_keys(F.col("text")).alias("k"),
                     d.canonical_json(F.col("doc")).alias("c")).collect()
    assert rows[0].k == ["id", "amount"] and rows[0].c == '{"amount":50,"id":"x"}'
    assert rows[1].c is None and rows[2].k is None


def test_kinds_of_typed_values(spark):
    row = spark.range(1).select(*(
        d.json_kind(F.expr(f"variant_get(to_variant_object(named_struct('x', {value})), '$.x', 'variant')")).alias(name)
        for name, value in (("day", "DATE'2024-01-01'"), ("time", "TIMESTAMP'2024-01-01 00:00:00'"),
                            ("bytes", "X'00'"), ("decimal", "1.5BD"), ("double", "1.5D")))).first()
    assert row.asDict() == {"day": "string", "time": "string", "bytes": "string",
                            "decimal": "number", "double": "number"}
