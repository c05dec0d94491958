"""Classify schema changes as safe, compatible or breaking.

Both schemas of a comparison sit on one row, so the field diff is a per-row expression: no shuffle
and no join by field name. Only the change rows are exploded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pactline import types as t
from pactline.functions.documents import (
    as_object,
    canonical_json,
    json_kind,
    let,
    with_document,
)
from pactline.functions.rows import bind
from pactline.functions.semver import bump_error, bump_level, parse_semver
from pactline.functions.text import name_of_rank, quoted, rank_of
from pactline.operators.joins import lookup_join
from pactline.operators.partitions import cut
from pactline.operators.registry import latest_version

CHANGE = "struct<field:string,change_type:string,description:string,severity:string>"
CHANGES = f"array<{CHANGE}>"
_FIELDS = "array<struct<name:string,type:string,has_default:boolean,required:boolean>>"
_STRINGS = "array<string>"


# ---------------------------------------------------------------------------------------------
# schemas as field lists


def _last_of_each_name(fields: Column) -> Column:
    """Sorted by name with the last duplicate kept; sorting keeps this below quadratic time."""
    placed = F.sort_array(
        F.transform(
            fields,
            lambda f, i: F.struct(f["name"].alias("name"), i.alias("at"), f.alias("field")),
        )
    )
    return let(
        placed,
        lambda all_: F.transform(
            F.filter(
                all_,
                lambda x, i: F.coalesce(F.get(all_, i + 1)["name"] != x["name"], F.lit(True)),
            ),
            lambda x: x["field"],
        ),
    )


def _member(node: Column, name: str) -> Column:
    return F.try_variant_get(node, f"$.{name}", "variant")


def _is(node: Column, *kinds: str) -> Column:
    return node.isNull() | json_kind(node).isin("null", *kinds)


def avro_fields(schema: Column) -> Column:
    """Field list of an Avro record schema held as VARIANT.

    A field has a default when the key is there, also with the value null. A missing type is kept
    as empty text.
    """
    listed = F.try_variant_get(schema, "$.fields", "array<variant>")
    described = F.transform(
        listed,
        lambda f: F.struct(
            F.coalesce(F.try_variant_get(f, "$.name", "string"), F.lit("")).alias("name"),
            F.coalesce(canonical_json(_member(f, "type")), F.lit("")).alias("type"),
            _member(f, "default").isNotNull().alias("has_default"),
            F.lit(False).alias("required"),
        ),
    )
    return F.coalesce(_last_of_each_name(described), F.array().cast(_FIELDS))


def avro_schema_ok(schema: Column) -> Column:
    """Are the parts of an Avro schema that the comparison reads of the right kind?"""
    fields = F.try_variant_get(schema, "$.fields", "array<variant>")
    fine = lambda f: (
        json_kind(f).isin("object", "null")
        & _is(_member(f, "name"), "string")
        & _is(_member(f, "doc"), "string")
        & _is(_member(f, "aliases"), "array")
    )
    return (
        schema.isNotNull()
        & _is(_member(schema, "type"), "string")
        & _is(_member(schema, "name"), "string")
        & _is(_member(schema, "namespace"), "string")
        & _is(_member(schema, "fields"), "array")
        & F.coalesce(~F.exists(fields, lambda f: ~fine(f)), F.lit(True))
    )


def json_fields(schema: Column) -> Column:
    """Property list of a JSON Schema held as VARIANT, ordered by name."""
    required = F.coalesce(
        F.try_variant_get(schema, "$.required", _STRINGS), F.array().cast(_STRINGS)
    )
    described = F.transform(
        F.map_entries(as_object(_member(schema, "properties"))),
        lambda p: F.struct(
            p["key"].alias("name"),
            F.coalesce(canonical_json(_member(p["value"], "type")), F.lit("")).alias("type"),
            F.lit(False).alias("has_default"),
            F.array_contains(required, p["key"]).alias("required"),
        ),
    )
    return F.coalesce(F.sort_array(described), F.array().cast(_FIELDS))


def json_schema_ok(schema: Column) -> Column:
    required = F.try_variant_get(schema, "$.required", "array<variant>")
    return (
        schema.isNotNull()
        & _is(_member(schema, "type"), "string")
        & _is(_member(schema, "description"), "string")
        & _is(_member(schema, "properties"), "object")
        & _is(_member(schema, "required"), "array")
        & F.coalesce(
            ~F.exists(required, lambda r: ~json_kind(r).isin("string", "null")), F.lit(True)
        )
    )


# ---------------------------------------------------------------------------------------------
# differences of two field lists


def _by_name(fields: Column) -> Column:
    return F.map_from_entries(F.transform(fields, lambda f: F.struct(f["name"], f)))


def _names(fields: Column) -> Column:
    return F.transform(fields, lambda f: f["name"])


def removed_names(current: Column, proposed: Column) -> Column:
    return F.array_except(_names(current), _names(proposed))


def added_names(current: Column, proposed: Column) -> Column:
    return F.array_except(_names(proposed), _names(current))


def _change(field: Column, kind: str, description: Column, severity: Column | str) -> Column:
    level = severity if isinstance(severity, Column) else F.lit(severity)
    return F.struct(
        field.alias("field"),
        F.lit(kind).alias("change_type"),
        description.alias("description"),
        level.alias("severity"),
    )


def _text(before: str, name: Column, after: str) -> Column:
    return F.concat(F.lit(before), quoted(name), F.lit(after))


def _breaking_if(condition: Column) -> Column:
    return F.when(condition, t.BREAKING).otherwise(t.COMPATIBLE)


def _retyped(kind: str, name: Column, old: Column, new: Column) -> Column:
    return F.concat(
        F.lit(f"{kind} "), quoted(name), F.lit(" type changed from "), old["type"],
        F.lit(" to "), new["type"],
    )


def _avro_rules(name: Column, old: Column, new: Column, mode: Column) -> list[Column]:
    both = old.isNotNull() & new.isNotNull()
    strict_addition = ~new["has_default"] & F.coalesce(mode == t.BACKWARD, F.lit(False))
    return [
        F.when(
            new.isNull(),
            _change(name, t.FIELD_REMOVED, _text("field ", name, " removed from schema"),
                    _breaking_if(~old["has_default"])),
        ),
        F.when(
            old.isNull(),
            _change(name, t.FIELD_ADDED, _text("field ", name, " added to schema"),
                    _breaking_if(strict_addition)),
        ),
        F.when(both & (old["type"] != new["type"]),
               _change(name, t.TYPE_CHANGED, _retyped("field", name, old, new), t.BREAKING)),
        F.when(
            both & old["has_default"] & ~new["has_default"],
            _change(name, t.DEFAULT_REMOVED, _text("field ", name, " default value removed"),
                    t.COMPATIBLE),
        ),
    ]


def _json_rules(name: Column, old: Column, new: Column, strict_types: bool) -> list[Column]:
    both = old.isNotNull() & new.isNotNull()
    rules = [
        F.when(
            new.isNull(),
            _change(name, t.FIELD_REMOVED, _text("property ", name, " removed"),
                    _breaking_if(old["required"])),
        ),
        F.when(
            old.isNull(),
            _change(name, t.FIELD_ADDED, _text("property ", name, " added"),
                    _breaking_if(new["required"])),
        ),
    ]
    if strict_types:
        rules.append(
            F.when(both & (old["type"] != new["type"]),
                   _change(name, t.TYPE_CHANGED, _retyped("property", name, old, new),
                           t.BREAKING))
        )
    rules.append(
        F.when(
            both & ~old["required"] & new["required"],
            _change(name, t.REQUIRED_ADDED,
                    _text("property ", name, " is now required (was optional)"), t.BREAKING),
        )
    )
    return rules


def diff_fields(current: Column, proposed: Column, rules) -> Column:
    """Changes between two field lists, ordered by field name.

    ``rules(name, old, new)`` gives candidate changes; ``old`` and ``new`` are field structs, NULL
    where the field is missing on that side.
    """
    names = F.sort_array(F.array_union(_names(current), _names(proposed)))

    def compare(both: Column) -> Column:
        def one(name: Column) -> Column:
            pair = F.struct(
                F.try_element_at(both["old"], name).alias("old"),
                F.try_element_at(both["new"], name).alias("new"),
            )
            return let(pair, lambda p: F.array_compact(F.array(*rules(name, p["old"], p["new"]))))

        return F.flatten(F.transform(names, one))

    sides = F.struct(_by_name(current).alias("old"), _by_name(proposed).alias("new"))
    return let(sides, compare).cast(CHANGES)


def worst_classification(changes: Column) -> Column:
    """Most severe class of a change list; no change is SAFE."""
    ranks = F.transform(changes, lambda c: rank_of(c["severity"], t.CLASSIFICATION_RANK))
    return name_of_rank(
        F.coalesce(F.array_max(ranks), F.lit(0)), t.CLASSIFICATION_RANK
    )


def with_schema_fields(df: DataFrame, text: str, schema_format: str, out: str) -> DataFrame:
    """Add ``out``: the field list of a schema text, NULL when it is malformed for its format.

    PROTOBUF is not interpreted and has an empty list; an unknown format has none.
    """
    node, kind = F.col("__schema"), F.col(schema_format)
    fields = (
        F.when((kind == t.AVRO) & avro_schema_ok(node), avro_fields(node))
        .when((kind == t.JSON_SCHEMA) & json_schema_ok(node), json_fields(node))
        .when(kind == t.PROTOBUF, F.array().cast(_FIELDS))
    )
    parsed = with_document(df, text, "__schema")
    return bind(parsed, {out: fields.cast(_FIELDS)}).drop("__schema")


def with_field_changes(
    df: DataFrame,
    current: str,
    proposed: str,
    schema_format: str,
    compatibility: str,
    strict_types: bool = False,
) -> DataFrame:
    """Add ``changes``, ``classification`` and ``schema_error`` for two field lists per row.

    PROTOBUF is always SAFE; an unknown format or a malformed schema is an error and no class.
    """
    kind, old, new, mode = (F.col(c) for c in (schema_format, current, proposed, compatibility))
    shown = F.when(kind == t.AVRO, F.lit("avro")).otherwise(F.lit("json"))
    broken = lambda side, label: F.when(
        side.isNull(), F.concat(F.lit(f"parsing {label} "), shown, F.lit(" schema"))
    )
    unknown = F.when(
        ~F.coalesce(kind.isin(t.AVRO, t.JSON_SCHEMA, t.PROTOBUF), F.lit(False)),
        F.concat(F.lit("unsupported schema format: "), F.coalesce(kind, F.lit(""))),
    )
    error = F.when(
        F.coalesce(kind != t.PROTOBUF, F.lit(True)),
        F.coalesce(unknown, broken(old, "current"), broken(new, "proposed")),
    )
    usable = F.col("schema_error").isNull()
    avro_diff = diff_fields(old, new, lambda n, o, p: _avro_rules(n, o, p, mode))
    json_diff = diff_fields(old, new, lambda n, o, p: _json_rules(n, o, p, strict_types))
    changes = (
        F.when(usable & (kind == t.AVRO), avro_diff)
        .when(usable & (kind == t.JSON_SCHEMA), json_diff)
        .otherwise(F.array().cast(CHANGES))
    )
    compared = bind(df.withColumn("schema_error", error), {"changes": changes})
    worst = F.when(usable, worst_classification(F.col("changes")))
    return compared.withColumn("classification", worst)


def with_schema_changes(
    df: DataFrame,
    current: str,
    proposed: str,
    schema_format: str,
    compatibility: str,
    strict_types: bool = False,
) -> DataFrame:
    """:func:`with_field_changes` for two schema texts per row, both read in the same format."""
    listed = with_schema_fields(df, current, schema_format, "__old_fields")
    listed = with_schema_fields(listed, proposed, schema_format, "__new_fields")
    return with_field_changes(
        listed, "__old_fields", "__new_fields", schema_format, compatibility, strict_types
    ).drop("__old_fields", "__new_fields")


def change_rows(df: DataFrame, *keys: str) -> DataFrame:
    """One row per change, with its severity."""
    return df.select(*keys, F.inline("changes"))


# ---------------------------------------------------------------------------------------------
# version history


def with_previous(versions: DataFrame, value: Column, out: str) -> DataFrame:
    """Add ``value`` of the version before (same contract, by created_at and id).

    The rows are sorted by contract and time into ranges of even size, so a long history, also one
    with a single time stamp, is divided like all others. Inside a range the row before is looked up
    in a window; the first row of a range takes the last row of the range before, from a table with
    one row per range. NULL keys are a contract of their own, NULL times come first.
    """
    order = ["contract_id", "created_at", "id"]
    entry = F.struct(F.col("contract_id").alias("contract_id"), value.alias("value"))
    ranged = cut(
        versions.withColumn("__entry", entry).repartitionByRange(*order)
        .withColumn("__range", F.spark_partition_id()),
        "version-ranges",
    )
    inside = Window.partitionBy("__range").orderBy(*order)
    last = ranged.groupBy("__range").agg(F.max_by("__entry", F.struct(*order)).alias("__last"))
    # One row for each range, and there are as many as partitions.
    across = Window.orderBy("__range")
    carried = last.select("__range", F.lag("__last").over(across).alias("__carried"))
    near = F.lag("__entry").over(inside)
    joined = ranged.withColumn("__near", near).join(F.broadcast(carried), "__range", "left")
    before = F.coalesce("__near", "__carried")
    same = before["contract_id"].eqNullSafe(F.col("contract_id"))
    return joined.withColumn(out, F.when(same, before["value"])).drop(
        "__range", "__near", "__carried", "__entry"
    )


def _digest(*columns: str) -> Column:
    """A key for values of text columns; NULL is a value of its own."""
    parts = []
    for name in columns:
        given = F.concat(F.lit("="), F.length(name).cast("string"), F.lit(":"), F.col(name))
        parts.append(F.coalesce(given, F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def _schemas_compared(pairs: DataFrame, texts: DataFrame, strict_types: bool) -> DataFrame:
    """Every distinct pair (__old, __new, __format, __mode) of schema digests, compared once.

    ``texts`` holds each schema text once, by digest.
    """
    for side, spread_by in (("old", "__new"), ("new", "__old")):
        named = texts.select(F.col("__digest").alias(f"__{side}"), F.col("__text").alias(f"__{side}_text"))
        pairs = lookup_join(pairs, named, f"__{side}", spread_by=[spread_by])
    compared = with_schema_changes(
        pairs, "__old_text", "__new_text", "__format", "__mode", strict_types
    )
    return cut(compared.drop("__old_text", "__new_text"), "compared-schemas")


def evolution_history(versions: DataFrame, strict_types: bool = False) -> DataFrame:
    """Every version against its predecessor: changes, class and size of the version step.

    Predecessors are found from keys and digests of schemas alone. Texts are fetched afterwards, by
    digest, and each distinct pair of schemas is parsed and compared once, however many contracts
    and versions share it. The first version of a contract has no class and no changes. A step
    between two formats is an error.
    """
    keyed = versions.withColumn("__digest", _digest("schema_format", "schema_body"))
    texts = cut(
        versions.select("schema_format", F.col("schema_body").alias("__text")).distinct().select(
            _digest("schema_format", "__text").alias("__digest"), "__text"
        ),
        "schema-texts",
    )
    kept = F.struct("version", "schema_format", "compatibility", "__digest")
    before = with_previous(keyed.drop("schema_body"), kept, "__prev")
    paired = cut(
        before.select(
            *[c for c in versions.columns if c != "schema_body"],
            F.col("__prev.version").alias("previous_version"),
            F.col("__prev").isNotNull().alias("__follows"),
            F.col("__prev.__digest").alias("__old"),
            F.col("__digest").alias("__new"),
            F.when(F.col("__prev.schema_format") == F.col("schema_format"), F.col("schema_format"))
            .otherwise(F.concat_ws(" to ", "__prev.schema_format", "schema_format"))
            .alias("__format"),
            F.col("__prev.compatibility").alias("__mode"),
        ).withColumn("__pair", F.when(F.col("__follows"), _digest("__old", "__new", "__format", "__mode"))),
        "version-pairs",
    )
    pairs = paired.filter("__follows").select("__pair", "__old", "__new", "__format", "__mode")
    compared = _schemas_compared(pairs.distinct(), texts, strict_types).select(
        "__pair", "changes", "classification", "schema_error"
    )
    steps = bind(
        lookup_join(paired, compared, "__pair", spread_by=["id"]),
        {
            "__now": parse_semver(F.col("version")),
            "__then": parse_semver(F.col("previous_version")),
        },
    )
    malformed = F.when(
        F.col("__now").isNull() | F.col("__then").isNull(),
        F.lit("version must be MAJOR.MINOR.PATCH"),
    )
    step_error = F.coalesce(malformed, bump_error(F.col("__then"), F.col("__now")))
    return steps.withColumns(
        {
            "changes": F.coalesce("changes", F.array().cast(CHANGES)),
            "bump": bump_level(F.col("__then"), F.col("__now")),
            "bump_error": F.when(F.col("__follows"), step_error),
        }
    ).drop("__now", "__then", "__follows", "__old", "__new", "__format", "__mode", "__pair")


# ---------------------------------------------------------------------------------------------
# the change gate


def changes_against_latest(
    proposals: DataFrame, contracts: DataFrame, versions: DataFrame, strict_types: bool = False
) -> DataFrame:
    """Proposals (change_id, contract_name, schema_format, proposed_schema) compared with the
    latest version of the contract they name, with ``topic``, ``changes``, ``classification`` and
    ``error``. An unknown contract or one without versions is SAFE.

    Each distinct pair of schemas is parsed and compared once and its changes are stored, so neither
    proposals that share schemas nor several readers of the result compare anything again.
    """
    known = contracts.select(
        F.col("id").alias("contract_id"), F.col("name").alias("contract_name"), "topic"
    )
    named = lookup_join(proposals, known, "contract_name", spread_by=["change_id"])
    baseline = latest_version(versions).select(
        "contract_id", F.col("schema_body").alias("current_schema"), "compatibility"
    )
    paired = named.join(baseline, "contract_id", "left")
    incomplete = (F.coalesce(F.length("contract_name"), F.lit(0)) == 0) | (
        F.coalesce(F.length("proposed_schema"), F.lit(0)) == 0
    )
    # Formats that are never compared, and a missing baseline, need no texts: one pair stands for all.
    silent = F.col("current_schema").isNull() | F.coalesce(
        F.col("schema_format") == t.PROTOBUF, F.lit(False)
    )
    rows = cut(
        paired.select(
            *proposals.columns, "topic", "compatibility",
            incomplete.alias("__incomplete"),
            F.when(~silent, F.col("current_schema")).alias("__old_text"),
            F.when(~silent, F.col("proposed_schema")).alias("__new_text"),
            F.when(silent, t.PROTOBUF).otherwise(F.col("schema_format")).alias("__format"),
            F.when(~silent, F.col("compatibility")).alias("__mode"),
        ).withColumn(
            "__pair",
            F.when(~F.col("__incomplete"), _digest("__old_text", "__new_text", "__format", "__mode")),
        ),
        "proposals",
    )
    pairs = rows.filter("not __incomplete").select(
        "__pair", "__old_text", "__new_text", "__format", "__mode"
    )
    stored = cut(
        with_schema_changes(
            pairs.distinct(), "__old_text", "__new_text", "__format", "__mode", strict_types
        ).select("__pair", "changes", "classification", "schema_error"),
        "compared-proposals",
    )
    compared = lookup_join(rows, stored, "__pair", spread_by=["change_id"])
    error = F.when(
        F.col("__incomplete"), "contract_name and proposed_schema are required"
    ).otherwise(F.concat(F.lit("schema analysis failed: "), F.col("schema_error")))
    return compared.select(
        *proposals.columns, "topic", "compatibility",
        F.coalesce("changes", F.array().cast(CHANGES)).alias("changes"),
        "classification",
        error.alias("error"),
    )


def consumers_per_topic(edges: DataFrame) -> DataFrame:
    """Consumer count and sorted distinct teams of each topic, aggregated before any join."""
    per_team = edges.groupBy("source_topic", "consumer_team").agg(
        F.count(F.lit(1)).alias("__n")
    )
    team = F.when(F.col("consumer_team") != "", F.col("consumer_team"))
    return per_team.groupBy(F.col("source_topic").alias("topic")).agg(
        F.sum("__n").alias("n_consumers"),
        F.sort_array(F.collect_list(team)).alias("teams"),
    )


def gate(compared: DataFrame, edges: DataFrame) -> DataFrame:
    """One decision row per proposal from :func:`changes_against_latest`.

    Consumers count only for breaking changes; approval is needed when there are any. Edges are
    reduced per topic before the join, so many proposals on one busy topic do not multiply.
    """
    joined = compared.join(consumers_per_topic(edges), "topic", "left")
    breaking = F.coalesce(F.col("classification") == t.BREAKING, F.lit(False))
    count = F.when(breaking, F.coalesce(F.col("n_consumers"), F.lit(0))).otherwise(F.lit(0))
    teams = F.when(breaking & (F.col("n_consumers") > 0), F.col("teams"))
    return joined.select(
        "change_id", "contract_name", "topic", "classification", "changes", "error",
        F.size("changes").alias("n_changes"),
        count.cast("bigint").alias("n_consumers"),
        (breaking & (F.coalesce(F.col("n_consumers"), F.lit(0)) > 0)).alias("requires_approval"),
        F.coalesce(teams, F.array().cast(_STRINGS)).alias("approval_from_teams"),
    )


def affected_consumers(compared: DataFrame, edges: DataFrame) -> DataFrame:
    """One row per breaking proposal and consumer; with ``fields_impacted`` if edges name fields.

    Keyed by topic; adaptive execution splits a topic that holds many proposals and consumers.
    """
    changed = F.array_distinct(F.transform("changes", lambda c: c["field"]))
    breaking = compared.filter(F.col("classification") == t.BREAKING).select(
        "change_id", F.col("topic").alias("source_topic"), changed.alias("__changed")
    )
    joined = breaking.join(edges, "source_topic", "inner")
    impacted = (
        F.sort_array(F.array_intersect("__changed", "fields_used"))
        if "fields_used" in edges.columns
        else F.array().cast(_STRINGS)
    )
    return joined.select(
        "change_id", "source_topic", "consumer_name", "consumer_type", "consumer_team",
        impacted.alias("fields_impacted"),
    )


def gate_outcomes(decisions: DataFrame) -> DataFrame:
    """Gate decisions per class."""
    return decisions.filter(F.col("classification").isNotNull()).groupBy("classification").agg(
        F.count(F.lit(1)).alias("n")
    )
