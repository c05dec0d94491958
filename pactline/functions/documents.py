"""JSON documents as VARIANT: strict parsing, dotted paths, path listing and rewriting.

A dotted path walks through objects only. JSON null is *present*; a missing key, or a step through
something that is not an object, is *absent*. Arrays are opaque values.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactline.functions.rows import bind

OBJECT = "map<string,variant>"
_BLANKS = " \t\n\r"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times in ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


# ---------------------------------------------------------------------------------------------
# parsing


def with_parsed(df: DataFrame, text: str, out: str) -> DataFrame:
    """Add ``out``: the VARIANT of the whole text, or NULL if it is not exactly one JSON value.

    ``try_parse_json`` ignores whatever follows the first value. Wrapping the text into an array
    that ends with the text's own hash makes trailing content visible: the hash must then be the
    second and last element. Parsing stays in its own projection so that it happens once per row.
    """
    wrapped, stamp = f"__{out}_wrapped", F.xxhash64(F.col(text))
    boxed = F.try_parse_json(F.concat(F.lit("["), F.col(text), F.lit(","), stamp, F.lit("]")))
    whole = (
        F.try_variant_get(wrapped, "$[1]", "bigint") == stamp
    ) & F.try_variant_get(wrapped, "$[2]", "variant").isNull()
    value = F.when(whole, F.try_variant_get(wrapped, "$[0]", "variant"))
    return bind(df.withColumn(wrapped, boxed), {out: value}).drop(wrapped)


def is_object_text(text: Column) -> Column:
    """For text known to be valid JSON: is it an object?"""
    return F.left(F.ltrim(text, F.lit(_BLANKS)), F.lit(1)) == F.lit("{")


def with_document(df: DataFrame, text: str, out: str) -> DataFrame:
    """Like :func:`with_parsed`, but only objects and the literal ``null`` count as documents."""
    parsed = with_parsed(df, text, out)
    keep = is_object_text(F.col(text)) | F.is_variant_null(out)
    return parsed.withColumn(out, F.when(keep, F.col(out)))


# ---------------------------------------------------------------------------------------------
# dotted paths


def path_segments(path: Column) -> Column:
    return F.split(path, r"\.", -1)


def variant_path(path: Column) -> Column:
    """VARIANT path of a dotted path; NULL for a segment that holds both kinds of quote."""
    step = F.transform(
        path_segments(path),
        lambda s: F.when(~s.contains("'"), F.concat(F.lit("['"), s, F.lit("']"))).when(
            ~s.contains('"'), F.concat(F.lit('["'), s, F.lit('"]'))
        ),
    )
    text = F.concat(F.lit("$"), F.array_join(step, ""))
    return F.when(~F.exists(step, lambda s: s.isNull()), text)


def as_object(node: Column) -> Column:
    """Members of an object as a map, NULL for every other kind."""
    return F.try_variant_get(node, "$", OBJECT)


def _walk(doc: Column, path: Column) -> Column:
    return F.aggregate(
        path_segments(path), doc, lambda node, s: F.try_element_at(as_object(node), s)
    )


def literal_path(path: str) -> str | None:
    """:func:`variant_path` of a path known when the query is written."""
    steps = []
    for segment in path.split("."):
        if "'" in segment and '"' in segment:
            return None
        quote = '"' if "'" in segment else "'"
        steps.append(f"[{quote}{segment}{quote}]")
    return "$" + "".join(steps)


def path_get(doc: Column, path: Column | str, compiled: Column | None = None) -> Column:
    """The VARIANT at a dotted path: SQL NULL when absent, variant null for JSON null.

    A ``str`` is the path itself. For a path column, ``compiled`` is its :func:`variant_path` when
    the caller has that as a column already.
    """
    if isinstance(path, str):
        fixed = literal_path(path)
        if fixed is not None:
            return F.try_variant_get(doc, fixed, "variant")
        return _walk(doc, F.lit(path))
    target = compiled if compiled is not None else variant_path(path)
    return F.when(target.isNotNull(), F.try_variant_get(doc, target, "variant")).otherwise(
        _walk(doc, path)
    )


def path_set(doc: Column, path: Column, value: Column) -> Column:
    """Replace (or add) the value at a dotted path; NULL when a parent is not an object.

    Rebuilds the objects from the innermost to the root, so only the touched branch is rewritten.
    """

    def rebuild(segments: Column) -> Column:
        depth = F.size(segments)

        def step(child: Column, i: Column) -> Column:
            above = F.slice(segments, F.lit(1), i - 1)
            parent = as_object(
                F.aggregate(above, doc, lambda node, s: F.try_element_at(as_object(node), s))
            )
            name = F.get(segments, i - 1)

            def merge(members: Column) -> Column:
                others = F.map_filter(members, lambda k, _: k != name)
                merged = F.map_concat(others, F.create_map(name, child))
                usable = members.isNotNull() & child.isNotNull()
                return F.when(usable, F.to_variant_object(merged))

            return let(parent, merge)

        inside_out = F.reverse(F.sequence(F.lit(1), depth))
        return F.aggregate(inside_out, value, step)

    return let(path_segments(path), rebuild)


_UNROLLED_SEGMENTS = 3


def path_replace(doc: Column, path: Column, value: Column) -> Column:
    """:func:`path_set` for a path that is present: one pass over the members of each level.

    The usual short paths are written out; longer ones take the general way.
    """

    def inside(node: Column, segments: Column, at: int, depth: int) -> Column:
        wanted = F.get(segments, F.lit(at))
        new = lambda child: value if at == depth - 1 else inside(child, segments, at + 1, depth)
        members = F.transform_values(
            as_object(node), lambda k, child: F.when(k == wanted, new(child)).otherwise(child)
        )
        return F.to_variant_object(members)

    def choose(segments: Column) -> Column:
        chain = F.when(F.size(segments) == 1, inside(doc, segments, 0, 1))
        for depth in range(2, _UNROLLED_SEGMENTS + 1):
            chain = chain.when(F.size(segments) == depth, inside(doc, segments, 0, depth))
        return chain.otherwise(path_set(doc, path, value))

    return let(path_segments(path), choose)


# ---------------------------------------------------------------------------------------------
# kinds and listings

# The type names Spark gives to VARIANT values, and the kinds they are in JSON. A type
# without a JSON form of its own (a date, say) is text there.
_KINDS = {
    "OBJECT": "object",
    "ARRAY": "array",
    "STRING": "string",
    "BOOLEAN": "boolean",
    "VOID": "null",
    "TINYINT": "number",
    "SMALLINT": "number",
    "INT": "number",
    "BIGINT": "number",
    "FLOAT": "number",
    "DOUBLE": "number",
    "DECIMAL": "number",
}


def json_kind(node: Column) -> Column:
    """string, number, boolean, object, array or null; SQL NULL for an absent value."""
    kinds = F.create_map(*[F.lit(x) for pair in _KINDS.items() for x in pair])
    name = F.regexp_extract(F.schema_of_variant(node), "^[A-Z_]+", 0)
    return F.when(node.isNotNull(), F.coalesce(F.try_element_at(kinds, name), F.lit("string")))


def canonical_json(node: Column) -> Column:
    """JSON text with sorted keys and no blanks, for comparing fragments by value."""
    return F.to_json(node)


def top_level_keys(text: Column) -> Column:
    """Distinct keys of a JSON object text."""
    return F.array_distinct(F.json_object_keys(text))


def _levels(text: Column, max_segments: int | None) -> Column:
    """An upper bound of the nesting depth: the number of opening braces in the text."""
    braces = F.length(text) - F.length(F.replace(text, F.lit("{")))
    if max_segments is not None:
        braces = F.least(braces, F.lit(max_segments))
    return F.sequence(F.lit(1), F.greatest(braces, F.lit(1)))


_ENTRIES = "array<struct<path:string,node:variant>>"


def object_listing(doc: Column, text: Column, max_segments: int | None = None) -> Column:
    """(done, cut): every object path with its value, intermediate objects included, by levels, and
    whether ``max_segments`` has left anything out.

    Walks level by level inside one expression, so no row is multiplied and nothing shuffles. The
    number of rounds comes from the text itself, hence no depth is too deep.
    """
    none = F.array().cast(_ENTRIES)

    def children(entry: Column, at_root: bool) -> Column:
        prefix = F.lit("") if at_root else F.concat(entry["path"], F.lit("."))
        members = F.map_entries(as_object(entry if at_root else entry["node"]))
        listed = F.transform(
            members,
            lambda m: F.struct(
                F.concat(prefix, m["key"]).alias("path"), m["value"].alias("node")
            ),
        )
        return F.coalesce(listed, none)

    first = children(doc, at_root=True)
    start = F.struct(first.alias("frontier"), none.alias("done"), F.lit(False).alias("cut"))

    def deeper(state: Column, level: Column) -> Column:
        below = F.flatten(F.transform(state["frontier"], lambda e: children(e, at_root=False)))
        last = level >= F.lit(max_segments) if max_segments is not None else F.lit(False)
        return F.when(F.size(state["frontier"]) == 0, state).otherwise(
            F.struct(
                F.when(last, none).otherwise(below).alias("frontier"),
                F.concat(state["done"], state["frontier"]).alias("done"),
                (last & (F.size(below) > 0)).alias("cut"),
            )
        )

    return F.aggregate(
        _levels(text, max_segments), start, deeper,
        lambda s: F.struct(F.coalesce(s["done"], none).alias("done"), s["cut"].alias("cut")),
    )


def object_entries(doc: Column, text: Column, max_segments: int | None = None) -> Column:
    """Every object path with its value (see :func:`object_listing`)."""
    return F.coalesce(object_listing(doc, text, max_segments)["done"], F.array().cast(_ENTRIES))


def object_paths(doc: Column, text: Column, max_segments: int | None = None) -> Column:
    """Every object path of the document, sorted."""
    return F.sort_array(
        F.transform(object_entries(doc, text, max_segments), lambda e: e["path"])
    )


def described_fields(entries: Column) -> Column:
    """(path, value_type, nullable, present) of listed entries, by path."""
    described = F.transform(
        entries,
        lambda e: F.struct(
            e["path"].alias("path"),
            json_kind(e["node"]).alias("value_type"),
            F.is_variant_null(e["node"]).alias("nullable"),
            F.lit(True).alias("present"),
        ),
    )
    return F.sort_array(described)


def extract_fields(doc: Column, text: Column, max_segments: int | None = None) -> Column:
    """(path, value_type, nullable, present) per field, at most ``max_segments`` deep if given."""
    return described_fields(object_entries(doc, text, max_segments))
