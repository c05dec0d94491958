"""Mask message fields by contract policy and flag undeclared sensitive-looking fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pactline import types as t
from pactline.functions.documents import (
    json_kind,
    let,
    object_paths,
    path_get,
    path_replace,
    variant_path,
    with_document,
)
from pactline.functions.masks import detect_pii, looks_sensitive, mask, redact, tokenize
from pactline.functions.rows import bind

DEFAULT_KEY = "default"
PARSE_ERROR = "parsing payload for masking: not a JSON object"
_POLICIES = "array<struct<path:string,masking_op:string,pii_class:string,compiled:string>>"
_DETECTIONS = "array<struct<path:string,pii_class:string,from_pattern:boolean>>"


def _apply_policy(state: Column, policy: Column, pads: tuple[Column, Column], opts: dict) -> Column:
    """One step of the fold over the policies: the state after one more policy."""
    path, operation = policy["path"], policy["masking_op"]
    blank = F.coalesce(policy["pii_class"], F.lit("")) == ""
    namespace = F.when(blank, path).otherwise(policy["pii_class"])

    def fail(reason: Column) -> Column:
        text = F.concat(F.lit('masking field "'), path, F.lit('": '), reason)
        return F.struct(
            state["doc"].alias("doc"), state["done"].alias("done"), text.alias("error")
        )

    def succeed(doc: Column) -> Column:
        done = F.array_append(state["done"], path)
        return F.struct(doc.alias("doc"), done.alias("done"), state["error"].alias("error"))

    def put(text: Column) -> Column:
        return succeed(path_replace(state["doc"], path, text.cast("variant")))

    def step(current: Column) -> Column:
        text = F.try_variant_get(current, "$", "string")
        textual = json_kind(current) == "string"
        hidden = (
            F.when(operation == t.REDACT, redact(operation))
            .when(operation == t.MASK, mask(text, opts["mask_char"], opts["keep"]))
            .otherwise(tokenize(text, namespace, pads=pads, prefix=opts["prefix"]))
        )
        unknown = ~operation.isin(*t.MASKING_OPERATIONS)
        return (
            F.when(current.isNull(), state)
            .when(F.is_variant_null(current), succeed(state["doc"]))
            .when(unknown, fail(F.concat(F.lit("unknown masking operation: "), operation)))
            .when(
                (operation != t.REDACT) & ~textual,
                fail(F.concat(operation, F.lit(" needs a string, got "), json_kind(current))),
            )
            .when(
                (operation == t.TOKENIZE) & pads[0].isNull(), fail(F.lit("TOKENIZE has no key"))
            )
            .otherwise(put(hidden))
        )

    return F.when(state["error"].isNotNull(), state).otherwise(
        let(path_get(state["doc"], path, policy["compiled"]), step)
    )


def masking_rules(policies: Column) -> Column:
    """The rules that name an operation, in order, with their compiled path; empty for NULL."""
    named = F.filter(policies, lambda p: F.coalesce(p["masking_op"], F.lit("")) != "")
    plain = F.transform(
        named,
        lambda p: F.struct(
            *[p[n].alias(n) for n in ("path", "masking_op", "pii_class")],
            variant_path(p["path"]).alias("compiled"),
        ),
    )
    return F.coalesce(plain, F.array().cast(_POLICIES))


def apply_policies(
    df: DataFrame,
    policies: Column,
    pads: tuple[Column, Column],
    *,
    document: str = "document",
    payload: str = "payload",
    only: Column | None = None,
    mask_char: str = "*",
    keep: int = 4,
    prefix: str = "tok_",
) -> DataFrame:
    """Add ``masked_document``, ``masked_payload``, ``fields_transformed`` and ``masking_error``.

    Policies apply in order. A failing policy blocks the whole message: both masked columns are then
    NULL, so a half-masked text cannot leave the operator. Absent fields are skipped, JSON null
    counts as transformed. ``policies`` are rows of :func:`masking_rules`. Rows outside ``only`` are
    left alone: all four columns are NULL.
    """
    opts = {"mask_char": mask_char, "keep": keep, "prefix": prefix}
    start = F.struct(
        F.col(document).alias("doc"),
        F.array().cast("array<string>").alias("done"),
        F.lit(None).cast("string").alias("error"),
    )
    chosen = F.lit(True) if only is None else only
    folded = F.when(
        chosen, F.aggregate(policies, start, lambda s, p: _apply_policy(s, p, pads, opts))
    )
    unparsed = F.when(chosen & F.col(document).isNull(), F.lit(PARSE_ERROR))
    error = F.coalesce(unparsed, F.col("__mask.error"))
    ok = F.col("masking_error").isNull()
    text = F.when(F.size("__mask.done") == 0, F.col(payload)).otherwise(F.to_json("__mask.doc"))
    return (
        bind(df, {"__mask": folded})
        .withColumn("masking_error", error)
        .withColumns(
            {
                "masked_document": F.when(ok, F.col("__mask.doc")),
                "masked_payload": F.when(ok, text),
                "fields_transformed": F.when(ok, F.col("__mask.done")),
            }
        )
        .drop("__mask")
    )


def scan_pii(doc: Column, text: Column, covered: Column) -> Column:
    """(path, pii_class, from_pattern) for suspicious field names no policy covers exactly."""
    suspicious = F.filter(
        object_paths(doc, text), lambda p: looks_sensitive(p) & ~F.array_contains(covered, p)
    )
    return F.transform(
        suspicious,
        lambda p: F.struct(
            p.alias("path"), detect_pii(p).alias("pii_class"), F.lit(True).alias("from_pattern")
        ),
    ).cast(_DETECTIONS)


def with_keys(enforcement: DataFrame, keys: DataFrame) -> DataFrame:
    """Attach key pads and compiled masking rules to each contract.

    The pads travel as data and not as literals; the rules are prepared once per contract, not once
    per message.
    """
    if "key_id" in enforcement.columns:
        named = enforcement
    else:
        named = enforcement.withColumn(
            "key_id", F.when(F.col("topic").isNotNull(), F.lit(DEFAULT_KEY))
        )
    return named.join(keys, "key_id", "left").drop("key_id").withColumn(
        "masking", masking_rules(F.col("fields"))
    )


def mask_messages(
    messages: DataFrame, *, rules: str = "contract.masking", only: Column | None = None, **options
) -> DataFrame:
    """Masking and advisory scan of messages that carry their contract (with key pads).

    Expects the columns ``payload``, ``contract`` and, when already parsed, ``document``. Adds the
    columns of :func:`apply_policies` and ``pattern_detections``. The scan sees the masked document
    and runs also when there are no policies. ``rules`` names a column of :func:`masking_rules`.
    """
    if "document" not in messages.columns:
        messages = with_document(messages, "payload", "document")
    pads = (F.col("contract.ipad"), F.col("contract.opad"))
    masked = apply_policies(messages, F.col(rules), pads, only=only, **options)
    covered = F.transform(F.col(rules), lambda p: p["path"])
    found = F.when(
        F.col("masked_document").isNotNull(),
        scan_pii(F.col("masked_document"), F.col("masked_payload"), covered),
    )
    return bind(masked, {"pattern_detections": found})


def _schema_paths(data_type: T.DataType, prefix: str = "") -> list[str]:
    if not isinstance(data_type, T.StructType):
        return []
    paths = []
    for field in data_type.fields:
        path = f"{prefix}{field.name}"
        paths.append(path)
        paths.extend(_schema_paths(field.dataType, f"{path}."))
    return paths


def scan_table_columns(spark: SparkSession, df: DataFrame) -> DataFrame:
    """The name detector over a table's own (nested) columns; the schema is the only input."""
    rows = [(path,) for path in _schema_paths(df.schema)]
    found = spark.createDataFrame(rows, "path string").withColumn(
        "pii_class", detect_pii(F.col("path"))
    )
    return found.filter(F.col("pii_class").isNotNull())
