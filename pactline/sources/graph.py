"""Lineage documents to node and edge tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactline import types as t
from pactline.functions.text import classify_dataset

GRAPH_DOCUMENT = """
graph array<struct<
  id: string, type: string,
  data: struct<name: string, facets: struct<
    schema: struct<fields: array<struct<name: string>>>,
    ownership: struct<owners: array<struct<name: string>>>>>,
  inEdges: array<struct<origin: string>>,
  outEdges: array<struct<destination: string>>>>
"""


def schema_field_names(facet: Column) -> Column:
    """Distinct non-empty names of a schema facet."""
    names = F.filter(
        F.transform(facet["fields"], lambda f: f["name"]),
        lambda n: F.coalesce(n, F.lit("")) != "",
    )
    return F.array_distinct(F.coalesce(names, F.array().cast("array<string>")))


def first_owner(facet: Column) -> Column:
    """Name of the first owner; NULL when the list is empty or missing."""
    return F.get(facet["owners"], F.lit(0))["name"]


def complete_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Add bare nodes for edge endpoints that are not listed."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    bare = ends.join(nodes.select("id"), "id", "left_anti").select(
        "id",
        F.lit(t.DATASET).alias("node_type"),
        F.col("id").alias("name"),
        *[F.lit(None).cast("string").alias(c) for c in ("namespace", "dataset_type", "owner_team")],
        F.array().cast("array<string>").alias("fields"),
    )
    return nodes.unionByName(bare)


def malformed_documents(df: DataFrame, value: str = "value") -> DataFrame:
    """The documents that :func:`lineage_graph_from_json` cannot read, or not in full.

    Rows of ``df`` with ``error``: no JSON object, no graph list, or parts of another type than the
    lineage API gives them, which would be missing from the graph without notice.
    """
    parsed = F.from_json(value, GRAPH_DOCUMENT + ", _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"})
    text = F.col(value)
    error = (
        F.when(text.isNull(), "no document")
        .when(F.col("__document").isNull() | F.col("__document._corrupt").isNotNull(),
              "not a lineage document")
        .when(F.col("__document.graph").isNull(), "no graph")
    )
    return df.withColumn("__document", parsed).withColumn("error", error).drop("__document").filter(
        F.col("error").isNotNull())


def lineage_graph_from_json(
    df: DataFrame, namespace: str, value: str = "value"
) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of lineage API documents held as text.

    A node listed in several documents is kept once (the last by attribute order); fields are
    recorded for datasets only. Edge endpoints that are not listed become bare nodes. Documents that
    cannot be read add nothing; :func:`malformed_documents` lists them.
    """
    listed = df.select(
        F.inline(F.from_json(value, GRAPH_DOCUMENT)["graph"])
    ).withColumn("id", F.coalesce("id", F.lit("")))
    name = F.coalesce("data.name", "id")
    is_dataset = F.col("type") == t.DATASET
    described = listed.filter(F.col("type").isin(t.DATASET, t.JOB)).select(
        "id",
        F.col("type").alias("node_type"),
        name.alias("name"),
        F.lit(namespace).alias("namespace"),
        F.when(is_dataset, classify_dataset(name)).alias("dataset_type"),
        first_owner(F.col("data.facets.ownership")).alias("owner_team"),
        F.when(is_dataset, schema_field_names(F.col("data.facets.schema")))
        .otherwise(F.array().cast("array<string>"))
        .alias("fields"),
    )
    attributes = [c for c in described.columns if c != "id"]
    nodes = described.groupBy("id").agg(F.max(F.struct(*attributes)).alias("a")).select("id", "a.*")
    incoming = listed.select(F.explode("inEdges.origin").alias("src"), F.col("id").alias("dst"))
    outgoing = listed.select(F.col("id").alias("src"), F.explode("outEdges.destination").alias("dst"))
    edges = incoming.unionByName(outgoing).filter("src is not null and dst is not null").distinct()
    return complete_nodes(nodes, edges), edges
