"""Read registry tables with their fixed schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pactline import types as t


def read_registry(
    spark: SparkSession, path: str | None = None, *, jdbc: dict[str, str] | None = None
) -> dict[str, DataFrame]:
    """All registry tables, as Parquet folders below ``path`` or from a JDBC source.

    Columns and filters of later steps reach either source. ``jdbc`` holds reader options without
    ``dbtable``.
    """
    if jdbc is not None:
        return {
            name: spark.read.format("jdbc").options(**jdbc, dbtable=name).load()
            for name in t.REGISTRY
        }
    root = str(path).rstrip("/")
    return {
        name: spark.read.schema(schema).parquet(f"{root}/{name}")
        for name, schema in t.REGISTRY.items()
    }
