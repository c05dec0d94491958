"""Row-level bindings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bind(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns that are computed exactly once per row, whatever is filtered or used later.

    A plain ``withColumn`` invites the optimizer to move a later filter below it together with a
    copy of the whole expression, and so to parse each payload twice. Here the values come out of
    a one-row generator: filters on other columns still move down to the scan, filters on these
    columns stay above.
    """
    kept = [c for c in df.columns if c not in columns]
    row = F.struct(*[value.alias(name) for name, value in columns.items()])
    return df.select(*[F.col(f"`{c}`") for c in kept], F.inline(F.array(row)))
