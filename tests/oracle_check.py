"""Compare Spark results with the SQL counterparts in DuckDB."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        if (Path(sf_dir) / f"{name}.parquet").exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _cell(value):
    if isinstance(value, float):
        return None if math.isnan(value) else f"{value:.9g}"
    return str(value) if value is not None else None


def rows_of(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    shaped = [tuple(_cell(row[i]) for i in order) for row in rows]
    return sorted(shaped, key=lambda r: tuple((x is not None, x or "") for x in r))


def compare(df, con, sql: str) -> str | None:
    """None if both sides agree, else a short explanation."""
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    expected = rows_of(names, cursor.fetchall())
    actual = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if actual == expected:
        return None
    only_spark = [r for r in actual if r not in set(expected)][:2]
    only_sql = [r for r in expected if r not in set(actual)][:2]
    return f"{len(actual)} vs {len(expected)} rows; spark {only_spark}; sql {only_sql}"
