"""Derived inputs built from keys, against the plain way of building them."""

from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from pactline import types as t
from workload import derive as d


@pytest.fixture(scope="module")
def odd_tables(spark, tmp_path_factory):
    """Missing keys, names that several suppliers share, repeated lines and several statuses."""
    home = str(tmp_path_factory.mktemp("odd"))
    day = lambda n: datetime(1998, 1, n)
    tables = {
        "region": ([(0, "R")], "r_regionkey int, r_name string"),
        "nation": ([(n, f"N{n}", 0) for n in (1, 6, 9, 10)], "n_nationkey int, n_name string, n_regionkey int"),
        "customer": ([(1, "C1", 9, 1.0, "HOUSEHOLD")],
                     "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"),
        "supplier": ([(1, "same", 9, 1.0), (2, "same", 10, 1.0), (3, "none", 1, 1.0), (4, None, 6, 1.0),
                      (5, None, 9, 1.0), (5, "twice", 9, 1.0), (None, "lost", 9, 1.0)],
                     "s_suppkey long, s_name string, s_nationkey int, s_acctbal double"),
        "orders": ([(1, 1, "F", "1-URGENT"), (2, None, "O", "2-HIGH"), (None, 3, "O", "2-HIGH")],
                   "o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string"),
        "lineitem": ([(1, s, n, flag, status, day(n or 9))
                      for s in (1, 2, 3, 4, 5, 6, None) for n in (1, 2, None)
                      for flag, status in (("A", "F"), ("N", "O"), ("R", None), (None, "long one"))]
                     + [(2, 1, 7, "N", None, None), (None, 1, 1, "A", "F", day(3)), (None, 1, None, "A", "O", day(4))],
                     "l_orderkey long, l_suppkey long, l_linenumber int, l_returnflag string, "
                     "l_linestatus string, l_shipdate timestamp"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{home}/{name}.parquet")
    return home


def rows_of(df):
    return sorted(map(str, df.collect()))


def test_edges_from_keys_equal_those_from_texts(spark, odd_tables):
    seen = d.edge_observations(spark, odd_tables)
    plain = seen.groupBy("source_topic", "consumer_name").agg(
        F.min("consumer_type").alias("consumer_type"), F.max("consumer_team").alias("consumer_team"),
        F.max("seen_at").alias("last_seen_at"))
    built = d._build_lineage_edges(spark, odd_tables)
    assert built.columns == plain.columns
    assert rows_of(built) == rows_of(plain)


def test_line_nodes_from_keys_equal_those_from_texts(spark, odd_tables):
    plain = d.table(spark, odd_tables, "lineitem").select(
        *d._node(t.DATASET, "line", d._line_key(), F.col("l_linestatus"),
                 F.when(F.col("l_returnflag") == "R", d._strings("quantity", "tax"))
                 .otherwise(F.array().cast("array<string>")))).groupBy("id").agg(
        *[F.max(c).alias(c) for c in ("node_type", "name", "namespace", "owner_team", "fields")])
    built = d._build_nodes(spark, odd_tables).filter(F.col("name").startswith("line."))
    assert rows_of(built.select(plain.columns)) == rows_of(plain)


def test_lines_are_aggregated_by_hashing(spark, odd_tables, capsys):
    """Sorting texts twice was what spilled; a build also ran once only to count its partitions."""
    for build in (d._build_lineage_edges, d._build_nodes):
        build(spark, odd_tables).explain()
        assert "SortAggregate" not in capsys.readouterr().out
