"""Impact reports for many proposed changes at once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pactline.operators.impact import (
    Walk,
    affected,
    find_source_node,
    may_be_impacted,
    report,
    score,
    walk,
    with_graph_state,
    with_node_attributes,
)
from pactline.operators.joins import BROADCAST_BYTES, BROADCAST_ROWS, hashed, measure
from pactline.operators.partitions import cut


@dataclass(frozen=True)
class BlastRadius:
    reports: DataFrame
    consumers: DataFrame


def scored_consumers(
    requests: DataFrame, nodes: DataFrame, edges: DataFrame, max_depth: int = 5
) -> DataFrame:
    """Scored nodes per change for requests that already carry their ``source`` node.

    Changes of the same topic share one walk through the graph.
    """
    asked = cut(requests.select("change_id", "source", "changed_fields"), "requests")
    return _scored(walk(edges, asked, max_depth), asked, nodes)


def _scored(
    walked: Walk, requests: DataFrame, nodes: DataFrame, impacted_only: bool = False
) -> DataFrame:
    """Scored nodes per change; on request without those that no change has an impact on."""
    reached = with_node_attributes(walked.numbered_nodes(), nodes).withColumnRenamed("source", "__walk")
    if impacted_only:
        reached = reached.filter(may_be_impacted(F.col("fields"), F.col("depth")))
    # The changes take the number of their source, so rows meet them by number and move once at most;
    # few changes go to the rows, which are many and would meet at a few sources.
    numbers = walked.names.select(F.col("source").alias("__walk"), F.col("name").alias("source"))
    asked = requests.select("change_id", "source", "changed_fields").join(numbers, "source")
    rows, size = measure(requests.select("change_id", "source", "changed_fields"))
    few = rows <= BROADCAST_ROWS and size <= BROADCAST_BYTES
    asked = F.broadcast(asked) if few else hashed(asked, size)
    return score(reached.join(asked, "__walk")).drop("changed_fields", "__walk")


def blast_radius(
    requests: DataFrame,
    nodes: DataFrame,
    edges: DataFrame,
    namespace: str,
    max_depth: int = 5,
) -> BlastRadius:
    """Reports and impacted consumers of requests (change_id, topic, changed_fields[, added_fields]).

    Added fields are accepted and have no influence. ``nodes`` lists every edge endpoint (see
    ``sources.graph.complete_nodes``). A report is ``truncated`` if a deeper walk would reach more.
    Requests may have a ``namespace``: those of a namespace without nodes get the report of an empty
    graph. Without that column it is the whole graph that may be empty.
    """
    located = cut(with_graph_state(find_source_node(nodes, requests, namespace), nodes), "located")
    walked = walk(edges, located, max_depth)
    # Written once: the report reads a few of its columns three times, and only of impacted rows.
    scored = cut(affected(_scored(walked, located, nodes, impacted_only=True)), "scored")
    reports = report(located, scored).join(
        located.select("change_id", "source").join(walked.truncated(), "source").select(
            "change_id", "truncated"
        ),
        "change_id", "left",
    )
    return BlastRadius(
        reports.withColumn("truncated", F.coalesce("truncated", F.lit(False))), scored
    )
