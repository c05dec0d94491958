"""Decide on proposed schema changes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from pactline.operators.evolution import (
    affected_consumers,
    change_rows,
    changes_against_latest,
    gate,
)


@dataclass(frozen=True)
class GateResult:
    decisions: DataFrame
    changes: DataFrame
    consumers: DataFrame


def run_gate(
    proposals: DataFrame,
    contracts: DataFrame,
    versions: DataFrame,
    edges: DataFrame,
    strict_types: bool = False,
) -> GateResult:
    """Decisions (one row per proposal), their changes, and the consumers of breaking ones."""
    compared = changes_against_latest(proposals, contracts, versions, strict_types)
    return GateResult(
        decisions=gate(compared, edges),
        changes=change_rows(compared, "change_id"),
        consumers=affected_consumers(compared, edges),
    )
