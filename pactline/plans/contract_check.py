"""Validate, then mask: the path of a message from producer to sink."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pactline import types as t
from pactline.operators.masking import mask_messages, with_keys
from pactline.operators.validation import validate
from pactline.sources.sinks import outcome_rows


def check_and_mask(
    messages: DataFrame, enforcement: DataFrame, keys: DataFrame, **masking
) -> DataFrame:
    """Validated messages; those accepted are masked by their contract's policies.

    One scan and one narrow stage: contracts and keys are broadcast after their size is checked.
    Nothing is computed for messages that are not accepted; their masking columns are NULL.
    """
    validated = validate(messages, with_keys(enforcement, keys))
    return mask_messages(validated, only=F.col("status") == t.ACCEPTED, **masking)


def contract_outcomes(
    messages: DataFrame, enforcement: DataFrame, keys: DataFrame, *extra: str, **masking
) -> DataFrame:
    """Rows ready for :func:`pactline.sources.sinks.write_outcomes`."""
    return outcome_rows(check_and_mask(messages, enforcement, keys, **masking), *extra)
