"""Data contracts, masking, schema evolution and lineage impact on Spark DataFrames.

Every operator takes and returns DataFrames or Columns, so the same code runs in batch jobs and
inside Structured Streaming micro-batches.
"""

from pactline.session import configure

__all__ = ["configure"]
