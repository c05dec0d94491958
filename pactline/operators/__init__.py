"""DataFrame operators, usable in batch jobs and inside micro-batches."""
