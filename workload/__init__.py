"""Queries over the driver tables, their SQL counterparts, and the derived inputs they share."""
