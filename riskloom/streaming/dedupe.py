"""Unique transaction ids within a bounded time."""

from __future__ import annotations

from pyspark.sql import DataFrame


def drop_duplicate_ids(rows: DataFrame, *, key: str, ts: str, lateness: str = "1 hour") -> DataFrame:
    """The first row of each id; ids are remembered until the watermark has passed them."""
    return rows.withWatermark(ts, lateness).dropDuplicatesWithinWatermark([key])
