"""Broadcasts behind a check of the size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Rows of a narrow table (requests, flags, offsets) that any executor can hold.
BROADCAST_ROWS = 100_000


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """The table marked for broadcast if it has at most ``rows`` rows, else unchanged.

    The check counts no further than the bound. Unmarked, the join is a shuffled one
    whose hot keys the adaptive optimizer splits.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
