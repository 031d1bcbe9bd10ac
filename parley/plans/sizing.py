"""Broadcast decisions with an explicit size bound.

A side is broadcast only when its row count is bounded: either by
construction (a fixed table, a top-k vocabulary) or by a count taken before
the join. Beyond the bound the join is left to a shuffle (sort-merge or
shuffled-hash, with AQE skew splitting).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Rows of a lookup side that may be shipped to every executor.
DEFAULT_BROADCAST_ROWS = 2_000_000


def broadcast_fixed(df: DataFrame, bound: int, what: str) -> DataFrame:
    """Broadcast a side whose size is bounded by construction (``bound`` rows,
    e.g. a 7-row language table or a ``limit(k)`` vocabulary)."""
    if bound > DEFAULT_BROADCAST_ROWS:
        raise ValueError(f"{what}: bound {bound} exceeds the broadcast limit")
    return F.broadcast(df)


def broadcast_if_small(df: DataFrame, what: str,
                       max_rows: int = DEFAULT_BROADCAST_ROWS) -> tuple[DataFrame, bool]:
    """Count the side (one cheap aggregate, only the row count leaves the
    cluster) and broadcast it only when it is within ``max_rows``."""
    n = df.count()
    if n <= max_rows:
        return F.broadcast(df), True
    return df, False
