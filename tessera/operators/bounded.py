"""Broadcasts only of what was counted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a few short columns that every executor can hold.
ROWS = 200_000


def broadcast(df: DataFrame, rows: int = ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most `rows` rows, else as it is: the planner and AQE choose the join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
