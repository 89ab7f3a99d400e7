"""Broadcast only what has been measured."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import cut

MAX_ROWS = 50_000


def measured(df: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """``df``, materialised, with a broadcast hint if it has at most ``max_rows`` rows; else for an ordinary shuffle join."""
    df = cut(df)
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df
