"""Exact sums over columns that hold money as doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def cents(column: str | Column) -> Column:
    """A double rounded to two places as decimal(18,2), so that a sum doesn't depend on the partitioning."""
    return (F.col(column) if isinstance(column, str) else column).cast("decimal(18,2)")
