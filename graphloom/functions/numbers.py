"""Small numeric expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(c: Column, low, high) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def snap(c: Column, grid: float) -> Column:
    """Nearest multiple of the grid width; halves go up."""
    return F.floor(c / F.lit(grid) + F.lit(0.5)) * F.lit(grid)


def call_weight(calls: Column) -> Column:
    """Weight of a call edge that stands for `calls` call sites."""
    return F.least(F.lit(3.0), F.lit(0.5) + F.lit(0.4) * calls)
