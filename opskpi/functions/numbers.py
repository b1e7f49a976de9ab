"""Numeric helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def try_decimal(c: Column, precision: int = 18, scale: int = 2) -> Column:
    """Text/number to decimal; unparseable -> NULL."""
    return c.try_cast(f"decimal({precision},{scale})")


def qty_day_diff(a: Column, b: Column) -> Column:
    """Day difference of two *quantities* read as day numbers: floor(b) - floor(a)."""
    return (F.floor(b) - F.floor(a)).cast("bigint")
