"""Classing operators: first non-zero of several RAG columns, sign, targets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_nonzero_class(values: Sequence[tuple[Column, str]], default_value: Column,
                        default_class: str) -> tuple[Column, Column]:
    """(value, class) of the first column whose value is non-zero.

    NULL (e.g. unparseable text) counts as "not non-zero" and falls through.
    """
    value_expr = None
    class_expr = None
    for col, cls in values:
        cond = F.coalesce(col != 0, F.lit(False))
        value_expr = F.when(cond, col) if value_expr is None else value_expr.when(cond, col)
        class_expr = F.when(cond, F.lit(cls)) if class_expr is None else class_expr.when(cond, F.lit(cls))
    return value_expr.otherwise(default_value), class_expr.otherwise(F.lit(default_class))


def rag_class(value: Column, amber_from: float, red_from: float,
              higher_is_worse: bool = True) -> Column:
    """Red/amber/green class from two thresholds."""
    if higher_is_worse:
        return (F.when(value >= red_from, "red").when(value >= amber_from, "amber")
                .when(value.isNotNull(), "green"))
    return (F.when(value <= red_from, "red").when(value <= amber_from, "amber")
            .when(value.isNotNull(), "green"))


def sign_state(value: Column) -> Column:
    return F.when(value < 0, "negative").when(value == 0, "zero").when(value > 0, "positive")


def target_interval(value: Column, target: Column, target_start: Column) -> tuple[Column, Column, Column]:
    """(from, to, gap): the target line runs from ``target_start`` (else the
    value) to the target; gap = value - target."""
    start = F.coalesce(target_start, value)
    return F.least(start, target), F.greatest(start, target), value - target


def in_band(value: Column, band_start: Column, band_end: Column) -> Column:
    """Value inside the metric's target band (NULL when no band is set)."""
    lo = F.least(band_start, band_end)
    hi = F.greatest(band_start, band_end)
    return F.when(band_start.isNull() | band_end.isNull(), F.lit(None).cast("boolean")) \
        .otherwise(value.between(lo, hi))


def threshold_class(value: Column, threshold: float, below: str = "warning", otherwise: str | None = None) -> Column:
    """Class from one threshold (e.g. ``< 95 -> 'warning'``)."""
    cls = F.when(value < threshold, F.lit(below))
    return cls.otherwise(F.lit(otherwise)) if otherwise is not None else cls
