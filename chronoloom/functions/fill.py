"""Filling of missing values along a series, and division that never fails."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec


def fb(x: Column, w: WindowSpec) -> Column:
    """The last value so far; before the first value, the first one to come. Null only if the series has no value."""
    past = F.last(x, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    # where the past has no value, the first one to come is the first one of all: a frame that is the same for all rows is computed once
    first = F.first(x, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return F.coalesce(past, first)


def first_valid(x: Column, w: WindowSpec) -> Column:
    """The first value of the series, 0 if it has none."""
    return F.coalesce(F.first(x, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), F.lit(0.0))


def divide_or_zero(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0 or either is missing."""
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def rounded(x: Column, digits: int = 6) -> Column:
    """Rounded, with no negative zero."""
    return F.round(x, digits) + F.lit(0.0)
