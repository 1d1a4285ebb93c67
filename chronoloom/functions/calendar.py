"""Cyclic encodings of a time within its day, week, month or year."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_MS = 86_400_000
#: The milliseconds of the step units.
UNITS = {"ms": 1, "s": 1000, "m": 60_000, "h": 3_600_000, "d": DAY_MS, "w": 7 * DAY_MS}


def _start(period: str, ts: Column) -> Column:
    return F.date_trunc(period, ts).cast("timestamp_ntz")


def offset_ms(ts: Column, period: str, step: str = "1ms") -> Column:
    """Milliseconds from the start of the period to ts, truncated to whole steps (since 1970; weeks begin on Monday)."""
    n, unit = re.fullmatch(r"(\d+)(ms|s|mo|m|h|d|w|y)", step).groups()
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    since = F.timestamp_diff("MILLISECOND", epoch, ts)
    if unit in ("mo", "y"):
        since = F.timestamp_diff("MILLISECOND", epoch, _start("month" if unit == "mo" else "year", ts))
    else:
        size, first = int(n) * UNITS[unit], 4 * DAY_MS if unit == "w" else 0  # 1970-01-05 was a Monday
        since = since - F.pmod(since - first, F.lit(size))
    return since - F.timestamp_diff("MILLISECOND", epoch, _start(period, ts))


def length_ms(ts: Column, period: str) -> Column:
    """The length of the period that ts lies in: a month's actual days, a year's 365 or 366."""
    if period == "day":
        return F.lit(DAY_MS).cast("long")
    if period == "week":
        return F.lit(7 * DAY_MS).cast("long")
    if period == "month":
        return F.dayofmonth(F.last_day(ts)).cast("long") * DAY_MS
    if period == "year":
        return F.dayofyear(F.make_date(F.year(ts), F.lit(12), F.lit(31))).cast("long") * DAY_MS
    raise ValueError(f"unknown period: {period}")


def cyclic(ts: Column, period: str, step: str = "1ms") -> tuple[Column, Column]:
    """The cosine and the sine of the place in the period."""
    angle = 2 * math.pi * offset_ms(ts, period, step) / length_ms(ts, period)
    return F.cos(angle).alias(f"{period}_cos"), F.sin(angle).alias(f"{period}_sin")
