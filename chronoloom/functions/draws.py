"""Random draws from a digest of what they belong to: alike on every run, whatever the partitions, and told alike by other engines."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def digest(*of: Column | str, seed: int) -> Column:
    """The MD5 of the values and the seed, joined by slashes, as hexadecimal digits."""
    parts = [(F.col(c) if isinstance(c, str) else c).cast("string") for c in of]
    return F.md5(F.concat_ws("/", *parts, F.lit(str(seed))))


def uniform(*of: Column | str, seed: int) -> Column:
    """A number in (0, 1): the first 52 bits of the digest."""
    return (F.conv(F.substring(digest(*of, seed=seed), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def normal(*of: Column | str, seed: int) -> Column:
    """A standard normal number from two uniform ones."""
    return F.sqrt(-2 * F.ln(uniform(*of, seed=seed))) * F.cos(2 * math.pi * uniform(*of, seed=seed + 1))
