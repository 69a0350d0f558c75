"""Reproducible pseudo-random columns.

Draws depend only on stable row identifiers, so a retried task, another partitioning or another
engine yields the same numbers. One md5 carries four 32-bit draws.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_32 = float(2**32)


def digest(*parts) -> Column:
    """md5 of the parts joined by ':'; plain Python values become literals."""
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.md5(F.concat_ws(":", *[c.cast("string") for c in cols]))


def hex_int(text: Column, start: int, length: int) -> Column:
    """Unsigned integer from `length` hex digits (1-based start)."""
    return F.conv(F.substring(text, start, length), 16, 10).cast("bigint")


def unit(hashed: Column, slot: int) -> Column:
    """Draw number `slot` (0..3) of a digest, in [0, 1)."""
    return hex_int(hashed, 1 + 8 * slot, 8) / F.lit(TWO_32)


def between(u: Column, low, high) -> Column:
    return low + u * (high - low)
