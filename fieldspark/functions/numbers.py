"""Rounding as the source data was rounded: on the binary value, not on its decimal text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fixed(col: Column | str, digits: int) -> Column:
    """Nearest multiple of 10^-digits, halves away from zero.

    The built-in ``round`` works on the shortest decimal text, so 0.145 (binary 0.14499…) becomes 0.15 there, 0.14 here.
    """
    col = F.col(col) if isinstance(col, str) else col
    scale = float(10**digits)
    return F.signum(col) * F.floor(F.abs(col) * scale + 0.5) / scale + F.lit(0.0)


def whole(col: Column) -> Column:
    """Nearest whole number as a long, halves away from zero."""
    return fixed(col, 0).cast("long")
