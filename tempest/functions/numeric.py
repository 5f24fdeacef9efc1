"""Numeric helpers shared by operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A value that sits exactly on a decimal tie (x.xx5) is stored as a double just above or
# just below it depending on summation order; adding 1e-11 before rounding sends every such
# tie up, independent of the order (half-up on the decimal value).
TIE_NUDGE = 1e-11


def round_half_up(c, digits: int) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c + F.lit(TIE_NUDGE), digits)
