"""Validity of numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_valid(c: Column) -> Column:
    """Neither null nor NaN nor infinite."""
    return F.coalesce(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), F.lit(False))


def number(c: Column) -> Column:
    """``c``, with NaN as null: so a comparison with it is not true, as in IEEE arithmetic (Spark puts NaN above all)."""
    return F.when(~F.isnan(c), c)


def rounded(c: Column, digits: int) -> Column:
    """``round(c, digits)`` of doubles: the same numbers, by arithmetic where that is sure, since ``round`` goes through decimals.

    A value too near the middle of two, or too large for its fraction to be seen, is left to ``round``.
    """
    scaled = c * F.lit(10.0**digits)
    whole = F.floor(scaled + 0.5)
    sure = (F.abs(scaled) < 1e9) & (F.abs(scaled - whole) < 0.499)
    return F.when(sure, whole / F.lit(10.0**digits)).otherwise(F.round(c, digits))
