"""Rounding that every engine repeats bit for bit."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scoreloom.functions.paths import _col


def rounded(value: Column | str, digits: int = 6) -> Column:
    """Nearest number with ``digits`` decimals, halves upwards, in plain double arithmetic.

    ``round`` goes through the shortest decimal text here and through other ways elsewhere, which differ on
    halves. Numbers too large to have such decimals stay as they are.
    """
    x = _col(value).cast("double")
    factor = 10.0**digits
    return F.when(F.abs(x) < 9e18 / factor, F.floor(x * factor + 0.5) / factor).otherwise(x)
