"""Text forms: base64, captions, run stamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scoreloom.functions.paths import _col

_UNIT = 1 << 56  # a percentage scaled by this power of two is a whole number that fits a bigint


def base64_text(content: Column | str) -> Column:
    """Base64 on one line; Spark breaks the text every 76 characters."""
    return F.replace(F.base64(_col(content)), F.lit("\r\n"), F.lit(""))


def base64_bytes(text: Column | str) -> Column:
    return F.unbase64(_col(text))


def percent_tenths(score: Column | str) -> Column:
    """``score`` in tenths of a percent, rounded as Python's ``.1%`` rounds it.

    Python multiplies by 100 and then rounds the exact binary value, half to even. Scaling by 2**56 loses
    nothing for a score in [0, 1], so the comparison with one half can be made in whole numbers.
    """
    scaled = (_col(score) * 100.0 * F.lit(float(_UNIT))).cast("bigint").cast("decimal(20,0)")
    tenfold = scaled * F.lit(10).cast("decimal(5,0)")
    unit = F.lit(str(_UNIT)).cast("decimal(20,0)")
    whole = F.call_function("div", tenfold, unit)
    rest = tenfold % unit
    up = (rest * 2 > unit) | ((rest * 2 == unit) & (whole % 2 == 1))
    return whole + up.cast("bigint")


def caption(label: Column | str, score: Column | str) -> Column:
    """``label (12.3%)``."""
    tenths = percent_tenths(score)
    return F.concat(
        _col(label), F.lit(" ("),
        F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit("%)"),
    )


def run_stamp(ts: Column | str) -> Column:
    """A time to the second, fit for a file name: ``2024-01-31T23-59-58``."""
    return F.translate(F.substring(_col(ts).cast("string"), 1, 19), " :", "T-")


def results_name(ts: Column | str) -> Column:
    return F.concat(F.lit("results_"), run_stamp(ts))
