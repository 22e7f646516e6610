"""Arrays of numbers as columns: normalisation, logits, softmax, argmax."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scoreloom.functions.paths import _col


def scale_and_normalise(values: Column | str, mean: float, std: float, top: float = 1.0) -> Column:
    """``(v / top - mean) / std`` for every element; ``top`` is 255 for byte pixels."""
    return F.transform(_col(values), lambda v: (v.cast("double") / F.lit(top) - F.lit(mean)) / F.lit(std))


def linear_logits(features: Column | str, rows: Column) -> Column:
    """One logit per class: ``w . x + b``. ``rows`` is an array of ``w, b``, one value for the whole table."""
    x = _col(features)
    dot = lambda w: F.aggregate(
        F.zip_with(w, x, lambda a, v: a * v.cast("double")), F.lit(0.0), lambda acc, v: acc + v
    )
    return F.transform(rows, lambda r: dot(r["w"]) + r["b"])


def best_class(logits: Column | str) -> Column:
    """Zero-based index of the largest logit; the first one on a tie."""
    z = _col(logits)
    return (F.array_position(z, F.array_max(z)) - 1).cast("int")


def softmax(logits: Column | str) -> Column:
    z = _col(logits)
    powers = F.transform(z, lambda v: F.exp(v - F.array_max(z)))
    return F.transform(powers, lambda p: p / F.aggregate(powers, F.lit(0.0), lambda acc, v: acc + v))


def confidence(logits: Column | str) -> Column:
    """Largest softmax value, without building the softmax."""
    z = _col(logits)
    return 1.0 / F.aggregate(z, F.lit(0.0), lambda acc, v: acc + F.exp(v - F.array_max(z)))
