from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from scoreloom.operators import sums
from scoreloom.sources.models import average_weights, centroid_weights


def expected(rows):
    """Mean by place over the arrays that have a number there."""
    out = {}
    for key in {k for k, v in rows if v is not None}:
        mine = [v for k, v in rows if k == key and v is not None]
        width = max(map(len, mine))
        at = lambda i: [v[i] for v in mine if i < len(v) and v[i] is not None]  # noqa: B023, E731
        out[key] = [sum(at(i)) / len(at(i)) if at(i) else None for i in range(width)]
    return out


@pytest.mark.parametrize("flush", [8_000_000, 10])
def test_means_match_a_plain_count(spark, monkeypatch, flush):
    monkeypatch.setattr(sums, "FLUSH_VALUES", flush)
    rng = np.random.default_rng(1)
    rows = [(int(rng.integers(0, 5)), [float(x) for x in rng.integers(0, 50, 6)]) for _ in range(400)]
    rows += [(7, None), (8, []), (None, [1.0, None]), (None, [3.0]), (9, [None]), (1, [1.0] * 9), (2, [2.0])]
    df = spark.createDataFrame(rows, "k int, v array<double>").repartition(7)
    got = {r.k: list(r.m) for r in sums.array_means(df, ["k"], "v", "m").collect()}
    want = expected(rows)
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert [None if x is None else round(x, 9) for x in got[k]] == [None if x is None else round(x, 9) for x in v], k


def test_one_row_per_class_and_task(spark):
    """The shuffles move whole arrays: no row per weight."""
    df = spark.range(0, 4000, 1, 8).select((F.col("id") % 3).cast("int").alias("label"), F.array_repeat(F.col("id").cast("double"), 500).alias("v"))
    text = centroid_weights(df, "v", "label")._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in text and text.count("Exchange hashpartitioning") == 2
    partial = sums.array_sums(df, ["label"], "v")
    assert partial.count() == 3 and {r.n for r in partial.collect()} == {1333, 1334}


def test_soup_of_large_checkpoints(spark):
    width = 200_000
    rows = spark.range(0, 12, 1, 4).select((F.col("id") % 2).cast("int").alias("class_id"), F.array_repeat(F.col("id").cast("double"), width).alias("weights"), F.col("id").cast("double").alias("bias"))
    got = {r.class_id: (len(r.weights), set(r.weights), r.bias) for r in average_weights(rows).collect()}
    assert got == {0: (width, {5.0}, 5.0), 1: (width, {6.0}, 6.0)}
    assert average_weights(rows.limit(0)).count() == 0
