from __future__ import annotations

import struct

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scoreloom.functions import tensors
from scoreloom.operators import compare, scoring
from scoreloom.sources.models import Checkpoints, LinearModel, Preprocess
from scoreloom.sources.storage import write_file


@pytest.fixture
def model():
    rng = np.random.default_rng(5)
    return LinearModel(rng.normal(size=(4, 6)), rng.normal(size=4), {0: "a", 1: "b", 3: "d"})


@pytest.fixture
def rows(spark):
    rng = np.random.default_rng(6)
    data = [(i, [float(np.float32(v)) for v in rng.normal(size=6)]) for i in range(300)]
    return spark.createDataFrame(data, "i int, x array<float>")


def brute(model, rows):
    out = {}
    for r in rows.collect():
        z = model.weights @ np.array(r.x) + model.bias
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        out[r.i] = (int(z.argmax()), round(float(p.max()), 9))
    return out


def test_three_scorers_agree_with_numpy(rows, model):
    want = brute(model, rows)
    scored = [
        scoring.score_native(rows, "x", model), scoring.score_arrow(rows, "x", model),
        scoring.score_batches(rows, "x", model, 6, batch_size=7), scoring.score_arrow(rows.repartition(5), "x", model),
    ]
    for df in scored:
        assert {r.i: (r.class_id, round(r.score, 9)) for r in df.collect()} == want


def test_ties_take_the_first_class(spark):
    model = LinearModel(np.zeros((3, 2)), np.array([1.0, 1.0, 0.0]))
    df = spark.createDataFrame([(0, [1.0, 2.0])], "i int, x array<float>")
    for scored in (scoring.score_native(df, "x", model), scoring.score_arrow(df, "x", model)):
        assert scored.first().class_id == 0


def test_null_vectors_stay_as_null_scores(spark, model):
    df = spark.createDataFrame([(0, [0.1] * 6), (1, None), (2, [0.2] * 6)], "i int, x array<float>").coalesce(1)
    got = {r.i: (r.class_id, r.score) for r in scoring.score_arrow(df, "x", model).collect()}
    assert got[1] == (None, None)
    z = model.weights @ np.full(6, np.float32(0.2), dtype=np.float64) + model.bias
    assert got[2][0] == z.argmax() and got[2][1] == pytest.approx(1 / np.exp(z - z.max()).sum())
    only_null = df.where("i = 1")
    assert [tuple(r) for r in scoring.score_arrow(only_null, "x", model).select("class_id", "score").collect()] == [(None, None)]


def test_softmax_and_confidence(spark):
    df = spark.createDataFrame([([1.0, 3.0, 2.0],), ([1000.0, 1000.0, -1000.0],)], "z array<double>")
    got = df.select(tensors.softmax("z").alias("p"), tensors.confidence("z").alias("c"), tensors.best_class("z").alias("k")).collect()
    for r in got:
        assert sum(r.p) == pytest.approx(1) and max(r.p) == pytest.approx(r.c)
    assert [r.k for r in got] == [1, 0]


def test_unknown_class_keeps_its_index(spark, model):
    df = spark.createDataFrame([(0,), (2,), (None,)], "class_id int")
    assert [r.label for r in scoring.with_label(df, model.labels).collect()] == ["a", "2", None]
    assert [r.label for r in scoring.with_label(df, {}).collect()] == ["0", "2", None]
    assert model.label(2) == "2" and model.label(3) == "d"


def test_served_in_sql(spark, rows, model):
    scoring.register_served(spark, "served_test", scoring.ServedVectors(model))
    rows.createOrReplaceTempView("served_rows")
    out = spark.sql("SELECT i, served_test(named_struct('features', x)) AS prediction FROM served_rows")
    assert out.schema["prediction"].dataType.simpleString() == "struct<label:string,score:double>"
    want = brute(model, rows)
    got = {r.i: (r.prediction.label, round(r.prediction.score, 9)) for r in out.collect()}
    assert got == {i: (model.label(c), s) for i, (c, s) in want.items()}


def test_null_input_gives_null_in_every_scorer(spark, model):
    """One rule: no vector, no prediction, and a completeness check finds the row."""
    rows = spark.createDataFrame([(0, [0.5] * 6), (1, None), (2, [1.0] * 6)], "i int, x array<double>").coalesce(1)
    scoring.register_served(spark, "served_null", scoring.ServedVectors(model))
    scoring.register_served(spark, "served_why", scoring.ServedVectors(model), errors=True)
    served = rows.selectExpr("i", "served_null(named_struct('features', x)) AS p").selectExpr("i", "p.label", "p.score")
    why = rows.selectExpr("i", "served_why(named_struct('features', x)) AS p").select("i", "p.*").orderBy("i").collect()
    assert [r.error for r in why] == [None, "no vector", None] and [r.class_id is None for r in why] == [False, True, False]
    batches = scoring.score_batches(rows, "x", model, 6)
    for scored in (served, batches, scoring.score_arrow(rows, "x", model), scoring.score_native(rows, "x", model)):
        assert [r.score is None for r in scored.orderBy("i").collect()] == [False, True, False]
    for labelled in (served, batches):
        assert [r.i for r in compare.missing(rows.select("i"), labelled, "i").collect()] == [1]
    parts = Checkpoints(model.weights[None], model.bias[None], tuple(range(len(model.bias))))
    assert [r.logits is None for r in scoring.ensemble_logits(rows, "x", parts).orderBy("i").collect()] == [False, True, False]


def test_failed_rows_are_not_scored(spark):
    inputs = spark.createDataFrame([(i, "g") for i in range(3)], "path int, g string")
    predictions = spark.createDataFrame([(0, "a"), (1, None)], "path int, label string")
    assert tuple(compare.completeness(inputs, predictions, "g").first()) == ("g", 3, 1, 2)
    assert sorted(r.path for r in compare.missing(inputs, predictions).collect()) == [1, 2]


def test_classes_that_are_not_consecutive(spark, rows, model):
    """Class ids are those of the model, not positions of its rows."""
    from dataclasses import replace

    ids = tuple(10 * i + 3 for i in range(len(model.bias)))
    odd = replace(model, classes=ids, labels={ids[0]: "first"})
    want = {i: ids[c] for i, (c, _) in brute(model, rows).items()}
    for scored in (scoring.score_arrow(rows, "x", odd), scoring.score_native(rows, "x", odd), scoring.score_batches(rows, "x", odd, 6)):
        assert {r.i: r.class_id for r in scored.collect()} == want
    labels = {r.label for r in scoring.score_batches(rows, "x", odd, 6).collect()}
    assert labels <= {"first", *map(str, ids)}


def test_soup_equals_ensemble_for_a_linear_model(spark, rows):
    rng = np.random.default_rng(8)
    parts = Checkpoints(rng.normal(size=(5, 3, 6)), rng.normal(size=(5, 3)), (0, 1, 2))
    soup = LinearModel(parts.weights.mean(axis=0), parts.bias.mean(axis=0))
    x = np.array([r.x for r in rows.orderBy("i").collect()])
    ensemble = np.array([[p.z for p in r.logits] for r in scoring.ensemble_logits(rows, "x", parts).orderBy("i").collect()])
    assert np.allclose(ensemble, soup.logits(x), atol=1e-9)


def test_ensemble_skips_unknown_classes():
    parts = Checkpoints(np.array([[[1.0], [2.0]], [[3.0], [np.nan]]]), np.array([[0.0, 0.0], [0.0, np.nan]]), (0, 1))
    assert parts.mean_logits(np.array([[1.0]])).tolist() == [[2.0, 2.0]]


def test_agreement_counts_nulls_as_equal(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (3, None), (4, None)], "path int, label string")
    b = spark.createDataFrame([(1, "x"), (2, "z"), (3, None), (4, "w")], "path int, label string")
    assert tuple(compare.agreement(a, b).first()) == (4, 2, 2, 0.5, 0, 0)
    assert tuple(compare.agreement(a.where("path > 1"), b.where("path < 4")).first()) == (2, 1, 1, 0.5, 1, 1)


def test_map_rows_keeps_columns_and_batches(spark):
    added = T.StructType([T.StructField("n", T.IntegerType())])
    df = spark.range(25).withColumn("t", F.lit("x")).coalesce(1)
    out = scoring.map_rows(df, added, lambda: lambda part: [[part.num_rows] * part.num_rows], 10, drop=["t"])
    assert out.columns == ["id", "n"]
    assert sorted(r.n for r in out.collect()) == [5] * 5 + [10] * 20
