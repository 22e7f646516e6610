from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from scoreloom.operators import scoring
from scoreloom.session import session_conf
from scoreloom.sources import models
from scoreloom.sources.models import ModelStore, Preprocess, average_weights, centroid_weights, label_map, stage_model


def weights(spark, value):
    return spark.createDataFrame([(0, [value, 1.0], 0.5), (1, [2.0, 3.0], value)], "class_id int, weights array<double>, bias double")


def labels(spark):
    return spark.createDataFrame([(0, "tench"), (1, "church")], "class_id int, label string")


@pytest.fixture
def store(spark, tmp_path):
    return ModelStore(spark, str(tmp_path / "store"))


def test_versions_count_up_and_compare_as_numbers(spark, store):
    for i in range(3):
        assert store.register("m", weights(spark, float(i)), labels(spark)) == str(i + 1)
    store.register("m", weights(spark, 9.0), version="9")
    assert store.register("m", weights(spark, 10.0)) == "10"
    assert store.register("m", weights(spark, 11.0)) == "11"
    assert store.register("other", weights(spark, 0.0)) == "1"
    assert store.latest("m").first()["version"] == 11


def test_alias_moves(spark, store):
    first = store.register("m", weights(spark, 1.0), labels(spark), prep=Preprocess(8, (0.1, 0.2, 0.3), (1.0, 2.0, 3.0)))
    second = store.register("m", weights(spark, 2.0))
    store.set_alias("m", "prod", first)
    model = store.load("models:/m@prod")
    assert model.weights.tolist() == [[1.0, 1.0], [2.0, 3.0]] and model.bias.tolist() == [0.5, 1.0]
    assert model.labels == {0: "tench", 1: "church"} and model.prep == Preprocess(8, (0.1, 0.2, 0.3), (1.0, 2.0, 3.0))
    store.set_alias("m", "prod", second)
    moved = store.load("models:/m@prod")
    assert moved.version == "2" and moved.label(1) == "1"
    assert store.load("models:/m/1").weights.tolist() == model.weights.tolist()


def test_bad_addresses(spark, store):
    store.register("m", weights(spark, 1.0))
    store.set_alias("m", "prod", "1")
    with pytest.raises(LookupError):
        store.load("models:/m@test")
    with pytest.raises(ValueError, match="not a model address"):
        store.load("m@prod")
    with pytest.raises(ValueError, match="holds 0 values"):
        store.load("models:/m/7")


def test_size_is_checked_before_loading(spark, store, monkeypatch):
    store.register("m", weights(spark, 1.0))
    monkeypatch.setattr(models, "MAX_MODEL_VALUES", 3)
    with pytest.raises(ValueError, match="holds 4 values"):
        store.load("models:/m/1")
    with pytest.raises(ValueError, match="holds 4 values"):
        store.load_versions("m")


def test_tags(spark, store):
    version = store.register("served", weights(spark, 1.0), tags={"source_model": "m@prod v1"})
    store.set_tag("served", version, "stage", "old")
    store.set_tag("served", version, "stage", "new")
    assert {r["key"]: r["value"] for r in store.tags().collect()} == {"source_model": "m@prod v1", "stage": "new"}


def test_missing_preprocessing_falls_back(spark, store):
    store.register("m", weights(spark, 1.0))
    assert store.load("models:/m/1").prep == Preprocess()


def test_lower_precision():
    model = models.LinearModel(np.array([[0.1, 1 / 3]]), np.array([2.5005]))
    assert model.half().weights.tolist() == [[float(np.float16(0.1)), float(np.float16(1 / 3))]]
    assert model.rounded(2).weights.tolist() == [[0.1, 0.33]] and model.rounded(3).bias.tolist() == [2.501]


def test_staged_model_is_the_same(spark, store, tmp_path):
    store.register("m", weights(spark, 1.0), labels(spark), prep=Preprocess(4, (0.1, 0.2, 0.3), (1.0, 1.0, 2.0)))
    model = store.load("models:/m/1")
    staged = stage_model(spark, model, str(tmp_path / "staged"))
    back = staged.load()
    assert back.weights.tolist() == model.weights.tolist() and back.labels == model.labels
    assert back.prep == staged.prep == model.prep
    assert staged.load() is back  # once per process


def test_centroids_and_average(spark):
    rng = np.random.default_rng(1)
    data = [(i, i % 3, i % 2, rng.normal(size=4).tolist()) for i in range(60)]
    df = spark.createDataFrame(data, "i int, label int, fold int, x array<double>")
    got = {r.class_id: r for r in centroid_weights(df, "x", "label").collect()}
    for c in range(3):
        mean = np.mean([d[3] for d in data if d[1] == c], axis=0)
        assert np.allclose(got[c].weights, mean) and got[c].bias == pytest.approx(-0.5 * mean @ mean)
    folds = centroid_weights(df, "x", "label", "fold")
    soup = {r.class_id: r for r in average_weights(folds).collect()}
    for c in range(3):
        parts = [np.mean([d[3] for d in data if d[1] == c and d[2] == f], axis=0) for f in range(2)]
        assert np.allclose(soup[c].weights, np.mean(parts, axis=0))
        assert soup[c].bias == pytest.approx(np.mean([-0.5 * p @ p for p in parts]))


def test_label_map_and_inverse(spark):
    codes = spark.createDataFrame([(0, "n3"), (1, "n1"), (2, "n2")], "class_id int, code string")
    names = spark.createDataFrame([("n1", "church"), ("n3", "tench")], "code string, label string")
    rows = label_map(codes, names).orderBy("class_id").collect()
    assert [(r.class_id, r.code, r.label) for r in rows] == [(0, "n3", "tench"), (1, "n1", "church"), (2, "n2", "2")]
    assert {r.label: r.class_id for r in rows} == {"tench": 0, "church": 1, "2": 2}


def test_a_failed_registration_leaves_nothing_behind(spark, tmp_path, monkeypatch):
    store = ModelStore(spark, str(tmp_path / "store"))
    weights = spark.createDataFrame([(3, [1.0, 2.0], 0.5), (7, [3.0, 4.0], 1.5)], "class_id int, weights array<double>, bias double")
    with monkeypatch.context() as m:
        m.setattr(ModelStore, "_append_row", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            store.register("odd", weights)
    assert store.register("odd", weights) == "1"
    model = store.load("models:/odd/1")
    assert model.weights.shape == (2, 2) and model.classes == (3, 7)
    both = weights.withColumn("version", F.lit(1))
    for _ in range(2):
        store.register_all("many", both)
    assert store.weights().where("name = 'many'").count() == 2
    assert store.load_versions("many").classes == (3, 7)


@pytest.mark.parametrize("values", [8_000_000, 30])
def test_staged_blocks_are_the_same_model(spark, tmp_path, monkeypatch, values):
    """Also where each class has a file of its own; class ids with gaps keep their names."""
    monkeypatch.setattr(models, "BLOCK_VALUES", values)
    rng = np.random.default_rng(5)
    rows = [(c, rng.normal(size=12).tolist(), float(rng.normal())) for c in (0, 2, 3, 7, 9)]
    store = ModelStore(spark, f"{tmp_path}/models")
    labels = spark.createDataFrame([(0, "a"), (7, "h"), (8, "none")], "class_id int, label string")
    weights = spark.createDataFrame(rows, "class_id int, weights array<double>, bias double").repartition(3)
    store.register("m", weights, labels, prep=Preprocess(2, (0.1, 0.2, 0.3), (1.0, 2.0, 3.0)))
    staged, whole = store.stage("models:/m/1", f"{tmp_path}/blocks"), store.load("models:/m/1")
    ready, x = staged.load(), rng.normal(size=(20, 12))
    assert np.allclose(ready.logits(x), whole.logits(x)) and ready.classes == whole.classes
    assert [ready.label(c) for c in ready.classes] == [whole.label(c) for c in whole.classes] and staged.prep == whole.prep
    assert len(ready.blocks) == (1 if values > 30 else 3) and isinstance(ready.blocks[0], np.memmap)


def test_a_model_of_any_size_scores(spark, tmp_path):
    """More values than the driver would take."""
    width, classes = 75_264, 134
    assert width * classes > models.MAX_MODEL_VALUES
    store = ModelStore(spark, f"{tmp_path}/models")
    one_hot = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.when(i == F.col("id"), 1.0).otherwise(0.0))
    store.register("big", spark.range(0, classes, 1, 8).select(F.col("id").cast("int").alias("class_id"), one_hot.alias("weights"), F.lit(0.0).alias("bias")))
    with pytest.raises(ValueError, match="values"):
        store.load("models:/big/1")
    model = store.stage("models:/big/1", f"{tmp_path}/blocks")
    rows = spark.range(0, 20, 1, 2).select("id", F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.when(i == F.col("id") * 5, 9.0).otherwise(0.0)).alias("v"))
    with session_conf(spark, {"spark.sql.execution.arrow.maxRecordsPerBatch": 10}):
        got = {r.id: (r.class_id, round(r.score, 6)) for r in scoring.score_arrow(rows, "v", model).drop("v").collect()}
    assert got == {i: (5 * i, round(float(1 / (1 + (classes - 1) * np.exp(-9.0))), 6)) for i in range(20)}
