"""Whole runs from text parameters, as a job would start them."""

from __future__ import annotations

import json
import uuid

import numpy as np
import pytest

from scoreloom.functions import pixels
from scoreloom.plans import reports
from scoreloom.plans.jobs import PATTERNS, register_for_scoring_and_serving, run_job
from scoreloom.plans.runlog import RunLog
from scoreloom.sources.models import ModelStore, Preprocess


@pytest.fixture(scope="module")
def root(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("job")
    rng = np.random.default_rng(4)
    (base / "images").mkdir()
    for i in range(9):
        body = pixels.encode_image(rng.integers(0, 256, (6, 6, 3), dtype=np.uint8), "", "netpbm")
        (base / "images" / f"{i}.ppm").write_bytes(body)
    store = ModelStore(spark, f"{base}/models")
    rows = [(c, rng.normal(size=12).tolist(), 0.0) for c in range(3)]
    weights = spark.createDataFrame(rows, "class_id int, weights array<double>, bias double")
    labels = spark.createDataFrame([(0, "tench"), (1, "church"), (2, "gas pump")], "class_id int, label string")
    for _ in range(2):
        store.register("soup", weights, prep=Preprocess(2))
    assert register_for_scoring_and_serving(store, "soup", labels, "classifier", "classifier_serving") == ("1", "1")
    return base


def test_set_up(spark, root):
    store = ModelStore(spark, f"{root}/models")
    served = store.load("models:/classifier_serving@prod")
    direct = store.load("models:/classifier@prod")
    assert served.weights.tolist() == direct.weights.tolist() and served.labels == {0: "tench", 1: "church", 2: "gas pump"}
    tags = store.tags().where("name = 'classifier_serving'").collect()
    assert [(r["version"], r["key"], r["value"]) for r in tags] == [("1", "source_model", "classifier@prod v1")]


def test_all_six_patterns_agree_and_are_logged(spark, root):
    values = {
        "catalog": "", "schema": f"jobs_{uuid.uuid4().hex[:8]}", "dataset": "tiny", "image_dir": f"{root}/images",
        "image_glob": "*.ppm", "file_glob": "*.ppm", "n_images": "7", "num_partitions": "2",
    }
    seen = {}
    for pattern in PATTERNS:
        run = run_job(spark, pattern, values, str(root), form="netpbm")
        seen[pattern] = sorted((r.path, r.label, round(r.score, 9)) for r in run.table.collect())
        folder = root / f"bench_out_{pattern}" / "tiny"
        assert len(list((folder / "annotated").glob("*.ppm"))) == 7
        (result,) = (folder / "results").glob("results_*.json")
        assert json.loads(result.read_text()) == [run.summary]
    assert all(rows == seen["p1"] for rows in seen.values()) and len(seen["p1"]) == 7
    log = RunLog(spark, f"{root}/runs")
    assert {r.run_name for r in log.runs().collect()} == {f"{p}_tiny" for p in PATTERNS}
    shares = reports.phase_breakdown(log.phases(), "run_name", "phase", "seconds").collect()
    assert {r["phase"] for r in shares if r["run_name"] == "p6_tiny"} == {"img_to_b64", "model_call", "annotate_write"}
    ranks = reports.run_ranking(log.walls(), "run_name", "total_wall_s").collect()
    assert sorted(r["rank"] for r in ranks)[0] == 1 and len(ranks) == 6
    assert log.metrics().where("key = 'num_images'").agg({"value": "min"}).first()[0] == 7.0


def test_ingest_goes_on_in_a_later_session(spark, root):
    """A rerun finds nothing new, also when the catalog has forgotten the table."""
    values = {
        "catalog": "", "schema": f"jobs_{uuid.uuid4().hex[:8]}", "dataset": "again", "image_dir": f"{root}/images",
        "file_glob": "*.ppm", "n_images": "", "num_partitions": "2",
    }
    counts = []
    for forget in (False, True, True):
        if forget:
            spark.sql(f"DROP TABLE {values['schema']}.bench_again_binary")
        run = run_job(spark, "p4", values, str(root), log=False, form="netpbm")
        counts.append((run.summary["num_ingested"], run.summary["num_images"], run.table.count()))
    assert counts == [(9, 9, 9)] * 3


def test_unknown_pattern(spark, root):
    with pytest.raises(ValueError):
        run_job(spark, "p7", {}, str(root))
