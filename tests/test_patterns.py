from __future__ import annotations

import json
import re

import numpy as np
import pytest

from test_images import jvm_image

from scoreloom.functions import pixels
from scoreloom.operators import scoring
from scoreloom.operators.artifacts import NameClash
from scoreloom.plans import patterns
from scoreloom.session import scratch_path
from scoreloom.sources import files
from scoreloom.sources.models import LinearModel, Preprocess, stage_model

MODEL = LinearModel(
    np.random.default_rng(3).normal(size=(3, 12)), np.zeros(3), {0: "tench", 1: "church"}, Preprocess(2)
)


def picture(seed, side=20):
    return np.random.default_rng(seed).integers(0, 256, (side, side + 3, 3), dtype=np.uint8)


@pytest.fixture
def folder(tmp_path):
    for i in range(12):
        target = tmp_path / "in" / f"s{i % 2}" / f"{i:02d}.ppm"
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(pixels.encode_image(picture(i), "", "netpbm"))
    return tmp_path / "in"


def truth(folder):
    out = {}
    for path in sorted(folder.rglob("*.ppm")):
        body = pixels.decode_image(path.read_bytes())
        z = MODEL.logits(pixels.to_tensor(body, 2, MODEL.prep.mean, MODEL.prep.std)[None])[0]
        out[str(path)] = (MODEL.label(int(z.argmax())), round(float(1 / np.exp(z - z.max()).sum()), 9))
    return out


def run_all(spark, data, folder, n, naming="basename", mode="FAILFAST"):
    def params():
        return data.params(
            image_dir=str(folder), image_glob="*/*.ppm", file_glob="*.ppm", n_images=n, num_partitions=3, micro_batch=5,
            dataset="d1", write_workers=2,
        )

    def output():
        return patterns.Output(scratch_path(spark, "annotated"), naming, form="netpbm", mode=mode)

    scoring.register_served(spark, "patterns_query", scoring.ServedImages(MODEL, 5, mode))
    staged_model = stage_model(spark, MODEL, scratch_path(spark, "m"))
    return {
        "direct": patterns.direct(spark, params(), staged_model, output()),
        "tree": patterns.direct(spark, params(), MODEL, output(), tree=True),
        "ingest": patterns.ingest_then_score(spark, params(), MODEL, output(), scratch_path(spark, "c")),
        "staged": patterns.staged(spark, params(), staged_model, output(), scratch_path(spark, "s"), batch_size=4, write_tasks=3),
        "served": patterns.served(spark, params(), "patterns_query", output()),
    }


@pytest.mark.parametrize("n", [None, 5, 100])
def test_all_patterns_give_the_same_labels(spark, data, folder, n):
    want = truth(folder)
    want = {p: want[p] for p in sorted(want)[:n]}
    for name, run in run_all(spark, data, folder, n).items():
        rows = run.table.collect()
        assert {r.path: (r.label, round(r.score, 9)) for r in rows} == want, name
        assert run.summary["num_images"] == len(want) == len(rows)
        assert run.summary["images_per_sec"] > 0
        for r in rows:
            body = open(r.output_path, "rb").read()
            assert f"# {r.label} ({r.score:.1%})\n".encode() in body[:60]
            assert (pixels.decode_image(body)[3, 3] == 0).all()


def test_no_files(spark, data, tmp_path):
    (tmp_path / "empty").mkdir()
    for name, run in run_all(spark, data, tmp_path / "empty", 5).items():
        assert run.table.collect() == [], name
        assert run.summary["num_images"] == 0


def test_a_manifest_needs_no_listing(spark, data, folder):
    want = truth(folder)
    paths = [(p, 1) for p in want]
    manifest = spark.createDataFrame(paths, "path string, length bigint")
    params = data.params(image_dir="/absent", n_images=10)
    run = patterns.direct(spark, params, MODEL, patterns.Output(scratch_path(spark, "a"), form="netpbm"), manifest=manifest)
    got = {r.path: (r.label, round(r.score, 9)) for r in run.table.collect()}
    assert got == {p: want[p] for p in sorted(want)[:10]}


def test_decoding_by_sparks_image_reader(spark, data, tmp_path):
    want = {}
    for i in range(6):
        target = tmp_path / "png" / f"s{i % 2}" / f"{i} a+b.png"
        target.parent.mkdir(parents=True, exist_ok=True)
        jvm_image(spark, target, picture(i, 9), "png")
        z = MODEL.logits(pixels.to_tensor(picture(i, 9), 2, MODEL.prep.mean, MODEL.prep.std)[None])[0]
        want[str(target)] = (MODEL.label(int(z.argmax())), round(float(1 / np.exp(z - z.max()).sum()), 9))
    (tmp_path / "png" / "s0" / "bad.png").write_bytes(b"no image")

    def go(mode, n=None):
        params = data.params(image_dir=str(tmp_path / "png"), image_glob="*/*.png", n_images=n)
        output = patterns.Output(scratch_path(spark, "a"), form="netpbm", mode=mode)
        return patterns.direct(spark, params, MODEL, output, jvm_decode=True).table.collect()

    rows = go("PERMISSIVE")
    assert {r.path: (r.label, round(r.score, 9)) for r in rows if r.error is None} == want
    assert [r.path for r in rows if r.error] == [str(tmp_path / "png" / "s0" / "bad.png")]
    assert len(go("PERMISSIVE", 3)) == 3
    with pytest.raises(Exception, match="not an image"):
        go("FAILFAST")


def test_ordinal_names(spark, data, folder):
    params = data.params(image_dir=str(folder), image_glob="*/*.ppm", n_images=7, write_workers=2)
    output = patterns.Output(scratch_path(spark, "annotated"), "ordinal", form="netpbm")
    run = patterns.direct(spark, params, MODEL, output, "p1")
    got = {r.path: r.output_path.rsplit("/", 1)[1] for r in run.table.collect()}
    assert got == {p: f"{i:06d}.ppm" for i, p in enumerate(sorted(truth(folder))[:7])}


def test_repeating_a_run_changes_nothing(spark, data, folder):
    params = data.params(image_dir=str(folder), image_glob="*/*.ppm", num_partitions=2)
    output = patterns.Output(scratch_path(spark, "annotated"), "relative", form="netpbm")
    states = []
    for _ in range(2):
        run = patterns.direct(spark, params, MODEL, output)
        states.append(sorted((r.output_path, r.label, open(r.output_path, "rb").read()) for r in run.table.collect()))
    assert states[0] == states[1] and len(states[0]) == 12


def test_a_bad_file(spark, data, folder):
    want = truth(folder)
    bad = str(folder / "s0" / "bad.ppm")
    (folder / "s0" / "bad.ppm").write_bytes(b"nothing")
    for name, run in run_all(spark, data, folder, None, mode="PERMISSIVE").items():
        rows = {r.path: r for r in run.table.collect()}
        assert {p: (r.label, round(r.score, 9)) for p, r in rows.items() if p != bad} == want, name
        assert rows[bad].label is None and rows[bad].score is None and rows[bad].output_path is None, name
        if name != "served":
            assert rows[bad].error, name
    params = data.params(image_dir=str(folder), image_glob="*/*.ppm", num_partitions=2)
    output = patterns.Output(scratch_path(spark, "annotated"), form="netpbm")
    for run in (
        lambda: patterns.direct(spark, params, MODEL, output),
        lambda: patterns.staged(spark, params, MODEL, output, scratch_path(spark, "s")),
    ):
        with pytest.raises(Exception, match="unknown image format"):
            run()


def test_a_file_that_is_gone(spark, data, folder):
    gone = str(folder / "s0" / "gone.ppm")
    manifest = spark.createDataFrame([(p, 1) for p in [*truth(folder), gone]], "path string, length bigint")
    params = data.params(image_dir="/absent")

    def go(mode):
        output = patterns.Output(scratch_path(spark, "a"), form="netpbm", mode=mode)
        return patterns.direct(spark, params, MODEL, output, manifest=manifest).table.collect()

    assert [r.path for r in go("PERMISSIVE") if r.error == "no content"] == [gone]
    with pytest.raises(Exception, match="gone.ppm"):
        go("FAILFAST")
    with pytest.raises(ValueError):
        patterns.direct(spark, params, MODEL, patterns.Output("/o"), manifest=manifest, jvm_decode=True)


def test_clashing_names_write_nothing(spark, data, folder):
    (folder / "s1" / "00.ppm").write_bytes((folder / "s0" / "00.ppm").read_bytes())
    params = data.params(image_dir=str(folder), image_glob="*/*.ppm")
    target = scratch_path(spark, "annotated")
    with pytest.raises(NameClash):
        patterns.direct(spark, params, MODEL, patterns.Output(target, form="netpbm"))


def test_tasks_by_bytes(spark, data, folder, monkeypatch):
    monkeypatch.setattr(files, "TASK_BYTES", 3000)
    size = sum(p.stat().st_size for p in folder.rglob("*.ppm"))
    for n, wanted, tasks in ((None, None, -(-size // 3000)), (None, 2, -(-size // 3000)), (None, 40, 40), (100, 40, 40)):
        params = data.params(image_dir=str(folder), image_glob="*/*.ppm", n_images=n, num_partitions=wanted)
        run = patterns.direct(spark, params, MODEL, patterns.Output(scratch_path(spark, "a"), form="netpbm"))
        assert run.summary["num_partitions"] == tasks and run.summary["num_images"] == 12


def test_summary_is_logged_and_exported(spark, tmp_path):
    from datetime import datetime, timedelta, timezone

    from scoreloom.plans.runlog import Clock, RunLog, export_summary, numeric_entries

    clock = Clock()
    with clock.phase("inference"):
        pass
    summary = {"pattern": "p3", "dataset": "coco", "num_images": 10, "flag": True} | clock.summary(10)
    assert set(summary) >= {"inference_s", "total_wall_s", "images_per_sec"}
    log = RunLog(spark, str(tmp_path / "runs"))
    ids = {log.log(summary, {"num_partitions": 128, "note": "x"}) for _ in range(2)}
    assert {r.run_name for r in log.runs().collect()} == {"p3_coco"} and len(ids) == 2
    keys = {r.key for r in log.metrics().collect()}
    assert keys == {"num_images", "inference_s", "total_wall_s", "images_per_sec"}
    assert {r.key for r in numeric_entries(log.params()).collect()} == {"num_partitions"}

    now = datetime(2024, 1, 31, 23, 59, 58, 987654, tzinfo=timezone(timedelta(hours=2)))
    target = export_summary(spark, summary, str(tmp_path / "results"), now)
    assert re.search(r"/results_2024-01-31T21-59-58\.json$", target)
    with open(target.removeprefix("file://")) as f:
        assert json.load(f) == [summary]


def test_steps_are_timed_in_the_tasks(spark, data, folder):
    params = data.params(image_dir=str(folder), image_glob="*/*.ppm")
    run = patterns.direct(spark, params, MODEL, patterns.Output(scratch_path(spark, "a"), form="netpbm"))
    assert run.summary["task_inference_s"] > 0 and run.summary["task_write_s"] > 0 and run.summary["task_model_s"] >= 0
    assert run.table.count() == 12


def test_steps_are_rows_by_stage_partition_and_attempt(spark, data, folder):
    """Every pattern reports what its tasks did; each picture counts once per step."""
    for name, run in run_all(spark, data, folder, None).items():
        assert sum(r.rows for r in run.steps if r.step == "write") == 12, name
        assert len({(r.step, r.stage, r.partition) for r in run.steps}) == len(run.steps)
        assert run.summary["task_write_s"] == round(sum(r.seconds for r in run.steps if r.step == "write"), 3)


def test_repeated_attempts_count_once(spark, tmp_path):
    from scoreloom.operators.steps import StepRow, StepTimes, _Sums
    from scoreloom.plans.runlog import Clock, RunLog

    steps = StepTimes()
    steps.sums = type("Held", (), {"value": {}})()
    for key, value in ((("write", 3, 0, 7), (2.0, 4)), (("write", 3, 0, 9), (5.0, 4)), (("write", 3, 1, 8), (1.0, 2)), (("write", 3, 1, 8), (1.0, 1))):
        _Sums().addInPlace(steps.sums.value, {key: value})
    assert steps.rows() == [StepRow("write", 3, 0, 9, 5.0, 4), StepRow("write", 3, 1, 8, 2.0, 3)]
    assert steps.summary() == {"task_write_s": 7.0}

    ticks = iter(range(0, 100, 5))
    clock = Clock(lambda: next(ticks))
    with clock.phase("inference_write"):
        pass
    summary = {"pattern": "p3", "dataset": "d", "num_images": 7} | clock.summary(7) | {"task_write_s": 700.0}
    log = RunLog(spark, str(tmp_path / "runs"))
    log.log(summary, {}, [*steps.rows(), StepRow("write", 3, 0, 7, 2.0, 4)])  # also where a log holds both attempts
    assert [(r.phase, r.seconds) for r in log.phases().collect()] == [("inference_write", 5.0)]
    assert {(r.phase, r.seconds, r.share) for r in log.shares().collect()} == {("inference_write", 5.0, 0.333333), ("other", 10.0, 0.666667)}
    assert [(r.step, r.n_tasks, r.seconds, r["rows"]) for r in log.steps().collect()] == [("write", 2, 7.0, 7)]


def test_staged_opens_and_decodes_each_file_once(spark, data, folder):
    """The model takes the files away before it answers, so that no later step can open them again."""
    import os
    from pathlib import Path

    inner = MODEL

    class Mover:
        prep = inner.prep

        def __init__(self, folder):
            self.folder = folder

        def load(self):
            return self

        def logits(self, batch):
            for path in Path(self.folder).rglob("*.ppm"):
                path.unlink(missing_ok=True)
            return inner.logits(batch)

        def label(self, index):
            return inner.label(index)

    want = truth(folder)
    before = {p: pixels.decode_image(open(p, "rb").read()) for p in want}
    params = data.params(image_dir=str(folder), image_glob="*/*.ppm", num_partitions=3, micro_batch=5)
    work = scratch_path(spark, "s")
    run = patterns.staged(spark, params, Mover(str(folder)), patterns.Output(scratch_path(spark, "a"), form="netpbm"), work, batch_size=4)
    assert not list(folder.rglob("*.ppm"))
    rows = run.table.collect()
    assert {r.path: (r.label, round(r.score, 9)) for r in rows} == want
    for r in rows:
        written = pixels.decode_image(open(r.output_path, "rb").read())
        assert (written[:2] == before[r.path][:2]).all()  # above the box
    assert sum(r.rows for r in run.steps if r.step == "decode") == 12
    assert not os.path.exists(f"{work}/decoded") and os.path.exists(f"{work}/scored")
