from __future__ import annotations

import uuid

import numpy as np
import pytest

from scoreloom.functions import pixels
from scoreloom.sources.models import LinearModel, Preprocess
from scoreloom.streaming import ingest as S


def put(folder, name, body):
    target = folder / name
    target.parent.mkdir(parents=True, exist_ok=True)
    target.write_bytes(body)


@pytest.fixture
def place(tmp_path):
    return tmp_path / "in", f"ingest_{uuid.uuid4().hex[:8]}", str(tmp_path / "checkpoint")


def test_each_file_lands_once(spark, place):
    folder, table, checkpoint = place
    for i in range(15):
        put(folder, f"d{i % 3}/{i}.jpg", bytes([i]))
    put(folder, "other.txt", b"x")
    for expected in (15, 15):
        S.ingest(spark, str(folder), table, checkpoint, "*.jpg", files_per_manifest=4)
        assert spark.table(table).count() == expected
    put(folder, "late/16.jpg", b"new")
    S.ingest(spark, str(folder), table, checkpoint, "*.jpg", files_per_manifest=4)
    rows = spark.table(table).collect()
    assert len(rows) == len({r.path for r in rows}) == 16
    assert spark.table(table).columns == ["path", "length", "content"]


def test_a_second_checkpoint_is_refused(spark, place, tmp_path):
    folder, table, checkpoint = place
    put(folder, "1.jpg", b"1")
    S.ingest(spark, str(folder), table, checkpoint)
    with pytest.raises(ValueError, match="is fed by the checkpoint"):
        S.ingest(spark, str(folder), table, str(tmp_path / "another"))


def test_manifests_name_the_files(spark, place, tmp_path):
    folder, table, checkpoint = place
    for i in range(6):
        put(folder, f"{i}.jpg", bytes([i]) * (i + 1))
    manifests = str(tmp_path / "manifests")
    for names, expected in ((range(4), 4), ((), 4), (range(4, 6), 6)):
        rows = [(f"file:{folder}/{i}.jpg",) for i in names]
        if rows:
            spark.createDataFrame(rows, "path string").repartition(2).write.mode("append").parquet(manifests)
        S.ingest_manifests(spark, manifests, table, checkpoint, manifests_per_batch=1)
        got = {r.path[-5]: (r.length, bytes(r.content)) for r in spark.table(table).collect()}
        assert got == {str(i): (i + 1, bytes([i]) * (i + 1)) for i in range(expected)}


def test_old_and_empty_files_are_not_lost(spark, place):
    """Copies that keep their times arrive with old ones; empty files and names with an underscore are files too."""
    import os
    import time

    folder, table, checkpoint = place
    put(folder, "1.jpg", b"1")
    S.ingest(spark, str(folder), table, checkpoint)
    for name, body in (("old.jpg", b"old"), ("empty.jpg", b""), ("_x.jpg", b"x")):
        put(folder, name, body)
        month_ago = time.time() - 30 * 86400
        os.utime(folder / name, (month_ago, month_ago))
    for _ in range(2):
        S.ingest(spark, str(folder), table, checkpoint)
        got = {r.path.rsplit("/", 1)[1]: bytes(r.content) for r in spark.table(table).collect()}
        assert got == {"1.jpg": b"1", "old.jpg": b"old", "empty.jpg": b"", "_x.jpg": b"x"}


def test_nothing_there_makes_an_empty_table(spark, place):
    folder, table, checkpoint = place
    S.ingest(spark, str(folder), table, checkpoint)
    assert spark.table(table).count() == 0
    put(folder, "1.jpg", b"1")
    S.ingest(spark, str(folder), table, checkpoint)
    assert spark.table(table).count() == 1


def test_a_crash_before_the_first_batch_leaves_the_table_bound(spark, place, tmp_path, monkeypatch):
    folder, table, checkpoint = place
    put(folder, "1.jpg", b"1")
    bind = S._bind

    def lost(*given):
        bind(*given)
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(S, "_bind", lost)
        with pytest.raises(RuntimeError):
            S.ingest(spark, str(folder), table, checkpoint)
    with pytest.raises(ValueError, match="is fed by the checkpoint"):
        S.ingest(spark, str(folder), table, str(tmp_path / "another"))
    put(folder, "2.jpg", b"2")
    S.ingest(spark, str(folder), table, checkpoint)
    assert spark.table(table).count() == 2


def test_bad_rows_are_not_tried_again(spark, place):
    folder, table, checkpoint = place
    put(folder, "bad.ppm", b"nothing")
    model = LinearModel(np.zeros((2, 12)), np.zeros(2), {}, Preprocess(2))
    S.ingest(spark, str(folder), table, checkpoint)
    for _ in range(2):
        S.score_new(spark, table, table + "_predictions", model, mode="PERMISSIVE")
        rows = spark.table(table + "_predictions").collect()
        assert [(r.label, bool(r.error)) for r in rows] == [(None, True)]


def test_only_new_rows_are_scored(spark, place):
    folder, table, checkpoint = place
    predictions = table + "_predictions"
    rng = np.random.default_rng(2)
    model = LinearModel(rng.normal(size=(2, 12)), np.zeros(2), {0: "a", 1: "b"}, Preprocess(2))

    def picture():
        return pixels.encode_image(rng.integers(0, 256, (3, 3, 3), dtype=np.uint8), "", "netpbm")

    for i in range(5):
        put(folder, f"{i}.ppm", picture())
    for new, expected in ((0, 5), (0, 5), (3, 8)):
        for i in range(new):
            put(folder, f"late{i}.ppm", picture())
        S.ingest(spark, str(folder), table, checkpoint)
        S.score_new(spark, table, predictions, model)
        rows = spark.table(predictions).collect()
        assert len(rows) == len({r.path for r in rows}) == expected
        assert {r.label for r in rows} <= {"a", "b"}
    assert S.prediction_rows(spark.table(predictions)).columns == ["path", "label", "confidence"]


def test_a_batch_stays_within_its_bytes(spark, place):
    """Small files share batches, larger ones have their own; what the stream takes in shows in its progress."""
    folder, table, checkpoint = place
    sizes = [7, 50, 50, 1, 0, 99, 100, 101, 400, 30, 30, 30, 30, 20, 45, 3]
    for i, size in enumerate(sizes):
        put(folder, f"{i:02}.jpg", b"x" * size)
    progress = S.ingest(spark, str(folder), table, checkpoint, batch_bytes=100)
    manifests = spark.read.schema(S.MANIFEST).option("recursiveFileLookup", "true").parquet(S._manifests(checkpoint))
    named = manifests.selectExpr("_metadata.file_path f", "length").groupBy("f").agg({"length": "sum", "*": "count"}).collect()
    assert sorted(b for b in (r["sum(length)"] for r in named) if b > 100) == [101, 400]
    taken = [p["numInputRows"] for p in progress if p["numInputRows"]]
    assert sorted(taken) == sorted(r["count(1)"] for r in named) and 6 < len(taken) < len(sizes)
    assert sorted(r.length for r in spark.table(table).collect()) == sorted(sizes)


def test_many_files_are_laid_out_by_tasks(spark, place, monkeypatch):
    folder, table, checkpoint = place
    monkeypatch.setattr(S, "DRIVER_ENTRIES", 3)
    for i in range(40):
        put(folder, f"{i:02}.jpg", b"x" * i)
    S.ingest(spark, str(folder), table, checkpoint, batch_bytes=120)
    manifests = spark.read.schema(S.MANIFEST).option("recursiveFileLookup", "true").parquet(S._manifests(checkpoint))
    named = manifests.selectExpr("_metadata.file_path f", "length", "slot").groupBy("f").agg({"length": "sum", "slot": "max"}).collect()
    assert 7 <= len(named) <= 20 and max(r["sum(length)"] for r in named) <= 120
    assert sorted(r.length for r in spark.table(table).collect()) == list(range(40))


def test_tasks_follow_bytes(spark, tmp_path):
    """Shares are cut by bytes: a task has no more than half a share beside one file."""
    rows = [(f"/p/{i:03}", 1 << 20 if i % 10 else 5 << 20) for i in range(100)]
    S.admit(spark.createDataFrame(rows, "path string, length long"), str(tmp_path / "m"), batch_bytes=1 << 30)
    named = spark.read.schema(S.MANIFEST).option("recursiveFileLookup", "true").parquet(str(tmp_path / "m"))
    shares = [r["sum(length)"] for r in named.groupBy("slot").agg({"length": "sum"}).collect()]
    half = -(-(1 << 30) // spark.sparkContext.defaultParallelism) // 2
    assert len(shares) == -(-140 * (1 << 20) // half) and max(shares) <= half + (5 << 20)


@pytest.mark.parametrize("few", [True, False])
def test_tasks_follow_the_number_of_small_files(spark, tmp_path, monkeypatch, few):
    """Opening a file has its cost: tens of thousands of tiny files are the work of many tasks, and of manifests of a bounded length."""
    if not few:
        monkeypatch.setattr(S, "DRIVER_ENTRIES", 100)
    rows = spark.range(9000).selectExpr("concat('/p/', lpad(id, 6, '0')) path", "77L length")
    S.admit(rows, str(tmp_path / "m"), files_per_manifest=4000)
    named = spark.read.schema(S.MANIFEST).option("recursiveFileLookup", "true").parquet(str(tmp_path / "m")).selectExpr("path", "slot", "_metadata.file_path f")
    files = [r["count"] for r in named.groupBy("f").count().collect()]
    tasks = [r["count"] for r in named.groupBy("f", "slot").count().collect()]
    assert sorted(files) == [1000, 4000, 4000]
    assert max(tasks) <= S.TASK_BYTES // 2 // S._OPEN_BYTES and len(tasks) >= 9
    assert named.select("path").distinct().count() == 9000


def test_a_manifest_is_read_by_several_tasks(spark, place, tmp_path, monkeypatch):
    """Files named by one small manifest are looked up once, and read and stored by several tasks."""
    folder, table, checkpoint = place
    monkeypatch.setattr(S, "_OPEN_BYTES", S.TASK_BYTES)  # capped at a sixteenth of a share
    for i in range(64):
        put(folder, f"{i:02}.jpg", bytes([i]))
    manifests = str(tmp_path / "named")
    spark.createDataFrame([(f"file:{folder}/{i:02}.jpg",) for i in range(64)], "path string").coalesce(1).write.parquet(manifests)
    S.ingest_manifests(spark, manifests, table, checkpoint)
    rows = spark.table(table).selectExpr("path", "content", "_metadata.file_path f").collect()
    assert sorted(bytes(r.content) for r in rows) == [bytes([i]) for i in range(64)]
    assert len({r.f for r in rows}) >= 4


def test_manifests_with_lengths_are_cut_too(spark, place, tmp_path):
    folder, table, checkpoint = place
    for i in range(6):
        put(folder, f"{i}.jpg", bytes([i]) * 10)
    manifests = str(tmp_path / "named")
    rows = [(f"file:{folder}/{i}.jpg", 10 if i % 2 else None) for i in range(6)]
    spark.createDataFrame(rows, "path string, length long").coalesce(1).write.parquet(manifests)
    progress = S.ingest_manifests(spark, manifests, table, checkpoint, batch_bytes=20)
    assert [p["numInputRows"] for p in progress if p["numInputRows"]] and max(p["numInputRows"] for p in progress) <= 2
    assert spark.table(table).count() == 6


def arrivals(folder, spark, table, checkpoint, rng, names):
    for name in names:
        put(folder, name, pixels.encode_image(rng.integers(0, 256, (3, 3, 3), dtype=np.uint8), "", "netpbm"))
    S.ingest(spark, str(folder), table, checkpoint)


def test_a_restart_between_score_and_ledger(spark, place, monkeypatch):
    folder, table, checkpoint = place
    predictions, rng = table + "_predictions", np.random.default_rng(2)
    model = LinearModel(rng.normal(size=(2, 12)), np.zeros(2), {0: "a", 1: "b"}, Preprocess(2))
    arrivals(folder, spark, table, checkpoint, rng, ("0.ppm", "1.ppm", "2.ppm"))

    def lost(*given):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(S, "write_file", lost)
        with pytest.raises(Exception, match="lost"):
            S.score_arrivals(spark, table, predictions, model, f"{checkpoint}-scoring")
    assert spark.table(predictions).count() == 3  # scored, not in the ledger
    for names, expected in (((), 3), (("3.ppm",), 4), ((), 4)):
        arrivals(folder, spark, table, checkpoint, rng, names)
        S.score_arrivals(spark, table, predictions, model, f"{checkpoint}-scoring")
        rows = spark.table(predictions).collect()
        assert len(rows) == len({r.path for r in rows}) == expected and {r.batch for r in rows} <= {0, 1}


def test_a_batch_in_the_ledger_is_not_scored_again(spark, place):
    """The stream forgets its last batch, as after a crash before its commit."""
    from pathlib import Path

    folder, table, checkpoint = place
    predictions, rng = table + "_predictions", np.random.default_rng(2)
    model = LinearModel(rng.normal(size=(2, 12)), np.zeros(2), {0: "a", 1: "b"}, Preprocess(2))
    arrivals(folder, spark, table, checkpoint, rng, ("0.ppm", "1.ppm"))
    S.score_arrivals(spark, table, predictions, model, f"{checkpoint}-scoring")
    for commit in Path(f"{checkpoint}-scoring/commits").glob("*0*"):
        commit.unlink()
    broken = LinearModel(np.zeros((1, 99)), np.zeros(1), {}, Preprocess(2))  # would fail if it were asked
    S.score_arrivals(spark, table, predictions, broken, f"{checkpoint}-scoring")
    assert spark.table(predictions).count() == 2
