from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from scoreloom.session import session_conf
from scoreloom.sources import artifact_set
from scoreloom.sources.artifact_set import SetWriter, recover_set, save_set


def bodies(spark, names, tasks=3):
    rows = [(n, n.encode() * 3) for n in names]
    return spark.createDataFrame(rows, "name string, body binary").repartition(tasks)


def content(folder):
    return {str(p.relative_to(folder)): p.read_bytes() for p in folder.rglob("*") if p.is_file()}


def hidden(folder):
    return [p.name for p in folder.parent.iterdir() if p.name.startswith(".")]


def test_a_set_replaces_the_one_before(spark, tmp_path):
    folder = tmp_path / "out"
    for names in (["a.ppm", "sub/b.ppm", "c d+e%.ppm"], ["a.ppm", "new.ppm"], []):
        save_set(bodies(spark, names), str(folder))
        assert content(folder) == {n: n.encode() * 3 for n in names} and not hidden(folder)


def test_an_aborted_job_leaves_the_old_set(spark, tmp_path):
    """One task has written before another fails."""
    folder = tmp_path / "out"
    save_set(bodies(spark, ["old1", "old2"]), str(folder))
    broken = bodies(spark, [f"new{i}" for i in range(40)], 4).withColumn("body", F.when(F.col("name") == "new39", F.raise_error(F.lit("lost")).cast("binary")).otherwise(F.col("body")))
    with session_conf(spark, {"spark.sql.execution.arrow.maxRecordsPerBatch": 1}), pytest.raises(Exception, match="lost"):
        save_set(broken, str(folder))
    assert set(content(folder)) == {"old1", "old2"}
    assert not [n for n in hidden(folder) if n.endswith(".old")]


def test_a_commit_that_was_lost_half_way(spark, tmp_path, monkeypatch):
    folder = tmp_path / "out"
    save_set(bodies(spark, ["old"]), str(folder))
    writer = SetWriter(str(folder))
    (tmp_path / writer.staged.rpartition("/")[2]).mkdir()
    moved = artifact_set.move_folder
    calls = []

    def move(a, b):
        calls.append(a)
        if len(calls) == 2:
            raise KeyboardInterrupt  # the driver is gone
        moved(a, b)

    monkeypatch.setattr(artifact_set, "move_folder", move)
    with pytest.raises(KeyboardInterrupt):
        writer.commit([])
    assert not folder.exists()
    recover_set(str(folder))
    assert set(content(folder)) == {"old"}


def test_only_whole_sets(spark, tmp_path):
    with pytest.raises(Exception, match="as a whole"):
        spark.dataSource.register(artifact_set.ArtifactSet)
        bodies(spark, ["a"]).write.format("artifact_set").mode("append").save(str(tmp_path / "out"))
