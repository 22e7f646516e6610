from __future__ import annotations

import pytest

from scoreloom.session import (
    RunParams, make_namespace, output_table, parse_switch, quote_name, scratch_path, scratch_root, session_conf, shared_uri,
)

BASE = {"catalog": "c", "schema": "s", "dataset": "coco", "image_dir": "/d"}


def test_parameters_are_cast_once():
    p = RunParams.from_text(BASE | {"n_images": "12", "num_partitions": "3", "micro_batch": "4"})
    assert (p.n_images, p.num_partitions, p.micro_batch, p.write_workers) == (12, 3, 4, 32)
    assert RunParams.from_text(BASE).n_images is None
    assert RunParams.from_text(BASE | {"n_images": ""}).n_images is None
    assert p.model_uri == "models:/classifier@prod"
    for bad in ({"n_images": "many"}, {"num_partitions": "1.5"}, {"unknown": "1"}):
        with pytest.raises(ValueError):
            RunParams.from_text(BASE | bad)


def test_switch():
    assert parse_switch("true") and not parse_switch("false")
    with pytest.raises(ValueError):
        parse_switch("yes")


def test_names_are_quoted():
    p = RunParams.from_text(BASE)
    assert output_table(p, "p3", "predictions") == "`c`.`s`.`bench_p3_coco_predictions`"
    assert output_table(p, "", "binary") == "`c`.`s`.`bench_coco_binary`"
    assert quote_name("", "a`b") == "`a``b`"


def test_namespace_is_made_once(spark, tmp_path):
    for _ in range(2):
        make_namespace(spark, "odd_name", str(tmp_path / "odd"))
    assert spark.catalog.databaseExists("odd_name")


def test_scratch_follows_the_session(spark):
    assert scratch_root(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")
    assert scratch_path(spark, "a").startswith(scratch_root(spark) + "/")
    assert scratch_path(spark, "a") != scratch_path(spark, "a")


class Session:
    """Just enough of a session to ask for its scratch folder."""

    def __init__(self, master, app="app-1", **conf):
        values = {"spark.master": master, **conf}
        self.conf = type("Conf", (), {"get": staticmethod(lambda key, default=None: values.get(key, default))})
        self.sparkContext = type("Context", (), {"applicationId": app})


def test_own_scratch_only_in_a_local_session(monkeypatch, tmp_path):
    monkeypatch.setattr("tempfile.tempdir", str(tmp_path))
    root = scratch_root(Session("local[2]"))
    assert root.startswith(str(tmp_path)) and scratch_root(Session("local[2]")) == root
    assert scratch_root(Session("local[2]", app="app-2")) != root
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch_root(Session("spark://host:7077"))
    assert scratch_root(Session("spark://host:7077", **{"spark.checkpoint.dir": "hdfs://h/c/"})) == "hdfs://h/c"


def test_shared_uri(spark):
    assert shared_uri(spark, "/a/b") == "file:///a/b"
    assert shared_uri(spark, "s3://b/c") == "s3://b/c"


def test_session_conf_is_restored_after_an_error(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    with pytest.raises(RuntimeError), session_conf(spark, {"spark.sql.shuffle.partitions": 3}):
        assert spark.conf.get("spark.sql.shuffle.partitions") == "3"
        raise RuntimeError
    assert spark.conf.get("spark.sql.shuffle.partitions") == before
