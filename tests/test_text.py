from __future__ import annotations

import base64
import random

import pytest
from pyspark.sql import functions as F

from scoreloom.functions import paths as P
from scoreloom.functions import text


def test_caption_rounds_like_python(spark):
    rng = random.Random(7)
    scores = [0.0, 1.0, 0.0625, 0.1235, 0.1875, 0.3125, 0.9375, 0.0005, 0.9995, 0.9994999999, 1 / 3]
    scores += [k / 16 for k in range(17)] + [k / 2000 for k in range(2001)] + [rng.random() for _ in range(3000)]
    df = spark.createDataFrame([(i, "en", s) for i, s in enumerate(scores)], "i int, label string, s double")
    got = {r.i: r.c for r in df.select("i", text.caption("label", "s").alias("c")).collect()}
    assert got == {i: f"en ({s:.1%})" for i, s in enumerate(scores)}


def test_base64_has_no_line_breaks(spark):
    body = bytes(range(256)) * 5
    df = spark.createDataFrame([(bytearray(body),)], "content binary")
    row = df.select(text.base64_text("content").alias("t")).select("t", text.base64_bytes("t").alias("b")).first()
    assert row.t == base64.b64encode(body).decode()
    assert bytes(row.b) == body


@pytest.mark.parametrize(
    "path, bare",
    [
        ("file:/a/b.jpg", "/a/b.jpg"), ("file:///a/b.jpg", "/a/b.jpg"),
        ("/a/file:/b.jpg", "/a/file:/b.jpg"), ("s3://bucket/a.jpg", "s3://bucket/a.jpg"),
    ],
)
def test_normalise_path(spark, path, bare):
    assert spark.range(1).select(P.normalise_path(F.lit(path)).alias("p")).first().p == bare


def test_origin_is_decoded(spark):
    df = spark.range(1).select(P.origin_path(F.lit("file:///d/a%20b+c%25.png")).alias("p"))
    assert df.first().p == "/d/a b+c%.png"


@pytest.mark.parametrize(
    "path, root",
    [
        ("file:/a/b/a/b/c.jpg", "/a/b"), ("/a/b/a/b/c.jpg", "file:/a/b/"), ("hdfs://host:8020/a/b/a/b/c.jpg", "/a/b"),
        ("s3://a/b/a/b/c.jpg", "s3://a/b"),
    ],
)
def test_relative_path(spark, path, root):
    assert spark.range(1).select(P.relative_path(F.lit(path), root).alias("p")).first().p == "a/b/c.jpg"


def test_ordinal_names_keep_long_numbers(spark):
    df = spark.createDataFrame([(0,), (999999,), (1234567,)], "i long")
    names = [r.n for r in df.select(P.ordinal_name("i", ".jpg").alias("n")).collect()]
    assert names == [f"{i:06d}.jpg" for i in (0, 999999, 1234567)]


def test_names(spark):
    row = spark.range(1).select(
        P.base_name(F.lit("/a/b/c.jpg")).alias("b"), P.join_path("/out", F.lit("c.jpg")).alias("j"),
        text.results_name(F.lit("2024-01-31 23:59:58.987").cast("timestamp_ntz")).alias("r"),
    ).first()
    assert row == ("c.jpg", "/out/c.jpg", "results_2024-01-31T23-59-58")
