from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from scoreloom.operators import ordinals
from scoreloom.operators.ordinals import with_ordinal, with_rank
from scoreloom.session import session_conf
from scoreloom.sources import files


def test_ordinal_is_the_sorted_position(spark):
    paths = [f"/d/{random.Random(i).randrange(10**9):09d}-{i}" for i in range(5000)]
    df = spark.createDataFrame([(p,) for p in paths], "path string").repartition(13)
    got = {r.path: r.ordinal for r in with_ordinal(df, "path").collect()}
    assert got == {p: i for i, p in enumerate(sorted(paths))}


def test_rank_with_a_hot_value_and_nulls(spark):
    rng = random.Random(3)
    values = [7] * 2000 + [None] * 20 + [rng.randrange(500) for _ in range(4000)]
    df = spark.createDataFrame(list(enumerate(values)), "i int, v int").repartition(11)
    got = {r.i: r["rank"] for r in with_rank(df, "v").collect()}
    df.createOrReplaceTempView("ranked_rows")
    want = {r.i: r.k for r in spark.sql("SELECT i, rank() OVER (ORDER BY v) AS k FROM ranked_rows").collect()}
    assert got == want


def test_first_n(spark):
    df = spark.range(3000).select(F.concat(F.lit("/p/"), F.lpad(F.col("id").cast("string"), 5, "0")).alias("path"))
    assert sorted(r.path for r in files.first_n(df, 700).collect()) == [f"/p/{i:05}" for i in range(700)]
    assert files.first_n(df, 5000).count() == 3000
    assert files.first_n(df, None).count() == 3000


def test_ordinal_of_nothing(spark):
    assert with_ordinal(files.path_table(spark, []), "path").collect() == []


@pytest.mark.parametrize("hot", [0, 1000])
def test_ranks_of_a_hot_value(spark, hot):
    """A third of the values are equal, or none; nulls share a rank as well."""
    rows = [(i, None if i % 50 == 7 else 5 if i < hot else i * 7919 % 3001) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, v long").repartition(8)
    ranked = ordinals.with_rank(df, "v")
    assert ranked.columns == ["id", "v", "rank"]
    key = lambda v: (v is not None, v or 0)
    values = sorted((v for _, v in rows), key=key)
    first = {}
    for at, v in enumerate(values):
        first.setdefault(v, at + 1)
    assert {r.id: r["rank"] for r in ranked.collect()} == {i: first[v] for i, v in rows}


def test_a_hot_value_is_many_tasks_work(spark):
    df = spark.range(0, 90_000, 1, 8).select(F.when(F.col("id") % 3 == 0, 1.0).otherwise(F.col("id").cast("double")).alias("wall"))
    with session_conf(spark, {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": -1}):
        ranked = ordinals.with_rank(df, "wall")
        text = ranked._jdf.queryExecution().executedPlan().toString()
        sizes = [r["n"] for r in ranked.groupBy(F.col("rank")).agg(F.count(F.lit(1)).alias("n")).collect()]
        ranges = [r["n"] for r in spark.read.parquet(*ranked.inputFiles()).groupBy("_range").agg(F.count(F.lit(1)).alias("n")).collect()]
    assert max(sizes) == 30_001 and len(sizes) == 60_000
    assert len(ranges) == 8 and max(ranges) <= 2 * sorted(ranges)[4]  # no task has the value to itself
    assert "hashpartitioning(wall" not in text

