"""Reports on hand-made runs, with the edge cases the tables do not hold."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from scoreloom.operators import compare
from scoreloom.plans import reports


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_phases(spark):
    df = spark.createDataFrame(
        [("p1", "write", 635.0), ("p1", "infer", 75.0), ("p1", "infer", 30.0), ("p5", "idle", 0.0)], "run string, phase string, s double"
    )
    assert rows(reports.phase_breakdown(df, "run", "phase", "s")) == [
        ("p1", "infer", 105.0, 0.141892), ("p1", "write", 635.0, 0.858108), ("p5", "idle", 0.0, None)
    ]
    assert rows(reports.phase_columns(df, "run", "phase", "s", ["write", "infer"])) == [("p1", 635.0, 105.0, 0.0, 740.0), ("p5", 0.0, 0.0, 0.0, 0.0)]
    assert rows(reports.phase_columns(df, "run", "phase", "s", ["write"])) == [("p1", 635.0, 105.0, 740.0), ("p5", 0.0, 0.0, 0.0)]
    short = df.withColumn("s", F.col("s") * 1e-6)
    assert rows(reports.phase_breakdown(short, "run", "phase", "s"))[:2] == [("p1", "infer", 0.000105, 0.141892), ("p1", "write", 0.000635, 0.858108)]
    assert rows(reports.throughput(df, "run", "s")) == [("p1", 3, 740.0, 0.0), ("p5", 1, 0.0, 1e9)]


def test_ranking_shares_ranks(spark):
    df = spark.createDataFrame([("a", 350.0), ("b", 358.0), ("c", 358.0), ("d", 740.0)], "run string, s double")
    assert rows(reports.run_ranking(df, "run", "s")) == [
        ("a", 350.0, 1, 1.0), ("b", 358.0, 2, 1.022857), ("c", 358.0, 2, 1.022857), ("d", 740.0, 4, 2.114286)
    ]


def test_two_datasets(spark):
    df = spark.createDataFrame(
        [("p6", False, 100.0), ("p6", False, 108.0), ("p6", True, 195.0), ("p9", True, 1.0)], "p string, second boolean, s double"
    )
    assert rows(reports.dataset_delta(df, "p", F.col("second"), "s")) == [("p6", 104.0, 195.0, 87.5), ("p9", None, 1.0, None)]
    assert rows(reports.scaling_report(df, "p", F.col("second"), "s")) == [
        ("p6", 2, 1, 0.009615, 0.005128, 0.533333), ("p9", 0, 1, 0.0, 1.0, None)
    ]


def test_cold_and_warm(spark):
    t = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame(
        [("p2", t, 1, 358.0), ("p2", t, 2, 150.0), ("p2", t + dt.timedelta(1), 0, 160.0), ("p3", t, 1, 5.0)],
        "p string, ts timestamp_ntz, id int, s double",
    )
    assert rows(reports.cold_warm(df, "p", reports.time_order("ts", "id"), "s")) == [
        ("p2", 3, 358.0, 155.0, 2.309677, 2.386667), ("p3", 1, 5.0, None, None, 1.0)
    ]


def test_best_takes_the_name_on_a_tie(spark):
    df = spark.createDataFrame([(5, "b", 2.0), (5, "a", 2.0), (9, "b", 1.0), (9, "a", 3.0)], "n int, p string, s double")
    assert rows(reports.best_by_scale(df, "n", "p", "s")) == [(5, "a", 2.0), (9, "b", 1.0)]


def test_queue_is_not_billed(spark):
    df = spark.createDataFrame([("p1", "work", 629.0), ("p1", "start", 111.0), ("p1", "queue", 882.0)], "r string, p string, s double")
    assert rows(reports.billed_time(df, "r", "p", "s", "start", "queue")) == [("p1", 629.0, 111.0, 882.0, 1622.0, 740.0)]


def test_cost(spark):
    usage = spark.createDataFrame([("gpu", 1, 0.30), ("gpu", 1, 0.09), ("cpu", 2, 3.53)], "sku string, k int, u double")
    prices = spark.createDataFrame([(1, "P2", 0.65), (2, "P3", 0.45)], "pk int, run string, price double")
    assert rows(reports.cost_report(usage, prices, "sku", "k", "pk", "u", "price", "run")) == [
        ("cpu", "P3", 3.53, 1.59), ("gpu", "P2", 0.39, 0.25)
    ]


def test_sizes(spark):
    df = spark.createDataFrame([("a", 1024), ("a", 3072), ("b", 10)], "d string, length bigint")
    assert rows(reports.size_profile(df, "d")) == [("a", 2, 2.0, 1024, 3072), ("b", 1, 0.01, 10, 10)]


def test_completeness_counts_each_input_once(spark):
    inputs = spark.createDataFrame([("/a", "x"), ("/b", "x"), ("/c", "y")], "path string, g string")
    done = spark.createDataFrame([("/a", "l"), ("/a", "l"), ("/z", "l")], "path string, label string")
    assert rows(compare.completeness(inputs, done, "g")) == [("x", 2, 1, 1), ("y", 1, 0, 1)]
    assert rows(compare.missing(inputs, done).select("path")) == [("/b",), ("/c",)]
    assert compare.join_payload(done, inputs).count() == 2
