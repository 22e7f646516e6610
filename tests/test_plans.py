"""What the physical plans must not do at scale."""

from __future__ import annotations

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from scoreloom.operators import compare, scoring
from scoreloom.operators.artifacts import with_output_path
from scoreloom.plans import patterns, reports
from scoreloom.session import materialise
from scoreloom.sources import files
from scoreloom.sources.models import LinearModel


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df):
    return len(re.findall(r"(?<!Broadcast)Exchange (?:hash|range|Round|Single)", plan(df)))


@pytest.fixture
def model():
    return LinearModel(np.zeros((2, 64)), np.zeros(2))


@pytest.fixture
def no_broadcast(spark):
    from scoreloom.session import session_conf

    with session_conf(spark, {"spark.sql.autoBroadcastJoinThreshold": -1}):
        yield


def test_scoring_is_narrow_and_reads_two_columns(data, model):
    rows = data.table("embeddings")
    for scored in (
        scoring.score_arrow(rows.select("vec_id", "embedding"), "embedding", model),
        scoring.score_native(rows.select("vec_id", "embedding"), "embedding", model),
        scoring.score_batches(rows.select("vec_id", "embedding"), "embedding", model, 64),
    ):
        assert exchanges(scored) == 0
        assert "ReadSchema: struct<vec_id:bigint,embedding:array<float>>" in plan(scored)


def test_ensemble_does_not_multiply_rows(data):
    from scoreloom.sources.models import Checkpoints

    rows = scoring.ensemble_logits(data.table("embeddings"), "embedding", Checkpoints(np.zeros((9, 2, 64)), np.zeros((9, 2)), (0, 1)))
    assert exchanges(rows) == 0 and "Generate" not in plan(rows)


def test_every_row_wanted_moves_no_payload(spark, data, no_broadcast):
    rows = materialise(spark.range(20).select(F.concat(F.lit("/p/"), "id").alias("path"), F.lit(b"x").alias("content")), "p")
    params, output = data.params(n_images=None), patterns.Output("/out", form="netpbm")
    assert exchanges(patterns._wanted(rows, rows.select("path"), params, output)) == 0


def test_the_cut_looks_at_paths_only(spark, data):
    rows = materialise(spark.range(20).select(F.concat(F.lit("/p/"), "id").alias("path"), F.lit(b"x").alias("content")), "p")
    params, output = data.params(n_images=5, num_partitions=None), patterns.Output("/out", form="netpbm")
    text = plan(patterns._wanted(rows, rows.select("path"), params, output))
    assert "BroadcastHashJoin" in text
    assert not re.search(r"(Sort|Exchange hashpartitioning|Exchange rangepartitioning)[^\n]*content", text)


def test_every_row_is_scored_once_per_model(spark, data):
    """One evaluation in Python for every model in the plan, whatever follows it."""
    models = {"score_arrow": 1, "score_batches": 1, "served_score": 1, "logit_ensemble": 1, "scorer_agreement": 2, "label_lookup": 1, "classify_pictures": 1}
    from scoreloom.catalogue import QUERIES

    for name, wanted in models.items():
        text = plan(QUERIES[name](spark, data.folder))
        assert len(re.findall(r"(?:ArrowEvalPython|BatchEvalPython|ArrowEvalPythonUDTF) \[|MapInArrow |MapInPandas ", text)) == wanted, name


def test_payload_join_shuffles_each_side_once(data, no_broadcast):
    left = data.table("labels").select("doc_id", "quality")
    joined = compare.join_payload(left, data.table("documents").select("doc_id", "text"), "doc_id")
    assert exchanges(joined) == 2


def test_no_nested_loops_or_products(spark, sf_dir):
    from scoreloom.catalogue import QUERIES

    for name, build in QUERIES.items():
        if name.startswith("run_d") or name in ("run_staged", "run_served", "run_ingest", "run_ingest_first"):
            continue  # these only read back a table
        text = plan(build(spark, sf_dir))
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text, name


def test_reports_hash_and_combine_first(data):
    events = data.table("events")
    for df in (
        reports.cold_warm(events, "user_id", reports.time_order("ts", "event_id"), "value"),
        reports.throughput(events, "user_id", "value"),
        reports.billed_time(events, "user_id", "event_type", "value", "signup", "error"),
        reports.phase_columns(events, "user_id", "event_type", "value", ["view"]),
    ):
        text = plan(df)
        assert "SortAggregate" not in text and "partial_" in text and exchanges(df) == 1


def test_usage_is_added_up_before_the_join(data, no_broadcast):
    df = reports.cost_report(
        data.table("lineitem"), data.table("part"), "l_returnflag", "l_partkey", "p_partkey", "l_quantity", "p_retailprice", "p_brand"
    )
    assert plan(df).count("partial_sum") >= 2
    assert "ReadSchema: struct<l_partkey:bigint,l_quantity:double,l_returnflag:string>" in plan(df)


def test_ordinals_keep_one_row_per_range_in_one_task(spark):
    df = with_output_path(files.path_table(spark, [f"/p/{i}" for i in range(50)]), "/out", "ordinal")
    text = plan(df)
    single = text[text.index("SinglePartition") :]
    assert "HashAggregate(keys=[_range" in single and text.count("SinglePartition") == 1


def test_sizes_need_no_content(data):
    assert "text" not in plan(reports.size_profile(data.table("documents"), "lang", "n_chars"))


def test_pictures_stay_where_they_are(spark, data, no_broadcast):
    """Predictions come to a table dealt by path: nothing moves or sorts above its scan."""
    rows = spark.range(40).select(F.concat(F.lit("/p/"), "id").alias("path"), F.lit(b"x").alias("content"))
    table = f"{data.params().schema}.payload"
    assert patterns.save_bucketed(rows.repartition(12, "path"), table, "path", 12) == 40
    predictions = materialise(rows.select("path", F.lit(1).alias("class_id")), "p")
    joined = compare.join_bucketed(predictions, spark.table(table))
    text = plan(joined)
    payload = text[text.index("ShuffledHashJoin") :]
    scan = next(line for line in payload.splitlines() if "content" in line and "Scan parquet" in line)
    assert exchanges(joined) == 1 and "Bucketed: true" in text and "SelectedBucketsCount: 12 out of 12" in scan
    assert not [line for line in payload.splitlines() if ("Exchange" in line or "Sort " in line) and "content" in line]
    assert joined.count() == 40


def test_the_model_step_may_ask_for_its_own_executors(spark):
    from pyspark.resource import ResourceProfileBuilder, TaskResourceRequests

    profile = ResourceProfileBuilder().require(TaskResourceRequests().cpus(2)).build
    model = LinearModel(np.zeros((2, 12)), np.zeros(2), {})
    pictures = spark.createDataFrame([], "path string, small binary, error string")
    plain, asked = (scoring.score_decoded(pictures, model, profile=p) for p in (None, profile))
    node = lambda df: df._jdf.queryExecution().sparkPlan().toString()
    assert "task resources: cpus -> name: cpus, amount: 2.0" in node(asked) and "task resources" not in node(plain)
