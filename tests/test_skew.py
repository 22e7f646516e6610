"""The queries on tables where one key holds a third of all rows, with every join shuffled and tiny partitions."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry
from compare import TABLES, duck_rows, spark_rows
from scoreloom.session import session_conf

# Table to the select list that makes it skewed; the others are copied.
SKEWED = {
    "events": "* REPLACE (CASE WHEN event_id % 3 = 0 THEN 1 ELSE user_id END AS user_id)",
    "lineitem": "* REPLACE (CASE WHEN l_orderkey % 3 = 0 THEN 7 ELSE l_partkey END AS l_partkey)",
    "documents": "* REPLACE (CASE WHEN doc_id % 3 = 0 THEN 'en' ELSE lang END AS lang)",
    "pages": "* REPLACE (CASE WHEN page_id % 3 = 0 THEN 'https://hot.example.com/en/1' ELSE url END AS url)",
    "embeddings": "* REPLACE (CASE WHEN vec_id % 3 = 0 THEN 0 ELSE label END AS label)",
}
QUERIES = (
    "run_log phase_breakdown phase_columns throughput run_ranking dataset_delta scaling_report cold_warm best_by_scale "
    "billed_time cost_report scorer_agreement completeness missing_inputs join_payload size_profile name_clashes "
    "artifact_by_ordinal label_lookup model_by_alias weight_soup logit_ensemble run_ingest run_served incremental_score"
).split()

LARGE = {
    "spark.sql.autoBroadcastJoinThreshold": -1,
    "spark.sql.files.maxPartitionBytes": "64k",
    "spark.sql.files.openCostInBytes": "1k",
    "spark.sql.execution.arrow.maxRecordsPerBatch": 37,
}


@pytest.fixture(scope="module")
def skewed(tmp_path_factory, sf_dir):
    folder = str(tmp_path_factory.mktemp("skewed"))
    con = duckdb.connect()
    for name in TABLES:
        rows = f"SELECT {SKEWED.get(name, '*')} FROM read_parquet('{sf_dir}/{name}.parquet')"
        con.execute(f"COPY ({rows}) TO '{folder}/{name}.parquet' (FORMAT parquet)")
    return folder


@pytest.mark.parametrize("name", QUERIES)
def test_skewed_tables(spark, skewed, name):
    with session_conf(spark, LARGE):
        got = spark_rows(entry.queries()[name](spark, skewed))
    assert got == duck_rows(skewed, entry.oracle_sql()[name])
