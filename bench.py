"""Time every registered query and print one JSON line.

``BENCH_SF_DIR`` is the data folder, ``BENCH_CPUS`` the number of local threads, ``BENCH_QUERIES`` an optional
comma-separated choice. Files and models that the queries share are made first; that time (``setup_sec``) is in the total. Every
query runs ``BENCH_ROUNDS`` times (2); its best time counts.
"""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession

from scoreloom.catalogue import QUERIES, inputs

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
ROUNDS = int(os.environ.get("BENCH_ROUNDS", "2"))
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = ("run_direct_ordinal", "run_direct", "run_ingest", "run_staged", "run_served")


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("scoreloom-bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", os.environ.get("BENCH_CHECKPOINT_DIR") or tempfile.mkdtemp(prefix="scoreloom-bench-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    chosen = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q] or list(QUERIES)

    begin = time.perf_counter()
    x = inputs(spark, FOLDER)
    pictures = x.table("embeddings").count()
    for name in ("page_folder", "picture_folder", "store", "vector_model", "picture_model", "staged_picture_model"):
        getattr(x, name)
    setup = time.perf_counter() - begin

    seconds = {}
    for name in chosen * ROUNDS:
        begin = time.perf_counter()
        QUERIES[name](spark, FOLDER).write.format("noop").mode("overwrite").save()
        took = round(time.perf_counter() - begin, 3)
        seconds[name] = min(took, seconds.get(name, took))
    print(json.dumps({
        "metric": "total_query_time", "value": round(setup + sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(FOLDER.rstrip("/")).removeprefix("sf"), "setup_sec": round(setup, 3), "cpus": int(CPUS),
        "pictures_per_sec": {n: round(pictures / seconds[n], 1) for n in RUNS if n in seconds},
    }))
    spark.stop()


if __name__ == "__main__":
    main()
