"""One-time set-up, and one scoring run from text parameters."""

from __future__ import annotations

import argparse
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreloom.operators.scoring import ServedImages, register_served
from scoreloom.plans import patterns
from scoreloom.plans.runlog import RunLog, export_summary
from scoreloom.session import RunParams, make_namespace, parse_switch, ship_package
from scoreloom.sources.models import ModelStore, Scorer

PATTERNS = ("p1", "p2", "p3", "p4", "p5", "p6")
SERVED_FUNCTION = "model_query"


def register_for_scoring_and_serving(
    store: ModelStore, source: str, labels: DataFrame, bench: str, serving: str, alias: str = "prod"
) -> tuple[str, str]:
    """Take the newest version of ``source``, stamp readable labels on it, and register it twice.

    ``bench`` is loaded by the batch patterns; ``serving`` is the form called from SQL and is tagged with the
    version it was made from. Both get the alias. Returns both version numbers.
    """
    newest = str(store.latest(source).first()["version"])
    one = (F.col("name") == source) & (F.col("version") == newest)
    weights = store.weights().where(one)
    prep = store.prep(source, newest)
    bench_version = store.register(bench, weights, labels, prep=prep)
    store.set_alias(bench, alias, bench_version)
    origin = {"source_model": f"{bench}@{alias} v{bench_version}"}
    serving_version = store.register(serving, weights, labels, prep=prep, tags=origin)
    store.set_alias(serving, alias, serving_version)
    return bench_version, serving_version


def output_folder(root: str, pattern: str, dataset: str) -> str:
    # Fixed format of the output folders.
    return f"{root.rstrip('/')}/bench_out_{pattern}/{dataset}"


def run_job(
    spark: SparkSession, pattern: str, values: Mapping[str, str], root: str, model: Scorer | None = None,
    log: bool = True, manifests: str | None = None, **output,
) -> patterns.Run:
    """Run one pattern from text parameters, with its outputs, run log and results below ``root``.

    Without ``model`` the address in the parameters is looked up in the model store at ``root/models``.
    A folder of ``manifests`` (Parquet files of ``path, length``) takes the place of a listing in every pattern.
    ``output`` passes on naming, form, extension, shards or mode of the artifacts.
    """
    if pattern not in PATTERNS:
        raise ValueError(f"pattern must be one of {PATTERNS}")
    ship_package(spark)
    params = RunParams.from_text(values)
    make_namespace(spark, params.schema, catalog=params.catalog)
    if model is None:
        model = ModelStore(spark, f"{root.rstrip('/')}/models").load(params.model_uri)
    folder = output_folder(root, pattern, params.dataset)
    naming = "ordinal" if pattern in ("p1", "p2") else "basename"
    manifest = None if manifests is None else spark.read.schema("path string, length long").parquet(manifests)
    where = patterns.Output(f"{folder}/annotated", **{"naming": naming, **output})
    if pattern == "p4":
        run = patterns.ingest_then_score(
            spark, params, model, where, f"{folder}/_ingest", location=f"{folder}/_binary", manifests=manifests
        )
    elif pattern == "p5":
        run = patterns.staged(spark, params, model, where, folder, manifest=manifest)
    elif pattern == "p6":
        register_served(spark, SERVED_FUNCTION, ServedImages(model, params.micro_batch, where.mode), errors=True)
        run = patterns.served(spark, params, SERVED_FUNCTION, where, manifest=manifest)
    else:
        run = patterns.direct(spark, params, model, where, pattern, manifest=manifest)
    if log:
        used = {
            "pattern": pattern, "dataset": params.dataset, "model_uri": params.model_uri,
            "num_partitions": params.num_partitions,
        }
        RunLog(spark, f"{root.rstrip('/')}/runs").log(run.summary, used, run.steps)
        export_summary(spark, run.summary, f"{folder}/results")
    return run


def main(arguments: list[str] | None = None) -> None:
    """``python -m scoreloom.plans.jobs p3 /shared/out schema=cv dataset=coco image_dir=/shared/images ...``"""
    parser = argparse.ArgumentParser(description="Run one batch-scoring pattern.")
    parser.add_argument("pattern", choices=PATTERNS)
    parser.add_argument("root")
    parser.add_argument("parameters", nargs="*", metavar="key=value")
    parser.add_argument("--log", default="true", type=parse_switch, metavar="true|false")
    given = parser.parse_args(arguments)
    values = dict(p.split("=", 1) for p in given.parameters)
    spark = SparkSession.builder.appName(f"scoreloom-{given.pattern}").getOrCreate()
    run = run_job(spark, given.pattern, {"catalog": "", **values}, given.root, log=given.log)
    print(run.summary)


if __name__ == "__main__":
    main()
