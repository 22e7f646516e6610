"""Runs as rows: parameters, metrics and phases, in long form."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterable, Iterator, Mapping
from contextlib import contextmanager
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreloom.functions.numbers import rounded
from scoreloom.operators.steps import StepRow
from scoreloom.session import shared_uri
from scoreloom.sources.storage import write_file

RUNS = "run_id string, run_name string, pattern string, dataset string, logged_at timestamp"
ENTRIES = "run_id string, key string, value string"
METRICS = "run_id string, key string, value double"
TOTAL = "total_wall_s"
STEPS = "run_id string, step string, stage int, partition int, attempt long, seconds double, rows long"


@dataclass
class Clock:
    """Seconds per named phase, and since the start, by the clock ``now``."""

    now: Callable[[], float] = time.time
    phases: dict[str, float] = field(default_factory=dict)
    started: float = field(init=False)

    def __post_init__(self) -> None:
        self.started = self.now()

    @contextmanager
    def phase(self, name: str) -> Iterator[None]:
        begin = self.now()
        try:
            yield
        finally:
            self.phases[name] = self.phases.get(name, 0.0) + self.now() - begin

    def summary(self, rows: int, divisor: float | None = None) -> dict:
        """Phase seconds, wall seconds and rows per second; ``divisor`` replaces the wall in the rate."""
        wall = self.now() - self.started
        out = {f"{name}_s": round(s, 3) for name, s in self.phases.items()}
        out["total_wall_s"] = round(wall, 3)
        out["images_per_sec"] = rate(rows, wall if divisor is None else divisor)
        return out


def rate(rows: int, seconds: float) -> float:
    return round(rows / max(seconds, 1e-9), 2)


def numeric_entries(entries: DataFrame) -> DataFrame:
    """Entries whose text is a number, as metrics; the others are left out."""
    number = F.expr("try_cast(value AS double)")
    return entries.withColumn("value", number).where(F.col("value").isNotNull())


@dataclass(frozen=True)
class RunLog:
    """Append-only ``runs``, ``run_params``, ``run_metrics`` and ``run_steps`` below one folder.

    Metrics are of the whole run, its phases in wall seconds. Steps are what tasks spent, a row per stage, partition and attempt;
    they overlap in time, so they are a table of their own and no share of the wall.
    """

    spark: SparkSession
    root: str

    def log(self, summary: Mapping, params: Mapping, steps: Iterable[StepRow] = ()) -> str:
        """Record one run as ``{pattern}_{dataset}``; returns its id."""
        run_id = uuid.uuid4().hex
        name = f"{summary['pattern']}_{summary['dataset']}"
        head = (run_id, name, summary["pattern"], summary["dataset"], datetime.now(timezone.utc))
        metrics = [
            (run_id, k, float(v)) for k, v in summary.items() if type(v) in (int, float)
        ]
        self._append([(run_id, k, str(v)) for k, v in params.items()], ENTRIES, "run_params")
        self._append(metrics, METRICS, "run_metrics")
        self._append([(run_id, *s) for s in steps], STEPS, "run_steps")
        self._append([head], RUNS, "runs")
        return run_id

    def _append(self, rows: list, schema: str, table: str) -> None:
        self.spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{self.root}/{table}")

    def runs(self) -> DataFrame:
        return self.spark.read.schema(RUNS).parquet(f"{self.root}/runs")

    def params(self) -> DataFrame:
        return self.spark.read.schema(ENTRIES).parquet(f"{self.root}/run_params")

    def metrics(self) -> DataFrame:
        return self.spark.read.schema(METRICS).parquet(f"{self.root}/run_metrics")

    def phases(self) -> DataFrame:
        """``run_id, run_name, pattern, dataset, logged_at, phase, seconds``: what the reports read. Wall seconds only."""
        key = F.col("key")
        timed = self.metrics().where(F.endswith(key, F.lit("_s")) & (key != TOTAL) & ~F.startswith(key, F.lit("task_")))
        phase = F.regexp_replace("key", "_s$", "").alias("phase")
        return self.runs().join(timed.select("run_id", phase, F.col("value").alias("seconds")), "run_id")

    def shares(self) -> DataFrame:
        """``run_id, run_name, pattern, dataset, phase, seconds, share`` of the wall; what no phase covers is the phase
        ``other``, so the shares of a run add up to 1."""
        phases = self.phases().select("run_id", "phase", "seconds")
        wall = self.metrics().where(F.col("key") == TOTAL).select("run_id", F.col("value").alias("wall"))
        covered = phases.groupBy("run_id").agg(F.sum("seconds").alias("covered"))
        rest = wall.join(covered, "run_id", "left").select("run_id", F.lit("other").alias("phase"), (F.col("wall") - F.coalesce("covered", F.lit(0.0))).alias("seconds"))
        every = phases.unionByName(rest).join(wall, "run_id")
        share = F.when(F.col("wall") != 0, F.col("seconds") / F.col("wall"))
        named = self.runs().select("run_id", "run_name", "pattern", "dataset")
        return named.join(every.select("run_id", "phase", rounded("seconds", 3).alias("seconds"), rounded(share).alias("share")), "run_id")

    def steps(self) -> DataFrame:
        """``run_id, step, n_tasks, seconds, rows``: every partition of a stage counts once, with its last attempt."""
        once = self.spark.read.schema(STEPS).parquet(f"{self.root}/run_steps").groupBy("run_id", "step", "stage", "partition").agg(
            F.max_by(F.struct("seconds", "rows"), "attempt").alias("last")
        )
        return once.groupBy("run_id", "step").agg(
            F.count(F.lit(1)).alias("n_tasks"), rounded(F.sum("last.seconds"), 3).alias("seconds"), F.sum("last.rows").alias("rows")
        )

    def walls(self) -> DataFrame:
        """One row per run with ``num_images``, ``total_wall_s`` and ``images_per_sec``."""
        keys = ("num_images", "total_wall_s", "images_per_sec")
        value = lambda k: F.max(F.when(F.col("key") == k, F.col("value"))).alias(k)
        wide = self.metrics().groupBy("run_id").agg(*map(value, keys))
        return self.runs().join(wide, "run_id")


def export_summary(spark: SparkSession, summary: Mapping, folder: str, now: datetime | None = None) -> str:
    """Write the summary as a JSON list of one object, named by the UTC time to the second."""
    now = (now or datetime.now(timezone.utc)).astimezone(timezone.utc)
    target = f"{shared_uri(spark, folder).rstrip('/')}/results_{now:%Y-%m-%dT%H-%M-%S}.json"
    write_file(target, json.dumps([dict(summary)], indent=2).encode())
    return target
