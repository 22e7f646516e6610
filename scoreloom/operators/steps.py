"""Seconds and rows per step of a run, measured inside its tasks."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import NamedTuple

from pyspark import TaskContext
from pyspark.accumulators import AccumulatorParam
from pyspark.sql import SparkSession


class StepRow(NamedTuple):
    """What one attempt of one task spent on one step."""

    step: str
    stage: int
    partition: int
    attempt: int  # unique in the application
    seconds: float
    rows: int


class _Sums(AccumulatorParam):
    """Adds up dictionaries of (seconds, rows)."""

    def zero(self, value: dict) -> dict:
        return {}

    def addInPlace(self, value1: dict, value2: dict) -> dict:
        for key, (seconds, rows) in value2.items():
            before = value1.get(key, (0.0, 0))
            value1[key] = before[0] + seconds, before[1] + rows
        return value1


class StepTimes:
    """Steps of the tasks, keyed by stage, partition and attempt; one entry per task and step reaches the driver.

    Only attempts that succeed report. One that is repeated, by speculation or after its result was lost, reports under another key,
    and ``rows`` keeps the last attempt of each partition, so nothing counts twice. The sums are over all tasks, so they may be
    more than the run took, and are never added to its wall time.
    """

    def __init__(self, spark: SparkSession | None = None, now: Callable[[], float] = time.perf_counter):
        self.sums = None if spark is None else spark.sparkContext.accumulator({}, _Sums())
        self.now = now

    @contextmanager
    def step(self, name: str, rows: int = 0) -> Iterator[None]:
        begin = self.now()
        yield
        if self.sums is not None:
            task = TaskContext.get()
            key = name, task.stageId(), task.partitionId(), task.taskAttemptId()
            self.sums.add({key: (self.now() - begin, rows)})

    def rows(self) -> list[StepRow]:
        """The attempt that counts of every step, stage and partition."""
        last: dict[tuple, StepRow] = {}
        for (step, stage, partition, attempt), (seconds, rows) in (self.sums.value if self.sums else {}).items():
            if (step, stage, partition) not in last or last[step, stage, partition].attempt < attempt:
                last[step, stage, partition] = StepRow(step, stage, partition, attempt, seconds, rows)
        return sorted(last.values())

    def summary(self) -> dict[str, float]:
        """``task_{step}_s``: seconds of all tasks together."""
        total: dict[str, float] = {}
        for row in self.rows():
            total[row.step] = total.get(row.step, 0.0) + row.seconds
        return {f"task_{step}_s": round(seconds, 3) for step, seconds in sorted(total.items())}
