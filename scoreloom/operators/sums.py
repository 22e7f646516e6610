"""Sums of arrays by key: one row per key and task is shuffled, whatever the length of the arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from scoreloom.session import ship_package

FLUSH_VALUES = 8_000_000  # numbers a task holds before it hands on what it has
FAN_IN = 32  # partial sums that one step of the tree puts together

_SUMS = [T.StructField("total", T.ArrayType(T.DoubleType())), T.StructField("missing", T.ArrayType(T.LongType())), T.StructField("n", T.LongType())]


class _Sum:
    """Sum of arrays, how many there are, and (if any) how many lack each place."""

    def __init__(self):
        self.total, self.missing, self.n = np.zeros(0), None, 0

    def _fit(self, width: int) -> None:
        grown = width - len(self.total)
        if grown > 0:  # what came before lacks the new places
            if self.n:
                held = np.zeros(len(self.total), dtype=np.int64) if self.missing is None else self.missing
                self.missing = np.append(held, np.full(grown, self.n))
            self.total = np.append(self.total, np.zeros(grown))

    def add(self, total: np.ndarray, missing: np.ndarray | None, n: int) -> None:
        self._fit(len(total))
        lacking = len(self.total) - len(total)
        if missing is not None or lacking:
            held = np.zeros(len(self.total), dtype=np.int64) if self.missing is None else self.missing
            held[: len(total)] += 0 if missing is None else missing
            held[len(total) :] += n
            self.missing = held
        self.total[: len(total)] += total
        self.n += n


def _row_sums(column: pa.Array, rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray | None, int]]:
    """Totals of some rows of a list column: together where they are whole and of one length, else one by one."""
    some = column.take(pa.array(rows))
    sizes = some.value_lengths().to_numpy(zero_copy_only=False)
    values = some.flatten()
    if len(some) and values.null_count == 0 and (sizes == sizes[0]).all():
        yield values.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(some), -1).sum(axis=0), None, len(some)
        return
    for row in some:
        given = row.values.cast(pa.float64())
        gaps = given.is_null().to_numpy(zero_copy_only=False)
        yield given.fill_null(0.0).to_numpy(zero_copy_only=False), gaps.astype(np.int64) if gaps.any() else None, 1


def array_sums(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """``keys, total, missing, n``: per key the sum of the arrays by place, the number of arrays, and how many have no number at
    each place (null where all are whole). Null arrays don't count; a shorter array lacks its last places. Partial sums are
    merged in two steps, so no task has to take in those of all others."""
    ship_package(df.sparkSession)
    given = df.where(F.col(column).isNotNull()).select(*keys, column)
    kept = [given.schema[k] for k in keys]
    schema = T.StructType([*kept, *_SUMS])
    arrow = to_arrow_schema(schema)

    def batch(sums: dict[tuple, _Sum]) -> pa.RecordBatch:
        columns = [[k[i] for k in sums] for i in range(len(keys))]
        columns += [[s.total for s in sums.values()], [s.missing for s in sums.values()], [s.n for s in sums.values()]]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

    def named(part: pa.RecordBatch) -> dict[tuple, list[int]]:
        found: dict[tuple, list[int]] = {}
        for i, key in enumerate(zip(*(part.column(k).to_pylist() for k in keys))):
            found.setdefault(key, []).append(i)
        return found

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, _Sum] = {}
        for part in batches:
            for key, rows in named(part).items():
                for found in _row_sums(part.column(column), np.array(rows)):
                    sums.setdefault(key, _Sum()).add(*found)
            if sum(len(s.total) for s in sums.values()) > FLUSH_VALUES:
                yield batch(sums)
                sums = {}
        yield batch(sums)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by key."""
        sums: dict[tuple, _Sum] = {}
        for part in batches:
            for key, rows in named(part).items():
                if key not in sums:
                    if sums:
                        yield batch(sums)
                    sums = {key: _Sum()}
                for i in rows:
                    total, missing, n = (part.column(c)[i] for c in ("total", "missing", "n"))
                    gaps = None if missing.as_py() is None else missing.values.to_numpy()
                    sums[key].add(total.values.to_numpy(), gaps, n.as_py())
        yield batch(sums)

    first = given.mapInArrow(partial, schema).withColumn("_part", F.pmod(F.spark_partition_id(), F.lit(FAN_IN)))
    once = first.repartition(*keys, "_part").sortWithinPartitions(*keys, "_part").drop("_part").mapInArrow(merged, schema)
    return once.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(merged, schema)


def array_means(df: DataFrame, keys: list[str], column: str, out: str) -> DataFrame:
    """``keys, out``: the mean of the arrays by place, over those that have a number there; null where none has."""
    sums = array_sums(df, keys, column)
    mean = F.transform("total", lambda v, i: F.try_divide(v, F.col("n") - F.coalesce(F.get("missing", i), F.lit(0))))
    return sums.select(*keys, mean.alias(out))
