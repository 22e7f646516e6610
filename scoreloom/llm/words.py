"""Words of whole Arrow batches as numpy arrays, without a Python object per word.

A word is a maximal run of bytes for which ``table`` is true; words never cross rows. Word and n-gram hashes are 64 bits,
the same in every task. Work goes through slices of a quarter megabyte, so memory does not follow the batch.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

SLICE_BYTES = 1 << 18  # a slice's arrays take over a hundred times as much


def _trimmer() -> Callable[[], object]:
    try:
        trim = ctypes.CDLL(None).malloc_trim  # the C library that has it
    except (OSError, AttributeError):
        return lambda: None
    return lambda: trim(0)


_trim = _trimmer()


BATCH_ROWS = 1000
_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Hand texts to Python a thousand rows at a time, where the session has Spark's own number of ten thousand: batches are counted
    in rows, and buffers on both sides of the pipe grow with their bytes. Stays set, since results are computed later."""
    if spark.conf.get(_ROWS) == "10000":
        spark.conf.set(_ROWS, str(BATCH_ROWS))


def release() -> None:
    """Give freed memory back to the machine."""
    pa.default_memory_pool().release_unused()
    _trim()


def give_back(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A pass over batches after which the worker keeps no freed memory: workers are used again by other steps, or wait."""
    def passed(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            release()

    return passed


_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Everything but space and the control characters 9 to 13.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[32, 9, 10, 11, 12, 13]] = False

#: ASCII letters and digits, and every byte of a character beyond ASCII.
ALPHANUMERIC = np.zeros(256, dtype=bool)
ALPHANUMERIC[48:58] = ALPHANUMERIC[65:91] = ALPHANUMERIC[97:123] = ALPHANUMERIC[128:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit integers."""
    x = (x ^ (x >> np.uint64(32))) * _MIX
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return x ^ (x >> np.uint64(32))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


@dataclass
class Words:
    """``row`` (of the batch), byte range in ``data`` and hash of every word; ``first[i]:first[i + 1]`` are row i's words."""

    data: np.ndarray
    rows: range
    row: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray

    def stems(self, n: int, fold: np.ndarray = LOWER) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the first n bytes of each word as if they were a word, and whether the word is longer."""
        longer = self.end - self.start > n
        total = np.full(int(longer.sum()), n, dtype=np.uint64)
        for j, p in enumerate(powers(_BASE, n)):
            total += (fold[self.data[self.start[longer] + j]].astype(np.uint64) + np.uint64(1)) * p
        out = np.zeros(len(self.start), dtype=np.uint64)
        out[longer] = mix(total)
        return out, longer

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the n words from each word on, and whether they lie in one row."""
        m = len(self.hash)
        out = np.zeros(m, dtype=np.uint64)
        whole = np.zeros(m, dtype=bool)
        if m >= n:
            last = m - n + 1
            total = np.zeros(last, dtype=np.uint64)
            for j, p in enumerate(powers(_MIX, n + 1)[1:]):
                total += self.hash[j : j + last] * p
            out[:last] = mix(total)
            whole[:last] = self.row[:last] == self.row[n - 1 :]
        return out, whole


def word_hashes(texts: list[str], table: np.ndarray = NOT_SPACE, fold: np.ndarray = LOWER) -> np.ndarray:
    """Hashes of the words of a few texts."""
    return np.concatenate([np.zeros(0, dtype=np.uint64), *(w.hash for w in words(pa.array(texts, pa.string()), table, fold))])


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    if not len(column):
        return np.zeros(1, dtype=np.int64), np.zeros(0, dtype=np.uint8)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return offsets - offsets[0], data[offsets[0] : offsets[-1]]


def slices(column: pa.Array, size: int = SLICE_BYTES) -> Iterator[tuple[range, np.ndarray, np.ndarray]]:
    """Runs of rows of about ``size`` bytes: the rows, their offsets from 0, their bytes."""
    offsets, data = buffers(column)
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1)
        to = min(to, n)
        yield range(at, to), offsets[at : to + 1] - offsets[at], data[offsets[at] : offsets[to]]
        at = to


def words(column: pa.Array, table: np.ndarray = NOT_SPACE, fold: np.ndarray = LOWER, size: int = SLICE_BYTES) -> Iterator[Words]:
    """The words of a string column, in slices of rows. Hashes are of the bytes after ``fold`` (A-Z lowered)."""
    for rows, offsets, data in slices(column, size):
        inside = table[data]
        edge = np.zeros(len(data) + 1, dtype=bool)
        edge[offsets] = True
        before = np.empty_like(inside)
        before[:1], before[1:] = False, inside[:-1]
        start = np.flatnonzero(inside & (edge[:-1] | ~before))
        after = np.empty_like(inside)
        after[-1:], after[:-1] = False, inside[1:]
        end = np.flatnonzero(inside & (edge[1:] | ~after)) + 1
        row = np.searchsorted(offsets, start, side="right") - 1
        first = np.searchsorted(start, offsets)
        if len(start):
            length = end - start
            at = np.cumsum(length) - length
            power = powers(_BASE, int(length.max()) + 1)
            value = (fold[data[inside]].astype(np.uint64) + np.uint64(1)) * power[np.arange(int(length.sum())) - np.repeat(at, length)]
            hashed = mix(np.add.reduceat(value, at) + length.astype(np.uint64))
        else:
            hashed = np.zeros(0, dtype=np.uint64)
        yield Words(data, rows, row + rows.start, start, end, hashed, first)
