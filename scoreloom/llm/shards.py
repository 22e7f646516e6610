"""A reproducible shuffle into shards: a Feistel permutation of global row numbers.

Rows are numbered in the order of ``doc_id``, then text size and checksum. The permutation maps numbers to numbers, so shard
and slot of any row can be computed from its number, the table's row count and the key, and back (``inverse``). It works
on a grid of a x b cells, a * b >= n; a number that lands beyond n walks on along its cycle until it lands inside.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scoreloom.operators.ordinals import with_ordinal
from scoreloom.session import materialise, ship_package

PRIME = 2**31 - 1
ROUNDS = 6


def round_keys(key: int, rounds: int = ROUNDS) -> list[tuple[int, int]]:
    """Multiplier and offset of each round, from a small linear generator."""
    out, x = [], key % PRIME
    for _ in range(rounds):
        x = (x * 48271 + 11) % PRIME
        y = (x * 69621 + 7) % PRIME
        out.append((x | 1, y))
    return out


def grid(n: int) -> tuple[int, int]:
    a = 1
    while a * a < n:
        a *= 2
    while a > 1 and (a - 1) * (a - 1) >= n:  # the square root, rounded up
        step = max(1, (a - int(np.sqrt(n))) // 2)
        a -= step if (a - step) * (a - step) >= n else 1
    return a, -(-n // a) if n else 1


def _mixed(x: np.ndarray, a: int, b: int) -> np.ndarray:
    x = (x + b) % PRIME
    x = x * x % PRIME
    return (x * (a % PRIME) + b) % PRIME


def _once(x: np.ndarray, a: int, b: int, keys: list[tuple[int, int]]) -> np.ndarray:
    """One pass over the grid: even rounds move the left part, odd rounds the right one."""
    left, right = x // b, x % b
    for i, (m, c) in enumerate(keys):
        if i % 2 == 0:
            left = (left + _mixed(right, m, c)) % a
        else:
            right = (right + _mixed(left, m, c)) % b
    return left * b + right


def _back(x: np.ndarray, a: int, b: int, keys: list[tuple[int, int]]) -> np.ndarray:
    left, right = x // b, x % b
    for i, (m, c) in reversed(list(enumerate(keys))):
        if i % 2 == 0:
            left = (left - _mixed(right, m, c)) % a
        else:
            right = (right - _mixed(left, m, c)) % b
    return left * b + right


def permute(x: np.ndarray, n: int, key: int, inverse: bool = False) -> np.ndarray:
    """The permutation of 0 .. n - 1, or its inverse."""
    a, b = grid(n)
    step, keys = (_back if inverse else _once), round_keys(key)
    out = step(np.asarray(x, dtype=np.int64), a, b, keys)
    while (far := out >= n).any():
        out[far] = step(out[far], a, b, keys)
    return out


def shard_rows(df: DataFrame, order: list[str], shards: int = 16, key: int = 42) -> DataFrame:
    """Add ``shard`` (0 to shards - 1, counts at most one apart) and ``slot`` (gapless from 0 in each shard).

    Rows are numbered in the order of the columns ``order``, nulls first; rows equal in all of them are alike and may swap
    numbers. Only what ``df`` holds is shuffled, once: pass narrow rows. An empty table stays empty.
    """
    ship_package(df.sparkSession)
    # rows alike in all columns of the order are spread by their place in the input, so that they don't meet in one range
    spread = df.withColumn("_order", F.struct(*order, F.xxhash64(F.monotonically_increasing_id()).alias("_spread")))
    numbered = materialise(with_ordinal(spread, "_order", "_number").drop("_order"), "numbered")
    n = numbered.count()

    def run(batches):
        for batch in batches:
            at = permute(batch.column("_number").to_numpy(zero_copy_only=False), n, key)
            rest = [(m, c) for m, c in zip(batch.schema.names, batch.columns) if m != "_number"]
            made = [pa.array(at % shards, pa.int32()), pa.array(at // shards, pa.int64())]
            yield pa.RecordBatch.from_arrays([*(c for _, c in rest), *made], [*(m for m, _ in rest), "shard", "slot"])

    kept = numbered.drop("_number").schema
    return numbered.mapInArrow(run, kept.add("shard", T.IntegerType()).add("slot", T.LongType()))


def shard_documents(docs: DataFrame, shards: int = 16, key: int = 42) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` of every row; law ``rows``.

    Size is the text's bytes in UTF-8 plus 1, so 1 for null and empty texts, whose checksum is 0. A null ``doc_id`` is
    numbered first. Repeated rows keep a slot each.
    """
    text = F.coalesce("text", F.lit(""))
    narrow = docs.select(
        "doc_id", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    out = shard_rows(narrow, ["doc_id", "size", "text_crc32"], shards, key)
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


def oracle(shards: int = 16, key: int = 42) -> str:
    """The same in SQL: rounds as nested selects, the walk as a recursion."""
    body = "SELECT k, x // b AS l, x % b AS r, a, b, n FROM {source}"
    for i, (m, c) in enumerate(round_keys(key)):
        mixed = lambda v: f"((((({v} + {c}) % {PRIME}) * (({v} + {c}) % {PRIME})) % {PRIME}) * {m % PRIME} + {c}) % {PRIME}"  # noqa: B023, E731
        new = f"(l + {mixed('r')}) % a AS l, r" if i % 2 == 0 else f"l, (r + {mixed('l')}) % b AS r"
        body = f"SELECT k, {new}, a, b, n FROM ({body})"
    step = f"SELECT k, l * b + r AS x, a, b, n FROM ({body})"
    return f"""WITH RECURSIVE rows AS (
        SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS size, coalesce(text, '') AS t FROM documents),
    numbered AS (SELECT doc_id, size, t, row_number() OVER (ORDER BY doc_id NULLS FIRST, size) - 1 AS k FROM rows),
    side AS (SELECT count(*) AS n, CAST(ceil(sqrt(count(*))) AS BIGINT) AS a FROM rows),
    walk AS (
        {step.format(source="(SELECT k, k AS x, a, CAST(ceil(n / a) AS BIGINT) AS b, n FROM numbered, side)")}
        UNION ALL {step.format(source="walk WHERE x >= n")}),
    placed AS (SELECT k, x FROM walk WHERE x < n)
    SELECT doc_id, CAST(size AS BIGINT) AS size, 'rows' AS law, CAST(x % {shards} AS INT) AS shard, CAST(x // {shards} AS BIGINT) AS slot,
        CAST(NULL AS INT) AS grown_shard FROM numbered JOIN placed USING (k)"""
