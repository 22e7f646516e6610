"""Vectors as short codes: one codebook per part of the vector, fitted by active-entry Lloyd rounds in whole numbers.

A round sends the codebooks (some kilobytes) and the list of the entries that moved to every task. A part whose assigned
entry stayed where it was keeps its stored exact distance and compares only the moved entries with it; every other part
compares all entries. On equal distances the lower index wins. Each pass writes the rows with their new assignment and stored
distances, and beside them one row of sums per entry and task, from which the driver makes the next codebooks.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from scoreloom.session import drop_scratch, scratch_path, ship_package

# Fixed values of the code: parts of a vector, entries of a codebook, rounds, units of a component.
PARTS, ENTRIES, ROUNDS, UNIT = 8, 16, 6, 4096

LARGEST = 2.0**31  # components from here on count as not finite: their errors have no 64-bit value
_SMALL = 1 << 27  # whole numbers below it keep every squared distance of a vector within 64 bits
_BATCH = 4096  # rows that are compared at once
UNKNOWN = -1  # a stored distance that has no 64-bit value, or none yet: the part is compared with all entries

Books = list[list[list[int]]]  # by part, entry, position


def _sized(numbers: list | np.ndarray) -> np.ndarray:
    """Whole numbers as 64-bit ones where squares of differences fit, else as Python's own."""
    wide = np.array(numbers, dtype=object)
    return wide.astype(np.int64) if not wide.size or (abs(wide) < _SMALL).all() else wide


def whole_numbers(matrix: np.ndarray) -> np.ndarray:
    """floor(4096 * x), exactly."""
    if not matrix.size or np.abs(matrix).max() < _SMALL / UNIT:
        return np.floor(matrix.astype(np.float64) * UNIT).astype(np.int64)
    return np.array([[math.floor(Fraction(float(x)) * UNIT) for x in row] for row in matrix], dtype=object)


def distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of rows and entries, exact whole numbers."""
    if entries.dtype == object or x.dtype == object:
        x, entries = x.astype(object), entries.astype(object)
    return ((x[:, None, :] - entries[None, :, :]) ** 2).sum(axis=2)


def _nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    far = distances(x, entries)
    if not far.shape[1]:
        return np.zeros(len(x), dtype=np.int64), np.full(len(x), UNKNOWN)
    best = far.argmin(axis=1)  # the first of equals
    return best, far[np.arange(len(x)), best]


def assign(x: np.ndarray, entries: np.ndarray, moved: np.ndarray, code: np.ndarray, stored: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """New entry and distance of each row, and how many rows were compared with all entries.

    ``code`` and ``stored`` are what the rows had before ``moved`` entries moved; ``stored`` is the exact distance to the
    assigned entry, or UNKNOWN. An entry that stayed was no nearer before and is none now.
    """
    code, best = code.astype(np.int64), stored.astype(x.dtype if x.dtype == object or entries.dtype != object else object)
    anew = (stored == UNKNOWN) | moved[code]
    code, best = code.copy(), best.copy()
    if anew.any():
        code[anew], best[anew] = _nearest(x[anew], entries)
    if moved.any() and not anew.all():
        rest, ids = np.flatnonzero(~anew), np.flatnonzero(moved)
        place, far = _nearest(x[rest], entries[ids])
        closer = (far < best[rest]) | ((far == best[rest]) & (ids[place] < code[rest]))
        code[rest[closer]], best[rest[closer]] = ids[place[closer]], far[closer]
    return code, best, int(anew.sum())


def usable(vectors: DataFrame, column: str = "embedding") -> Column:
    """Whether a vector is there, cuts into equal parts, and holds finite numbers only."""
    sound = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < LARGEST))
    return F.coalesce(F.col(column).isNotNull() & (F.size(column) > 0) & (F.size(column) % PARTS == 0) & sound, F.lit(False))


def first_books(vectors: DataFrame) -> Books:
    """The parts of the vectors with the least identifiers; among equal identifiers the lesser vector comes first."""
    rows = vectors.orderBy(F.col("id").asc_nulls_last(), "vector").limit(ENTRIES).collect()
    if not rows:
        return [[] for _ in range(PARTS)]
    width = len(rows[0]["vector"]) // PARTS
    seeds = [[math.floor(Fraction(x) * UNIT) for x in r["vector"]] for r in rows if len(r["vector"]) == width * PARTS]
    return [[s[p * width : (p + 1) * width] for s in seeds] for p in range(PARTS)]


_FITS = 1 << 63


@dataclass
class _Tally:
    """What one task adds up: sums and counts by part and entry, and comparisons with all entries."""

    sums: dict[tuple[int, int], tuple[list[int], int]] = field(default_factory=dict)
    scanned: int = 0

    def add(self, part: int, code: np.ndarray, x: np.ndarray) -> None:
        for e in np.unique(code).tolist():
            mine = x[code == e]
            total, count = self.sums.get((part, e), ([0] * x.shape[1], 0))
            self.sums[part, e] = [a + int(b) for a, b in zip(total, mine.sum(axis=0))], count + len(mine)

    def columns(self) -> dict:
        keys = sorted(self.sums)
        return {
            "part": [p for p, _ in keys], "entry": [e for _, e in keys], "sums": [[Decimal(v) for v in self.sums[k][0]] for k in keys],
            "n": [self.sums[k][1] for k in keys], "scanned": [self.scanned, *[0] * (len(keys) - 1)][: len(keys)],
        }


def _written(rows: DataFrame) -> T.StructType:
    """What a pass writes: rows, and (with a part) sums."""
    added = "code binary, stored array<bigint>, error bigint, part int, entry int, sums array<decimal(38,0)>, n bigint, scanned bigint"
    return T.StructType([rows.schema[c] for c in ("id", "label", "vector")] + T._parse_datatype_string(added).fields)


def _pass(rows: DataFrame, books: Books, moved: list[list[int]]) -> DataFrame:
    """Rows with their new entries, and one row of sums per entry, part and task."""
    width = len(books[0][0])
    arrays = [_sized(b) for b in books]
    masks = [np.isin(np.arange(len(b)), m) for b, m in zip(books, moved)]
    out = _written(rows)
    kinds = to_arrow_schema(out)

    def shaped(n: int, columns: dict) -> pa.RecordBatch:
        made = [pa.nulls(n, f.type) if f.name not in columns else columns[f.name] for f in kinds]
        return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(made, kinds)], kinds.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = _Tally()
        for batch in batches:
            for at in range(0, batch.num_rows, _BATCH):
                yield assigned(batch.slice(at, _BATCH), tally)
        yield shaped(len(tally.sums), tally.columns())

    def assigned(part: pa.RecordBatch, tally: _Tally) -> pa.RecordBatch:
        n = part.num_rows
        whole = whole_numbers(part.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(n, PARTS * width))
        codes = np.frombuffer(b"".join(part.column("code").to_pylist()), dtype=np.uint8).reshape(n, PARTS)
        stored = part.column("stored").flatten().to_numpy(zero_copy_only=False).reshape(n, PARTS)
        new, far, error = np.empty((n, PARTS), dtype=np.uint8), np.empty((n, PARTS), dtype=np.int64), np.zeros(n, dtype=object)
        for p in range(PARTS):
            x = whole[:, p * width : (p + 1) * width]
            code, best, anew = assign(x, arrays[p], masks[p], codes[:, p], stored[:, p])
            tally.scanned += anew
            tally.add(p, code, x)
            new[:, p] = code
            far[:, p] = best if best.dtype != object else [b if b < _FITS else UNKNOWN for b in best]
            error = error + best
        return shaped(n, {
            "id": part.column("id"), "label": part.column("label"), "vector": part.column("vector"),
            "code": [r.tobytes() for r in new], "stored": far.tolist(), "error": [int(v) if v < _FITS else None for v in error],
        })

    return rows.mapInArrow(run, out)


def _next_books(written: DataFrame, books: Books) -> tuple[Books, list[list[int]], int]:
    """The codebooks after a round, which entries moved, and how many comparisons with all entries the round made. At most
    PARTS * ENTRIES rows of sums reach the driver."""
    width = len(books[0][0])
    added = [F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(width)]
    found = written.where("part is not null").groupBy("part", "entry").agg(*added, F.sum("n").alias("n"), F.sum("scanned").alias("scanned")).collect()
    new = [[list(e) for e in b] for b in books]
    for r in found:
        new[r["part"]][r["entry"]] = [int(r[f"s{i}"]) // r["n"] for i in range(width)]
    moved = [[e for e, (x, y) in enumerate(zip(a, b)) if x != y] for a, b in zip(books, new)]
    return new, moved, sum(r["scanned"] or 0 for r in found)


def fit(vectors: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, Books, list[int]]:
    """``id, label, vector, code, stored, error`` of every usable row after the last assignment, the final codebooks, and the
    comparisons with all entries that each pass made. ``vectors`` has ``id, label, vector``; each pass replaces the files
    of the one before."""
    spark = vectors.sparkSession
    books, kind = first_books(vectors), _written(vectors)
    if not books[0]:
        return spark.createDataFrame([], kind), books, []
    width = len(books[0][0])
    blank = F.lit(bytes(PARTS)), F.array_repeat(F.lit(UNKNOWN).cast("long"), PARTS)
    rows = vectors.where(F.size("vector") == PARTS * width).select("id", "label", "vector", blank[0].alias("code"), blank[1].alias("stored"))
    moved = [list(range(len(b))) for b in books]
    effort, path = [], None
    for number in range(rounds + 1):
        if any(moved):  # else nothing can change any more
            before, path = path, scratch_path(spark, f"codes-{number}")
            _pass(rows, books, moved).write.parquet(path)
            written = spark.read.schema(kind).parquet(path)
            rows = written.where("part is null").select("id", "label", "vector", "code", "stored", "error")
            following, moved, anew = _next_books(written, books)
            effort.append(anew)
            if before:
                drop_scratch(spark, before)
        if number < rounds and any(moved):
            books = following
    return rows, books, effort


def compress(vectors: DataFrame) -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256`` of every row whose vector is usable.

    Vectors that are null, empty, or hold a null, a non-finite component or one of 2^31 and more are left out, and so are those
    whose length is no multiple of 8 or differs from that of the least ``vec_id``. Components are exact at any size below that;
    an error beyond 64 bits is null. Repeated rows count as often as they are there; rows without ``vec_id`` are coded, but
    come last when codebooks start. With fewer than 16 rows codebooks have fewer entries. Null labels are one label; a sum of
    errors beyond 64 bits is null. An empty table gives no rows. Other columns are not read.
    """
    ship_package(vectors.sparkSession)
    kept = vectors.where(usable(vectors)).select(
        F.col("vec_id").cast("long").alias("id"), "label", F.col("embedding").alias("vector")
    )
    rows, books, _ = fit(kept)
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    total = F.when(F.count("error") == F.count(F.lit(1)), F.expr("try_cast(sum(cast(error as decimal(38,0))) as bigint)"))
    sums = rows.groupBy("label").agg(total.alias("label_error"))
    sums = sums.select(F.col("label").alias("_label"), "label_error")
    out = rows.join(sums, F.col("label").eqNullSafe(F.col("_label")), "left")
    return out.select(F.col("id").alias("vec_id"), F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def oracle(rounds: int = ROUNDS) -> str:
    """The same in SQL, with every part compared with every entry in each round."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""far{r} AS (SELECT x.r, x.part, b.entry, list_sum(list_transform(list_zip(x.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
            FROM x JOIN book{r} b USING (part)),
        code{r} AS MATERIALIZED (SELECT r, part, min_by(entry, d * 16 + entry) AS entry, min(d) AS d FROM far{r} GROUP BY r, part)""")
        if r < rounds:
            steps.append(f"""sum{r} AS (SELECT part, entry, i, (sum(v[i]) - ((sum(v[i]) % count(*)) + count(*)) % count(*)) // count(*) AS m
            FROM x JOIN code{r} USING (r, part), range(1, (SELECT max(len(v)) FROM x) + 1) t(i) GROUP BY part, entry, i),
        new{r} AS (SELECT part, entry, list(m::BIGINT ORDER BY i) AS v FROM sum{r} GROUP BY part, entry),
        book{r + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(n.v, b.v) AS v FROM book{r} b LEFT JOIN new{r} n USING (part, entry))""")
    return f"""WITH kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label,
        list_transform(embedding, lambda c: CAST(floor(4096 * CAST(c AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
    x AS MATERIALIZED (SELECT r, part, v[part * (len(v) // {PARTS}) + 1 : (part + 1) * (len(v) // {PARTS})] AS v FROM kept, range({PARTS}) p(part)),
    book0 AS MATERIALIZED (SELECT part, r - 1 AS entry, v FROM x WHERE r <= {ENTRIES}),
    {", ".join(steps)},
    digest AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM book{rounds}),
    coded AS (SELECT r, string_agg(lpad(to_hex(entry), 2, '0'), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM code{rounds} GROUP BY r)
    SELECT vec_id, lower(code) AS code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
    FROM kept JOIN coded USING (r), digest"""
