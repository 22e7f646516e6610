"""File collections as DataFrames."""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Iterator
from heapq import nsmallest
from itertools import islice
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from scoreloom.functions.paths import normalise_path, origin_path, relative_path
from scoreloom.functions.text import base64_text
from scoreloom.session import DEFAULT_MODEL_BATCH, materialise, payload_batches, shared_uri, ship_package
from scoreloom.sources.storage import IO_THREADS, file_size, io_map, list_folder, list_names, read_file, write_file

PATH_SCHEMA = T.StructType([T.StructField("path", T.StringType())])

TASK_BYTES = 512 << 20  # most input bytes of one task

DRIVER_ENTRIES = 10_000  # a tree of no more is listed by the driver
SPLIT = 200_000  # entries of one folder that one task lists; beyond that, tasks share it
_SAMPLED = 10_000  # names that say where the ranges begin
TOP_ROWS = 10_000  # rows that every task keeps when it looks for the first ones

_PIECE = T.StructType([
    T.StructField("path", T.StringType()), T.StructField("trail", T.ArrayType(T.StringType())), T.StructField("after", T.StringType()),
    T.StructField("until", T.StringType()),
])
_FOUND = T.StructType([*_PIECE.fields, T.StructField("kind", T.StringType()), T.StructField("length", T.LongType())])
_LISTED_FILES = T.StructType([T.StructField("path", T.StringType()), T.StructField("length", T.LongType())])
_BATCH_BYTES = 4 << 20  # of payload that a task holds at once, unless its files are larger


def binary_scan(spark: SparkSession, folder: str, glob: str | None = None, recursive: bool = True) -> DataFrame:
    """Files as ``path, length, content``, listed like everywhere else and read by the tasks that hold the paths.

    Where only names and lengths are wanted, ``list_files`` opens nothing.
    """
    listed = list_files(spark, folder, glob or "*", any_depth=recursive)
    return read_bytes(listed.repartition(tasks_for(listed, spark.sparkContext.defaultParallelism)))


def first_n(df: DataFrame, n: int | None, key: str = "path") -> DataFrame:
    """The first ``n`` rows by ``key``, which is unique; fewer rows are all kept, ``None`` keeps everything.

    A small ``n`` is kept by every task and merged. A larger one is found by counting (``nth_key``), without sorting or moving the
    rows: ``df`` is then read several times, so pass a written table of narrow rows, and join payloads back to what is left.
    """
    if n is None:
        return df
    if n <= TOP_ROWS:
        return df.orderBy(key).limit(n)
    last = nth_key(df, n, key)
    return df if last is None else df.where(F.col(key) <= last)


def nth_key(df: DataFrame, n: int, key: str, rows: int | None = None, cuts: int = 255) -> str | None:
    """The ``n``-th least key; None if there are no more than ``n``.

    Keys are counted between ``cuts`` keys chosen by hash; the one interval that holds the ``n``-th is cut again, until it is
    within ``rows`` of either bound and the rest can be taken from the top.
    """
    rows = rows or TOP_ROWS
    span, left = df.select(key), n
    if span.count() <= n:
        return None
    while left > rows:
        chosen = sorted(r[0] for r in span.orderBy(F.xxhash64(key), key).limit(cuts).collect())
        place = F.size(F.filter(F.lit(chosen), lambda cut: cut <= F.col(key)))  # 0: below the first cut
        counts = dict(span.groupBy(place.alias("at")).count().collect())
        at = 0
        while left > counts.get(at, 0):
            left -= counts.get(at, 0)
            at += 1
        if at > 0:
            span = span.where(F.col(key) >= chosen[at - 1])
        if at < len(chosen):
            span = span.where(F.col(key) < chosen[at])
    return span.orderBy(key).limit(left).agg(F.max(key)).first()[0]


def list_files(
    spark: SparkSession, folder: str, glob: str = "*", n: int | None = None, any_depth: bool = False
) -> DataFrame:
    """``path, length`` of the files, the first ``n`` by path.

    Without ``any_depth`` the pattern is relative to ``folder`` and fixes the depth: ``*.jpg`` is flat,
    ``*/*`` exactly one level down; only folders that its parts name are listed. With it the pattern is on the file name, at any depth.
    """
    if any_depth:
        return first_n(list_tree(spark, folder, glob), n)
    found = None
    for one in _without_slashes(glob):
        listed = _listing(spark, folder, [glob_pattern(p) for p in glob_parts(one)])
        found = listed if found is None else found.unionByName(listed)
    return first_n(found if "{" not in glob else found.dropDuplicates(["path"]), n)


def at_depth(files: DataFrame, folder: str, glob: str) -> DataFrame:
    """Keep the files that lie as deep below ``folder`` as ``glob`` says, and match it part by part."""
    return files.where(relative_path("path", folder).rlike(f"^{glob_pattern(glob)}$"))


def glob_parts(glob: str) -> list[str]:
    """The pattern of each level; a slash inside brackets or braces parts nothing."""
    parts, depth, i = [""], 0, 0
    while i < len(glob):
        c, step = glob[i], 1
        if c == "[" and (end := glob.find("]", i + 2)) > 0:
            step = end - i + 1
        elif c == "\\":
            step = 2
        depth += (c == "{") - (c == "}" and depth > 0)
        if c == "/" and not depth:
            parts.append("")
        else:
            parts[-1] += glob[i : i + step]
        i += step
    return [p for p in parts if p]


def _without_slashes(glob: str) -> list[str]:
    """Patterns that mean the same together, none of which has a slash between braces."""
    group = re.search(r"\{([^{}]*/[^{}]*)\}", glob)
    if not group:
        return [glob]
    return [x for part in group[1].split(",") for x in _without_slashes(glob[: group.start()] + part + glob[group.end() :])]


def glob_pattern(glob: str) -> str:
    """A regular expression for a pattern of ``*``, ``?``, ``[abc]``, ``[^a-c]``, ``{a,b}`` and ``\\x``; none of them but a
    literal slash matches one."""
    out, depth, i = "", 0, 0
    while i < len(glob):
        c = glob[i]
        if c == "[" and (end := glob.find("]", i + 2)) > 0:
            inner = glob[i + 1 : end]
            negated = inner[0] in "!^"
            body = inner[negated:].replace("\\", "\\\\").replace("[", "\\[").replace("&", "\\&")
            out, i = out + ("[^/" if negated else "[") + body + "]", end
        elif c == "{":
            out, depth = out + "(?:", depth + 1
        elif c == "}" and depth:
            out, depth = out + ")", depth - 1
        elif c == "," and depth:
            out += "|"
        elif c == "\\" and i + 1 < len(glob):
            i += 1
            out += re.escape(glob[i])
        else:
            out += {"*": "[^/]*", "?": "[^/]"}.get(c) or re.escape(c)
        i += 1
    return out


def example_input(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """The first file as a one-row serving input (base64 ``image``); no row when there is no file."""
    return read_bytes(list_files(spark, folder, glob, n=1)).select(base64_text("content").alias("image"))


def path_table(spark: SparkSession, paths: list[str]) -> DataFrame:
    """A given list of paths as a table; an empty list gives an empty table."""
    return spark.createDataFrame([(p,) for p in paths], PATH_SCHEMA)


def list_tree(spark: SparkSession, folder: str, glob: str | None = None, partitions: int | None = None) -> DataFrame:
    """``path, length`` of every file below ``folder`` whose name matches.

    Empty files count, and names that start with ``_``; only names that start with a dot are left out. A folder that is not
    there is empty. Links are followed, but not back to a folder on the way to them; a link that names nothing is left out.
    """
    return _listing(spark, folder, None, glob_pattern(glob) if glob else None, partitions)


def _listing(spark: SparkSession, folder: str, levels: list[str] | None, name: str | None = None, partitions: int | None = None) -> DataFrame:
    """Files below ``folder``: at any depth those named ``name``, or with ``levels`` those whose path matches part by part.

    A small tree is listed by the driver and costs no job. Once it has seen ``DRIVER_ENTRIES`` entries, it drops what it has and
    tasks list the folders, one level per job. Each level is written to the scratch folder, so all readers see the same files,
    and only the depth of the tree is a driver loop.
    """
    ship_package(spark)
    depth = None if levels is None else len(levels)
    match = lambda at: (levels[at] if depth else name, "both" if depth is None else "files" if at == depth - 1 else "folders")
    root = shared_uri(spark, folder)
    here = _listed_here(root, depth, match)
    if here is not None:
        return spark.createDataFrame(here, _LISTED_FILES)
    width = partitions or spark.sparkContext.defaultParallelism
    frontier, found = spark.createDataFrame([(root, [], None, None)], _PIECE), None
    at, waiting = 0, 1
    while waiting and (depth is None or at < depth):
        pending, parts = frontier, []
        while waiting:
            seen = Observation()
            count = [F.count(F.when(F.col("kind") == k, 1)).alias(k) for k in ("folder", "range")]
            level = materialise(pending.repartition(width).mapInArrow(_lister(*match(at)), _FOUND).observe(seen, *count), "listing")
            parts.append((level, seen.get["folder"]))
            pending, waiting = level.where("kind = 'range'").select(*_PIECE.names), seen.get["range"]
        for level, _ in parts:
            files = level.where("kind = 'file'").select("path", "length")
            found = files if found is None else found.unionByName(files)
        frontier, waiting = None, sum(folders for _, folders in parts)
        for level, _ in parts:
            below = level.where("kind = 'folder'").select(*_PIECE.names)
            frontier = below if frontier is None else frontier.unionByName(below)
        at += 1
    return found


def _listed_here(root: str, depth: int | None, match: Callable) -> list[tuple[str, int]] | None:
    """The files as a list, or None where there are more entries than the driver should look at."""
    frontier, found, seen, at = [(root, ())], [], 0, 0
    while frontier and (depth is None or at < depth):
        below = []
        name, want = match(at)
        wanted = None if name is None else re.compile(name, re.DOTALL)
        for folder, trail in frontier:
            for entry in list_folder(folder, wanted, want, trail):
                seen += 1
                if seen > DRIVER_ENTRIES:
                    return None
                if entry.is_folder:
                    below.append((entry.path, entry.trail))
                else:
                    found.append((entry.path, entry.length))
        frontier, at = below, at + 1
    return found


def _lister(name: str | None, want: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Lists the pieces of a level: folders, or ranges of names in a folder. A piece of more than ``SPLIT`` entries leaves as ranges
    of about that size instead, for other tasks to list."""
    wanted, split = None if name is None else re.compile(name, re.DOTALL), SPLIT
    schema = to_arrow_schema(_FOUND)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)

    def listed(folder: str, trail: list[str], after: str | None, until: str | None) -> Iterator[tuple]:
        entries = list_folder(folder, wanted, want, trail, after, until)
        base, names, sizes, trails = folder.rstrip("/") + "/", [], array("q"), {}  # held as narrow as may be, until it is known to be no range
        for e in islice(entries, split):
            names.append(e.path.removeprefix(base))
            sizes.append(e.length)
            if e.is_folder:
                trails[len(names) - 1] = e.trail
        if len(names) < split or next(entries, None) is None:
            return ((base + n, list(trails.get(i, ())), None, None, "folder" if i in trails else "file", size) for i, (n, size) in enumerate(zip(names, sizes)))
        entries.close()
        del names, sizes, trails
        total = 0

        def counted() -> Iterator[str]:
            nonlocal total
            for e in list_names(folder):
                if not e.startswith(".") and (after is None or e > after) and (until is None or e <= until):
                    total += 1
                    yield e

        names = sorted(nsmallest(_SAMPLED, counted(), key=lambda e: crc32(e.encode("utf-8", "surrogateescape"))))
        pieces = min(max(2, -(-total // split)), len(names))
        edges = [after, *(names[len(names) * k // pieces] for k in range(1, pieces)), until]
        return iter([(folder, trail, low, high, "range", 0) for low, high in zip(edges, edges[1:])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pieces in batches:
            for piece in zip(*(pieces.column(c).to_pylist() for c in _PIECE.names)):
                rows = listed(*piece)
                while some := list(islice(rows, 10_000)):
                    yield batch(some)

    return run


def tasks_for(files: DataFrame, at_least: int = 1) -> int:
    """Number of tasks at which none has to read more than ``TASK_BYTES`` of ``path, length`` files."""
    return tasks_for_bytes(files.agg(F.sum("length").alias("n")).first()["n"], at_least)


def tasks_for_bytes(total: int | None, at_least: int = 1) -> int:
    return max(at_least, -(-(total or 0) // TASK_BYTES))


def with_lengths(files: DataFrame) -> DataFrame:
    """``path, length`` with the lengths that are missing looked up by the tasks."""
    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = batch.column("length").to_pylist()
            asked = [p for p, n in zip(batch.column("path").to_pylist(), known) if n is None]
            found = iter(io_map(file_size, asked))
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array([next(found) if n is None else n for n in known], pa.int64())], ["path", "length"])

    return files.select("path", "length").mapInArrow(fill, _LISTED_FILES)


def read_bytes(paths: DataFrame, column: str = "path") -> DataFrame:
    """Add ``content`` to a table of paths; each task opens the files of its own rows.

    Only the narrow rows are ever shuffled before this step. Output batches are cut by bytes.
    """
    out = T.StructType([*paths.schema.fields, T.StructField("content", T.BinaryType())])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start, held, size = 0, [], 0
            for i in range(0, batch.num_rows, IO_THREADS):
                read = io_map(read_file, batch.column(column).slice(i, IO_THREADS).to_pylist())
                held += read
                size += sum(map(len, read))
                if size >= _BATCH_BYTES or start + len(held) == batch.num_rows:
                    part = batch.slice(start, len(held))
                    arrays = [*part.columns, pa.array(held, pa.binary())]
                    start, held, size, read = start + len(held), [], 0, []
                    yield pa.RecordBatch.from_arrays(arrays, names=[*part.schema.names, "content"])

    return paths.mapInArrow(fill, out)


def write_bytes(files: DataFrame) -> DataFrame:
    """Write ``content`` to ``path`` for every row, from the tasks; returns the written paths and lengths."""

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = []
            for i in range(0, batch.num_rows, IO_THREADS):
                part = batch.slice(i, IO_THREADS)
                bodies = part.column("content").to_pylist()
                io_map(write_file, part.column("path").to_pylist(), bodies)
                sizes += map(len, bodies)
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(sizes, pa.int64())], ["path", "length"])

    with payload_batches(files.sparkSession, DEFAULT_MODEL_BATCH):
        return materialise(files.select("path", "content").mapInArrow(put, _LISTED_FILES), "written")


def spark_images(
    spark: SparkSession, folder: str, mode: str = "FAILFAST", glob: str = "*", recursive: bool = True
) -> DataFrame:
    """Images decoded by Spark's own reader: ``path, height, width, channels, data`` (BGR bytes), ``error``.

    An unreadable file gives a placeholder row. ``FAILFAST`` raises on it, ``PERMISSIVE`` keeps it with an
    ``error`` text, ``DROPMALFORMED`` drops it.
    """
    raw = (
        spark.read.format("image").option("dropInvalid", str(mode == "DROPMALFORMED").lower())
        .option("pathGlobFilter", glob).option("recursiveFileLookup", str(recursive).lower())
    )
    bad = F.col("image.mode") < 0
    text = F.concat(F.lit("not an image: "), F.col("image.origin"))
    error = F.when(bad, F.raise_error(text) if mode == "FAILFAST" else text)
    return raw.load(folder).select(
        origin_path("image.origin").alias("path"),
        F.when(~bad, F.col("image.height")).alias("height"),
        F.when(~bad, F.col("image.width")).alias("width"),
        F.when(~bad, F.col("image.nChannels")).alias("channels"),
        F.when(~bad, F.col("image.data")).alias("data"),
        error.cast("string").alias("error"),
    )


def with_normal_path(df: DataFrame, column: str = "path") -> DataFrame:
    return df.withColumn(column, normalise_path(column))
