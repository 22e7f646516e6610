"""One annotated picture per row, written by the task that holds the row."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.resource import ResourceProfile
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scoreloom.functions import pixels
from scoreloom.functions.paths import base_name, join_path, normalise_path, ordinal_name, relative_path
from scoreloom.operators.ordinals import with_ordinal
from scoreloom.operators.scoring import check_mode, classify_decoded, classify_pictures, file_reader, map_rows
from scoreloom.operators.steps import StepTimes
from scoreloom.session import DEFAULT_MICRO_BATCH, shared_uri
from scoreloom.sources.models import Scorer
from scoreloom.sources.storage import io_map, write_file

NAMINGS = ("ordinal", "basename", "relative")

_PREDICTED = [
    T.StructField("class_id", T.IntegerType()), T.StructField("label", T.StringType()),
    T.StructField("score", T.DoubleType()), T.StructField("error", T.StringType()),
]


_DECODED = ("height", "width", "channels", "data", "error")  # what ``spark_images`` gives


class NameClash(ValueError):
    """Two inputs would be written to the same artifact."""


def with_output_path(
    df: DataFrame, folder: str, naming: str = "basename", root: str = "", extension: str = ".jpg", shards: int = 0
) -> DataFrame:
    """Add ``output_path`` (and ``ordinal`` for that naming).

    ``ordinal`` counts rows in path order, ``basename`` keeps the file name, ``relative`` the path below
    ``root``. ``shards`` spreads the artifacts over that many subfolders, for stores that slow down on one.
    """
    if naming not in NAMINGS:
        raise ValueError(f"naming must be one of {NAMINGS}")
    if naming == "ordinal":
        df = with_ordinal(df, "path")
        name: Column = ordinal_name("ordinal", extension)
    elif naming == "basename":
        name = base_name("path")
    else:
        name = relative_path("path", root)
    if shards:
        shard = F.pmod(F.xxhash64(normalise_path("path")), F.lit(shards)).cast("string")
        name = F.concat_ws("/", shard, name)
    return df.withColumn("output_path", join_path(folder, name))


def name_clashes(df: DataFrame, column: str = "output_path") -> DataFrame:
    """Names that more than one row would use, with their counts."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def require_unique(df: DataFrame, column: str = "output_path") -> None:
    """Fail before anything is written when two rows share an artifact.

    Hashes are compared first, so that in the usual case eight bytes per row are shuffled; only when some are
    equal are the names themselves compared.
    """
    hashes = df.groupBy(F.xxhash64(column).alias("_hash")).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    if hashes.isEmpty():
        return
    clash = name_clashes(df, column).limit(3).collect()
    if clash:
        raise NameClash("several inputs for: " + ", ".join(r[column] for r in clash))


def _from_struct(height: int, width: int, channels: int, data: bytes | None, error: str | None) -> tuple:
    if data is None:
        return None, error or "no picture"
    return pixels.bgr_rows_to_rgb(data, height, width, channels), None


def _body(picture, label: str, score: float, form: str) -> bytes:
    text = f"{label} ({score:.1%})"
    return pixels.encode_image(pixels.annotate(picture, text), text, form)


def _write(picture, label: str, score: float, target: str, form: str) -> None:
    write_file(target, _body(picture, label, score, form))


def score_and_write(
    df: DataFrame, model: Scorer, batch_size: int = DEFAULT_MICRO_BATCH, mode: str = "FAILFAST",
    form: str = "auto", content: str | None = None, decoded: bool = False, profile: ResourceProfile | None = None,
    spent: StepTimes | None = None,
) -> DataFrame:
    """Decode, score, annotate and write in one pass over ``path, output_path``.

    ``spent`` adds up the tasks' seconds per step.

    Each picture is decoded once. With ``content`` the bytes come from that column; without, the task opens
    ``path`` itself and the bytes never leave it. ``decoded`` rows come from ``spark_images`` instead. The
    output adds ``class_id, label, score, error``; rows that could not be decoded have no artifact and a null
    ``output_path``.
    """
    check_mode(mode)
    form = pixels.settle_form(form)
    prep = model.prep
    base = shared_uri(df.sparkSession, "/")

    def make() -> Callable:
        clock = spent or StepTimes()
        with clock.step("model"):
            ready = model.load()

        def run(part: pa.RecordBatch, bodies: list | None = None) -> list:
            with clock.step("inference", part.num_rows):
                pictures, rows = classify(part, bodies)
            with clock.step("write", part.num_rows):
                targets = part.column("_target").to_pylist()
                return [*zip(*rows), io_map(write, pictures, rows, targets)]

        def classify(part: pa.RecordBatch, bodies: list | None) -> tuple[list, list[tuple]]:
            if decoded:
                found = [_from_struct(*row) for row in zip(*[part.column(c).to_pylist() for c in _DECODED])]
                return classify_decoded(found, ready, prep)
            return classify_pictures(part.column(content).to_pylist() if content else bodies, ready, prep, mode)

        def write(picture, row: tuple, target: str) -> str | None:
            _, label, score, error = row
            if error is not None:
                return None
            _write(picture, label, score, _with_scheme(target, base), form)
            return target

        return run

    added = T.StructType([*_PREDICTED, T.StructField("output_path", T.StringType())])
    drop = ["_target", *([content] if content else []), *(_DECODED if decoded else [])]
    fetch = None if content or decoded else file_reader("path", mode, lambda p: _with_scheme(p, base))
    return map_rows(df.withColumnRenamed("output_path", "_target"), added, make, batch_size, drop, fetch, profile)


def annotate_and_write(
    df: DataFrame, content: str | None = "content", batch_size: int = DEFAULT_MICRO_BATCH, form: str = "auto",
    mode: str = "FAILFAST", spent: StepTimes | None = None,
) -> DataFrame:
    """Write the artifact of rows that are already scored (``label, score, output_path`` and the bytes).

    Without ``content`` the task opens ``path``. Rows without a label are passed on without an artifact.
    """
    form = pixels.settle_form(form)
    base = shared_uri(df.sparkSession, "/")

    def make() -> Callable:
        clock = spent or StepTimes()

        def write(body: bytes | None, label: str | None, score: float | None, target: str) -> str | None:
            if label is None or body is None:
                return None
            _write(pixels.decode_image(body), label, score, _with_scheme(target, base), form)
            return target

        def run(part: pa.RecordBatch, bodies: list | None = None) -> list:
            bodies = part.column(content).to_pylist() if content else bodies
            with clock.step("write", part.num_rows):
                return [io_map(write, bodies, *[part.column(c).to_pylist() for c in ("label", "score", "_target")])]

        return run

    added = T.StructType([T.StructField("output_path", T.StringType())])
    drop = ["_target", *([content] if content else [])]
    fetch = None if content else file_reader("path", mode, lambda p: _with_scheme(p, base))
    return map_rows(df.withColumnRenamed("output_path", "_target"), added, make, batch_size, drop, fetch)


_HELD = ("height", "width", "data", "label", "score")  # a decoded picture (``decode_pictures``) and its prediction


def _held(part: pa.RecordBatch) -> list[tuple]:
    """Pictures with label and score; None where one is missing."""
    rows = zip(*(part.column(c).to_pylist() for c in _HELD))
    return [
        None if data is None or label is None else (np.frombuffer(data, dtype=np.uint8).reshape(height, width, 3), label, score)
        for height, width, data, label, score in rows
    ]


def write_pictures(df: DataFrame, batch_size: int = DEFAULT_MICRO_BATCH, form: str = "auto", spent: StepTimes | None = None) -> DataFrame:
    """The same for rows that carry their picture decoded (``height, width, data``), as ``decode_pictures`` leaves it."""
    form = pixels.settle_form(form)
    base = shared_uri(df.sparkSession, "/")

    def make() -> Callable:
        clock = spent or StepTimes()

        def write(held: tuple | None, target: str) -> str | None:
            if held is None:
                return None
            _write(*held, _with_scheme(target, base), form)
            return target

        def run(part: pa.RecordBatch) -> list:
            with clock.step("write", part.num_rows):
                return [io_map(write, _held(part), part.column("_target").to_pylist())]

        return run

    added = T.StructType([T.StructField("output_path", T.StringType())])
    return map_rows(df.withColumnRenamed("output_path", "_target"), added, make, batch_size, ["_target", "height", "width", "data"])


def picture_bodies(df: DataFrame, batch_size: int = DEFAULT_MICRO_BATCH, form: str = "auto", spent: StepTimes | None = None) -> DataFrame:
    """Replace the decoded picture by the ``body`` of its artifact, for a sink that writes whole sets; null without a label."""
    form = pixels.settle_form(form)

    def make() -> Callable:
        clock = spent or StepTimes()

        def run(part: pa.RecordBatch) -> list:
            with clock.step("write", part.num_rows):
                return [[None if held is None else _body(*held, form) for held in _held(part)]]

        return run

    added = T.StructType([T.StructField("body", T.BinaryType())])
    return map_rows(df, added, make, batch_size, ["height", "width", "data"])


def _with_scheme(path: str, base: str) -> str:
    """Put back the scheme of the shared store where a path was normalised."""
    return base.rstrip("/") + path if path.startswith("/") else path
