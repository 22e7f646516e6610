"""Scoring: table rows or image bytes in, label and score out.

Every scorer is a narrow step: rows stay where they are and the model goes to them.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import predict_batch_udf
from pyspark.resource import ResourceProfile
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from scoreloom.functions import pixels
from scoreloom.functions.tensors import best_class, confidence, linear_logits
from scoreloom.operators.steps import StepTimes
from scoreloom.session import DEFAULT_MICRO_BATCH, DEFAULT_MODEL_BATCH
from scoreloom.sources.models import Checkpoints, LinearModel, Preprocess, Scorer
from scoreloom.sources.storage import io_start, read_file

PREDICTION = "struct<class_id:int,label:string,score:double,error:string>"
SERVED = "label string, score double"


def choose(model, batch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Class id and softmax value of every row; models that know fewer classes say which in ``classes``."""
    places, scores = pick(model.logits(batch))
    classes = getattr(model, "classes", None)
    return (places if classes is None else np.asarray(classes, dtype=np.int32)[places]), scores


def pick(logits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best class (the first on a tie) and its softmax value, per row."""
    if not len(logits):
        return np.empty(0, np.int32), np.empty(0)
    top = logits.max(axis=1)
    return logits.argmax(axis=1).astype(np.int32), 1.0 / np.exp(logits - top[:, None]).sum(axis=1)


def with_label(df: DataFrame, labels: dict[int, str], class_column: str = "class_id", out: str = "label") -> DataFrame:
    """Readable label per class index, from a literal map; an unknown class keeps its index as text."""
    index = F.col(class_column)
    if not labels:
        return df.withColumn(out, index.cast("string"))
    pairs = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    return df.withColumn(out, F.coalesce(F.try_element_at(pairs, index), index.cast("string")))


def score_native(df: DataFrame, features: str, model: LinearModel) -> DataFrame:
    """Linear model as built-in expressions only: adds ``class_id`` and ``score``.

    The weights are one row of arrays, fetched once as a scalar; a model that was loaded has a bounded size.
    """
    kept = df.columns
    parts = [(w.tolist(), float(b)) for w, b in zip(np.asarray(model.weights, dtype=np.float64), model.bias)]
    rows = df.sparkSession.createDataFrame([(parts,)], "m array<struct<w:array<double>,b:double>>").scalar()
    place = best_class("_logits")
    if model.classes is not None:
        place = F.get(F.array(*[F.lit(int(c)) for c in model.classes]), place)
    return (
        df.withColumn("_rows", rows).withColumn("_logits", linear_logits(features, F.col("_rows")))
        .select(*kept, place.alias("class_id"), confidence("_logits").alias("score"))
    )


def _matrix(column: pa.Array) -> np.ndarray:
    """A list column as a matrix, without a Python object per row."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def score_arrow(df: DataFrame, features: str, model: Scorer) -> DataFrame:
    """Whole Arrow batches as matrices: adds ``class_id`` and ``score``. Only ``features`` reaches Python."""

    @F.arrow_udf("struct<class_id:int,score:double>")
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        ready = model.load()
        for column in batches:
            found = column.is_valid()
            given = column.filter(found)
            classes, scores = choose(ready, _matrix(given)) if len(given) else pick(np.empty((0, 1)))
            rows = pa.StructArray.from_arrays([pa.array(classes), pa.array(scores)], ["class_id", "score"])
            yield rows if len(given) == len(column) else _spread(rows, found)

    kept = df.columns
    return df.withColumn("_p", predict(features)).select(*kept, "_p.class_id", "_p.score")


def score_models(df: DataFrame, features: str, models: dict[str, Scorer]) -> DataFrame:
    """Several models in one pass over the rows: adds the class each chooses, in a column of its name. Null vectors give nulls."""
    names = list(models)

    @F.arrow_udf(f"struct<{','.join(f'`{n}`:int' for n in names)}>")
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        ready = [m.load() for m in models.values()]
        for column in batches:
            found = column.is_valid()
            given = column.filter(found)
            chosen = [choose(m, _matrix(given))[0] if len(given) else np.empty(0, np.int32) for m in ready]
            rows = pa.StructArray.from_arrays([pa.array(c, pa.int32()) for c in chosen], names)
            yield rows if len(given) == len(column) else _spread(rows, found)

    kept = df.columns
    return df.withColumn("_p", predict(features)).select(*kept, *(F.col("_p").getField(n).alias(n) for n in names))


def _spread(rows: pa.Array, found: pa.Array) -> pa.Array:
    """Put ``rows`` back at the places where ``found`` is true; the others become null."""
    mask = found.to_numpy(zero_copy_only=False)
    places = np.cumsum(mask) - 1
    return rows.take(pa.array(places, mask=~mask))


def score_batches(
    df: DataFrame, features: str, model: Scorer, width: int, batch_size: int = DEFAULT_MODEL_BATCH
) -> DataFrame:
    """Fixed-size mini-batches through ``predict_batch_udf``: adds ``class_id``, ``label`` and ``score``.

    The model is loaded once per worker. ``width`` is the length of ``features``.
    """

    def make() -> Callable:
        ready = model.load()

        def predict(batch: np.ndarray) -> dict[str, np.ndarray]:
            classes, scores = choose(ready, batch)
            labels = np.array([ready.label(c) for c in classes], dtype=object)
            return {"class_id": classes, "label": labels, "score": scores}

        return predict

    fields = [("class_id", T.IntegerType()), ("label", T.StringType()), ("score", T.DoubleType())]
    call = predict_batch_udf(
        make, return_type=T.StructType([T.StructField(*f) for f in fields]),
        batch_size=batch_size, input_tensor_shapes=[[width]],
    )
    kept = df.columns
    # a null vector goes in as zeros, and what comes out for it is dropped
    given = F.coalesce(features, F.array_repeat(F.lit(0.0), width).cast(df.schema[features].dataType))
    there = F.col(features).isNotNull()
    out = [F.when(there, F.col(f"_p.{name}")).alias(name) for name, _ in fields]
    return df.withColumn("_p", call(given)).select(*kept, *out)


def ensemble_logits(df: DataFrame, features: str, checkpoints: Checkpoints) -> DataFrame:
    """Mean logits over N checkpoints, per row: adds ``logits``, an array of ``class_id, z``. Rows are neither multiplied
    nor grouped; a null vector gives null. To unfold it, use ``inline_outer``: from a plain ``inline`` Spark infers a
    filter on the array, and evaluates the function once more for it.
    """

    @F.arrow_udf("array<struct<class_id:int,z:double>>")
    def mean_logits(column: pa.Array) -> pa.Array:
        found = column.is_valid()
        given = column.filter(found)
        classes = checkpoints.classes
        means = checkpoints.mean_logits(_matrix(given)) if len(given) else np.empty((0, len(classes)))
        offsets = np.arange(len(means) + 1, dtype=np.int32) * len(classes)
        ids = np.tile(np.asarray(classes, dtype=np.int32), len(means))
        pairs = pa.StructArray.from_arrays([pa.array(ids), pa.array(means.ravel())], ["class_id", "z"])
        rows = pa.ListArray.from_arrays(pa.array(offsets), pairs)
        return rows if len(given) == len(column) else _spread(rows, found)

    return df.withColumn("logits", mean_logits(features))


def _decode(content: bytes | None, mode: str) -> tuple[np.ndarray | None, str | None]:
    try:
        if content is None:
            raise pixels.DecodeError("no content")
        return pixels.decode_image(content), None
    except pixels.DecodeError as err:
        if mode == "FAILFAST":
            raise
        return None, str(err)


def file_reader(column: str, mode: str, address: Callable[[str], str] = str) -> Callable:
    """A ``fetch`` for ``map_rows``: starts reading the files of a micro-batch.

    With ``PERMISSIVE`` a file that is gone is None.
    """

    def read(uri: str) -> bytes | None:
        try:
            return read_file(uri)
        except FileNotFoundError:
            if mode == "FAILFAST":
                raise
            return None

    return lambda part: io_start(read, [address(p) for p in part.column(column).to_pylist()])


def check_mode(mode: str) -> None:
    if mode not in ("FAILFAST", "PERMISSIVE"):
        raise ValueError(f"mode must be FAILFAST or PERMISSIVE, not {mode!r}")


def classify_pictures(
    contents: Sequence[bytes | None], model: Scorer, prep: Preprocess, mode: str
) -> tuple[list, list[tuple]]:
    """Decoded pictures and ``(class_id, label, score, error)`` of one micro-batch."""
    return classify_decoded([_decode(c, mode) for c in contents], model, prep)


def classify_decoded(
    decoded: Sequence[tuple[np.ndarray | None, str | None]], model: Scorer, prep: Preprocess
) -> tuple[list, list[tuple]]:
    """The same for pictures that are decoded already, each with the error that prevented it or None."""
    rows: list[tuple] = [(None, None, None, err) for _, err in decoded]
    good = [i for i, (picture, _) in enumerate(decoded) if picture is not None]
    if good:
        batch = np.stack([pixels.to_tensor(decoded[i][0], prep.size, prep.mean, prep.std) for i in good])
        classes, scores = choose(model, batch)
        for i, c, s in zip(good, classes.tolist(), scores.tolist()):
            rows[i] = (c, model.label(c), s, None)
    return [picture for picture, _ in decoded], rows


def classify_content(
    content: Column | str, model: Scorer, batch_size: int = DEFAULT_MICRO_BATCH, mode: str = "FAILFAST"
) -> Column:
    """Prediction struct for image bytes in a table. Only the bytes go to Python, a micro-batch at a time."""
    check_mode(mode)
    prep = model.prep

    @F.arrow_udf(PREDICTION)
    def classify(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        ready = model.load()
        for column in batches:
            rows: list[tuple] = []
            for start in range(0, len(column), batch_size):
                _, found = classify_pictures(column.slice(start, batch_size).to_pylist(), ready, prep, mode)
                rows += found
            yield pa.StructArray.from_arrays(
                [
                    pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.string()),
                    pa.array([r[2] for r in rows], pa.float64()), pa.array([r[3] for r in rows], pa.string()),
                ],
                ["class_id", "label", "score", "error"],
            )

    return classify(content)


def map_rows(
    df: DataFrame, added: T.StructType, make: Callable[[], Callable], batch_size: int, drop: Sequence[str] = (),
    fetch: Callable | None = None, profile: ResourceProfile | None = None,
) -> DataFrame:
    """Add columns computed per micro-batch. ``make`` runs once per task and returns the batch function.

    The function takes a record batch of at most ``batch_size`` rows and returns one list per added column.
    Results leave in micro-batches too, so a task holds few pictures at a time however small their files are.
    ``fetch`` starts reading what a micro-batch needs while the one before it is computed; the function gets the
    results as a second argument. A ``profile`` asks for special executors (accelerators, say) for this step.
    """
    kept = [f for f in df.schema.fields if f.name not in drop]
    out = T.StructType([*kept, *added.fields])
    names = [f.name for f in kept]
    schema = to_arrow_schema(added)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        call = make()
        parts = (b.slice(start, batch_size) for b in batches for start in range(0, b.num_rows, batch_size))
        for part, started in _ahead(parts, fetch):
            lists = call(part) if fetch is None else call(part, [f.result() for f in started])
            new = [pa.array(values, field.type) for values, field in zip(lists, schema)]
            yield pa.RecordBatch.from_arrays([*[part.column(n) for n in names], *new], names=[*names, *schema.names])

    return df.mapInArrow(run, out, profile=profile)


def _ahead(parts: Iterator[pa.RecordBatch], fetch: Callable | None) -> Iterator[tuple]:
    """Each part with what ``fetch`` started for it, which happens one part before it is used."""
    if fetch is None:
        yield from ((part, None) for part in parts)
        return
    waiting = None
    for part in parts:
        started = part, fetch(part)
        if waiting is not None:
            yield waiting
        waiting = started
    if waiting is not None:
        yield waiting


def picture_tensors(
    df: DataFrame, prep: Preprocess, content: str | None = "content", batch_size: int = DEFAULT_MICRO_BATCH,
    precision: str = "double", mode: str = "FAILFAST",
) -> DataFrame:
    """Replace image bytes by ``tensor`` and ``error``: decoded, resized, normalised, flattened channels first.

    Without ``content`` the task opens ``path``, and only the tensor leaves it. What cannot be decoded gets a
    tensor of zeros and an error, or stops the job.
    ``precision="float"`` halves what travels on, for networks that compute in single precision anyway.
    """
    number = {"double": T.DoubleType(), "float": T.FloatType()}[precision]
    kind = {"double": np.float64, "float": np.float32}[precision]

    check_mode(mode)
    blank = np.zeros(3 * prep.size**2, kind)

    def tensor(picture: np.ndarray | None) -> np.ndarray:
        if picture is None:
            return blank
        return pixels.to_tensor(picture, prep.size, prep.mean, prep.std).ravel().astype(kind, copy=False)

    def make() -> Callable:
        def tensors(part: pa.RecordBatch, bodies: list | None = None) -> list:
            bodies = part.column(content).to_pylist() if content else bodies
            decoded = [_decode(c, mode) for c in bodies]
            return [[tensor(picture) for picture, _ in decoded], [error for _, error in decoded]]

        return tensors

    added = T.StructType([T.StructField("tensor", T.ArrayType(number)), T.StructField("error", T.StringType())])
    if content:
        return map_rows(df, added, make, batch_size, drop=[content])
    return map_rows(df, added, make, batch_size, fetch=file_reader("path", mode))


def decode_pictures(
    df: DataFrame, prep: Preprocess, batch_size: int = DEFAULT_MICRO_BATCH, mode: str = "FAILFAST", spent: StepTimes | None = None
) -> DataFrame:
    """Open and decode the files of ``path``, once: adds ``height, width, data`` (RGB bytes), ``small`` (the picture at the
    model's size) and ``error``. What cannot be decoded has nulls and an error, or stops the job."""
    check_mode(mode)

    def make() -> Callable:
        clock = spent or StepTimes()

        def run(part: pa.RecordBatch, bodies: list) -> list:
            with clock.step("decode", part.num_rows):
                decoded = [_decode(c, mode) for c in bodies]
                shape = lambda axis: [None if p is None else p.shape[axis] for p, _ in decoded]
                body = lambda p: np.ascontiguousarray(p).tobytes()
                whole = [None if p is None else body(p) for p, _ in decoded]
                small = [None if p is None else body(pixels.resize(p, prep.size, prep.size)) for p, _ in decoded]
                return [shape(0), shape(1), whole, small, [error for _, error in decoded]]

        return run

    added = T._parse_datatype_string("height int, width int, data binary, small binary, error string")
    return map_rows(df, added, make, batch_size, fetch=file_reader("path", mode))


def score_decoded(
    df: DataFrame, model: Scorer, batch_size: int = DEFAULT_MODEL_BATCH, precision: str = "double",
    profile: ResourceProfile | None = None, spent: StepTimes | None = None,
) -> DataFrame:
    """Replace ``small`` by ``class_id, label, score``; rows with an error get nulls.

    Fixed batches go through the model, loaded once per task. A ``profile`` asks for executors of its own for this step.
    """
    kind = {"double": np.float64, "float": np.float32}[precision]
    prep = model.prep

    def make() -> Callable:
        clock = spent or StepTimes()
        with clock.step("model"):
            ready = model.load()

        def run(part: pa.RecordBatch) -> list:
            rows = [(None, None, None)] * part.num_rows
            with clock.step("inference", part.num_rows):
                bodies = part.column("small").to_pylist()
                good = [i for i, body in enumerate(bodies) if body is not None]
                if good:
                    shape = prep.size, prep.size, 3
                    batch = np.stack([pixels.normalised(np.frombuffer(bodies[i], dtype=np.uint8).reshape(shape), prep.mean, prep.std) for i in good])
                    classes, scores = choose(ready, batch.astype(kind, copy=False))
                    for i, c, s in zip(good, classes.tolist(), scores.tolist()):
                        rows[i] = c, ready.label(c), s
            return [*zip(*rows)] if rows else [[], [], []]

        return run

    added = T._parse_datatype_string("class_id int, label string, score double")
    return map_rows(df, added, make, batch_size, ["small"], profile=profile)


def picture_bytes(
    df: DataFrame, size: int | None = None, content: str = "content", batch_size: int = DEFAULT_MICRO_BATCH
) -> DataFrame:
    """Replace image bytes by ``height, width, data`` (RGB, row by row), at the own or a fixed square size."""

    def make() -> Callable:
        def decode(part: pa.RecordBatch) -> list:
            pictures = [pixels.decode_image(c) for c in part.column(content).to_pylist()]
            if size is not None:
                pictures = [pixels.resize(p, size, size) for p in pictures]
            return [
                [p.shape[0] for p in pictures], [p.shape[1] for p in pictures],
                [np.ascontiguousarray(p).tobytes() for p in pictures],
            ]

        return decode

    added = T.StructType([
        T.StructField("height", T.IntegerType()), T.StructField("width", T.IntegerType()),
        T.StructField("data", T.BinaryType()),
    ])
    return map_rows(df, added, make, batch_size, drop=[content])


def served_frame(rows: Sequence[tuple]) -> pd.DataFrame:
    """What a served model answers: ``class_id, label, score, error``, nulls where a row failed."""
    ids = pd.array([r[0] for r in rows], dtype="Int32")
    scores = np.array([r[2] for r in rows], dtype=np.float64)
    return pd.DataFrame({"class_id": ids, "label": [r[1] for r in rows], "score": scores, "error": [r[3] for r in rows]})


class ServedImages:
    """The serving contract for images: a frame with base64 ``image`` in, a frame ``label, score`` out."""

    def __init__(self, model: Scorer, batch_size: int = DEFAULT_MICRO_BATCH, mode: str = "FAILFAST"):
        check_mode(mode)
        self.model = model
        self.batch_size = batch_size
        self.mode = mode

    def load(self) -> ServedImages:
        self.model.load()
        return self

    def predict(self, frame: pd.DataFrame) -> pd.DataFrame:
        ready, texts, rows = self.model.load(), frame["image"].tolist(), []
        for start in range(0, len(texts), self.batch_size):
            part = [None if t is None else base64.b64decode(t) for t in texts[start : start + self.batch_size]]
            rows += classify_pictures(part, ready, self.model.prep, self.mode)[1]
        return served_frame(rows)


class ServedVectors:
    """The serving contract for vectors: a frame with ``features`` in, a frame ``label, score`` out."""

    def __init__(self, model: Scorer):
        self.model = model

    def load(self) -> ServedVectors:
        self.model.load()
        return self

    def predict(self, frame: pd.DataFrame) -> pd.DataFrame:
        ready, given = self.model.load(), frame["features"].to_list()
        rows: list[tuple] = [(None, None, None, "no vector")] * len(given)
        good = [i for i, v in enumerate(given) if v is not None]
        if good:
            classes, scores = choose(ready, np.stack([given[i] for i in good]))
            for i, c, s in zip(good, classes.tolist(), scores.tolist()):
                rows[i] = (c, ready.label(c), s, None)
        return served_frame(rows)


def register_served(
    spark: SparkSession, name: str, served, batch_size: int = DEFAULT_MODEL_BATCH, errors: bool = False
) -> None:
    """Make a served model callable from SQL: ``name(named_struct(...))`` gives ``label, score``.

    The model is called for ``batch_size`` rows at a time. Rows that it cannot score have nulls, so that a completeness
    check finds them; ``errors`` adds ``class_id`` and the reason (``error``) to the struct.
    """
    columns = ["label", "score", "class_id", "error"] if errors else ["label", "score"]

    @F.pandas_udf(SERVED + (", class_id int, error string" if errors else ""))
    def model_query(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ready = served.load()
        for frame in batches:
            parts = [ready.predict(frame.iloc[i : i + batch_size]) for i in range(0, len(frame), batch_size)]
            yield pd.concat(parts, ignore_index=True)[columns] if parts else served_frame([])[columns]

    spark.udf.register(name, model_query)
