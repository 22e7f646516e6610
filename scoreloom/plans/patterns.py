"""The scoring patterns. All give the same labels for the same inputs; they differ in where bytes travel.

==================  =====================================================================
direct              list paths, cut, spread the paths; one pass reads, scores and writes
ingest_then_score   stream files into a byte table, then score the first N rows of it
staged              decode once, score and write as three steps, predictions in a Parquet folder
served              base64 table, model called from SQL, join back, write
==================  =====================================================================
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.resource import ResourceProfile
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from scoreloom.functions.paths import normalise_path, relative_path
from scoreloom.functions.pixels import EXTENSIONS, settle_form
from scoreloom.functions.text import base64_bytes, base64_text
from scoreloom.operators.artifacts import (
    annotate_and_write, picture_bodies, require_unique, score_and_write, with_output_path, write_pictures,
)
from scoreloom.operators.compare import join_bucketed
from scoreloom.operators.scoring import decode_pictures, score_decoded
from scoreloom.operators.steps import StepRow, StepTimes
from scoreloom.plans.runlog import Clock, rate
from scoreloom.session import DEFAULT_MODEL_BATCH, RunParams, materialise, output_table, payload_batches, quote_name, shared_uri
from scoreloom.sources.artifact_set import save_set
from scoreloom.sources.files import (
    at_depth, first_n, list_files, read_bytes, spark_images, tasks_for, tasks_for_bytes,
)
from scoreloom.sources.models import Scorer
from scoreloom.sources.storage import delete_folder
from scoreloom.streaming.ingest import ingest, ingest_manifests


@dataclass(frozen=True)
class Run:
    """What a pattern leaves behind: its table, the summary to log, and what its tasks spent on each step."""

    table: DataFrame
    summary: dict
    steps: tuple[StepRow, ...] = ()


@dataclass(frozen=True)
class Output:
    """Where a run writes its artifacts, and how they are named."""

    folder: str
    naming: str = "basename"
    extension: str | None = None  # by form
    form: str = "auto"
    shards: int = 0
    mode: str = "FAILFAST"

    def name_only(self, df: DataFrame, root: str) -> DataFrame:
        extension = self.extension or EXTENSIONS[settle_form(self.form)]
        return with_output_path(df, self.folder, self.naming, root, extension, self.shards)

    def name(self, df: DataFrame, root: str) -> DataFrame:
        """Add output paths, and refuse two inputs for one of them."""
        named = self.name_only(df, root)
        if self.naming == "basename":
            require_unique(named)
        return named


def save_table(df: DataFrame, table: str) -> int:
    """Overwrite a managed table; the rows are counted by the job that writes them."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").saveAsTable(table)
    return seen.get["n"]


def save_bucketed(df: DataFrame, table: str, key: str, buckets: int, location: str | None = None) -> int:
    """Overwrite a table whose rows are dealt to ``buckets`` files by ``key``, so that a join on it need not move them.

    Rows that were dealt by ``repartition(buckets, key)`` while they were narrow are written where they are, one file per task.
    """
    seen = Observation()
    writer = df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").bucketBy(buckets, key)
    (writer.option("path", location) if location else writer).saveAsTable(table)
    return seen.get["n"]


def _listed(spark: SparkSession, params: RunParams, any_depth: bool = False, manifest: DataFrame | None = None) -> DataFrame:
    """``path, length`` of the first N files; all readers see the same rows."""
    if manifest is not None:  # computed elsewhere, so written once here
        return first_n(materialise(manifest.select("path", "length"), "paths"), params.n_images)
    return list_files(spark, params.image_dir, params.file_glob if any_depth else params.image_glob, params.n_images, any_depth)


def _width(files: DataFrame, wanted: int | None) -> int:
    """How many tasks to spread files over: as asked, or more where the files may be too many for that."""
    return tasks_for(files, wanted or 1)


def _named(files: DataFrame, params: RunParams, output: Output, wanted: int | None) -> tuple[DataFrame, int]:
    """Files with their output paths, and the tasks to spread them over. One pass over the paths adds up the bytes and
    finds out whether two names may be the same, in which case nothing is written."""
    named = output.name_only(files, params.image_dir)
    if output.naming != "basename":
        return named, _width(files, wanted)
    by_name = named.groupBy(F.xxhash64("output_path").alias("_hash")).agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("bytes"))
    found = by_name.agg(F.max("n").alias("n"), F.sum("bytes").alias("bytes")).first()
    if (found["n"] or 0) > 1:
        require_unique(named)
    return named, tasks_for_bytes(found["bytes"], wanted or 1)


def _wanted(rows: DataFrame, paths: DataFrame, params: RunParams, output: Output) -> DataFrame:
    """Rows with payload, cut to the first N by path, with output paths.

    The cut and the checks look at ``paths`` only. Where every row is wanted and named by its own path, the
    payload does not move at all; otherwise it is joined to the chosen paths, which Spark broadcasts while they
    are few.
    """
    if params.n_images is None and output.naming != "ordinal":
        output.name(paths, params.image_dir)
        return output.name_only(rows, params.image_dir)
    chosen = output.name(first_n(paths, params.n_images), params.image_dir).join(rows, "path")
    return chosen


def direct(
    spark: SparkSession, params: RunParams, model: Scorer, output: Output, pattern: str = "p3", tree: bool = False,
    manifest: DataFrame | None = None, jvm_decode: bool = False, profile: ResourceProfile | None = None, clock: Clock | None = None,
) -> Run:
    """List, cut, spread the paths, then read, score and write each picture in one pass.

    Only paths are shuffled. With ``naming="ordinal"`` artifacts are numbered in path order and spread over
    ``write_workers`` tasks. ``tree`` lists names that match ``file_glob`` at any depth; a ``manifest``
    (``path, length``, a store inventory say) needs no listing at all. ``jvm_decode`` leaves decoding to Spark's image
    reader (JPEG, PNG, GIF, BMP without Pillow), which then also opens the files.
    """
    if jvm_decode and manifest is not None:
        raise ValueError("Spark's image reader lists for itself: give either jvm_decode or a manifest")
    clock = clock or Clock()
    with clock.phase("dataset_prep"):
        files = _listed(spark, params, tree, manifest)
        wanted = params.write_workers if output.naming == "ordinal" else params.num_partitions
        if jvm_decode:
            width = _width(files, wanted)
            images = spark_images(spark, params.image_dir, output.mode, params.image_glob.rsplit("/", 1)[-1])
            images = at_depth(images, params.image_dir, params.image_glob)
            rows_in = _wanted(images, files.select(normalise_path("path").alias("path")), params, output)
        else:
            named, width = _named(files, params, output, wanted)
            rows_in = named.drop("length").repartition(width)
    spent = StepTimes(spark)
    with clock.phase("inference_write"):
        scored = score_and_write(
            rows_in, model, params.micro_batch, output.mode, output.form, decoded=jvm_decode, profile=profile, spent=spent
        )
        table = output_table(params, pattern, "predictions")
        rows = save_table(scored.withColumn("path", normalise_path("path")), table)
    summary = {"pattern": pattern, "dataset": params.dataset, "num_partitions": width, "num_images": rows}
    return Run(spark.table(table), summary | clock.summary(rows) | spent.summary(), tuple(spent.rows()))


def ingest_then_score(
    spark: SparkSession, params: RunParams, model: Scorer, output: Output, checkpoint: str, pattern: str = "p4",
    location: str | None = None, manifests: str | None = None, clock: Clock | None = None,
) -> Run:
    """Stream every file into a byte table, then score the first N rows of the table by path.

    A folder of ``manifests`` (Parquet files with a ``path`` column) takes the place of a listing.

    With a ``location`` the table's files lie there, beside the checkpoint, and outlive a catalog that is kept
    in memory only.

    The cut looks at paths only. The chosen rows are joined back to their bytes, which are not sorted, and
    not shuffled while the chosen paths are few enough to broadcast.
    """
    clock = clock or Clock()
    binary = output_table(params, "", "binary")
    with clock.phase("ingest"):
        if manifests is None:
            ingest(spark, params.image_dir, binary, checkpoint, params.file_glob, location=location)
        else:
            ingest_manifests(spark, manifests, binary, checkpoint, location=location)
    ingested = spark.table(binary).count()
    spent = StepTimes(spark)
    with clock.phase("inference"):
        files = spark.table(binary).select("path", "content")
        rows_in = _wanted(files, files.select("path"), params, output)
        scored = score_and_write(
            rows_in, model, params.micro_batch, output.mode, output.form, content="content", spent=spent
        )
        table = output_table(params, pattern, "predictions")
        with payload_batches(spark, params.micro_batch):
            rows = save_table(scored.withColumn("path", normalise_path("path")), table)
    summary = {
        "pattern": pattern, "dataset": params.dataset, "num_partitions": params.num_partitions,
        "num_ingested": ingested, "num_images": rows,
    }
    return Run(spark.table(table), summary | clock.summary(rows) | spent.summary(), tuple(spent.rows()))


def staged(
    spark: SparkSession, params: RunParams, model: Scorer, output: Output, folder: str,
    batch_size: int = DEFAULT_MODEL_BATCH, pattern: str = "p5", precision: str = "double", write_tasks: int | None = None,
    manifest: DataFrame | None = None, profile: ResourceProfile | None = None, clock: Clock | None = None, whole_set: bool = False,
) -> Run:
    """Decode, score and write as three steps; the result is a Parquet folder.

    Every file is opened and decoded once, by the first step, which leaves a table of pictures dealt by path. The model step
    reads only their small form, and may run on executors of its own (``profile``): it is a stage between two written tables, so
    the others never wait for its hardware, and what writing loses never brings its work back. The write step joins the narrow
    predictions to the pictures where those lie. ``write_tasks`` is the number of files, and so of tasks that write; the pictures are
    dropped at the end. With ``whole_set`` the artifacts replace those of an earlier run together, or not at all.
    """
    clock, spent = clock or Clock(), StepTimes(spark)
    with clock.phase("stages"):
        named, width = _named(_listed(spark, params, manifest=manifest), params, output, params.num_partitions)
        width = write_tasks or width
        spread = named.drop("length").repartition(width, "path")
        pictures = decode_pictures(spread, model.prep, params.micro_batch, output.mode, spent)
        table = output_table(params, pattern, "decoded")
        save_bucketed(pictures, table, "path", width, f"{folder}/decoded")
        held = spark.table(table)
        scored = score_decoded(held.select("path", "small", "error"), model, batch_size, precision, profile, spent)
        with payload_batches(spark, batch_size):
            scored.write.mode("overwrite").parquet(f"{folder}/scored")
        done = spark.read.schema(scored.schema).parquet(f"{folder}/scored")
        if whole_set:
            pictures = picture_bodies(join_bucketed(done, held.drop("small", "error")), params.micro_batch, output.form, spent)
            name = relative_path("output_path", output.folder).alias("name")
            save_set(pictures.where("body is not null").select(name, "body"), output.folder, params.micro_batch)
            target = F.when(F.col("label").isNotNull(), F.col("output_path")).alias("output_path")
            written = join_bucketed(done, held.select("path", "output_path")).select(*done.columns, target)
        else:
            written = write_pictures(join_bucketed(done, held.drop("small", "error")), params.micro_batch, output.form, spent)
        seen = Observation()
        final = written.withColumn("path", normalise_path("path")).observe(seen, F.count(F.lit(1)).alias("n"))
        with payload_batches(spark, params.micro_batch):
            final.write.mode("overwrite").parquet(f"{folder}/predictions")
        spark.sql(f"DROP TABLE {table}")
        delete_folder(shared_uri(spark, f"{folder}/decoded"))
    rows = seen.get["n"]
    summary = {"pattern": pattern, "dataset": params.dataset, "num_images": rows}
    return Run(
        spark.read.schema(final.schema).parquet(f"{folder}/predictions"),
        summary | clock.summary(rows, divisor=clock.phases["stages"]) | spent.summary(), tuple(spent.rows()),
    )


def base64_rows(spark: SparkSession, params: RunParams, manifest: DataFrame | None = None) -> tuple[DataFrame, int]:
    """``path, image_b64`` of the first N files, read by the tasks that hold the paths, and the number of tasks the paths are
    dealt to."""
    listed = _listed(spark, params, manifest=manifest, any_depth=True)
    width = _width(listed, params.num_partitions)
    spread = listed.select(normalise_path("path").alias("path"), F.col("path").alias("_uri")).repartition(width, "path")
    return read_bytes(spread, "_uri").select("path", base64_text("content").alias("image_b64")), width


def served(
    spark: SparkSession, params: RunParams, function: str, output: Output, pattern: str = "p6",
    manifest: DataFrame | None = None, clock: Clock | None = None,
) -> Run:
    """Base64 table, then the registered SQL ``function`` on it, then join back and write.

    Each step is a table, so what a later step loses does not bring the model's work back. The base64 table is dealt by path, so
    the predictions come to its rows and no payload moves.
    """
    clock, spent = clock or Clock(), StepTimes(spark)
    b64, pred, out = (
        output_table(params, p, k) for p, k in (("", "b64"), (pattern, "predictions"), (pattern, "written"))
    )
    with clock.phase("img_to_b64"):
        coded, width = base64_rows(spark, params, manifest)
        save_bucketed(coded, b64, "path", width)
    with clock.phase("model_call"):
        called = spark.sql(
            f"SELECT path, {quote_name(function)}(named_struct('image', image_b64)) AS prediction FROM {b64}"
        )
        with payload_batches(spark, DEFAULT_MODEL_BATCH):
            n_pred = save_table(called, pred)
    with clock.phase("annotate_write"):
        # every field the function answers with: class and reason too, where it was registered with ``errors``
        flat = spark.table(pred).select("path", "prediction.*")
        named = output.name(flat, params.image_dir)
        rows_in = join_bucketed(named, spark.table(b64))
        with_bytes = rows_in.withColumn("content", base64_bytes("image_b64")).drop("image_b64")
        with payload_batches(spark, params.micro_batch):
            rows = save_table(annotate_and_write(with_bytes, batch_size=params.micro_batch, form=output.form, spent=spent), out)
    summary = {
        "pattern": pattern, "dataset": params.dataset, "num_partitions": params.num_partitions, "num_images": rows,
    }
    timing = clock.summary(rows)
    timing["call_images_per_sec"] = rate(n_pred, clock.phases["model_call"])
    return Run(spark.table(out), summary | timing | spent.summary(), tuple(spent.rows()))
