"""The registered queries: every operator over the given tables, whole.

The tables hold no files and no models, so both are derived from them, once per application and data folder:
page files from ``pages``, picture files and linear models from ``embeddings``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreloom.functions import paths as P
from scoreloom.functions import tensors, text
from scoreloom.functions.numbers import rounded
from scoreloom.operators import artifacts, compare, scoring
from scoreloom.operators.ordinals import with_ordinal
from scoreloom.plans import patterns, reports, runlog
from scoreloom.plans.jobs import register_for_scoring_and_serving
from scoreloom.session import (
    RunParams, make_namespace, quote_name, scratch_path, shared_uri, ship_package,
)
from scoreloom.sources import files
from scoreloom.sources.models import ModelStore, Preprocess, average_weights, centroid_weights, stage_model
from scoreloom.sources.models import label_map as map_labels
from scoreloom.streaming import ingest as streaming

# Fixed values of the picture model: input size, channel means and deviations.
PICTURE_PREP = Preprocess(4, (0.485, 0.456, 0.406), (0.229, 0.224, 0.225))
SIDE = 8  # an embedding of 64 numbers is an 8 x 8 picture
SCALE_SPLIT = "2024-01-16"
LOW_PRECISION_DIGITS = 2

_LOADED: dict[tuple[str, str], Inputs] = {}


class Inputs:
    """The tables of one data folder, with the files and models derived from them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def pictures(self) -> DataFrame:
        """Every embedding as a grey 8 x 8 netpbm picture: ``vec_id, label, path, content``."""
        pixel = lambda v: F.greatest(F.lit(0), F.least(F.lit(255), F.floor((v.cast("double") + 1) * 127.5)))
        body = F.array_join(F.transform("embedding", lambda v: F.lpad(F.hex(pixel(v)), 2, "0")), "")
        head = F.encode(F.lit(f"P5\n{SIDE} {SIDE}\n255\n"), "UTF-8")
        name = F.concat(F.lit("class_"), F.col("label"), F.lit("/"), P.ordinal_name("vec_id", ".pgm"))
        return self.table("embeddings").select(
            "vec_id", "label", name.alias("path"), F.concat(head, F.unhex(body)).alias("content")
        )

    def write_files(self, rows: DataFrame, folder: str) -> str:
        prefix = F.lit(shared_uri(self.spark, folder) + "/")
        tasks = self.spark.sparkContext.defaultParallelism
        if rows.rdd.getNumPartitions() < tasks:  # one small input file would be one task
            rows = rows.repartition(tasks)
        files.write_bytes(rows.select(F.concat(prefix, "path").alias("path"), "content"))
        return folder

    @cached_property
    def picture_folder(self) -> str:
        return self.write_files(self.pictures(), scratch_path(self.spark, "pictures"))

    @cached_property
    def page_folder(self) -> str:
        """Every page as a file, nested by top-level domain; ``.html`` for https, ``.htm`` for http."""
        site = F.regexp_extract("url", r"\.example\.([a-z]+)/", 1)
        ending = F.when(F.col("url").startswith("https"), ".html").otherwise(".htm")
        name = F.concat_ws("/", site, P.ordinal_name("page_id", ""))
        body = F.encode("html", "UTF-8")
        pages = self.table("pages").select(F.concat(name, ending).alias("path"), body.alias("content"))
        return self.write_files(pages, scratch_path(self.spark, "pages"))

    @cached_property
    def store(self) -> ModelStore:
        """Models as tables: one over vectors, its ten checkpoints, one over pictures, and its serving form."""
        store = ModelStore(self.spark, scratch_path(self.spark, "models"))
        rows = self.table("embeddings")
        text_of = F.concat(F.lit("class_"), "label").alias("label")
        names = rows.select(F.col("label").alias("class_id"), text_of).distinct()

        version = store.register("vectors", centroid_weights(rows, "embedding", "label"), names)
        store.set_alias("vectors", "prod", version)

        folds = rows.withColumn("version", F.col("vec_id") % 10 + 1)
        store.register_all("vector_checkpoints", centroid_weights(folds, "embedding", "label", "version"))
        store.set_alias("vector_checkpoints", "prod", "9")
        store.set_alias("vector_checkpoints", "prod", "10")

        tensors_ = scoring.picture_tensors(self.pictures(), PICTURE_PREP, batch_size=64)
        weights = centroid_weights(tensors_, "tensor", "label")
        store.register("picture_centroids", weights, prep=PICTURE_PREP)
        register_for_scoring_and_serving(store, "picture_centroids", names, "pictures", "pictures_serving")
        return store

    @cached_property
    def vector_model(self):
        return self.store.load("models:/vectors@prod")

    @cached_property
    def picture_model(self):
        return self.store.load("models:/pictures@prod")

    @cached_property
    def staged_picture_model(self):
        return stage_model(self.spark, self.picture_model, scratch_path(self.spark, "staged-model"))

    def params(self, **changes) -> RunParams:
        """Run parameters with an output schema of their own in the scratch folder."""
        schema = f"scoreloom_{uuid.uuid4().hex[:12]}"
        make_namespace(self.spark, schema, scratch_path(self.spark, schema, unique=False))
        values = {
            "catalog": "", "schema": schema, "dataset": "pictures", "image_dir": self.picture_folder,
            "image_glob": "*/*.pgm", "file_glob": "*.pgm", "n_images": None,
            "num_partitions": self.spark.sparkContext.defaultParallelism, "micro_batch": 64,
        }
        return RunParams(**{**values, **changes})

    def output(self, naming: str = "basename") -> patterns.Output:
        folder = scratch_path(self.spark, "annotated")
        return patterns.Output(folder, naming, form="netpbm")


def inputs(spark: SparkSession, folder: str) -> Inputs:
    key = (spark.sparkContext.applicationId, folder.rstrip("/"))
    if key not in _LOADED:
        ship_package(spark)
        _LOADED[key] = Inputs(spark, folder)
    return _LOADED[key]


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(build: Callable[[Inputs], DataFrame]) -> Callable[[Inputs], DataFrame]:
    QUERIES[build.__name__] = lambda spark, folder: build(inputs(spark, folder))
    return build


def _score(column: Column | str = "score") -> Column:
    return rounded(column).alias("score")


def _scored(df: DataFrame) -> DataFrame:
    return df.select("vec_id", F.col("class_id").cast("int").alias("pred"), _score())


# ---- files ----------------------------------------------------------------------------------------------


def _relative(df: DataFrame, folder: str, *more) -> DataFrame:
    return df.select(P.relative_path("path", folder).alias("path"), *more)


@query
def list_files(x: Inputs) -> DataFrame:
    folder = x.page_folder
    return _relative(files.list_files(x.spark, folder, "*/*"), folder, "length")


@query
def first_files(x: Inputs) -> DataFrame:
    """The first hundred files by path, of all there are: a report whose limit is its point."""
    folder = x.page_folder
    return _relative(files.list_files(x.spark, folder, "*/*.{html,htm}", n=100), folder, "length")


@query
def list_tree(x: Inputs) -> DataFrame:
    folder = x.page_folder
    return _relative(files.list_tree(x.spark, folder, "*.htm*"), folder, "length")


@query
def glob_filter(x: Inputs) -> DataFrame:
    folder = x.page_folder
    found = files.list_files(x.spark, folder, "*.html", any_depth=True)
    return _relative(found, folder, "length")


@query
def binary_scan(x: Inputs) -> DataFrame:
    folder = x.page_folder
    scan = files.binary_scan(x.spark, folder, "*.htm*").select("path", "length", "content")
    return _relative(scan, folder, "length", F.md5("content").alias("md5"))


@query
def read_paths(x: Inputs) -> DataFrame:
    """Bytes read by the tasks that hold the paths."""
    folder = x.page_folder
    listed = files.list_files(x.spark, folder, "*/*")
    tasks = files.tasks_for(listed, x.spark.sparkContext.defaultParallelism)
    body = files.read_bytes(listed.select("path").repartition(tasks))
    return _relative(body, folder, F.md5("content").alias("md5"))


@query
def normalise_path(x: Inputs) -> DataFrame:
    return _document_paths(x).select("doc_id", P.normalise_path("path").alias("path"))


@query
def size_profile(x: Inputs) -> DataFrame:
    return reports.size_profile(x.table("documents"), "lang", "n_chars")


@query
def base64_table(x: Inputs) -> DataFrame:
    coded = x.table("documents").select("doc_id", text.base64_text(F.encode("text", "UTF-8")).alias("b64"))
    return coded.select("doc_id", F.length("b64").cast("bigint").alias("n_chars"), F.md5("b64").alias("md5"))


@query
def base64_roundtrip(x: Inputs) -> DataFrame:
    body = F.encode("html", "UTF-8")
    back = text.base64_bytes(text.base64_text(body))
    return x.table("pages").select("page_id", F.md5(back).alias("md5"), (back == body).alias("same"))


# ---- pictures -------------------------------------------------------------------------------------------


@query
def decode_tensor(x: Inputs) -> DataFrame:
    """Bytes to RGB pixels: grey pictures get three equal channels."""
    return scoring.picture_bytes(x.pictures().select("vec_id", "content"), batch_size=64).select(
        "vec_id", "height", "width", F.md5("data").alias("md5")
    )


@query
def resize_pool(x: Inputs) -> DataFrame:
    size = PICTURE_PREP.size
    return scoring.picture_bytes(x.pictures().select("vec_id", "content"), size, batch_size=64).select(
        "vec_id", "height", "width", F.md5("data").alias("md5")
    )


@query
def picture_tensor(x: Inputs) -> DataFrame:
    made = scoring.picture_tensors(x.pictures().select("vec_id", "content"), PICTURE_PREP, batch_size=64)
    return made.select("vec_id", F.posexplode("tensor").alias("pos", "v")).withColumn("v", rounded("v"))


@query
def normalise_tensor(x: Inputs) -> DataFrame:
    scaled = tensors.scale_and_normalise("embedding", 0.5, 0.5)
    return x.table("embeddings").select("vec_id", F.posexplode(scaled).alias("pos", "v")).select(
        "vec_id", "pos", rounded("v").alias("v")
    )


# ---- models ---------------------------------------------------------------------------------------------


@query
def model_by_alias(x: Inputs) -> DataFrame:
    """Weights of the version an alias points to, found by joining the small tables."""
    aliases = x.store.aliases().where("name = 'vector_checkpoints' AND alias = 'prod'")
    return aliases.join(x.store.weights(), ["name", "version"]).select(
        "name", "alias", "version", "class_id", F.posexplode("weights").alias("dim", "w")
    ).withColumn("w", rounded("w"))


@query
def model_latest(x: Inputs) -> DataFrame:
    latest = x.store.latest("vector_checkpoints")
    held = x.store.weights().groupBy("name", F.col("version").cast("int").alias("version")).agg(
        F.count(F.lit(1)).alias("n_classes"), F.sum(F.size("weights")).alias("n_values")
    )
    return latest.join(held, ["name", "version"])


@query
def model_lineage(x: Inputs) -> DataFrame:
    """The serving model, what it was made from, and whether both hold the same weights."""
    total = x.store.weights().groupBy("name", "version").agg(
        F.count(F.lit(1)).alias("n_classes"),
        rounded(F.sum(F.aggregate("weights", F.lit(0.0), lambda acc, v: acc + v)), 6).alias("weight_sum"),
    )
    origin = x.store.tags().where("name = 'pictures_serving' AND key = 'source_model'")
    tagged = origin.join(x.store.aliases(), ["name", "version"]).select(
        "name", "version", "alias", F.col("value").alias("source_model")
    )
    return tagged.join(total, ["name", "version"])


@query
def label_map(x: Inputs) -> DataFrame:
    code = F.concat(F.lit("n"), F.lpad(F.col("label").cast("string"), 4, "0"))
    rows = x.table("embeddings").select(code.alias("code"), "label").distinct()
    names = rows.select("code", F.concat(F.lit("class_"), "label").alias("label"))
    return map_labels(with_ordinal(rows.select("code"), "code", "class_id"), names)


@query
def weight_soup(x: Inputs) -> DataFrame:
    checkpoints = x.store.weights().where("name = 'vector_checkpoints'")
    return average_weights(checkpoints).select("class_id", F.posexplode("weights").alias("dim", "w")).withColumn(
        "w", rounded("w")
    )


# ---- scoring --------------------------------------------------------------------------------------------


@query
def score_native(x: Inputs) -> DataFrame:
    return _scored(scoring.score_native(x.table("embeddings").select("vec_id", "embedding"), "embedding", x.vector_model))


@query
def score_arrow(x: Inputs) -> DataFrame:
    return _scored(scoring.score_arrow(x.table("embeddings").select("vec_id", "embedding"), "embedding", x.vector_model))


@query
def score_batches(x: Inputs) -> DataFrame:
    rows = x.table("embeddings").select("vec_id", "embedding")
    return _scored(scoring.score_batches(rows, "embedding", x.vector_model, SIDE * SIDE))


@query
def score_blocks(x: Inputs) -> DataFrame:
    """The model staged in blocks that tasks wrote and workers map, without its weights on the driver."""
    model = x.store.stage("models:/vectors@prod", scratch_path(x.spark, "blocks"))
    return _scored(scoring.score_arrow(x.table("embeddings").select("vec_id", "embedding"), "embedding", model))


@query
def softmax(x: Inputs) -> DataFrame:
    shares = tensors.softmax(F.transform("embedding", lambda v: v.cast("double")))
    return x.table("embeddings").select("vec_id", F.posexplode(shares).alias("pos", "p")).withColumn("p", rounded("p"))


@query
def served_score(x: Inputs) -> DataFrame:
    """The model called from SQL, struct in and struct out, then flattened."""
    scoring.register_served(x.spark, "vector_query", scoring.ServedVectors(x.vector_model))
    called = x.table("embeddings").selectExpr("vec_id", "vector_query(named_struct('features', embedding)) AS prediction")
    flat = called.selectExpr("vec_id", "prediction.label AS label", "prediction.score AS score")
    return flat.withColumn("score", rounded("score"))


@query
def classify_pictures(x: Inputs) -> DataFrame:
    """Image bytes of a table, scored in place by the staged model."""
    rows = x.pictures().select("vec_id", scoring.classify_content("content", x.staged_picture_model, 64).alias("p"))
    return rows.select("vec_id", F.col("p.class_id").alias("pred"), F.col("p.label").alias("label"), _score("p.score"))


@query
def label_lookup(x: Inputs) -> DataFrame:
    """Names exist for the classes of at least average size; the others fall back to their index."""
    rows = x.table("embeddings")
    sizes = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    mean = sizes.agg(F.avg("n").alias("m"))
    large = sizes.where(F.col("n") >= mean.scalar()).select(F.col("label").alias("class_id"))
    named = x.store.labels().where("name = 'vectors'").join(large, "class_id").select("class_id", "label")
    scored = scoring.score_arrow(rows.select("vec_id", "embedding"), "embedding", x.vector_model)
    label = F.coalesce("label", F.col("class_id").cast("string")).alias("label")
    return scored.join(named, "class_id", "left").select("vec_id", F.col("class_id").alias("pred"), label)


@query
def logit_ensemble(x: Inputs) -> DataFrame:
    checkpoints = x.store.load_versions("vector_checkpoints")
    rows = x.table("embeddings").select("vec_id", "embedding")
    mean = scoring.ensemble_logits(rows, "embedding", checkpoints)
    return mean.select("vec_id", F.inline_outer("logits")).withColumn("z", rounded("z"))


@query
def predictions_table(x: Inputs) -> DataFrame:
    """Scores saved over an older table, counted by the job that writes them."""
    params = x.params(dataset="vectors")
    scored = scoring.score_arrow(x.table("embeddings").select("vec_id", "embedding"), "embedding", x.vector_model)
    labelled = scoring.with_label(scored, x.vector_model.labels).select("vec_id", "label", _score())
    table = quote_name(params.schema, "bench_vectors_predictions")
    patterns.save_table(labelled.withColumn("score", F.lit(0.0)), table)
    rows = patterns.save_table(labelled, table)
    return x.spark.table(table).withColumn("n_rows", F.lit(rows).cast("bigint"))


# ---- artifacts ------------------------------------------------------------------------------------------


def _document_paths(x: Inputs) -> DataFrame:
    """Every document as a nested file path with a mount scheme."""
    name = P.ordinal_name("doc_id", ".txt")
    return x.table("documents").select(
        "doc_id", "lang", F.concat(F.lit("file:/vol/"), F.concat_ws("/", "lang", name)).alias("path")
    )


@query
def caption(x: Inputs) -> DataFrame:
    score = F.col("n_chars") / (F.col("n_chars") + 2000.0)
    return x.table("documents").select("doc_id", text.caption("lang", score).alias("caption"))


@query
def artifact_by_ordinal(x: Inputs) -> DataFrame:
    paths = _document_paths(x).select("path")
    return artifacts.with_output_path(paths, "/out/annotated", "ordinal").select("path", "ordinal", "output_path")


@query
def artifact_by_basename(x: Inputs) -> DataFrame:
    named = artifacts.with_output_path(_document_paths(x), "/out/annotated", "basename")
    return named.select("doc_id", "output_path")


@query
def name_clashes(x: Inputs) -> DataFrame:
    """Base names that several pages would share."""
    bare = F.regexp_replace("url", r"/?([?#].*)?$", "")
    pages = x.table("pages").select(bare.alias("path"))
    return artifacts.name_clashes(artifacts.with_output_path(pages, "/out", "basename"))


@query
def written_artifacts(x: Inputs) -> DataFrame:
    """The files a run leaves behind, written as a whole set and read back from its folder."""
    output = x.output("relative")
    patterns.staged(x.spark, x.params(), x.picture_model, output, scratch_path(x.spark, "staged"), whole_set=True)
    written = files.binary_scan(x.spark, output.folder, "*.pgm")
    note = F.regexp_extract(F.decode(F.substring("content", 1, 200), "ISO-8859-1"), "# ([^\n]*)\n", 1)
    return _relative(written, output.folder, "length", note.alias("caption"))


# ---- runs -----------------------------------------------------------------------------------------------


def _run_rows(x: Inputs, run: patterns.Run, output: patterns.Output) -> DataFrame:
    name = P.relative_path("output_path", output.folder)
    return _relative(run.table, x.picture_folder, "label", _score(), name.alias("artifact"))


@query
def run_direct_ordinal(x: Inputs) -> DataFrame:
    output = x.output("ordinal")
    return _run_rows(x, patterns.direct(x.spark, x.params(), x.picture_model, output, "p1"), output)


@query
def run_direct(x: Inputs) -> DataFrame:
    output = x.output()
    return _run_rows(x, patterns.direct(x.spark, x.params(), x.staged_picture_model, output, "p3"), output)


@query
def run_ingest(x: Inputs) -> DataFrame:
    output, params = x.output(), x.params()
    checkpoint = scratch_path(x.spark, "ingest-checkpoint")
    return _run_rows(x, patterns.ingest_then_score(x.spark, params, x.picture_model, output, checkpoint), output)


@query
def run_staged(x: Inputs) -> DataFrame:
    output = x.output()
    run = patterns.staged(x.spark, x.params(), x.picture_model, output, scratch_path(x.spark, "staged"))
    return _run_rows(x, run, output)


@query
def run_served(x: Inputs) -> DataFrame:
    output = x.output()
    scoring.register_served(x.spark, "model_query", scoring.ServedImages(x.picture_model, 64))
    return _run_rows(x, patterns.served(x.spark, x.params(), "model_query", output), output)


@query
def run_direct_first(x: Inputs) -> DataFrame:
    """A run over the first hundred pictures by path, which is what was asked for."""
    output = x.output()
    return _run_rows(x, patterns.direct(x.spark, x.params(n_images=100), x.picture_model, output, "p3"), output)


@query
def run_ingest_first(x: Inputs) -> DataFrame:
    """Every file is ingested, the first hundred by path are scored."""
    output, params = x.output(), x.params(n_images=100)
    checkpoint = scratch_path(x.spark, "ingest-checkpoint")
    return _run_rows(x, patterns.ingest_then_score(x.spark, params, x.picture_model, output, checkpoint), output)


@query
def score_class_gap(x: Inputs) -> DataFrame:
    """A model that lacks a class, by all three scorers: class ids are those it was trained on."""
    rows = x.table("embeddings")
    weights = centroid_weights(rows.where("label <> 3"), "embedding", "label")
    if "gapped" not in [r["name"] for r in x.store.versions("gapped").select("name").collect()]:
        x.store.register("gapped", weights)
    model, kept = x.store.load("models:/gapped/1"), rows.select("vec_id", "embedding")
    out = scoring.score_arrow(kept, "embedding", model).withColumnRenamed("class_id", "arrow")
    out = scoring.score_native(out.drop("score"), "embedding", model).withColumnRenamed("class_id", "native")
    out = scoring.score_batches(out.drop("score"), "embedding", model, SIDE * SIDE)
    return out.select("vec_id", F.col("arrow").cast("int"), F.col("native").cast("int"), F.col("class_id").cast("int").alias("batches"), "label", _score())


@query
def join_payload(x: Inputs) -> DataFrame:
    predictions = x.table("labels").select("doc_id", F.col("quality").cast("string").alias("label"))
    joined = compare.join_payload(predictions, x.table("documents").select("doc_id", "text"), "doc_id")
    return joined.select("doc_id", "label", F.length("text").cast("bigint").alias("n"), F.md5("text").alias("md5"))


# ---- streams --------------------------------------------------------------------------------------------


@query
def ingest_stream(x: Inputs) -> DataFrame:
    """Files streamed into a table; a second start finds nothing new."""
    params, checkpoint = x.params(), scratch_path(x.spark, "checkpoint")
    table = quote_name(params.schema, "bench_pages_binary")
    for _ in range(2):
        streaming.ingest(x.spark, x.page_folder, table, checkpoint, "*.htm*")
    rows = x.spark.table(table).select("path", "length", "content")
    return _relative(rows, x.page_folder, "length", F.md5("content").alias("md5"))


@query
def ingest_manifest(x: Inputs) -> DataFrame:
    """The same files, named by manifests instead of found by listing; they arrive in two steps."""
    params, checkpoint, folder = x.params(), scratch_path(x.spark, "checkpoint"), scratch_path(x.spark, "manifests")
    table = quote_name(params.schema, "bench_pages_binary")
    listed = files.list_files(x.spark, x.page_folder, "*/*").select("path")
    for secure in (True, False):
        found = listed.where(F.endswith("path", F.lit(".html")) == F.lit(secure))
        found.write.mode("append").parquet(folder)
        streaming.ingest_manifests(x.spark, folder, table, checkpoint)
    rows = x.spark.table(table)
    return _relative(rows, x.page_folder, "length", F.md5("content").alias("md5"))


@query
def incremental_score(x: Inputs) -> DataFrame:
    """Files arrive twice; each time they are ingested, and a second stream scores what came into the byte table."""
    params, folder, checkpoint = x.params(), scratch_path(x.spark, "arrivals"), scratch_path(x.spark, "checkpoint")
    binary, predictions = (quote_name(params.schema, t) for t in ("bench_pictures_binary", "predictions"))
    early = F.coalesce(F.col("label") < 5, F.lit(False))
    for arrived in (early, ~early):
        x.write_files(x.pictures().where(arrived), folder)
        streaming.ingest(x.spark, folder, binary, checkpoint, "*.pgm")
        streaming.score_arrivals(x.spark, binary, predictions, x.picture_model, f"{checkpoint}-scoring")
    return _relative(x.spark.table(predictions), folder, "label", _score())


# ---- run log and reports --------------------------------------------------------------------------------


@query
def run_log(x: Inputs) -> DataFrame:
    """Mixed entries of every run in long form; only those that are numbers become metrics."""
    entry = lambda k, v: F.struct(F.lit(k).alias("key"), v.cast("string").alias("value"))
    entries = x.table("events").select(
        F.col("user_id").alias("run"),
        F.inline(F.array(
            entry("pattern", F.col("event_type")), entry("seconds", F.col("value")),
            entry("k", F.get_json_object("props", "$.k")),
        )),
    )
    amount = F.col("value").cast(reports.SECONDS)
    return runlog.numeric_entries(entries).groupBy("run", "key").agg(
        F.count(F.lit(1)).alias("n"), F.sum(amount).cast("double").alias("total")
    )


class _Ticks:
    """A clock on which a second passes between any two looks at it."""

    def __init__(self):
        self.seconds = 0

    def __call__(self) -> int:
        self.seconds += 1
        return self.seconds


@query
def run_phases(x: Inputs) -> DataFrame:
    """All six patterns run and logged, by a fixed clock, and their phases read back with their shares of the wall."""
    log, n = runlog.RunLog(x.spark, scratch_path(x.spark, "runs")), x.spark.sparkContext.defaultParallelism
    scoring.register_served(x.spark, "phases_query", scoring.ServedImages(x.picture_model, 64))
    folder = lambda name: scratch_path(x.spark, name)
    runs = {
        "p1": lambda p, o, c: patterns.direct(x.spark, p, x.picture_model, o, "p1", clock=c),
        "p2": lambda p, o, c: patterns.direct(x.spark, p, x.picture_model, o, "p2", clock=c),
        "p3": lambda p, o, c: patterns.direct(x.spark, p, x.staged_picture_model, o, "p3", clock=c),
        "p4": lambda p, o, c: patterns.ingest_then_score(x.spark, p, x.picture_model, o, folder("ingest"), clock=c),
        "p5": lambda p, o, c: patterns.staged(x.spark, p, x.picture_model, o, folder("staged"), clock=c),
        "p6": lambda p, o, c: patterns.served(x.spark, p, "phases_query", o, clock=c),
    }
    for pattern, run in runs.items():
        done = run(x.params(), x.output("ordinal" if pattern in ("p1", "p2") else "basename"), runlog.Clock(_Ticks()))
        log.log(done.summary, {"pattern": pattern, "num_partitions": n}, done.steps)
    images = log.walls().select("run_id", F.col("num_images").cast("bigint").alias("num_images"))
    # what the tasks wrote, added up from their own rows
    written = log.steps().where("step = 'write'").select("run_id", F.col("rows").alias("num_written"))
    return log.shares().join(images, "run_id").join(written, "run_id").select("pattern", "phase", "seconds", "share", "num_images", "num_written")


@query
def run_name(x: Inputs) -> DataFrame:
    return x.table("events").select("event_id", text.results_name("ts").alias("name"))


@query
def phase_breakdown(x: Inputs) -> DataFrame:
    return reports.phase_breakdown(x.table("events"), "user_id", "event_type", "value")


@query
def phase_columns(x: Inputs) -> DataFrame:
    """Three phases by name; the two others are not lost."""
    return reports.phase_columns(x.table("events"), "user_id", "event_type", "value", ("click", "error", "purchase"))


@query
def short_phases(x: Inputs) -> DataFrame:
    """The same phases as they would be if a second took a microsecond's tenth of a thousandth part."""
    tiny = F.floor(F.col("value") * 100 + 0.5) * F.lit(0.000001)
    return reports.phase_breakdown(x.table("events").withColumn("value", tiny), "user_id", "event_type", "value")


@query
def throughput(x: Inputs) -> DataFrame:
    return reports.throughput(x.table("events"), "user_id", "value")


@query
def run_ranking(x: Inputs) -> DataFrame:
    return reports.run_ranking(x.table("events"), "user_id", "value")


def _second() -> Column:
    return F.col("ts") >= F.lit(SCALE_SPLIT).cast("timestamp_ntz")


@query
def dataset_delta(x: Inputs) -> DataFrame:
    return reports.dataset_delta(x.table("events"), "event_type", _second(), "value")


@query
def scaling_report(x: Inputs) -> DataFrame:
    return reports.scaling_report(x.table("events"), "event_type", _second(), "value")


@query
def cold_warm(x: Inputs) -> DataFrame:
    return reports.cold_warm(x.table("events"), "user_id", reports.time_order("ts", "event_id"), "value")


@query
def best_by_scale(x: Inputs) -> DataFrame:
    rows = x.table("events").withColumn("size", F.col("ts").cast("date").cast("string"))
    return reports.best_by_scale(rows, "size", "event_type", "value")


@query
def billed_time(x: Inputs) -> DataFrame:
    return reports.billed_time(x.table("events"), "user_id", "event_type", "value", startup="signup", queue="error")


@query
def cost_report(x: Inputs) -> DataFrame:
    return reports.cost_report(
        x.table("lineitem"), x.table("part"), sku="l_returnflag", key="l_partkey", price_key="p_partkey",
        units="l_quantity", price="p_retailprice", by="p_brand",
    )


@query
def scorer_agreement(x: Inputs) -> DataFrame:
    """Full against reduced precision, compared row by row."""
    rows = x.table("embeddings").select("vec_id", "embedding")
    both = [
        scoring.score_arrow(rows, "embedding", m).select("vec_id", "class_id")
        for m in (x.vector_model, x.vector_model.rounded(LOW_PRECISION_DIGITS))
    ]
    return compare.agreement(*both, key="vec_id", column="class_id")


@query
def half_agreement(x: Inputs) -> DataFrame:
    """Full against half-precision weights; both models see each row in the same pass, and nothing is joined."""
    rows = x.table("embeddings").select("vec_id", "embedding")
    both = scoring.score_models(rows, "embedding", {"full": x.vector_model, "half": x.vector_model.half()})
    return both.select(F.col("full").eqNullSafe(F.col("half")).alias("same")).agg(*compare.agreement_columns("same"))


@query
def completeness(x: Inputs) -> DataFrame:
    return compare.completeness(x.table("documents"), x.table("labels").select("doc_id"), "lang", "doc_id")


@query
def failed_predictions(x: Inputs) -> DataFrame:
    """Predictions without a label are missing, not scored."""
    label = F.when(F.col("quality") == 1, F.lit("good")).alias("label")
    return compare.completeness(x.table("documents"), x.table("labels").select("doc_id", label), "lang", "doc_id")


@query
def partial_agreement(x: Inputs) -> DataFrame:
    """Two sets of predictions, with nulls, of which each lacks rows of the other."""
    a = x.table("labels").select("doc_id", F.when(F.col("quality") == 1, F.lit("good")).alias("label"))
    b = x.table("embeddings").select(F.col("vec_id").alias("doc_id"), F.when(F.col("label") < 5, F.lit("good")).alias("label"))
    return compare.agreement(a, b, key="doc_id")


@query
def missing_inputs(x: Inputs) -> DataFrame:
    inputs_ = x.table("documents").select("doc_id", "lang")
    return compare.missing(inputs_, x.table("labels").select("doc_id"), "doc_id")
