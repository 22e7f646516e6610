"""Incremental ingest of files into a byte table, and scoring of what is new in it."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scoreloom.operators.compare import missing
from scoreloom.operators.ordinals import running_totals
from scoreloom.operators.scoring import classify_content
from scoreloom.session import DEFAULT_MODEL_BATCH, materialise, payload_batches, quote_name, shared_uri
from scoreloom.sources.files import DRIVER_ENTRIES, TASK_BYTES, list_tree, read_bytes, with_lengths
from scoreloom.sources.models import Scorer
from scoreloom.sources.storage import delete_folder, exists, write_file

FILES_PER_MANIFEST = 100_000
MANIFESTS_PER_BATCH = 1000
BATCH_BYTES = 64 << 30  # most input bytes of one micro-batch, unless a single file is larger
_LEAST_SHARE = 1 << 20  # bytes that are worth a task of their own
_OPEN_BYTES = 256 << 10  # bytes that are read in the time it takes to open a file and to write its row
_CHECKPOINT = "scoreloom.checkpoint"
INGESTED = T.StructType([T.StructField("path", T.StringType()), T.StructField("length", T.LongType()), T.StructField("content", T.BinaryType())])
MANIFEST = T.StructType([T.StructField("path", T.StringType()), T.StructField("length", T.LongType()), T.StructField("slot", T.IntegerType())])


def _manifests(checkpoint: str) -> str:
    return f"{checkpoint.rstrip('/')}-manifests"


def admit(files: DataFrame, folder: str, batch_bytes: int = BATCH_BYTES, files_per_manifest: int = FILES_PER_MANIFEST) -> bool:
    """Write ``path, length`` files as manifests below ``folder``, each of which names at most ``batch_bytes`` of them, or one
    larger file, and no more than ``files_per_manifest``; false if there is no file.

    Files are laid end to end in path order and cut by where they begin: those of up to half the budget at every half of it, so
    none crosses a budget by more than it leaves free; larger ones are manifests of their own. ``slot`` cuts each manifest in the
    same way into the shares of its tasks, where a file counts at least as much as opening it costs: tasks are as many
    for a million small files as for their time in large ones. A few files are laid out by the driver, more by distributed running totals.
    """
    spark, half = files.sparkSession, max(batch_bytes // 2, 1)
    share = max(min(TASK_BYTES, -(-batch_bytes // spark.sparkContext.defaultParallelism)) // 2, min(_LEAST_SHARE, half))
    least = min(_OPEN_BYTES, max(share // 16, 1))
    few = sorted(files.select("path", "length").limit(DRIVER_ENTRIES + 1).collect())
    if not few:
        return False
    if len(few) <= DRIVER_ENTRIES:
        rows, begin, cost = [], 0, 0
        for number, (path, length) in enumerate(few):
            rows.append((path, length, begin, number, cost))
            begin, cost = begin + length, cost + (max(length, least) if length <= half else 0)
        laid = spark.createDataFrame(rows, "path string, length long, begin long, number long, cost long").coalesce(1)
    else:
        cost = F.when(F.col("length") <= half, F.greatest("length", F.lit(least))).otherwise(0)
        costs = files.select("path", "length", F.lit(1).alias("_one"), cost.alias("_cost"))
        laid = running_totals(costs, "path", {"begin": "length", "number": "_one", "cost": "_cost"})
    small, div = F.col("length") <= half, lambda x, y: F.call_function("div", F.col(x), F.lit(y))
    whole = F.concat_ws("-", div("begin", half), div("number", files_per_manifest))
    cut = laid.withColumn("manifest", F.when(small, whole).otherwise(F.concat(F.lit("large-"), F.col("begin"))))
    cut = cut.repartition("manifest")
    first = F.min("cost").over(Window.partitionBy("manifest"))
    slot = F.when(small, F.call_function("div", F.col("cost") - first, F.lit(share))).otherwise(0)
    # a folder of its own: a start that is lost leaves whole manifests or none that count
    named = cut.select("path", "length", "manifest", slot.cast("int").alias("slot"))
    named.write.partitionBy("manifest").option("maxRecordsPerFile", files_per_manifest).parquet(f"{folder}/{uuid.uuid4().hex}")
    return True


def manifest_stream(spark: SparkSession, folder: str, manifests_per_batch: int = 1) -> DataFrame:
    """Stream of the files that admitted manifests name; tasks open the files, by the shares that the manifests gave them.

    The checkpoint remembers manifests. A micro-batch takes one manifest unless asked otherwise, so it reads no more bytes than
    a manifest may name.
    """
    slots = spark.read.schema(MANIFEST).option("recursiveFileLookup", "true").parquet(folder).agg(F.max("slot").alias("n")).first()["n"]
    # By default a file that is a week older than the newest one seen is passed over; none may be.
    named = (
        spark.readStream.schema(MANIFEST).option("maxFilesPerTrigger", manifests_per_batch).option("recursiveFileLookup", "true")
        .option("maxFileAge", "36500d").parquet(folder)
    )
    tasks = (slots or 0) + 1
    slot = F.coalesce("slot", F.pmod(F.hash("path"), F.lit(tasks)))
    spread = named.withColumn("slot", F.pmod(slot, F.lit(tasks))).repartitionById(tasks, "slot").select("path")
    return read_bytes(spread).select("path", F.octet_length("content").cast("bigint").alias("length"), "content")


def ingest(
    spark: SparkSession, folder: str, table: str, checkpoint: str, glob: str | None = None,
    files_per_manifest: int = FILES_PER_MANIFEST, location: str | None = None, batch_bytes: int = BATCH_BYTES,
) -> list[dict]:
    """Drain the files that have arrived in ``folder`` into ``table``, then stop.

    What the listing has and no manifest names yet is written as manifests beside the checkpoint, however old it is; the
    stream takes them in, at most ``batch_bytes`` of files at a time. A start that was lost between the two finds its manifests
    there. Returns the stream's progress.
    """
    manifests = _manifests(checkpoint)
    fresh = list_tree(spark, folder, glob)
    known = not list_tree(spark, manifests, "*.parquet").isEmpty()
    if known:
        named = spark.read.schema(MANIFEST).option("recursiveFileLookup", "true").parquet(manifests)
        fresh = materialise(fresh.join(named.select("path"), "path", "left_anti"), "arrived")
    return _drain_admitted(spark, known | admit(fresh, manifests, batch_bytes, files_per_manifest), table, checkpoint, location)


def ingest_manifests(
    spark: SparkSession, folder: str, table: str, checkpoint: str,
    manifests_per_batch: int = MANIFESTS_PER_BATCH, location: str | None = None, batch_bytes: int = BATCH_BYTES,
) -> list[dict]:
    """The same for the files named by the manifests that have arrived in ``folder``: Parquet files with a ``path`` column, and a
    ``length`` where the sender knows it. For collections that nobody wants to list, where a store's change feed names what is new.

    A first stream remembers what has arrived, ``manifests_per_batch`` at a time, and cuts it to the budget; the files themselves
    are read by the stream that ``ingest`` uses. A part that is repeated replaces what it wrote before.
    """
    manifests = _manifests(checkpoint)
    if list_tree(spark, folder, "*.parquet").isEmpty():
        return _drain_admitted(spark, False, table, checkpoint, location)
    arrived = spark.readStream.schema("path string, length long").option("maxFilesPerTrigger", manifests_per_batch).option("maxFileAge", "36500d").parquet(folder)

    def take(rows: DataFrame, number: int) -> None:
        mine = f"{manifests}/arrived-{number}"
        delete_folder(shared_uri(spark, mine))
        spread = rows.repartition(rows.sparkSession.sparkContext.defaultParallelism)  # one small manifest would be one task
        admit(materialise(with_lengths(spread), "arrived"), mine, batch_bytes)

    run = arrived.writeStream.option("checkpointLocation", f"{checkpoint.rstrip('/')}-arrivals").trigger(availableNow=True).foreachBatch(take)
    run.start().awaitTermination()
    return _drain_admitted(spark, not list_tree(spark, manifests, "*.parquet").isEmpty(), table, checkpoint, location)


def _drain_admitted(spark: SparkSession, some: bool, table: str, checkpoint: str, location: str | None) -> list[dict]:
    if not some:
        _bind(spark, table, INGESTED, checkpoint, location)
        return []
    return drain(manifest_stream(spark, _manifests(checkpoint)), table, checkpoint, location)


def drain(stream: DataFrame, table: str, checkpoint: str, location: str | None = None) -> list[dict]:
    """Write everything that has arrived into ``table``, then stop; returns the progress of its last batches. Each row lands once,
    across restarts.

    Table and checkpoint belong together: a table counts the batches of its checkpoint, and would take those
    of another one for repeats and drop them. So a second checkpoint is refused.
    """
    _bind(stream.sparkSession, table, stream.schema, checkpoint, location)
    query = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).toTable(table)
    query.awaitTermination()
    return [json.loads(p.json) for p in query.recentProgress]


def _bind(spark: SparkSession, table: str, schema: T.StructType, checkpoint: str, location: str | None) -> None:
    """Create the table with its checkpoint's name, before the first batch: no crash leaves one without the other."""
    bound = _bound_checkpoint(spark, table)
    if bound not in (None, checkpoint):
        raise ValueError(f"{table} is fed by the checkpoint {bound}")
    if bound is None:
        text = lambda s: "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"
        columns = ", ".join(f"{quote_name(f.name)} {f.dataType.simpleString()}" for f in schema)
        where = "" if location is None else f" LOCATION {text(location)}"
        spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({columns}) USING parquet{where} TBLPROPERTIES ({text(_CHECKPOINT)} = {text(checkpoint)})")
        if _bound_checkpoint(spark, table) != checkpoint:
            raise ValueError(f"{table} is there already and fed by no checkpoint of its own")


def _bound_checkpoint(spark: SparkSession, table: str) -> str | None:
    if not spark.catalog.tableExists(table):
        return None
    found = spark.sql(f"SHOW TBLPROPERTIES {table}").where(F.col("key") == _CHECKPOINT).first()
    return None if found is None else found["value"]


def unscored(binary: DataFrame, predictions: DataFrame) -> DataFrame:
    """Rows of the byte table that have no prediction yet; one that failed counts as done.

    The paths are compared first, without content. Only then is content read, and it is shuffled only when
    the new paths are too many to broadcast.
    """
    todo = materialise(missing(binary.select("path"), predictions.select("path")), "unscored")
    return binary.join(todo, "path", "left_semi")


def score_new(
    spark: SparkSession, binary_table: str, predictions_table: str, model: Scorer, mode: str = "FAILFAST"
) -> None:
    """Append predictions for the rows that have none; a second call with nothing new appends nothing."""
    binary = spark.table(binary_table).select("path", "content")
    if spark.catalog.tableExists(predictions_table):
        binary = unscored(binary, spark.table(predictions_table))
    scored = binary.select("path", classify_content("content", model, mode=mode).alias("p"))
    scored.select("path", "p.label", "p.score", "p.error").write.mode("append").saveAsTable(predictions_table)


def score_arrivals(
    spark: SparkSession, binary_table: str, predictions_table: str, model: Scorer, checkpoint: str, mode: str = "FAILFAST",
    batch_bytes: int = BATCH_BYTES,
) -> None:
    """Score what has arrived in a byte table since the last call, then stop; the table stays as it is for other readers.

    A stream of its own remembers how far it has read, so nothing is compared with earlier predictions. The predictions of a
    micro-batch are one partition (``batch``), which a repeated batch replaces as a whole; once it is written, the batch is entered in
    a ledger beside the checkpoint, and a batch that stands there is not scored again.
    """
    ledger = f"{checkpoint.rstrip('/')}-ledger"
    spark.sql(f"CREATE TABLE IF NOT EXISTS {predictions_table} (path STRING, label STRING, score DOUBLE, error STRING, batch BIGINT) USING parquet PARTITIONED BY (batch)")
    arrived = spark.readStream.option("maxBytesPerTrigger", batch_bytes).option("maxFileAge", "36500d").table(binary_table)

    def score(rows: DataFrame, number: int) -> None:
        entry = f"{shared_uri(spark, ledger)}/{number}"
        if exists(entry):
            return
        found = rows.select("path", classify_content("content", model, mode=mode).alias("p"))
        scored = found.select("path", "p.label", "p.score", "p.error")
        # a partition that is named is the only one replaced
        rows.sparkSession.sql(f"INSERT OVERWRITE TABLE {predictions_table} PARTITION (batch = {int(number)}) SELECT * FROM {{scored}}", scored=scored)
        write_file(entry, b"scored")

    run = arrived.select("path", "content").writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(score)
    try:
        with payload_batches(spark, DEFAULT_MODEL_BATCH):  # the stream takes the setting with it
            query = run.start()
        query.awaitTermination()
    finally:
        spark.catalog.refreshTable(predictions_table)  # the stream wrote it in a session of its own


def prediction_rows(df: DataFrame) -> DataFrame:
    return df.select("path", "label", F.col("score").alias("confidence"))
