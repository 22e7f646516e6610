"""Exact deduplication as a stateful stream: RocksDB keeps one entry per digest and never expires it.

Every row's normalised text is digested once; the narrow rows (digest, size, identifier, locator) are written and streamed
through a keyed aggregate whose state keeps, per digest, the row that stays: its identifier, where its content lies, and
the number of rows. Digests met more than once are *hits*; their full normalised texts are compared byte by byte, and
texts that differ under one digest are told apart. Only DataFrame operations run; no text of an unrepeated row is shuffled.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreloom.session import materialise, scratch_path

# Fixed value: the characters that don't count.
SPACE = r"[\x20\x09-\x0D]"
BATCHES = 4  # the keys of a table arrive in about so many micro-batches
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "128",
    "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "2",  # each store takes an eighth of it at once
    "spark.sql.streaming.stateStore.maintenanceInterval": "10s",  # finished streams give their stores back soon
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # a store would set aside megabytes before it has rows
    "spark.sql.streaming.metricsEnabled": "false",
}
BUCKETS = 1024  # of 32768 bits each: what marks the digests met more than once, 4 MB whatever the table


def normalised(text: str = "text") -> Column:
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), SPACE, "")


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def whole(docs: DataFrame) -> Column:
    """All columns of a row as one, ``_row``, so that none clashes with those added beside it."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")


def located(docs: DataFrame) -> DataFrame:
    """Rows as ``_row, _place, text, doc_id``: whole, and the file and row number they lie at. A table that was computed has
    no such places, and a second run might number its rows otherwise: it is written first."""
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")).alias("_place")
    pick = lambda df: df.select(whole(df), place, "text", "doc_id")
    try:
        return pick(docs)
    except AnalysisException:
        return pick(materialise(docs, "dedup-input"))


def state_of(spark: SparkSession, keys: str, schema, checkpoint: str) -> DataFrame:
    """Stream the key files through the keyed state; returns ``digest, best, size``. Called again with the same
    checkpoint, it takes in only what is new and the state goes on."""
    session = spark.newSession()
    for name, value in STATE.items():
        session.conf.set(name, value)
    session.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    files = len(session.read.schema(schema).parquet(keys).inputFiles())
    stream = session.readStream.schema(schema).option("maxFilesPerTrigger", max(1, -(-files // BATCHES))).option("maxFileAge", "36500d").parquet(keys)
    best = F.max(F.struct("points", (-F.col("doc_id")).alias("minus_id"), "place", "part"))
    grouped = stream.groupBy("digest").agg(best.alias("best"), F.count(F.lit(1)).alias("size"))
    query = (
        grouped.writeStream.format("noop").outputMode("update").option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    rows = session.read.format("statestore").load(checkpoint)
    best, size = [f.name for f in rows.schema["value"].dataType.fields]
    # read by the session that holds the state's settings, and written once
    out = scratch_path(spark, "dedup-state")
    rows.select("key.digest", F.col(f"value.`{best}`").alias("best"), F.col(f"value.`{size}`").alias("size")).write.parquet(out)
    return spark.read.parquet(out)


def _bit(digest: str = "digest") -> Column:
    return F.pmod(F.xxhash64(digest), F.lit(BUCKETS * 32768))


def marks(hits: DataFrame) -> DataFrame:
    """Bitmaps of the hits' digests by bucket; at most BUCKETS rows of 4 KB."""
    at = hits.select(_bit().alias("at")).select(F.floor(F.col("at") / 32768).alias("bucket"), (F.col("at") % 32768).alias("bit"))
    return at.groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))


def maybe_repeated(df: DataFrame, hits: DataFrame) -> Column:
    """Whether a row's digest may be among the hits (never wrong for those that are); needs ``marked(df)``."""
    byte = F.conv(F.hex(F.substring("bits", (F.col("_at") % 32768 / 8).cast("int") + 1, 1)), 16, 10).cast("int")
    return F.coalesce(byte.bitwiseAND(F.shiftleft(F.lit(1), 0) * F.pow(F.lit(2), F.col("_at") % 8).cast("int")) != 0, F.lit(False))


def with_marks(df: DataFrame, hits: DataFrame) -> DataFrame:
    """``df`` (with ``digest``) plus ``_maybe``: a broadcast of fixed size settles most rows without a shuffle."""
    small = F.broadcast(marks(hits))  # BUCKETS rows at most
    joined = df.withColumn("_at", _bit()).withColumn("bucket", F.floor(F.col("_at") / 32768)).join(small, "bucket", "left")
    return joined.withColumn("_maybe", maybe_repeated(joined, hits)).drop("_at", "bucket", "bits")


def exact_groups(docs: DataFrame, digest=sha256, checkpoint: str | None = None) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` and ``_place`` (where the row lies) of every row.

    Texts are equal when the same but for white space (null is empty; all blank texts are equal). The row with the most
    code points stays, then the one with the smallest ``doc_id`` (null after all others), then the last in place; of rows
    alike in all of these exactly one is ``kept``. ``digest`` is a parameter so that tests can make digests collide.
    """
    return _groups(located(docs), digest, checkpoint)


def _groups(docs: DataFrame, digest=sha256, checkpoint: str | None = None) -> DataFrame:
    spark = docs.sparkSession
    norm = normalised()
    rows = docs.select(
        digest(norm).alias("digest"), sha256(norm).alias("text_sha256"), "doc_id", F.col("_place").alias("place"),
        F.char_length(F.coalesce("text", F.lit(""))).cast("long").alias("points"), F.lit("").alias("part"),
    )
    keys = scratch_path(spark, "dedup-keys")
    rows.write.parquet(keys)
    rows = spark.read.parquet(keys)
    state = state_of(spark, keys, rows.schema, checkpoint or scratch_path(spark, "dedup-checkpoint"))
    hits = state.where("size > 1")
    # full bytes of the hits: one text per digest and task travels, and copies meet only there
    texts = docs.select(digest(norm).alias("digest"), norm.alias("norm"))
    texts = with_marks(texts, hits).where("_maybe").groupBy("digest").agg(F.min("norm").alias("low"), F.max("norm").alias("high"))
    torn = materialise(texts.where("low <> high").select("digest"), "dedup-torn")
    if not torn.isEmpty():  # equal digests of different texts: their groups are made by text
        marked = with_marks(docs.select(digest(norm).alias("digest"), norm.alias("part"), "doc_id", F.col("_place").alias("place"),
                                        F.char_length(F.coalesce("text", F.lit(""))).cast("long").alias("points")), torn)
        apart = marked.where("_maybe").drop("_maybe").join(torn, "digest", "left_semi")
        best = F.max(F.struct("points", (-F.col("doc_id")).alias("minus_id"), "place", F.lit("").alias("part")))
        split = apart.groupBy("digest", F.col("part")).agg(best.alias("best"), F.count(F.lit(1)).alias("size"))
        state = state.join(torn, "digest", "left_anti").withColumn("text_sha256", F.lit(None).cast("string")).unionByName(
            split.select("digest", "best", "size", sha256(F.col("part")).alias("text_sha256")))
        on = (F.col("r.digest") == F.col("s.digest")) & F.coalesce(F.col("r.text_sha256") == F.col("s.text_sha256"), F.lit(True))
    else:
        on = F.col("r.digest") == F.col("s.digest")
    return rows.alias("r").join(state.alias("s"), on).select(
        "r.doc_id", (-F.col("s.best.minus_id")).alias("keep_id"), F.col("s.size").alias("group_size"),
        (F.col("r.place") == F.col("s.best.place")).alias("kept"), "r.text_sha256", F.col("r.place").alias("_place"),
    )


def exact_dedup(docs: DataFrame) -> DataFrame:
    """The rows that stay, with all their columns. Rows whose digest was met once pass without a shuffle."""
    docs = located(docs)
    groups = materialise(_groups(docs).where("group_size > 1").select("text_sha256", "kept", "_place"), "dedup-hits")
    hits = groups.select(F.col("text_sha256").alias("digest"))
    marked = with_marks(docs.withColumn("digest", sha256(normalised())), hits)
    dropped = groups.where("NOT kept").select(F.col("_place").alias("_gone"))
    rest = marked.where("_maybe").join(dropped, F.col("_place") == F.col("_gone"), "left_anti")
    return marked.where("NOT _maybe").select("_row.*").unionByName(rest.select("_row.*"))


ORACLE = """
    WITH n AS (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS norm FROM documents),
    k AS (SELECT *, first_value(doc_id) OVER (PARTITION BY norm ORDER BY length(t) DESC, doc_id) AS keep_id,
        count(*) OVER (PARTITION BY norm) AS group_size FROM n)
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM k"""
