"""Benchmark decontamination: which documents hold a benchmark item, whole, edited or paraphrased.

Seeds are runs of ``GRAM`` words of an item that few items have (``RARE``). Where an item has none within ``GRAM`` - 1 places, its
frequent runs are seeds as well, so an item that is all template has seeds too; items of fewer words are a seed as a whole.
One pass over the corpus finds where seeds occur, through a bitmap of fixed size, and keeps those neighbourhoods as *passages*,
as wide as the seed's own items may reach; nothing else of the corpus travels. Passages and items that share a seed are joined and,
unless they have too few words in common, aligned word by word (Smith-Waterman); the score is the alignment's share of what
the whole item would reach. A copy whose unedited stretches are all shorter than ``GRAM`` words isn't found.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scoreloom.llm.dedup import whole, with_marks
from scoreloom.llm.words import ALPHANUMERIC, Words, give_back, small_batches, words
from scoreloom.session import materialise, ship_package

GRAM = 4
LEAST = 0.5
MATCH, OTHER, GAP = 2, -1, -1
RARE = 32  # items that may share a run for it to be a seed anywhere
BUCKETS, BITS = 1024, 32768  # of the bitmap: 4 MB, whatever the items
LEVELS = 1 << 16  # slots of the table that says how long the items of a seed may be


def _rows(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment of two word sequences: score, and where it ends in a and in b (exclusive)."""
    at = np.arange(len(b) + 1)
    above = np.zeros(len(b) + 1, dtype=np.int64)
    best, end_a, end_b = 0, 0, 0
    for i, word in enumerate(a):
        now = np.maximum(above + GAP, 0)
        now[1:] = np.maximum(now[1:], above[:-1] + np.where(b == word, MATCH, OTHER))
        now = np.maximum.accumulate(now - GAP * at) + GAP * at  # gaps in a, any number of them
        top = int(now.argmax())
        if now[top] > best:
            best, end_a, end_b = int(now[top]), i + 1, top
        above = now
    return best, end_a, end_b


def align(item: np.ndarray, passage: np.ndarray) -> tuple[float, int, int]:
    """Share of the item's full score, and the words of the passage that its best alignment covers."""
    if not len(item):
        return 0.0, 0, 0
    best, end_a, end_b = _rows(item, passage)
    _, _, length = _rows(item[:end_a][::-1], passage[:end_b][::-1])
    return best / (MATCH * len(item)), end_b - length, end_b


def _item_grams(batches):
    """Runs of items by place; an item of fewer than GRAM words is one run."""
    for batch in batches:
        ids = batch.column("item_id").to_numpy(zero_copy_only=False)
        for w in words(batch.column("text"), ALPHANUMERIC):
            size = np.diff(w.first)
            for n in range(1, GRAM + 1):
                gram, whole = w.grams(n)
                length = size[w.row - w.rows.start]
                at = np.flatnonzero(whole & ((length >= n) if n == GRAM else (length == n)))
                row = w.row[at] - w.rows.start
                yield pa.RecordBatch.from_arrays([
                    pa.array(gram[at].view(np.int64)), pa.array(ids[w.row[at]].astype(np.int64)), pa.array((at - w.first[row]).astype(np.int32)),
                    pa.array(length[at].astype(np.int32))], ["gram", "item_id", "at", "size"])


def _item_words(batches):
    for batch in batches:
        ids = batch.column("item_id")
        for w in words(batch.column("text"), ALPHANUMERIC):
            said = pa.ListArray.from_arrays(pa.array(w.first.astype(np.int32)), pa.array(w.hash.view(np.int64)))
            yield pa.RecordBatch.from_arrays([ids[w.rows.start : w.rows.stop], said], ["item_id", "item_words"])


def _slots(gram: np.ndarray) -> np.ndarray:
    return (gram & np.uint64(BUCKETS * BITS - 1)).astype(np.int64)


def _level(gram: np.ndarray) -> np.ndarray:
    """Another part of the hash."""
    return (gram >> np.uint64(40) & np.uint64(LEVELS - 1)).astype(np.int64)


def _passages(shipped, sizes: tuple[int, ...]):
    """Neighbourhoods of seeds, of ``sizes`` words: twice as many words as their items may have before and after, since an
    alignment has no more gaps than that; overlapping ones as one."""
    def seeds(w: Words, marked: np.ndarray, levels: np.ndarray):
        found = []
        for n in sizes:
            gram, whole = w.grams(n)
            slot = _slots(gram)
            at = np.flatnonzero(whole & (marked[slot >> 3] >> (slot & 7).astype(np.uint8) & 1).view(bool))
            found.append((at, np.full(len(at), n), gram[at]))
        at, size, gram = (np.concatenate(x) for x in zip(*found))
        return at, size, gram, np.int64(2) << levels[_level(gram)].astype(np.int64)

    def run(batches):
        marked = np.frombuffer(shipped.value, dtype=np.uint8)
        marked, levels = marked[: BUCKETS * BITS // 8], marked[BUCKETS * BITS // 8 :]
        for batch in batches:
            ids = batch.column("doc_id")
            for w in words(batch.column("text"), ALPHANUMERIC):
                at, size, gram, pad = seeds(w, marked, levels)
                if not len(at):
                    continue
                row = w.row[at] - w.rows.start
                start, end = np.maximum(at - pad, w.first[row]), np.minimum(at + size + pad, w.first[row + 1])
                order = np.lexsort((start, row))
                row, start, end, gram = row[order], start[order], end[order], gram[order]
                reached = np.maximum.accumulate(end)  # rows lie one after the other
                begin = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (start[1:] > reached[:-1])))
                start, end = start[begin], np.maximum.reduceat(end, begin)
                size = end - start
                cuts = np.concatenate([[0], np.cumsum(size)])
                said = w.hash[np.repeat(start - cuts[:-1], size) + np.arange(cuts[-1])]
                yield pa.RecordBatch.from_arrays([
                    ids.take(pa.array(row[begin] + w.rows.start)), pa.array((start - w.first[row[begin]]).astype(np.int64)),
                    pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(said.view(np.int64))),
                    pa.ListArray.from_arrays(pa.array(np.append(begin, len(gram)).astype(np.int32)), pa.array(gram.view(np.int64))),
                ], ["doc_id", "start", "words", "grams"])
    return run


def _aligned(least: float):
    def run(batches):
        for batch in batches:
            out = []
            columns = [batch.column(c) for c in ("doc_id", "item_id", "start", "words", "item_words")]
            for doc, item, start, passage, said in zip(*columns):
                a, b = said.values.to_numpy(), passage.values.to_numpy()
                if np.isin(a, b).sum() < least * len(a):  # even if all words in common matched
                    continue
                score, begin, end = align(a, b)
                if score >= least:
                    out.append((doc.as_py(), item.as_py(), score, start.as_py() + begin, start.as_py() + end))
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
            made = zip(*out) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(made, kinds)], ["doc_id", "item_id", "score", "start_word", "end_word"])
    return run


def _seeds(items: DataFrame) -> tuple[DataFrame, bytes, tuple[int, ...]]:
    """``gram, item_id`` of the seeds; how long (as a power of two) the items of a seed may be, by slot; and the seeds' sizes."""
    runs = materialise(items.mapInArrow(_item_grams, "gram long, item_id long, at int, size int"), "leak-runs")
    shared = runs.groupBy("gram").agg(F.count_distinct("item_id").alias("items"))
    near = Window.partitionBy("item_id").orderBy("at").rowsBetween(1 - GRAM, GRAM - 1)
    kept = runs.join(shared, "gram").withColumn("rarest", F.min("items").over(near)).where((F.col("items") <= RARE) | (F.col("rarest") > RARE))
    seeds = materialise(kept.groupBy("gram", "item_id").agg(F.max("size").alias("size")), "leak-seeds")
    slot = F.shiftrightunsigned("gram", 40).bitwiseAND(F.lit(LEVELS - 1))
    levels = bytearray(LEVELS)
    for r in seeds.groupBy(slot.alias("slot")).agg(F.max("size").alias("size")).collect():  # at most LEVELS rows of two numbers
        levels[r["slot"]] = (r["size"] - 1).bit_length()
    sizes = [r["n"] for r in seeds.select(F.least("size", F.lit(GRAM)).alias("n")).distinct().collect()]  # at most GRAM
    return seeds.select("gram", "item_id"), bytes(levels), tuple(sorted({GRAM, *sizes}))


def contaminated(docs: DataFrame, items: DataFrame, least: float = LEAST) -> DataFrame:
    """``doc_id, item_id, score, start_word, end_word`` for every document and item aligned with a score of ``least`` or more:
    the best alignment, and the document's words it covers (counted from 0, end exclusive).

    Words are runs of ASCII letters and digits and of characters beyond ASCII, A-Z lowered. Null and empty texts hold nothing;
    items of fewer than ``GRAM`` words are found where they occur whole, items without ``item_id`` are not looked for. Rows that
    share a ``doc_id`` count as one document, items that share an ``item_id`` as one with the better score; of equal scores
    the first place counts. Long texts are read whole. Empty tables give an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    ship_package(spark)
    small_batches(spark)
    items = items.where("item_id IS NOT NULL").select(F.col("item_id").cast("long"), "text")
    said = materialise(items.mapInArrow(_item_words, "item_id long, item_words array<long>"), "leak-items")
    grams, levels, sizes = _seeds(items)
    at = F.col("gram").bitwiseAND(F.lit(BUCKETS * BITS - 1))
    bits = grams.select(F.floor(at / BITS).cast("int").alias("bucket"), (at % BITS).alias("bit")).groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))
    bitmap = bytearray(BUCKETS * BITS // 8)
    for r in bits.collect():  # at most BUCKETS rows of BITS bits
        bitmap[r["bucket"] * BITS // 8 : (r["bucket"] + 1) * BITS // 8] = r["bits"]
    shipped = spark.sparkContext.broadcast(bytes(bitmap) + levels)
    found = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        give_back(_passages(shipped, sizes)), "doc_id long, start long, words array<long>, grams array<long>")
    passages = materialise(found.withColumn("passage", F.monotonically_increasing_id()), "leak-passages")
    shipped.destroy()  # the passages are written, nothing reads it again

    hits = passages.select("passage", F.explode(F.array_distinct("grams")).alias("gram"))
    pairs = hits.join(grams, "gram").select("passage", "item_id").distinct()
    rows = passages.select("passage", "doc_id", "start", "words").join(pairs, "passage").join(said, "item_id")
    scored = rows.select("doc_id", "item_id", "start", "words", "item_words").mapInArrow(
        give_back(_aligned(least)), "doc_id long, item_id long, score double, start_word long, end_word long")
    best = F.max_by(F.struct("score", "start_word", "end_word"), F.struct("score", (-F.col("start_word")).alias("s"), "end_word"))
    return scored.groupBy("doc_id", "item_id").agg(best.alias("b")).select("doc_id", "item_id", "b.*")


def without_leaks(docs: DataFrame, items: DataFrame, least: float = LEAST) -> DataFrame:
    """The rows of documents that hold no item, with all their columns. Rows without ``doc_id`` are judged together."""
    gone = contaminated(docs, items, least).select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("digest")).distinct()
    gone = materialise(gone, "leak-gone")
    key = F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit(""))
    marked = with_marks(docs.select(whole(docs), key.alias("digest")), gone)
    rest = marked.where("_maybe").join(gone, "digest", "left_anti")
    return marked.where("NOT _maybe").select("_row.*").unionByName(rest.select("_row.*"))
