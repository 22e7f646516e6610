"""Similarity join on sets of word n-grams: which documents are linked, by exact Jaccard similarity, through others or not.

1. One pass digests every set and counts all n-grams into a sketch of fixed size. Its counts give the global order, rare
   n-grams first; any order gives the same result, a good one less work.
2. Similar sets share an n-gram among the first few of each (the prefix). Prefixes go out by n-gram, one per distinct set and
   task. Where sets of fitting sizes meet, bounds that can only err to the safe side (position, sizes, a histogram of
   each set) decide which may be similar. That graph is sparse; no group's pairs are listed, only a chain through them.
3. Its components are small, apart from groups of near copies. Their sets are joined by a prefix tree (``trie``), which counts
   shared beginnings once and leaves a subtree when the remaining lengths can't reach the similarity. A component of more
   than ``BLOCK`` sets is cut into blocks: blocks join within themselves, their largest parts with each other, and then
   only what is still apart from the largest part is compared with every block.

Prefixes that meet and whole sets travel in turns, each a share of the corpus's n-grams at most, so disk follows the input and not how
many documents have copies. A turn looks only at n-grams whose sets the turns before it have left apart.
"""

from __future__ import annotations

import math
import zlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scoreloom.llm.components import components
from scoreloom.llm.dedup import whole, with_marks
from scoreloom.llm.trie import Union, links, needed
from scoreloom.llm.words import NOT_SPACE, Words, give_back, mix, small_batches, words
from scoreloom.session import drop_shuffles, drop_written, materialise, ship_package

COUNTERS = 1 << 21
SEGMENTS = 8
BINS = 64
#: Counts as one byte: exact up to 191, then the next step upwards, so that a bound made of them never falls short.
STEPS = np.concatenate([np.arange(192), np.ceil(191 * 1.12 ** np.arange(1, 64)), [2**32]]).astype(np.int64)
BLOCK = 2048
MET_BYTES = 100  # of a prefix row on its way to the others of its n-gram, with its set's histogram; packed, about
TURN_BYTES = 4  # for each n-gram of the corpus, what prefixes of a turn may take
TURN_GRAMS = 4  # a turn's whole sets have about one in so many of the corpus's n-grams
TURN_LEAST = 1 << 28  # bytes that are not worth more than one turn
_ONE = np.uint64(1)


def gram_sets(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of the rows of a slice, as one array, and where each row's begin (rows + 1 offsets). A row of fewer
    words has one n-gram, its whole sequence; a row without words has none."""
    grams, whole = w.grams(n)
    row = w.row - w.rows.start
    count = np.diff(w.first)
    short = [(i, w.hash[w.first[i] : w.first[i + 1]]) for i in np.flatnonzero((count > 0) & (count < n))]
    few = np.array([int(mix(np.array([len(h), *h], dtype=np.uint64) * np.arange(3, 2 * len(h) + 5, 2, dtype=np.uint64)).sum()) for _, h in short], dtype=np.uint64)
    value = np.concatenate([grams[whole], few])
    at = np.concatenate([row[whole], np.array([i for i, _ in short], dtype=np.int64)])
    order = np.lexsort((value, at))
    value, at = value[order], at[order]
    if len(value):
        new = np.concatenate([[True], (value[1:] != value[:-1]) | (at[1:] != at[:-1])])
        value, at = value[new], at[new]
    return value, np.searchsorted(at, np.arange(len(w.rows) + 1))


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(values, dtype=np.uint64)])
    return total[first[1:]] - total[first[:-1]]


def set_ids(value: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A digest of every set, independent of order; 0 is kept for the empty one."""
    size = np.diff(first).astype(np.uint64)
    out = mix(_sums(mix(value), first) ^ mix(_sums(mix(value ^ np.uint64(0x5851F42D4C957F2D)), first)) + size)
    return np.where(size > 0, np.maximum(out, _ONE), np.uint64(0)).view(np.int64)


def histograms(value: np.ndarray, first: np.ndarray) -> list[bytes]:
    """How many of a set's n-grams fall into each of BINS bins, as places in STEPS."""
    rows = len(first) - 1
    bins = (mix(value) >> np.uint64(58)).astype(np.int64) + BINS * np.repeat(np.arange(rows), np.diff(first))
    table = np.bincount(bins, minlength=BINS * rows).reshape(rows, BINS)
    table = np.searchsorted(STEPS, table).astype(np.uint8)
    return [line.tobytes() for line in table]


def _slot(value: np.ndarray) -> np.ndarray:
    return (value & np.uint64(COUNTERS - 1)).astype(np.int64)


_BOOK = T.StructType([
    T.StructField("segment", T.IntegerType()), T.StructField("blob", T.BinaryType()), T.StructField("doc_id", T.LongType()),
    T.StructField("n", T.LongType()), T.StructField("set", T.LongType()),
])
_BOOK_ARROW = pa.schema([("segment", pa.int32()), ("blob", pa.binary()), ("doc_id", pa.int64()), ("n", pa.int64()), ("set", pa.int64())])


def _census(n: int):
    """First pass: a row per document (size, digest, histogram), then the task's counters in segments."""
    def run(batches):
        counters = np.zeros(COUNTERS, dtype=np.uint32)
        for batch in batches:
            ids = batch.column("doc_id")
            for w in words(batch.column("text"), NOT_SPACE):
                value, first = gram_sets(w, n)
                np.add.at(counters, _slot(value), np.uint32(1))
                rows = len(w.rows)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(rows, -1, dtype=np.int32)), pa.array(histograms(value, first), pa.binary()), ids[w.rows.start : w.rows.stop],
                    pa.array(np.diff(first).astype(np.int64)), pa.array(set_ids(value, first))], schema=_BOOK_ARROW)
        width = COUNTERS // SEGMENTS
        parts = counters.reshape(SEGMENTS, width)
        blobs = []
        for part in parts:
            at = np.flatnonzero(part)
            thin = len(at) * 8 < width
            blobs.append(b"t" + at.astype("<u4").tobytes() + part[at].astype("<u4").tobytes() if thin else b"z" + zlib.compress(part.astype("<u4").tobytes(), 1))
        none = pa.nulls(SEGMENTS, pa.int64())
        if counters.any():
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(SEGMENTS, dtype=np.int32)), pa.array(blobs, pa.binary()), none, none, none], schema=_BOOK_ARROW)
    return run


def _added(batches):
    """Counters of all tasks added up by segment, then as logarithms in a byte each."""
    width = COUNTERS // SEGMENTS
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for segment, blob in zip(batch.column("segment").to_pylist(), batch.column("blob").to_pylist()):
            into = total.setdefault(segment, np.zeros(width, dtype=np.uint64))
            if blob[:1] == b"t":
                both = np.frombuffer(blob, dtype="<u4", offset=1)
                into[both[: len(both) // 2]] += both[len(both) // 2 :]
            else:
                into += np.frombuffer(zlib.decompress(blob[1:]), dtype="<u4")
    for segment, into in total.items():
        level = np.minimum(255, np.round(np.log2(into + 1.0) * 7)).astype(np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([segment], pa.int32()), pa.array([level.tobytes()], pa.binary())], ["segment", "blob"])


def _ranked(value: np.ndarray, first: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """N-grams as keys of the global order: level, then hash; sorted within each row."""
    key = (levels[_slot(value)].astype(np.uint64) << np.uint64(56)) | (value >> np.uint64(8))
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    return key[np.lexsort((key, row))]


_ORDER = np.uint64(1 << 63)  # makes unsigned order signed


def _prefixes(n: int, percent: int, levels):
    """Second pass: the prefix of every distinct set of the task."""
    def run(batches):
        table = np.frombuffer(levels.value, dtype=np.uint8)
        seen: set[int] = set()
        for batch in batches:
            for w in words(batch.column("text"), NOT_SPACE):
                value, first = gram_sets(w, n)
                ids, size = set_ids(value, first), np.diff(first)
                fresh = []
                for i, s in enumerate(ids.tolist()):
                    fresh.append(s != 0 and s not in seen)
                    seen.add(s)
                key = _ranked(value, first, table)
                take = np.where(fresh, size - -(-percent * size // 100) + 1, 0)
                at = np.repeat(first[:-1], take) + (pos := np.arange(int(take.sum())) - np.repeat(np.cumsum(take) - take, take))
                token = (key[at] ^ _ORDER).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(token), pa.array(np.repeat(ids, take)), pa.array(np.repeat(size, take).astype(np.int32)), pa.array(pos.astype(np.int32))],
                    ["token", "set", "size", "pos"])
    return run


def _meetings(percent: int):
    """Rows by n-gram, then size: edges between sets that may be similar, a spanning forest per group. A group of more than
    BLOCK sets of fitting sizes is chained without a look, which only adds to what the join decides later."""
    def edges(group):
        size, pos = (np.array([g[k] for g in group], dtype=np.int64) for k in (1, 2))
        bins = STEPS[np.frombuffer(b"".join(g[3] for g in group), dtype=np.uint8).reshape(-1, BINS)]
        union = Union(len(group))
        for j in range(1, len(group)):
            i = np.arange(int(np.searchsorted(size, -(-percent * size[j] // 100))), j)
            need = -(-percent * (size[i] + size[j]) // (100 + percent))
            i, need = (x[np.minimum(size[i] - pos[i], size[j] - pos[j]) >= need] for x in (i, need))
            i = i[np.minimum(bins[i], bins[j]).sum(axis=1) >= need]
            for k in i.tolist():
                if union.join(k, j):
                    yield group[k][0], group[j][0]

    def run(batches):
        token, group, chained = None, [], False
        out: list[tuple[int, int]] = []
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("token", "set", "size", "pos", "bins"))
            for t, s, size, pos, bins in zip(*columns):
                if t != token:
                    out.extend(edges(group) if not chained else zip([g[0] for g in group], [g[0] for g in group[1:]]))
                    token, group, chained = t, [], False
                elif group and 100 * group[-1][1] < percent * size:  # too small for this set and all after it
                    out.extend(edges(group) if not chained else zip([g[0] for g in group], [g[0] for g in group[1:]]))
                    group, chained = [], False
                group.append((s, size, pos, bins))
                if len(group) > BLOCK:
                    out.extend(zip([g[0] for g in group], [g[0] for g in group[1:]]))
                    group, chained = group[-1:], True
            yield _edges(out)
            out = []
        out.extend(edges(group) if not chained else zip([g[0] for g in group], [g[0] for g in group[1:]]))
        yield _edges(out)
    return run


def _edges(pairs) -> pa.RecordBatch:
    a, b = (np.array([p[k] for p in pairs], dtype=np.int64) for k in (0, 1))
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def _contents(n: int, levels):
    """Third pass: whole sets of the documents that stand for the sets to be joined."""
    def run(batches):
        table = np.frombuffer(levels.value, dtype=np.uint8)
        for batch in batches:
            ids = batch.column("doc_id")
            for w in words(batch.column("text"), NOT_SPACE):
                value, first = gram_sets(w, n)
                key = _ranked(value, first, table)
                grams = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array((key ^ _ORDER).view(np.int64)))
                yield pa.RecordBatch.from_arrays([ids[w.rows.start : w.rows.stop], pa.array(set_ids(value, first)), grams], ["doc_id", "set", "grams"])
    return run


def _tree_join(percent: int):
    """Rows by task: a spanning forest of the links between queries and indexed sets, by prefix tree."""
    def joined(rows):
        once = {}
        for s, label, query, indexed, grams in rows:
            old = once.get(s)
            once[s] = (label, query or bool(old and old[1]), indexed or bool(old and old[2]), grams)
        names = sorted(once)
        sets = [(np.asarray(once[s][3], dtype=np.int64).view(np.uint64) ^ _ORDER) for s in names]
        pick = lambda k: [i for i, s in enumerate(names) if once[s][k]]
        for i, j in links(sets, [once[s][0] for s in names], pick(1), pick(2), percent):
            yield names[i], names[j]

    def run(batches):
        now, rows, out = None, [], []
        for batch in batches:
            keys, rest = batch.column("task").to_pylist(), [batch.column(c) for c in ("set", "label", "query", "indexed")]
            grams = batch.column("grams")
            for i, (key, *row) in enumerate(zip(keys, *(c.to_pylist() for c in rest))):
                if key != now:
                    out.extend(joined(rows))
                    now, rows = key, []
                rows.append((*row, grams[i].values.to_numpy()))
            yield _edges(out)
            out = []
        out.extend(joined(rows))
        yield _edges(out)
    return run


def _joined(rows: DataFrame, percent: int) -> DataFrame:
    """Links of rows ``task, set, label, query, indexed, grams``."""
    rows = rows.select("task", "set", "label", "query", "indexed", "grams").repartition("task").sortWithinPartitions("task")
    return rows.mapInArrow(give_back(_tree_join(percent)), "a long, b long")


def _turns(size: float, most: float) -> int:
    """In how many turns ``size`` bytes go, of about ``most`` each."""
    return max(1, min(math.ceil(size / max(most, 1)), math.ceil(size / TURN_LEAST)))


def _turn(key: str, turns: int, turn: int):
    return F.pmod(F.xxhash64(key, F.lit(7)), F.lit(turns)) == turn


def _maybe(met: DataFrame, one: DataFrame, percent: int, total: int) -> DataFrame:
    """``a, label`` of sets that may be similar to others, given all their meetings: by turns of n-grams."""
    turns = _turns(MET_BYTES * met.count(), TURN_BYTES * total)
    found = None
    for turn in range(turns):
        now = met if turns == 1 else met.where(_turn("token", turns, turn))
        if found is not None:  # where all sets of an n-gram hang together, it has nothing to add
            label = F.coalesce("label", "set")
            apart = now.join(found, F.col("set") == F.col("a"), "left").groupBy("token").agg(F.min(label).alias("lo"), F.max(label).alias("hi"))
            now = now.join(apart.where("lo <> hi").select("token"), "token", "left_semi")
        groups = now.join(one.select("set", "bins"), "set").select("token", "set", "size", "pos", "bins")
        groups = groups.repartition("token").sortWithinPartitions("token", "size", "set")
        edges = groups.mapInArrow(give_back(_meetings(percent)), "a long, b long")
        last, found = found, components(edges if found is None else edges.unionByName(found.withColumnRenamed("label", "b")), "jaccard-maybe")
        if last is not None:
            drop_written(last)
        drop_shuffles(met.sparkSession)
    return found


def _relabelled(links_: DataFrame, sets: DataFrame) -> DataFrame:
    """``set, label`` after links between sets."""
    found = components(links_, "jaccard-links")
    out = sets.select("set").join(found, F.col("set") == F.col("a"), "left").select("set", F.coalesce("label", "set").alias("label"))
    out._written_to = found._written_to  # type: ignore[attr-defined]
    return out


def similar_sets(docs: DataFrame, n: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """``doc_id, n, set`` of every document, and ``set, label`` of the sets that are similar to others."""
    spark = docs.sparkSession
    ship_package(spark)
    small_batches(spark)
    texts = docs.select(F.col("doc_id").cast("long"), "text")
    book = materialise(texts.mapInArrow(give_back(_census(n)), _BOOK), "jaccard-book")
    rows = book.where("segment < 0").select("doc_id", "n", "set")
    counted = book.where("segment >= 0").select("segment", "blob").repartition(SEGMENTS, "segment")
    # SEGMENTS rows, COUNTERS bytes in all, whatever the corpus
    parts = {r["segment"]: r["blob"] for r in counted.mapInArrow(_added, "segment int, blob binary").collect()}
    empty = bytes(COUNTERS // SEGMENTS)
    levels = spark.sparkContext.broadcast(b"".join(parts.get(i, empty) for i in range(SEGMENTS)))

    prefixes = texts.mapInArrow(give_back(_prefixes(n, percent, levels)), "token long, set long, size int, pos int")
    # sets that meet another one of fitting size; repeats of a set lie side by side
    by = "PARTITION BY token ORDER BY size, set"
    once = prefixes.withColumn("_again", F.expr(f"lag(set) OVER ({by})")).where("_again IS NULL OR _again <> set")
    fits = f"100 * lag(size) OVER ({by}) >= {percent} * size OR {percent} * lead(size) OVER ({by}) <= 100 * size"
    met = once.withColumn("_meets", F.expr(fits)).where("_meets").select("token", "set", "size", "pos")
    met = materialise(met, "jaccard-met")
    drop_shuffles(spark)
    one = book.where("segment < 0 AND set <> 0").groupBy("set").agg(F.min("doc_id").alias("doc_id"), F.first("blob").alias("bins"), F.first("n").alias("n"))
    one = materialise(one.join(met.select("set").distinct(), "set", "left_semi"), "jaccard-one")
    drop_shuffles(spark)
    total = rows.agg(F.sum("n")).first()[0] or 0
    labels = _maybe(met, one, percent, total)
    maybe = labels.withColumnRenamed("a", "set").withColumnRenamed("label", "part")

    size = maybe.groupBy("part").agg(F.count(F.lit(1)).alias("size"))
    maybe = maybe.join(size, "part").withColumn("block", F.pmod(F.xxhash64("set"), F.ceil(F.col("size") / BLOCK)).cast("int"))
    chosen = materialise(maybe.join(one.select("set", "doc_id", "n"), "set"), "jaccard-chosen")
    drop_written(met, one, labels)
    grams = chosen.agg(F.sum("n")).first()[0] or 0
    turns, found = _turns(8 * grams, 8 * total / TURN_GRAMS), []
    for turn in range(turns):
        now = chosen if turns == 1 else chosen.where(_turn("part", turns, turn))
        found += _links(texts, now, n, percent, levels, total)
        drop_shuffles(spark)
    levels.destroy()  # all passes over the texts are written
    labels = components(reduce(DataFrame.unionByName, found), "jaccard-links")
    drop_written(chosen, *found)
    out = labels.withColumnRenamed("a", "set")
    rows._written_to, out._written_to = book._written_to, labels._written_to  # type: ignore[attr-defined]
    return rows, out


def _links(texts: DataFrame, chosen: DataFrame, n: int, percent: int, levels, total: int) -> list[DataFrame]:
    """Links between the chosen sets, of which no part is chosen in part."""
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("digest")  # a set may have rows without identifier only
    marked = with_marks(texts.withColumn("digest", name), chosen.select(name))
    content = marked.where("_maybe").select("doc_id", "text").mapInArrow(give_back(_contents(n, levels)), "doc_id long, set long, grams array<long>")
    content = content.drop("doc_id").join(chosen.select("set", "part", "block", "size"), "set").dropDuplicates(["set"])
    content = materialise(content, "jaccard-content")
    drop_shuffles(texts.sparkSession)

    flag = lambda name, value: F.lit(value).alias(name)
    label = F.col("set").alias("label")
    within = _joined(content.select(F.struct("part", "block").alias("task"), "set", label, flag("query", True), flag("indexed", True), "grams"), percent)
    found = [materialise(within, "jaccard-links")]
    big = content.where(f"size > {BLOCK}")
    if not big.isEmpty():
        drop_shuffles(texts.sparkSession)
        found += _across(big, found[0], percent, total)
    drop_written(content)
    return found


def _across(big: DataFrame, within: DataFrame, percent: int, total: int) -> list[DataFrame]:
    """Links between the blocks of large parts: first of one set for each block's largest component with those of other
    blocks, then of all that is not in the part's largest component with every block, by turns."""
    spark = big.sparkSession
    now = _relabelled(within, big)
    known = materialise(big.join(now, "set").select("set", "part", "block", "label", F.size("grams").alias("n")), "jaccard-known")
    drop_written(now)
    count = known.groupBy("part", "block", "label").agg(F.count(F.lit(1)).alias("c"), F.min("set").alias("set"))
    lead = count.groupBy("part", "block").agg(F.max_by("set", "c").alias("set"))
    flags = [F.lit(True).alias("query"), F.lit(True).alias("indexed")]
    leaders = big.select("set", "grams").join(known.join(lead.select("set"), "set", "left_semi"), "set").select(
        F.struct("part", F.lit(-1).alias("block")).alias("task"), "set", "label", *flags, "grams")
    between = materialise(_joined(leaders, percent), "jaccard-between")
    now = _relabelled(within.unionByName(between), big)
    held = materialise(known.drop("label").join(now, "set"), "jaccard-now")
    drop_written(known, now)
    count = held.groupBy("part", "label").agg(F.count(F.lit(1)).alias("c"))
    main = count.groupBy("part").agg(F.max_by("label", "c").alias("main"), F.max("c").alias("most"), F.sum("c").alias("all"))
    rest = held.join(main, "part").where("most < all")
    blocks, chunks = F.ceil(F.col("all") / BLOCK).cast("int"), F.ceil((F.col("all") - F.col("most")) / BLOCK).cast("int")
    rest = materialise(rest.withColumn("blocks", blocks).withColumn("chunks", chunks), "jaccard-rest")
    times = F.when(F.col("label") != F.col("main"), F.col("blocks")).otherwise(0) + F.col("chunks")
    turns = _turns(8 * (rest.agg(F.sum(F.col("n") * times)).first()[0] or 0), 8 * total / TURN_GRAMS)
    spread = rest.join(big.select("set", "grams"), "set")
    chunk = F.pmod(F.xxhash64("set", F.lit(1)), F.col("chunks")).cast("int")
    found = [between]
    for turn in range(turns):
        mine = lambda block, chunk: F.pmod(F.xxhash64("part", block, chunk), F.lit(turns)) == turn  # noqa: B023, E731
        each = lambda n, keep: F.explode(F.filter(F.sequence(F.lit(0), n - 1), keep))
        asks = spread.where("label <> main").withColumn("chunk", chunk)
        asks = asks.withColumn("block", each(F.col("blocks"), lambda b: mine(b, F.col("chunk")))).withColumn("query", F.lit(True))  # noqa: B023
        every = spread.withColumn("chunk", each(F.col("chunks"), lambda c: mine(F.col("block"), c))).withColumn("query", F.lit(False))  # noqa: B023
        tasks = [x.select(F.struct("part", "block", "chunk").alias("task"), "set", "label", "query", (~F.col("query")).alias("indexed"), "grams") for x in (asks, every)]
        found.append(materialise(_joined(tasks[0].unionByName(tasks[1]), percent), "jaccard-across"))
        drop_shuffles(spark)
    drop_written(held, rest)
    return found


def jaccard_components(docs: DataFrame, n: int = 3, percent: int = 90) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row. Two rows are linked when the Jaccard similarity of their sets of n
    words is ``percent`` or more; ``component_id`` is the least ``doc_id`` of all that links reach, itself included.

    Words are runs of anything but white space, A-Z lowered. Texts of fewer than n words have their whole sequence as the only
    element; null, empty and blank texts have none and are linked with nothing. Repeated rows are linked (unless empty).
    Null identifiers never become a component's name unless nothing else is in it. Empty tables give empty tables.
    """
    rows, labels = similar_sets(docs, n, percent)
    found = rows.join(labels, "set", "left").withColumn("label", F.coalesce("label", "set"))
    found = materialise(found.select("doc_id", "n", "label"), "jaccard-rows")
    drop_written(rows, labels)
    # written, so that the join meets plain tables, whose crowded labels Spark can split
    least = materialise(found.where("label <> 0").groupBy(F.col("label").alias("_label")).agg(F.min("doc_id").alias("least")), "jaccard-least")
    out = found.join(least, F.col("label") == F.col("_label"), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"))


def first_of_components(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """One row for each component, that with the least ``doc_id``, with all its columns; rows linked with nothing all stay,
    those of null identifier too. Of rows alike in identifier one component keeps all. Rows that are alone in their
    component are not shuffled."""
    found = jaccard_components(docs, n, percent)
    gone = materialise(found.where("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct(), "jaccard-gone")
    key = F.col("doc_id").cast("long")
    rows = docs.select(whole(docs), key.alias("_id"), F.coalesce(key.cast("string"), F.lit("")).alias("digest"))
    marked = with_marks(rows, gone.select(F.col("_gone").cast("string").alias("digest")))
    rest = marked.where("_maybe").join(gone, F.col("_id") == F.col("_gone"), "left_anti")
    return marked.where("NOT _maybe").select("_row.*").unionByName(rest.select("_row.*"))
