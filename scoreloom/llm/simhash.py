"""Near copies by SimHash: one 64-bit fingerprint per text, looked up in BK-trees.

The 64 bits are cut into six bands. Fingerprints that differ in at most four bits agree on at least two bands, so fifteen pairs
of bands make shards such that any two fingerprints within the radius share one. A shard's tree is sent to the tasks that hold
the shard's fingerprints instead of to all tasks: sending every tree everywhere would compare all with all. A shard of more
fingerprints than a block is cut into blocks, and the tree of each block goes to the cells of all its blocks, so no task
holds or searches an unbounded tree. A task hands on a spanning forest of what it found, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreloom.llm.bktree import Classes, grow, search
from scoreloom.llm.components import components
from scoreloom.llm.words import LOWER, words
from scoreloom.session import drop_written, materialise, ship_package

# Fixed values of the fingerprint.
WORDS, SEED, RADIUS = 4, 42, 4

BANDS = (11, 11, 11, 11, 10, 10)  # RADIUS differing bits leave two of six whole
BLOCK = 2048  # fingerprints of one tree
ROWS = 1 << 16  # fingerprints of small shards that are looked up at once
_CHUNK = 1 << 15  # shingles that are hashed at once


def fingerprint(text: bytes, start: np.ndarray, end: np.ndarray) -> int:
    """SimHash of the words ``text[start:end]``; zero without words."""
    if not len(start):
        return 0
    length = end - start
    at = np.cumsum(length + 1) - length - 1  # words one blank apart
    joined = np.full(int(at[-1] + length[-1]), 32, dtype=np.uint8)
    inside = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
    joined[np.repeat(at, length) + inside] = LOWER[text[np.repeat(start, length) + inside]]
    body, n = joined.tobytes(), max(len(start) - WORDS + 1, 1)
    stop = (at + length)[min(WORDS, len(start)) - 1 :]
    ones = np.zeros(64, dtype=np.int64)
    for begin in range(0, n, _CHUNK):
        spans = zip(at[begin : begin + _CHUNK].tolist(), stop[begin : begin + _CHUNK].tolist())
        hashes = np.array([xxhash.xxh64_intdigest(body[a:b], SEED) for a, b in spans], dtype="<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, fp`` (64 bits as a signed number) of every row; each text is read whole."""
    kind = docs.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros(batch.num_rows, dtype=np.uint64)
            for part in words(batch.column("text")):
                for i, row in enumerate(part.rows):
                    own = slice(part.first[i], part.first[i + 1])
                    out[row] = fingerprint(part.data, part.start[own], part.end[own])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out.view(np.int64))], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind.simpleString()}, fp bigint")


def shard_keys(fp: str = "fp") -> Column:
    """The fifteen shards of a fingerprint, as numbers: the pair of bands, and what the fingerprint has in them."""
    bands, at = [], 0
    for width in BANDS:
        bands.append((F.shiftrightunsigned(fp, at).bitwiseAND(F.lit((1 << width) - 1)), width))
        at += width
    pairs = []
    for number, ((a, _), (b, width)) in enumerate(combinations(bands, 2)):
        pairs.append(F.lit(number << 32).bitwiseOR(F.shiftleft(a, width)).bitwiseOR(b))
    return F.array(*pairs)


def _forest_links(keys: np.ndarray, prints: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links within each key; rows come sorted by key."""
    same = np.zeros(len(keys) + 1, dtype=bool)
    same[1:-1] = keys[1:] == keys[:-1]
    prints = prints[shared := same[:-1] | same[1:]].view(np.uint64)  # alone under a key: nothing to look up
    _, tree = np.unique(keys[shared], return_inverse=True)
    classes = Classes(len(prints))
    forest = grow(prints, tree)
    for query, node in search(forest, prints, tree, radius):
        classes.link(query, node)
    tied = np.flatnonzero(classes.label != np.arange(len(prints)))
    return prints[classes.label[tied]].view(np.int64), prints[tied].view(np.int64)


_FOUND = "a bigint, b bigint, key bigint, block int, fp bigint"


def _found(a=(), b=(), key=(), block=(), fp=()) -> pa.RecordBatch:
    n = len(a) + len(fp)
    fill = lambda values, kind: pa.array(values, kind) if len(values) else pa.nulls(n, kind)
    made = [fill(a, pa.int64()), fill(b, pa.int64()), fill(key, pa.int64()), fill(block, pa.int32()), fill(fp, pa.int64())]
    return pa.RecordBatch.from_arrays(made, ["a", "b", "key", "block", "fp"])


def shard_links(unique: DataFrame, radius: int = RADIUS, block: int = BLOCK, rows: int = ROWS) -> DataFrame:
    """``a, b``: links between the distinct fingerprints ``fp`` that leave the same connected classes as all links would.

    Small shards are looked up where they come together. A larger one leaves its task again in blocks of ``block``
    fingerprints, and each pair of its blocks is a cell of its own.
    """
    keyed = unique.select(F.explode(shard_keys()).alias("key"), "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, prints = np.zeros(0, np.int64), np.zeros(0, np.int64)
        open_key, passed = None, 0  # a shard that left in blocks and may go on, and how much of it
        for batch in chain(batches, [None]):
            if batch is not None:
                keys = np.concatenate([keys, batch.column("key").to_numpy(zero_copy_only=False)])
                prints = np.concatenate([prints, batch.column("fp").to_numpy(zero_copy_only=False)])
                if len(keys) < rows:
                    continue
            if not len(keys):
                return
            shards, start, shard, count = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
            place = np.arange(len(keys)) - start[shard]
            large = count > block
            if shards[0] == open_key:
                large[0] = True
                place[shard == 0] += passed
            ready = np.ones(len(shards), dtype=bool)
            ready[-1] = batch is None or large[-1]  # a small one waits for what may follow
            small, cut = (ready & ~large)[shard], large[shard]
            a, b = _forest_links(keys[small], prints[small], radius)
            yield _found(a=a, b=b)
            yield _found(key=keys[cut], block=place[cut] // block, fp=prints[cut])
            open_key, passed = (int(shards[-1]), int(place[-1]) + 1) if large[-1] else (None, 0)
            waits = ~ready[shard]
            keys, prints = keys[waits], prints[waits]

    near = materialise(keyed.repartition("key").sortWithinPartitions("key").mapInArrow(run, _FOUND), "shard-links")
    links = near.where("a is not null").select("a", "b")
    return links.unionByName(_block_links(near.where("key is not null").select("key", "block", "fp"), radius))


def _block_links(large: DataFrame, radius: int) -> DataFrame:
    """Links within and between the blocks of large shards: a cell per pair of blocks holds one tree and its queries."""
    number = large.groupBy("key").agg(F.max("block").alias("last"))
    dealt = large.join(number, "key").select("key", "block", "fp", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("other"))
    cells = dealt.select("key", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "fp")

    def look(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))  # two blocks
        prints = table.column("fp").to_numpy().view(np.uint64)
        first = table.column("block").to_numpy() == key[1].as_py()
        prints = np.concatenate([prints[first], prints[~first]])
        nodes, queries = prints[: first.sum()], prints[first.sum() :]
        classes = Classes(len(prints))
        shift = 0 if not len(queries) else len(nodes)
        queries = queries if len(queries) else nodes
        for query, node in search(grow(nodes, np.zeros(len(nodes), dtype=np.int64)), queries, np.zeros(len(queries), dtype=np.int64), radius):
            classes.link(query + shift, node)
        tied = np.flatnonzero(classes.label != np.arange(len(prints)))
        yield pa.RecordBatch.from_arrays([pa.array(prints[classes.label[tied]].view(np.int64)), pa.array(prints[tied].view(np.int64))], ["a", "b"])

    return cells.groupBy("key", "low", "high").applyInArrow(look, "a bigint, b bigint")


def near_copies(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every row.

    Null and empty texts, and texts of blanks, have the fingerprint zero and are linked like any other; texts of fewer than four
    words are one shingle. Repeated rows and equal texts share a fingerprint and so a component; a component's id is its
    smallest ``doc_id``, rows without one follow it, and a component of such rows only has a null id. An empty table gives
    no rows. Other columns, whatever their names, are not read.
    """
    ship_package(docs.sparkSession)
    prints = materialise(fingerprints(docs), "fingerprints")
    unique = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "unique-fingerprints")
    label = components(shard_links(unique, radius), "simhash").select(F.col("a").alias("fp"), "label")
    linked = unique.join(label, "fp", "left").select("fp", "least", F.coalesce("label", "fp").alias("label"))
    least = linked.groupBy("label").agg(F.min("least").alias("component_id"))
    # written, so that the last join meets plain tables, whose crowded fingerprints Spark can split
    ids = materialise(linked.join(least, "label").select("fp", "component_id"), "simhash-components")
    drop_written(unique)
    hexadecimal = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return prints.join(ids, "fp", "left").select("doc_id", hexadecimal, "component_id")
