"""How far the sources of a language differ in their words: a three-dimensional cube of (group block, group block, term block).

Words are counted per (lang, source, term) before anything else, so the cube only holds one entry per term that a group
has. Groups of a language are numbered and cut into blocks, terms are cut into blocks by hash. Every entry is replicated to
the cells of its row and column of blocks; a task that owns a cell lays its two slices out as matrices, and adds up the
divergence of each pair over the terms that the cell has. Sums are then reduced along the term axis. Terms that a cell lacks
have the same smoothed probability throughout, so they are added as a count. All arithmetic is in whole numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoreloom.session import materialise, ship_package

# What separates terms, which letters are lowered, the scale of a probability.
BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SCALE = 1_000_000_000

GROUP_BLOCK = 16  # groups on each side of a cell
TERM_BLOCK = 8192  # terms of a cell, about: a cell's matrix takes 2 MB
PARTIAL = "lang string, i int, j int, part long, present long"


def term_counts(docs: DataFrame) -> DataFrame:
    """``lang, source, term, n, docs``: occurrences, and documents that have the term. One row per key and task is shuffled."""
    name = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    words = F.array_remove(F.split(F.translate(name("text"), UPPER, LOWER), BETWEEN), "")
    both = docs.select(name("lang"), name("source"), words.alias("w")).select(
        "lang", "source", F.explode(F.array(F.struct("w", F.lit(1).alias("n")), F.struct(F.array_distinct("w").alias("w"), F.lit(0).alias("n")))).alias("e"),
    )
    each = both.select("lang", "source", F.col("e.n").alias("n"), F.explode("e.w").alias("term"))
    return each.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum(1 - F.col("n")).alias("docs"))


def probability(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + 2) / (total + 2 * terms)) without rounding; null for a language without terms."""
    exact = lambda c: c.cast("decimal(19,0)")
    parts = F.struct((F.lit(SCALE).cast("decimal(10,0)") * exact(count + 2)).alias("a"), F.nullif(exact(total + 2 * terms), F.lit(0)).alias("b"))
    return F.transform(F.array(parts), lambda x: F.call_function("div", x["a"], x["b"]) + 1)[0]


def distance(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def _cell(key: tuple, table: pa.Table) -> pa.Table:
    """Partial sums of all pairs of a cell; rows without a term name the groups and what they give a term they lack."""
    lang, low, high = (k.as_py() for k in key[:3])
    number, p, term = (table.column(c).combine_chunks() for c in ("g", "p", "term"))
    number, p = number.to_numpy(zero_copy_only=False), p.fill_null(1).to_numpy(zero_copy_only=False)
    body = term.is_valid().to_numpy(zero_copy_only=False)
    order = np.argsort(number[~body])
    ids, silent = number[~body][order], p[~body][order]
    coded = pc.dictionary_encode(term.drop_null())
    matrix = np.repeat(silent[:, None], len(coded.dictionary), axis=1)
    matrix[np.searchsorted(ids, number[body]), coded.indices.to_numpy(zero_copy_only=False)] = p[body]
    out: list[list[np.ndarray]] = [[], [], []]
    across = np.flatnonzero(ids // GROUP_BLOCK == high)
    for a in np.flatnonzero(ids // GROUP_BLOCK == low):
        others = across[across > a]
        x, y = matrix[a], matrix[others]
        for column, values in zip(out, (np.full(len(others), ids[a]), ids[others], ((y - x) ** 2 // (y + x)).sum(axis=1))):
            column.append(values)
    i, j, part = (np.concatenate([np.zeros(0, dtype=np.int64), *c]) for c in out)
    return pa.table({
        "lang": pa.array([lang] * len(i), pa.string()), "i": pa.array(i, pa.int32()), "j": pa.array(j, pa.int32()),
        "part": pa.array(part, pa.int64()), "present": pa.array(np.full(len(i), matrix.shape[1]), pa.int64()),
    })


def _cells(key: tuple, tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from _cell(key, pa.Table.from_batches(list(tables))).to_batches()


def _sources(docs: DataFrame, entries: DataFrame, terms: DataFrame) -> DataFrame:
    """One row per occurring group: its number ``g`` in the language, number of groups ``size``, ``total``, and of the language
    ``terms`` (V) and ``whole``; ``silent`` is the probability of a term that the group lacks."""
    name = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    found = docs.select(name("lang"), name("source")).distinct()
    totals = entries.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    languages = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("whole").alias("whole"))
    filled = found.join(totals, ["lang", "source"], "left").join(languages, "lang", "left").na.fill(0, ["total", "terms", "whole"])
    lang = Window.partitionBy("lang")
    return filled.select(
        "*", (F.row_number().over(lang.orderBy("source")) - 1).alias("g"), F.count(F.lit(1)).over(lang).alias("size"),
        probability(F.lit(0), F.col("total"), F.col("terms")).alias("silent"),
    )


def audit(docs: DataFrame, least_docs: int = 10, top: int = 10) -> DataFrame:
    """``lang, source, part, item, value, rank`` of all groups of the documents.

    ``pair`` rows compare a source with every other one of its language, over all terms that at least ``least_docs`` documents
    of the language have; ``term`` rows are the ``top`` terms that a source uses more than its language does. Null text, lang
    and source count as empty; every row is a document, repeated rows and rows without ``doc_id`` too. A language without
    kept terms has pairs of value 0 and no terms, a language with one source no pairs, an empty table gives no rows. Ties rank
    by the item's bytes. Other columns, whatever their names, are not read. A text is split whole, in one row.
    """
    spark = docs.sparkSession
    ship_package(spark)
    counts = materialise(term_counts(docs), "term-counts")
    terms = materialise(
        counts.groupBy("lang", "term").agg(F.sum("n").alias("whole"), F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs).drop("docs"),
        "terms",
    )
    entries = materialise(counts.join(terms, ["lang", "term"]).select("lang", "source", "term", "n", "whole"), "entries")
    groups = materialise(_sources(docs, entries, terms), "sources")

    sides = groups.select("lang", "source", "g", "size", "total", "terms", F.col("whole").alias("all"))
    measured = materialise(entries.join(sides, ["lang", "source"]).select(
        "lang", "source", "term", "g", "size", "terms", probability(F.col("n"), F.col("total"), F.col("terms")).alias("p"),
        probability(F.col("whole"), F.col("all"), F.col("terms")).alias("q"),
    ), "probabilities")

    blocks = F.greatest(F.lit(1), F.ceil(F.col("terms") / TERM_BLOCK)).cast("long")
    sidewise = F.explode(F.sequence(F.lit(0), F.floor((F.col("size") - 1) / GROUP_BLOCK).cast("int"))).alias("other")
    body = measured.select("lang", "g", F.col("term"), "p", F.pmod(F.xxhash64("term"), blocks).alias("k"), sidewise)
    heads = groups.select("*", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("k"))
    heads = heads.select("lang", "g", F.lit(None).cast("string").alias("term"), F.col("silent").alias("p"), "k", sidewise)
    block = F.floor(F.col("g") / GROUP_BLOCK).cast("int")
    placed = body.unionByName(heads).select(
        "lang", F.least(block, "other").alias("low"), F.greatest(block, "other").alias("high"), "k", "g", "term", "p"
    )
    partial = placed.groupBy("lang", "low", "high", "k").applyInArrow(_cells, PARTIAL)
    sums = partial.groupBy("lang", "i", "j").agg(F.sum("part").alias("part"), F.sum("present").alias("present"))

    side = lambda g, p, s: groups.select("lang", F.col("g").alias(g), F.col("silent").alias(p), F.col("source").alias(s), *(["terms"] if g == "i" else []))
    named = sums.join(side("i", "_p", "one"), ["lang", "i"]).join(side("j", "_q", "two"), ["lang", "j"])
    rest = F.coalesce((F.col("terms") - F.col("present")) * distance(F.col("_p"), F.col("_q")), F.lit(0))
    pairs = named.select("lang", "one", "two", (F.col("part") + rest).alias("value"))
    both = F.explode(F.array(F.struct(F.col("one").alias("source"), F.col("two").alias("item")), F.struct(F.col("two").alias("source"), F.col("one").alias("item"))))
    pairs = pairs.select("lang", "value", both.alias("e")).select("lang", "e.source", "e.item", "value")

    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.col("item").asc())
    ranked = lambda df: df.withColumn("rank", F.row_number().over(order))
    shape = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", F.col("value").cast("long").alias("value"), "rank")
    above = measured.where("p > q").select("lang", "source", F.col("term").alias("item"), distance(F.col("p"), F.col("q")).alias("value"))
    return shape(ranked(pairs), "pair").unionByName(shape(ranked(above).where(F.col("rank") <= top), "term"))


ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
w AS MATERIALIZED (SELECT r, lang, source, unnest(ts) AS term FROM d),
kept AS MATERIALIZED (SELECT lang, term, count(*) AS whole FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM w GROUP BY ALL),
e AS (SELECT g.lang, g.source, k.term, k.whole, coalesce(c.n, 0) AS n FROM g JOIN kept k ON g.lang = k.lang
    LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
p AS MATERIALIZED (SELECT *, 1 + ({SCALE}::HUGEINT * (n + 2)) // (sum(n) OVER own + 2 * count(*) OVER own) AS p,
    1 + ({SCALE}::HUGEINT * (whole + 2)) // (sum(whole) OVER own + 2 * count(*) OVER own) AS q FROM e
    WINDOW own AS (PARTITION BY lang, source)),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum(((x.p - y.p) * (x.p - y.p)) // (x.p + y.p)) AS value
        FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) s
    ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT lang, source, term AS item, ((p - q) * (p - q)) // (p + q) AS value FROM p WHERE n > 0 AND p > q),
every AS (SELECT lang, source, 'pair' AS part, item, value FROM pairs UNION ALL SELECT lang, source, 'term', item, value FROM terms),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM every)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INT) AS rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""
