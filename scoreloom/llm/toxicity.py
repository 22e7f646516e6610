"""Toxicity scores: gradient-boosted trees over dense features, calibrated by isotonic regression.

Features of a text are rates: words of two lexicons (a small fixed one, and one learned from labelled rows, of whole words
and of stems), such words near a second person, capitals, punctuation, and words that mix letters with digits or signs.
Labels are learned from at most ``TRAIN_ROWS`` labelled rows, taken in the order of a hash of ``doc_id``; rows in the
held-out fold are never among them. Half of them teach the lexicon, three tenths the trees, a fifth the calibration.
Everything else covers all rows. Labels, language, source and identifier are no inputs of a score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scoreloom.llm.words import ALPHANUMERIC, LOWER, Words, give_back, small_batches, word_hashes, words
from scoreloom.session import materialise, ship_package

TRAIN_ROWS = 12_000
FOLDS = 5
TREES = 20
DEPTH = 3
STEMS = (4, 5, 6)  # bytes
EVIDENCE = 20.0  # least log-likelihood ratio of a lexicon entry
NEAR = 5  # words
SCORED_BYTES = 1 << 20  # slices of scored texts: running sums of weights round by what lies in one
LEAST_OF_A_CLASS = 3  # fewer labelled rows of a class in any part: every score is the share of label 1

INSULTS = "idiot stupid moron loser trash scum pathetic worthless disgusting clown dumb fool jerk hate kill shut ugly liar"
SECOND = "you your yours yourself u ur du dich dir dein deine tu te toi ton ta tes vous votre vos usted ustedes tus su sus ti"

#: Letters, digits and the signs that stand for letters.
TABLE = ALPHANUMERIC.copy()
TABLE[[ord(c) for c in "@$*"]] = True
#: Lower case, and digits and signs as the letters they look like.
FOLD = LOWER.copy()
for sign, letter in zip("0134578@$", "oieastbas"):
    FOLD[ord(sign)] = ord(letter)
_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_LOUD = np.zeros(256, dtype=bool)
_LOUD[[33, 63]] = True
_MARK = np.zeros(256, dtype=bool)
_MARK[[*range(34, 48), *range(58, 63), 64, *range(91, 97), *range(123, 127)]] = True

FEATURES = (
    "insults", "log_insults", "learned", "learned_weight", "learned_most", "log_learned", "second", "near_second", "log_near_second",
    "capital_words", "capitals", "loud", "marks", "disguised", "disguised_insults", "log_words",
)


def _per_row(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums over ``first[i]:first[i + 1]``; empty ranges give 0."""
    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return total[first[1:]] - total[first[:-1]]


def terms(w: Words) -> list[tuple[np.ndarray, np.ndarray]]:
    """Hashes of every word and of its stems, each with the words that have it."""
    return [(w.hash, np.ones(len(w.hash), dtype=bool)), *(w.stems(n, FOLD) for n in STEMS)]


def features(w: Words, offsets: np.ndarray, lexicon: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """One line per row of the slice."""
    n, first = len(w.rows), w.first
    count = np.diff(first).astype(np.float64)
    some = np.maximum(count, 1)
    size = np.diff(offsets).astype(np.float64)
    insults = np.isin(w.hash, word_hashes([INSULTS], TABLE, FOLD))
    weight = np.zeros(len(w.hash))
    if len(lexicon):
        for hashed, has in terms(w):
            at = np.minimum(np.searchsorted(lexicon, hashed), len(lexicon) - 1)
            weight = np.maximum(weight, np.where(has & (lexicon[at] == hashed), weights[at], 0.0))
    hit = insults | (weight > 0)
    second = np.isin(w.hash, word_hashes([SECOND], TABLE, FOLD))
    near = np.zeros(len(w.hash), dtype=bool)
    for step in range(1, NEAR + 1):
        same = w.row[step:] == w.row[:-step]
        near[step:] |= second[:-step] & same
        near[:-step] |= second[step:] & same
    inside = np.concatenate([[0], np.cumsum(_UPPER[w.data])]), np.concatenate([[0], np.cumsum(_LETTER[w.data])])
    upper, letters = (c[w.end] - c[w.start] for c in inside)
    length = w.end - w.start
    disguised = (letters > 0) & (letters < length)
    most = np.zeros(n)
    np.maximum.at(most, w.row - w.rows.start, weight)
    by_byte = lambda table: _per_row(table[w.data], offsets) / np.maximum(size, 1)
    sums = lambda x: _per_row(x, first)
    return np.column_stack([
        sums(insults) / some, np.log1p(sums(insults)), sums(weight > 0) / some, sums(weight) / some, most, np.log1p(sums(weight > 0)),
        sums(second) / some, sums(hit & near) / some, np.log1p(sums(hit & near)),
        sums((upper == length) & (length > 1)) / some, by_byte(_UPPER), by_byte(_LOUD), by_byte(_MARK),
        sums(disguised) / some, sums(disguised & hit) / some, np.log1p(count),
    ])


def _offsets(w: Words, column: pa.Array) -> np.ndarray:
    sizes = pa.compute.binary_length(column[w.rows.start : w.rows.stop]).fill_null(0).to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.cumsum(sizes)])


def with_features(df: DataFrame, lexicon: dict[int, float], keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep`` and ``features`` (array of doubles) of every row; null and empty texts have zeros. ``text`` is
    passed on only where it is one of ``keep``."""
    ship_package(df.sparkSession)
    order = sorted(lexicon)
    hashes, weights = np.array(order, dtype=np.uint64), np.array([lexicon[h] for h in order])
    df = df.select(*keep, *([] if text in keep else [text]))
    fields = [f for f in df.schema.fields if f.name in keep]

    def run(batches):
        for batch in batches:
            column = batch.column(text)
            made = [features(w, _offsets(w, column), hashes, weights) for w in words(column, TABLE, FOLD, SCORED_BYTES)]
            flat = np.concatenate([*made, np.zeros((0, len(FEATURES)))]).ravel()
            ends = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * len(FEATURES))
            yield pa.RecordBatch.from_arrays([*map(batch.column, keep), pa.ListArray.from_arrays(ends, pa.array(flat))], [*keep, "features"])

    return df.mapInArrow(give_back(run), T.StructType([*fields, T.StructField("features", T.ArrayType(T.DoubleType()))]))


def learn_lexicon(train: DataFrame, evidence: float = EVIDENCE) -> dict[int, float]:
    """Words and stems that tell label 1 apart: hash and weight. ``train`` is bounded, and so is the result: every
    entry occurs in several rows of it."""
    def run(batches):
        for batch in batches:
            toxic = batch.column("label").to_numpy(zero_copy_only=False)
            for w in words(batch.column("text"), TABLE, FOLD):
                found = [np.unique(np.rec.fromarrays([hashed[has], w.row[has]], names="term,row")) for hashed, has in terms(w)]
                found = np.unique(np.concatenate(found))
                term, at = np.unique(found["term"], return_inverse=True)
                hot = np.bincount(at, weights=toxic[found["row"]], minlength=len(term))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(term.view(np.int64)), pa.array(np.bincount(at, minlength=len(term)).astype(np.int64)), pa.array(hot.astype(np.int64))],
                    ["term", "n", "toxic"])

    totals = train.agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("toxic")).first()
    counted = train.select("text", "label").mapInArrow(give_back(run), "term long, n long, toxic long")
    counted = counted.groupBy("term").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic")).where("toxic > 0")
    share = F.lit(totals["toxic"] / totals["n"])
    part = lambda k, p: F.when(k > 0, k * F.log(k / (F.col("n") * p))).otherwise(0.0)
    ratio = 2 * (part(F.col("toxic"), share) + part(F.col("n") - F.col("toxic"), 1 - share))
    odds = F.log((F.col("toxic") + 0.5) / (F.col("n") - F.col("toxic") + 0.5)) - F.log(share / (1 - share))
    chosen = counted.where((ratio >= evidence) & (F.col("toxic") > F.col("n") * share)).select("term", odds.alias("weight"))
    return {r["term"] & (2**64 - 1): float(r["weight"]) for r in chosen.collect()}


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == 0, F.lit(True))


def training_rows(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """``text, label, part`` of at most ``rows`` labelled rows outside the held-out fold."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out())
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("double").alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    # at most ``rows`` rows of 16 bytes
    train = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    train = train.groupBy("doc_id", "label").agg(F.max("text").alias("text"))  # of rows that share an identifier the greatest text
    return train.select("text", "label", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(10)).alias("part"))


def score(docs: DataFrame, labels: DataFrame, keep: list[str], rows: int = TRAIN_ROWS, text: str = "text") -> DataFrame:
    """The columns ``keep`` of every row and ``score`` (0 to 1). Null text counts as empty; empty texts are scored too.
    Labels without a row, null labels and null identifiers teach nothing; without enough labels every score is the
    share of label 1 among those known (0 without any)."""
    ship_package(docs.sparkSession)
    small_batches(docs.sparkSession)
    train = materialise(training_rows(docs.select("doc_id", F.col(text).alias("text")), labels, rows), "toxicity-train")
    per = {(r["p"], r["label"]): r["n"] for r in train.groupBy(F.expr("CASE WHEN part < 5 THEN 0 WHEN part < 8 THEN 1 ELSE 2 END").alias("p"), "label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if any(per.get((p, label), 0) < LEAST_OF_A_CLASS for p in range(3) for label in (0.0, 1.0)):
        known = sum(per.values())
        return docs.select(*keep, F.lit(sum(n for (_, label), n in per.items() if label == 1.0) / known if known else 0.0).alias("score"))
    lexicon = learn_lexicon(train.where("part < 5"))
    made = with_features(train.where("part >= 5"), lexicon, ["label", "part"])
    made = materialise(made.repartition(2), "toxicity-features").withColumn("features", array_to_vector("features"))
    trees = GBTClassifier(featuresCol="features", labelCol="label", maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, maxBins=64, seed=1)
    model = trees.fit(made.where("part < 8"))
    model.setPredictionCol("")
    chance = vector_to_array("probability")[1]
    judged = model.transform(made.where("part >= 8")).select("label", chance.alias("chance"))
    curve = IsotonicRegression(featuresCol="chance", labelCol="label", predictionCol="calibrated").fit(judged)
    found = with_features(docs, lexicon, keep, text).withColumn("features", array_to_vector("features"))
    found = model.transform(found).withColumn("chance", chance)
    # the calibrated curve has flat steps; a hundredth of the uncalibrated chance keeps the order within them
    blend = 0.99 * F.col("calibrated") + 0.01 * F.col("chance")
    return curve.transform(found).select(*keep, F.greatest(F.lit(0.0), F.least(F.lit(1.0), blend)).alias("score"))


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row; a null ``doc_id`` counts as held out.

    Repeated rows are scored each, and alike; rows that share a ``doc_id`` teach once. Long texts are read whole. An empty table gives
    no rows; columns other than ``doc_id`` and ``text`` are not read.
    """
    out = score(docs, labels, ["doc_id"])
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def clean(docs: DataFrame, labels: DataFrame, limit: float = 0.5) -> DataFrame:
    """The rows scored below ``limit``, with all their columns; the text is read once and never shuffled."""
    # by number, so that no column clashes with those of the model
    names = [f"_c{i}" for i in range(len(docs.columns))]
    numbered = docs.select(*[F.col(f"`{c}`").alias(n) for n, c in zip(names, docs.columns)], "doc_id")
    marked = score(numbered, labels, names, text=names[docs.columns.index("text")])
    return marked.where(F.col("score") < limit).select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns)])
