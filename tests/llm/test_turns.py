"""Prefixes that meet and whole sets travel in turns: the same result, and never the whole corpus at once."""

from __future__ import annotations

import random
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from scoreloom.llm import jaccard
from scoreloom.session import scratch_path


def copied(families: int, copies: int) -> tuple[list[tuple[int, str]], dict[int, int]]:
    """Texts of which each has near copies, and the least identifier of each family."""
    rng, rows, least = random.Random(5), [], {}
    for f in range(families):
        base = [f"w{rng.randrange(10**6)}" for _ in range(60)]
        for c in range(copies):
            rows.append((copies * f + c, " ".join([*base, f"c{c}"])))
            least[copies * f + c] = copies * f
    return rows, least


def test_sets_travel_in_turns(docs, monkeypatch):
    monkeypatch.setattr(jaccard, "TURN_LEAST", 1, raising=False)
    written, grams = jaccard.materialise, []

    def noted(df, name):
        out = written(df, name)
        if name == "jaccard-content":
            grams.append(out.agg(F.sum(F.size("grams"))).first()[0] or 0)
        return out

    monkeypatch.setattr(jaccard, "materialise", noted)
    rows, least = copied(50, 4)
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_components(docs(rows), 3, 90).collect()}
    assert got == least
    total = len(rows) * 59
    assert sum(grams) == total and max(grams) < 0.5 * total


def test_turns_give_back_what_they_wrote(spark, docs, monkeypatch):
    """Also where parts are cut into many blocks."""
    monkeypatch.setattr(jaccard, "BLOCK", 3)
    monkeypatch.setattr(jaccard, "TURN_LEAST", 1, raising=False)
    folder = Path(scratch_path(spark, "", unique=False))
    kept = lambda: {p.name for p in folder.iterdir() if p.name.startswith("jaccard-")}
    before = kept()
    rows, least = copied(10, 8)
    assert {r.doc_id: r.component_id for r in jaccard.jaccard_components(docs(rows), 3, 90).collect()} == least
    assert {x[:-13] for x in kept() - before} == {"jaccard-rows", "jaccard-least"}


def test_counts_in_a_byte_never_fall_short():
    """Also of a text that says few words very often."""
    word = pa.array([" ".join(f"v{x}" for x in range(600)) + " a b" * 3, "x y z"])
    for w in jaccard.words(word, jaccard.NOT_SPACE):
        value, first = jaccard.gram_sets(w, 3)
        for i, blob in enumerate(jaccard.histograms(value, first)):
            bins = (jaccard.mix(value[first[i] : first[i + 1]]) >> np.uint64(58)).astype(np.int64)
            assert len(blob) == jaccard.BINS and (jaccard.STEPS[np.frombuffer(blob, np.uint8)] == np.bincount(bins, minlength=jaccard.BINS)).all()
    many = np.array([0, 191, 192, 500, 10**6, 2**31])
    held = jaccard.STEPS[np.searchsorted(jaccard.STEPS, many).astype(np.uint8)]
    assert (held >= many).all() and (held[:2] == many[:2]).all() and len(jaccard.STEPS) == 256 and (np.diff(jaccard.STEPS) > 0).all()
