"""Vector codes against plain Lloyd rounds in Python's whole numbers."""

from __future__ import annotations

import hashlib
import math
import random
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from scoreloom.llm import codes


def plain(rows, rounds=codes.ROUNDS):
    """``rows`` of (id, label, vector) that are usable and alike long: what ``compress`` returns, as a multiset."""
    whole = [[math.floor(Fraction(x) * 4096) for x in v] for _, _, v in rows]
    w = len(whole[0]) // 8
    first = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, rows[i][2]))[:16]
    books = [[whole[i][p * w : (p + 1) * w] for i in first] for p in range(8)]
    far = lambda v, p, e: sum((a - b) ** 2 for a, b in zip(v[p * w : (p + 1) * w], books[p][e]))
    for r in range(rounds + 1):
        code = [[min(range(len(books[p])), key=lambda e: (far(v, p, e), e)) for p in range(8)] for v in whole]
        if r == rounds:
            break
        for p in range(8):
            books[p] = [
                [sum(c) // len(mine) for c in zip(*mine)] if (mine := [v[p * w : (p + 1) * w] for v, c in zip(whole, code) if c[p] == e]) else book
                for e, book in enumerate(books[p])
            ]
    error = [sum(far(v, p, c[p]) for p in range(8)) for v, c in zip(whole, code)]
    labels = Counter()
    for (_, label, _), e in zip(rows, error):
        labels[label] += e
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    fits = lambda v: v if v < 2**63 else None
    return Counter((r[0], bytes(c).hex(), fits(e), fits(labels[r[1]]), digest) for r, c, e in zip(rows, code, error))


def made(spark, rows, kind="float"):
    wide = [(i, label, v, 7, b"x", 1.5) for i, label, v in rows]
    return spark.createDataFrame(wide, f"vec_id long, label int, embedding array<{kind}>, id int, code binary, error double").repartition(3)


def result(df):
    return Counter(tuple(r) for r in codes.compress(df).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect())


@pytest.mark.parametrize("grid", [3, 1000])
def test_codes_match_plain_rounds(spark, grid):
    """A coarse grid makes ties and entries that nobody uses."""
    rng = random.Random(grid)
    rows = [(i * 3, rng.choice([None, 0, 1]), [rng.randrange(-grid, grid) / (2 * grid) for _ in range(16)]) for i in range(300)]
    rows = [(i, label, [float(np.float32(x)) for x in v]) for i, label, v in rows]
    rows += [rows[5], rows[5], (None, None, rows[7][2])]
    bad = [(1, 0, None), (2, 0, [0.0] * 15 + [None]), (4, 0, [float("nan")] * 16), (5, 1, [float("-inf")] * 16), (7, 1, [])]
    assert result(made(spark, rows + bad)) == plain(rows)


def test_few_and_no_rows(spark):
    rows = [(9, 1, [0.25] * 8), (3, None, [-0.1] * 8)]
    assert result(made(spark, rows, "double")) == plain(rows)
    assert not result(made(spark, [])) and not result(made(spark, [(1, 1, None)]))
    assert sum(result(made(spark, [(1, 1, [0.5] * 8), (2, 1, [0.5] * 16), (3, 1, [0.5] * 9)])).values()) == 1  # other lengths


def test_large_components_are_exact(spark):
    rng = random.Random(5)
    rows = [(i, i % 2, [rng.uniform(-1, 1) * 10 ** rng.choice([0, 3, 5, 9]) for _ in range(8)]) for i in range(60)]
    assert result(made(spark, rows, "double")) == plain(rows)
    assert sum(result(made(spark, [*rows, (99, 0, [1e30] * 8)], "double")).values()) == 60


def test_fixed_parts_compare_moved_entries_only(spark):
    rng = np.random.default_rng(3)
    x, entries = rng.integers(-9, 9, (500, 2)), rng.integers(-9, 9, (16, 2))
    blank = np.full(500, codes.UNKNOWN)
    code, far, anew = codes.assign(x, entries, np.ones(16, dtype=bool), np.zeros(500, dtype=np.uint8), blank)
    assert anew == 500
    moved = np.isin(np.arange(16), [0, 3, 11])
    entries = np.where(moved[:, None], entries + rng.integers(-2, 3, (16, 2)), entries)
    again, again_far, anew = codes.assign(x, entries, moved, code, far)
    want, want_far, _ = codes.assign(x, entries, moved, code, blank)
    assert anew == moved[code].sum() < 500 and (again == want).all() and (again_far == want_far).all()


def test_effort_falls(spark):
    rng = random.Random(1)
    df = made(spark, [(i, 0, [rng.random() for _ in range(8)]) for i in range(400)])
    kept = df.where(codes.usable(df)).selectExpr("vec_id id", "label", "embedding vector")
    _, _, effort = codes.fit(kept)
    assert effort[0] == 400 * 8 and effort[-1] < effort[0]
