"""The divergence audit against a count over all groups and terms in plain Python."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

from scoreloom.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans(divergence.UPPER, divergence.LOWER)


def plain(rows, least=10, top=10):
    docs = [(lang or "", source or "", TERM.findall((text or "").translate(LOWER))) for text, lang, source in rows]
    seen, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, terms in docs:
        groups[lang].add(source)
        seen[lang].update(set(terms))
        counts[lang, source].update(terms)
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in seen[lang].items() if n >= least]
        whole = sum((counts[lang, s] for s in sources), Counter())

        def probability(c):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 2) // (total + 2 * len(kept)) for t in kept}

        p, q = {s: probability(counts[lang, s]) for s in sources}, probability(whole)
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = sorted((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in sources if o != s)
            above = sorted((-f(p[s][t], q[t]), t.encode(), t) for t in kept if counts[lang, s][t] and p[s][t] > q[t])
            for part, ranked in (("pair", pairs), ("term", above[:top])):
                out += [(lang, s, part, item, -value, k + 1) for k, (value, _, item) in enumerate(ranked)]
    return Counter(out)


def made(spark, rows):
    wide = [(i, *row, "t", 1, 2) for i, row in enumerate(rows)]
    return spark.createDataFrame(wide, "doc_id long, text string, lang string, source string, term string, g int, k int").repartition(4)


def result(df, **options):
    return Counter(tuple(r) for r in divergence.audit(df, **options).collect())


def corpus(seed=2, sources=9):
    rng = random.Random(seed)
    vocabulary = ["alpha", "Beta", "été", "ÉTÉ", "日本", "x", "don't", "a1b", "same", "Same", *(f"w{c}" for c in "abcdefghijkl")]
    rows = []
    for _ in range(260):
        lang, source = rng.choice(["en", "en", "fr", None]), f"s{min(int(rng.expovariate(0.5)), sources - 1)}"
        text = " ".join(rng.choice(vocabulary[: rng.randint(3, len(vocabulary))]) for _ in range(rng.randint(0, 30)))
        rows.append((text, lang, rng.choice([source, source, None])))
    rows += [rows[0]] * 12 + [(None, "en", "blank"), ("", "zz", "one"), ("lone", "zz", "two"), ("1 2 3", "yy", "alone"), ("same " * 60_000, "fr", "s1")]
    return rows


def test_audit_matches_plain_counts(spark):
    rows = corpus()
    got = result(made(spark, rows))
    assert got == plain(rows) and {r[2] for r in got} == {"pair", "term"}


def test_many_term_blocks(spark, monkeypatch):
    """The same from cells of a few terms."""
    rows = corpus(7)
    monkeypatch.setattr(divergence, "TERM_BLOCK", 3)
    want = plain(rows, least=2, top=4)
    assert result(made(spark, rows), least_docs=2, top=4) == want


def test_more_groups_than_a_block(spark):
    rng = random.Random(3)
    rows = [(" ".join(rng.choices(["a", "b", "c", "d", "e"], k=6)), "en", f"s{rng.randrange(2 * divergence.GROUP_BLOCK + 5):02}") for _ in range(300)]
    assert result(made(spark, rows)) == plain(rows)


def test_empty_table(spark):
    assert not result(made(spark, []))
