"""Fingerprints against the definition, trees and classes against all pairs."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from scoreloom.llm import bktree, simhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def plain(text):
    words = WORD.findall((text or "").translate(LOWER))
    shingles = [" ".join(words[i : i + 4]) for i in range(max(len(words) - 3, 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(prints, radius=4):
    parent = {p: p for p in prints}
    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    ordered = sorted(parent)
    for i, a in enumerate(ordered):
        for b in ordered[:i]:
            if (a ^ b).bit_count() <= radius:
                parent[max(find(a), find(b))] = min(find(a), find(b))
    return {p: find(p) for p in prints}


def expected(rows):
    prints = [plain(t) for _, t in rows]
    label, least = classes(set(prints)), {}
    for (i, _), p in zip(rows, prints):
        if i is not None:
            least[label[p]] = min(i, least.get(label[p], i))
    return Counter((i, f"{p:016x}", least.get(label[p])) for (i, _), p in zip(rows, prints))


def corpus(rng, n=60):
    vocabulary = [a + b for a in "bcdfglmnprst" for b in ("a", "en", "Il", "or", "us", "é")]
    rows = []
    for i in range(n):
        words = [rng.choice(vocabulary) + rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 3, 4, 5, 40, 200]))]
        for k in range(rng.choice([1, 1, 2, 4])):
            copy = list(words)
            if k:
                copy[rng.randrange(len(copy))] = rng.choice(["x", "Zebra", "y z"])
            rows.append((len(rows) * 7 % 1009, rng.choice([" ", "  \n", "\t"]).join(copy)))
    return rows


def test_components_match_all_pairs(spark, docs):
    rows = corpus(random.Random(1))
    rows += [(None, rows[0][1]), (2000, None), (2001, ""), (2002, " \n\t"), rows[3], rows[3], (None, "only here"), (2003, "a b"), (2004, "A  B"), (2005, "long " * 100_000)]
    got = Counter(tuple(r) for r in simhash.near_copies(docs(rows)).collect())
    assert got == expected(rows)
    assert len({c for _, _, c in got}) < len(rows) - 10  # some are linked
    assert simhash.near_copies(docs([])).count() == 0


def test_fingerprint_is_half_or_less():
    text = np.frombuffer(b"one Two three four five", dtype=np.uint8)
    start, end = np.array([0, 4, 8, 14, 19]), np.array([3, 7, 13, 18, 23])
    assert simhash.fingerprint(text, start, end) == plain("one Two three four five")


def cluster(rng, n, spread=5):
    """Fingerprints around few centres, so that shards are crowded."""
    centres = [rng.getrandbits(64) for _ in range(3)]
    out = {sum(1 << b for b in rng.sample(range(64), rng.randint(0, spread))) ^ rng.choice(centres) for _ in range(n)}
    return sorted(out | {rng.getrandbits(64) for _ in range(n // 4)})


@pytest.mark.parametrize("radius", [0, 2, 4])
def test_tree_finds_all_within_the_radius(radius):
    rng = random.Random(radius)
    prints = np.array(cluster(rng, 400), dtype=np.uint64)
    tree = np.array([rng.randrange(3) for _ in prints])
    tree[:3] = [0, 1, 2]
    forest = bktree.grow(prints, tree)
    got = {(int(q), int(n)) for qs, ns in bktree.search(forest, prints, tree, radius) for q, n in zip(qs, ns)}
    want = {(i, j) for i in range(len(prints)) for j in range(len(prints)) if tree[i] == tree[j] and (int(prints[i]) ^ int(prints[j])).bit_count() <= radius}
    assert got == want


def test_tree_follows_few_edges():
    """Far fingerprints cost a query little where the tree splits well."""
    rng = random.Random(5)
    prints = np.array(sorted({sum(1 << b for b in rng.sample(range(64), k)) for k in (2, 30, 60) for _ in range(300)}), dtype=np.uint64)
    zero = np.zeros(len(prints), dtype=np.int64)
    forest = bktree.grow(prints, zero)
    assert len(forest.child) == len(prints) - 1
    parents, edges = forest.code // 128, forest.code % 128
    assert (np.bitwise_count(prints[parents] ^ prints[forest.child]) == edges).all()
    assert len(set(zip(parents.tolist(), edges.tolist()))) == len(edges)


@pytest.mark.parametrize(("block", "rows"), [(2048, 1 << 16), (16, 64), (7, 5), (1, 1)])
def test_links_keep_classes(spark, block, rows):
    """Also where shards are cut into blocks and arrive in portions."""
    rng = random.Random(block)
    prints = cluster(rng, 300 if block > 1 else 40)
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    unique = spark.createDataFrame(signed, "fp long").repartition(3)
    links = [(a % (1 << 64), b % (1 << 64)) for a, b in simhash.shard_links(unique, block=block, rows=rows).collect()]
    assert all((a ^ b).bit_count() <= 64 and a in set(prints) for a, b in links)
    parent = {p: p for p in prints}
    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in links:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    assert {p: find(p) for p in prints} == classes(prints)
