"""BK-trees of 64-bit fingerprints as arrays: children are keyed by their whole-number Hamming distance to the parent.

A forest holds one tree per key and is built and searched level by level, so no Python runs per node. A search follows only
the edges whose distance differs from the query's by no more than the radius.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

_EDGES = np.int64(128)  # more than any distance
QUERIES = 1024  # that go down a forest at once


@dataclass
class Forest:
    """``prints`` by node; ``roots`` by tree; the children of a node lie together in ``child``, by distance, found through ``code``."""

    prints: np.ndarray
    roots: np.ndarray
    code: np.ndarray
    child: np.ndarray


def grow(prints: np.ndarray, tree: np.ndarray) -> Forest:
    """``tree`` is the tree (0 to m - 1, each there) of every fingerprint; fingerprints of one tree are distinct."""
    n, trees = len(prints), int(tree.max()) + 1 if len(tree) else 0
    roots = np.full(trees, -1, dtype=np.int64)
    parents, edges, children = [], [], []
    waiting = np.arange(n)
    at, edge = tree.astype(np.int64) - trees, np.zeros(n, dtype=np.int64)  # negative: still above the root
    while len(waiting):
        key = at * _EDGES + edge
        _, first, group = np.unique(key, return_index=True, return_inverse=True)
        node = waiting[first]
        above = at[first] < 0
        roots[at[first][above] + trees] = node[above]
        parents.append(at[first][~above])
        edges.append(edge[first][~above])
        children.append(node[~above])
        stays = np.ones(len(waiting), dtype=bool)
        stays[first] = False
        waiting, at = waiting[stays], node[group][stays]
        edge = np.bitwise_count(prints[waiting] ^ prints[at]).astype(np.int64)
    code = np.concatenate([np.zeros(0, dtype=np.int64), *parents]) * _EDGES + np.concatenate([np.zeros(0, dtype=np.int64), *edges])
    order = np.argsort(code, kind="stable")
    return Forest(prints, roots, code[order], np.concatenate([np.zeros(0, dtype=np.int64), *children])[order])


def search(forest: Forest, queries: np.ndarray, tree: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (query, node) within ``radius``, in portions; every query looks in its own tree only."""
    for begin in range(0, len(queries), QUERIES):
        query = np.arange(begin, min(begin + QUERIES, len(queries)))
        node = forest.roots[tree[query]]
        while len(query):
            far = np.bitwise_count(queries[query] ^ forest.prints[node]).astype(np.int64)
            near = far <= radius
            if near.any():
                yield query[near], node[near]
            low = np.searchsorted(forest.code, node * _EDGES + np.maximum(far - radius, 0))
            count = np.searchsorted(forest.code, node * _EDGES + far + radius, side="right") - low
            at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            query, node = np.repeat(query, count), forest.child[np.repeat(low, count) + at]


class Classes:
    """Classes of the numbers 0 to n - 1 under links that arrive in portions; ``label`` is the least member once ``settle`` ran."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            x, y = self.label[a], self.label[b]
            apart = x != y
            if not apart.any():
                return
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(self.label, np.maximum(x, y), np.minimum(x, y))
            self.settle()

    def settle(self) -> None:
        while (self.label != (up := self.label[self.label])).any():
            self.label = up
