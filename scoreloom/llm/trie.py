"""A prefix tree over sets written as sequences in one global order, and a join that walks it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np


class Union:
    """Disjoint sets."""

    def __init__(self, n: int):
        self.above = list(range(n))

    def find(self, x: int) -> int:
        while self.above[x] != x:
            self.above[x] = self.above[self.above[x]]
            x = self.above[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        self.above[max(x, y)] = min(x, y)
        return x != y


def needed(a: int, b: int, percent: int) -> int:
    """Least overlap with which sets of these sizes reach the similarity."""
    return -(-percent * (a + b) // (100 + percent))


class Trie:
    """Path-compressed: a node has the run of elements on its edge, and below it sets that share everything so far.

    ``sets`` are sorted arrays of ranks. Each node knows the sizes below it, so a walk can tell what overlap is still
    possible: what it has, plus the smaller of what the query and the longest set below have left.
    """

    def __init__(self, sets: list[np.ndarray], chosen: list[int]):
        self.sets = sets
        order = sorted(chosen, key=lambda i: sets[i].astype(">u4").tobytes())  # lexicographic
        self.nodes: list[tuple[np.ndarray, int, int, int, list[int], int]] = []  # edge, depth after it, sizes below, children, set
        self.roots = self._build(order, 0)

    def _build(self, order: list[int], depth: int) -> list[int]:
        """Nodes for sets that share their first ``depth`` elements; iterative, as chains can be long."""
        out: list[int] = []
        todo = [(order, depth, out)]
        while todo:
            group, depth, put = todo.pop()
            i = 0
            while i < len(group):
                if len(self.sets[group[i]]) == depth:  # ends here
                    put.append(self._node(np.zeros(0, dtype=np.int64), depth, [group[i]], group[i]))
                    i += 1
                    continue
                head, j = self.sets[group[i]][depth], i + 1
                while j < len(group) and len(self.sets[group[j]]) > depth and self.sets[group[j]][depth] == head:
                    j += 1
                some = group[i:j]
                first, last = self.sets[some[0]], self.sets[some[-1]]
                if len(some) == 1:
                    put.append(self._node(first[depth:], len(first), some, some[0]))
                else:  # in this order, the first and last set share the least
                    n = min(len(first), len(last))
                    differ = np.flatnonzero(first[:n] != last[:n])
                    end = int(differ[0]) if len(differ) else n
                    node = self._node(first[depth:end], end, some, -1)
                    put.append(node)
                    todo.append((some, end, self.nodes[node][4]))
                i = j
        return out

    def _node(self, edge: np.ndarray, depth: int, below: list[int], one: int) -> int:
        sizes = [len(self.sets[i]) for i in below]
        self.nodes.append((edge, depth, min(sizes), max(sizes), [], one))
        return len(self.nodes) - 1

    def matches(self, query: np.ndarray, total: int, percent: int, skip) -> Iterator[int]:
        """Sets similar to ``query``; ``skip(i)`` tells which need no look. ``total`` bounds the ranks."""
        has = np.zeros(total, dtype=bool)
        has[query] = True
        size = len(query)
        todo = [(n, 0) for n in self.roots]
        while todo:
            node, overlap = todo.pop()
            edge, depth, least, most, children, one = self.nodes[node]
            if 100 * min(size, most) < percent * max(size, least) or one >= 0 and skip(one):
                continue
            overlap += int(np.count_nonzero(has[edge]))
            left = size - int(np.searchsorted(query, edge[-1], side="right")) if len(edge) else size - overlap
            if overlap + min(left, most - depth) < needed(size, least, percent):
                continue
            if one < 0:
                todo.extend((c, overlap) for c in children)
            elif 100 * overlap >= percent * (size + len(self.sets[one]) - overlap):
                yield one


def links(sets: list[np.ndarray], labels: list[int], queries: list[int], indexed: list[int], percent: int) -> Iterator[tuple[int, int]]:
    """Similar pairs (query, indexed) that connect what was apart: a spanning forest, given sets that share a label are
    connected. Sets that have most of their elements in common with others ask first; they connect most at once."""
    if not sets:
        return
    ranks, at = np.unique(np.concatenate(sets), return_inverse=True)
    cuts = np.cumsum([len(s) for s in sets])[:-1]
    ranked = [np.sort(x) for x in np.split(at, cuts)]
    often = np.bincount(at, minlength=len(ranks))
    union = Union(len(sets))
    first: dict[int, int] = {}
    for i, label in enumerate(labels):
        union.join(i, first.setdefault(label, i))
    trie = Trie(ranked, indexed)
    alone = [int(np.count_nonzero(often[r] == 1)) for r in ranked]
    for q in sorted(queries, key=lambda i: (alone[i], i)):
        for found in trie.matches(ranked[q], len(ranks), percent, lambda i, q=q: union.find(i) == union.find(q)):
            if union.join(q, found):
                yield q, found
