"""BK-trees over 64-bit values under Hamming distance, many side by side in numpy.

Children are keyed by their integer distance to the parent. The trees of all cells of a batch
are built together, a level at a time, and searched together: the frontier is a list of
(query, node) pairs, and only edges within the radius of the query's distance are followed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Pairs of a query and a node looked at side by side; bounds memory.
FRONTIER = 1 << 20


class Forest:
    """One BK-tree for each different value of ``cell``; nodes are the places of the values."""

    def __init__(self, values: np.ndarray, cell: np.ndarray):
        n = len(values)
        self.values = np.asarray(values, np.uint64)
        parent, edge = np.full(n, -1, np.int64), np.zeros(n, np.int64)
        pending = np.argsort(cell, kind="stable")
        key = np.asarray(cell, np.int64)[pending]
        above, distance = np.full(n, -1, np.int64), np.zeros(n, np.int64)  # of the pending values
        self.root_cells, self.roots = np.zeros(0, np.int64), np.zeros(0, np.int64)
        while len(pending):
            first = np.ones(len(key), bool)
            first[1:] = key[1:] != key[:-1]
            nodes = pending[first]
            if not len(self.roots):
                self.root_cells, self.roots = key[first], nodes
            parent[nodes], edge[nodes] = above[first], distance[first]
            owner = nodes[np.cumsum(first) - 1][~first]
            rest = pending[~first]
            apart = np.bitwise_count(self.values[rest] ^ self.values[owner]).astype(np.int64)
            key = owner * 65 + apart
            order = np.argsort(key, kind="stable")
            pending, key, above, distance = rest[order], key[order], owner[order], apart[order]
        below = np.flatnonzero(parent >= 0)
        keys = parent[below] * 65 + edge[below]
        self.children = below[np.argsort(keys, kind="stable")].astype(np.int32)
        # where the children of a node from a distance on begin
        self.from_edge = np.zeros(n * 65 + 1, np.int32)
        np.cumsum(np.bincount(keys, minlength=n * 65), out=self.from_edge[1:])

    def near(self, values: np.ndarray, cell: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(places among the asked values, nodes) at that distance or less, in parts of bounded length."""
        at = np.searchsorted(self.root_cells, cell)
        known = np.flatnonzero((at < len(self.root_cells)) & (self.root_cells[np.minimum(at, len(self.root_cells) - 1)] == cell)) if len(self.root_cells) else np.zeros(0, np.int64)
        stack = [(known.astype(np.int32), self.roots[at[known]].astype(np.int32))]
        while stack:
            query, node = stack.pop()
            if len(query) > FRONTIER:
                half = len(query) // 2
                stack += [(query[half:], node[half:]), (query[:half], node[:half])]
                continue
            apart = np.bitwise_count(values.take(query) ^ self.values.take(node)).astype(np.int32)
            hit = np.flatnonzero(apart <= radius)
            if len(hit):
                yield query[hit].astype(np.int64), node[hit].astype(np.int64)
            at = node * np.int32(65)
            low = self.from_edge.take(at + np.maximum(apart - np.int32(radius), 0))
            count = self.from_edge.take(at + np.minimum(apart + np.int32(radius + 1), 65)) - low
            followed = np.flatnonzero(count)
            if len(followed):
                count, low = count[followed], low[followed]
                ends = np.cumsum(count, dtype=np.int32)
                child = np.arange(ends[-1], dtype=np.int32) + np.repeat(low + count - ends, count)
                stack.append((np.repeat(query[followed], count), self.children.take(child)))


class Joined:
    """Which of n things are joined already."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def spanning(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Places of pairs (a, b) that join what was apart, fewest that keep what all of them connect."""
        chosen, place = [], np.arange(len(a))
        while True:
            la, lb = self.label[a], self.label[b]
            apart = la != lb
            if not apart.any():
                return np.array(chosen, np.int64)
            a, b, place, la, lb = a[apart], b[apart], place[apart], la[apart], lb[apart]
            names, at = np.unique(np.concatenate([la, lb]), return_inverse=True)
            # every label offers its first pair; those that close no circle are taken
            offer = np.full(len(names), len(a))
            np.minimum.at(offer, at[: len(a)], np.arange(len(a)))
            np.minimum.at(offer, at[len(a) :], np.arange(len(a)))
            up = list(range(len(names)))

            def root(x: int) -> int:
                while up[x] != x:
                    up[x] = x = up[up[x]]
                return x

            for e in np.unique(offer).tolist():
                x, y = root(int(at[e])), root(int(at[len(a) + e]))
                if x != y:
                    up[max(x, y)] = min(x, y)
                    chosen.append(int(place[e]))
            moved = np.array([root(x) for x in range(len(names))])
            spot = np.minimum(np.searchsorted(names, self.label), len(names) - 1)
            here = names[spot] == self.label
            self.label[here] = names[moved[spot[here]]]


def links(values: np.ndarray, cell: np.ndarray, radius: int, tree: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (a, b) of places in one cell within the radius, a searched in the tree that holds b.

    Without ``tree`` every value is in its cell's tree and each pair comes once; with it only
    the marked values are, and the others search them.
    """
    if tree is None:
        forest = Forest(values, cell)
        for a, b in forest.near(forest.values, cell, radius):
            once = a > b
            yield a[once], b[once]
    else:
        held, asked = np.flatnonzero(tree), np.flatnonzero(~tree)
        forest = Forest(values[held], cell[held])
        for a, b in forest.near(values[asked], cell[asked], radius):
            yield asked[a], held[b]
