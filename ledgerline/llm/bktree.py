"""BK-trees over 64-bit fingerprints, as flat arrays, and the links they find.

A node's children are keyed by their Hamming distance to it. A search goes down only edges whose distance is within
the radius of the query's own distance to the node; all queries of a batch go down level by level together.
"""

from __future__ import annotations

import numpy as np

QUERIES = 256


class BKTree:
    """values: distinct uint64. Nodes are numbered by their place in values."""

    def __init__(self, values: np.ndarray) -> None:
        self.values = values
        keys, nodes = [], []
        rest, group = np.arange(1, len(values)), np.zeros(max(len(values) - 1, 0), np.int64)
        parent = np.zeros(1, np.int64)  # the node of each group
        while len(rest):
            distance = np.bitwise_count(values[rest] ^ values[parent[group]]).astype(np.int64)
            edge = parent[group] * 65 + distance
            order = np.argsort(edge, kind="stable")
            rest, edge = rest[order], edge[order]
            first = np.r_[True, edge[1:] != edge[:-1]]
            keys.append(edge[first])
            nodes.append(rest[first])
            group, parent = (np.cumsum(first) - 1)[~first], rest[first]
            rest = rest[~first]
        edge = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        order = np.argsort(edge)
        self.edges, self.children = edge[order], (np.concatenate(nodes) if nodes else np.zeros(0, np.int64))[order]

    def search(self, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """All (query, node) with at most radius differing bits."""
        found_q, found_n = [], []
        q, node = np.arange(len(queries)), np.zeros(len(queries), np.int64)
        while len(q):
            d = np.bitwise_count(queries[q] ^ self.values[node]).astype(np.int64)
            hit = d <= radius
            found_q.append(q[hit])
            found_n.append(node[hit])
            lo = np.searchsorted(self.edges, node * 65 + np.maximum(d - radius, 0))
            hi = np.searchsorted(self.edges, node * 65 + np.minimum(d + radius, 64), side="right")
            n = hi - lo
            q = np.repeat(q, n)
            node = self.children[np.repeat(lo - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(len(q))] if len(q) else q
        return np.concatenate(found_q), np.concatenate(found_n)


def _root(parent: np.ndarray, x: np.ndarray) -> np.ndarray:
    while True:
        up = parent[x]
        if (up == x).all():
            return x
        x = up


def join(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Union of the sets of a[i] and b[i] for every i; roots are the least numbers."""
    while len(a):
        a, b = _root(parent, a), _root(parent, b)
        apart = a != b
        a, b = a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))


def forest(tree_values: np.ndarray, query_values: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(value, root) for each value that has a link: among tree_values, or if query_values are given between the two.

    The pairs connect the same values as all links do, with fewer pairs than values.
    """
    tree, queries = BKTree(tree_values), tree_values if query_values is None else query_values
    values = tree_values if query_values is None else np.concatenate([tree_values, query_values])
    offset, parent = 0 if query_values is None else len(tree_values), np.arange(len(values))
    for at in range(0, len(queries), QUERIES):
        q, node = tree.search(queries[at : at + QUERIES], radius)
        join(parent, q + at + offset, node)
    root = _root(parent, np.arange(len(values)))
    moved = root != np.arange(len(values))
    return values[moved], values[root[moved]]
