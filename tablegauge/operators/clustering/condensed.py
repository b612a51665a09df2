"""The cluster tree of a density-based clustering and the choice of its clusters.

The tree is small: its leaves are what remains of the spanning tree once every edge
between two large enough parts is cut, its inner nodes are those edges.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd


class ClusterTree:
    """Leaves 0..L-1, then one node per split edge in order of weight; the last is the root."""

    def __init__(self, n_leaves: int, edges: Sequence[tuple]):
        edges = sorted(edges, key=lambda e: e[:1] + tuple(e[3:]))
        n = n_leaves + len(edges)
        self.n_leaves = n_leaves
        self.parent = np.full(n, -1)
        #: Weight at which a node is cut from its parent; points enter below it.
        self.cut = np.full(n, np.inf)
        #: Weight at which a node itself splits (0 for a leaf).
        self.split = np.zeros(n)
        self.children: list[tuple[int, int] | None] = [None] * n
        top = np.arange(n)

        def find(i: int) -> int:
            while top[i] != i:
                top[i] = top[top[i]]
                i = top[i]
            return i

        for number, edge in enumerate(edges):
            node, a, b = n_leaves + number, find(int(edge[1])), find(int(edge[2]))
            self.parent[[a, b]] = node
            self.cut[[a, b]] = edge[0]
            self.split[node] = edge[0]
            self.children[node] = (a, b)
            top[a] = top[b] = node

    def locate(self, leaf: np.ndarray, entered: np.ndarray) -> np.ndarray:
        """The node a point belongs to: the first above its leaf that is cut after it entered."""
        node = np.asarray(leaf).copy()
        while True:
            up = (self.parent[node] >= 0) & (self.cut[node] <= entered)
            if not up.any():
                return node
            node[up] = self.parent[node][up]

    def point_sums(self, leaf: np.ndarray, entered: np.ndarray) -> pd.DataFrame:
        """Per node: number of its own points and the sum of their densities 1/entered."""
        node = self.locate(leaf, entered)
        n = len(self.parent)
        with np.errstate(divide="ignore"):
            density = 1.0 / entered
        return pd.DataFrame({"points": np.bincount(node, minlength=n),
                             "density": np.bincount(node, weights=density, minlength=n)})


class Selection:
    """The chosen nodes of a :class:`ClusterTree`, numbered 0.. in node order."""

    def __init__(self, tree: ClusterTree, chosen: np.ndarray):
        self.tree = tree
        number = np.full(len(chosen), -1)
        number[chosen] = np.arange(chosen.sum())
        # Nodes below a chosen one share its number; parents come after their children.
        for node in range(len(chosen) - 1, -1, -1):
            if number[node] < 0 and tree.parent[node] >= 0:
                number[node] = number[tree.parent[node]]
        self.number = number

    def labels(self, leaf: np.ndarray, entered: np.ndarray) -> np.ndarray:
        return self.number[self.tree.locate(leaf, entered)]


def select_clusters(n_leaves: int, edges: Sequence[tuple],
                    sums: Callable[[ClusterTree], pd.DataFrame]) -> Selection:
    """Choose the nodes with the greatest excess of mass; the root is never chosen.

    The mass of a node is the sum over its points of density minus the density at which
    the node was cut off; points of its children count with the density of the split.
    """
    tree = ClusterTree(n_leaves, edges)
    own = sums(tree)
    n = len(tree.parent)
    points, mass = own["points"].to_numpy().copy(), own["density"].to_numpy().copy()
    with np.errstate(divide="ignore"):
        born = np.where(np.isinf(tree.cut), 0.0, 1.0 / tree.cut)
        split_density = 1.0 / tree.split
    total = points.astype(float)
    for node in range(n):
        if tree.children[node]:
            below = sum(total[c] for c in tree.children[node])
            mass[node] += below * split_density[node]
            total[node] += below
    with np.errstate(invalid="ignore"):
        stability = np.nan_to_num(mass - total * born, nan=np.inf)
    chosen = np.zeros(n, bool)
    best = stability.copy()
    for node in range(n):
        if tree.parent[node] < 0 and n > 1 or n == 1:
            continue  # the root
        below = sum(best[c] for c in tree.children[node]) if tree.children[node] else -np.inf
        if below > stability[node]:
            best[node] = below
        else:
            chosen[node] = True
    # A chosen node hides the chosen ones below it.
    hidden = np.zeros(n, bool)
    for node in range(n - 1, -1, -1):
        above = tree.parent[node]
        if above >= 0:
            hidden[node] = chosen[above] or hidden[above]
    return Selection(tree, chosen & ~hidden)
