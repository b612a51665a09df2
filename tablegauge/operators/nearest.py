"""The best partners of the rows of a block, kept while its tiles meet those of another block.

Squared distances come from a matrix product first.  Whatever its error could hide is measured
again by differences, so that results and ties are those of :func:`distances`.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from tablegauge.operators.blocks import distances, pair_squares

#: Share of a tile from which all its distances are measured at once.
DENSE = 1 / 16
LARGEST = np.finfo(float).max


def square_bound(values: np.ndarray) -> np.ndarray:
    """Squares, rounded up; infinity becomes the largest number, which infinity itself exceeds."""
    with np.errstate(over="ignore"):
        return np.minimum(values * values * (1 + 1e-12), LARGEST)


def _first_ranks(rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the first k entries of every row in sorted ``rows``, and their ranks."""
    starts = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
    rank = np.arange(len(rows)) - np.repeat(starts, np.diff(np.r_[starts, len(rows)]))
    kept = np.flatnonzero(rank < k)
    return kept, rank[kept]


class Nearest:
    """The k nearest partners of every row, ties by id; infinite distances are no partners."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.distance = np.full((n, k), np.inf)
        self.id = np.zeros((n, k), dtype=np.int64)
        self.value = np.zeros((n, k))

    def update(self, at: slice, rough: np.ndarray, slack: float, x: np.ndarray, y: np.ndarray,
               ids: np.ndarray, values: np.ndarray) -> None:
        """Rows ``at`` meet the partners ``ids``; ``rough`` is infinite where they must not."""
        limit = square_bound(self.distance[at, -1]) + slack
        if np.isinf(self.distance[at, -1]).any():
            k = min(self.k, rough.shape[1])
            if k == self.k:
                limit = np.minimum(limit, np.partition(rough, k - 1, axis=1)[:, k - 1] + 2 * slack)
            limit = np.minimum(limit, LARGEST)
        rows, cols = np.nonzero(rough <= limit[:, None])
        if not len(rows):
            return
        if len(rows) > max(DENSE * rough.size, 4 * self.k * len(rough)):
            d = distances(x, y)
            d[~np.isfinite(rough)] = np.inf
            by_id = np.argsort(ids, kind="stable")
            order = by_id[np.argsort(d[:, by_id], axis=1, kind="stable")[:, :self.k]]
            rows, cols = np.repeat(np.arange(len(d)), order.shape[1]), order.ravel()
            distance = d[rows, cols]
        else:
            distance = np.sqrt(pair_squares(x, y, rows, cols))
        if ids.dtype.kind == "f":  # there are null ids
            self.id = self.id.astype(float)
        mine = (self.distance[at], self.id[at], self.value[at])
        touched = np.unique(rows)
        rows = np.r_[np.repeat(touched, self.k), rows]
        distance, id_, value = (np.r_[old[touched].ravel(), new] for old, new in
                                zip(mine, (distance, ids[cols], values[cols])))
        order = np.lexsort((id_, distance, rows))
        rows = rows[order]
        kept, rank = _first_ranks(rows, self.k)
        for old, new in zip(mine, (distance, id_, value)):
            old[rows[kept], rank] = new[order][kept]


class Least:
    """The cheapest partner of every row, ties by the given symmetric hash."""

    def __init__(self, n: int):
        self.cost, self.tie = np.full(n, np.inf), np.full(n, np.iinfo(np.int64).max)
        self.mate, self.value = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)

    def update(self, at: slice, rough: np.ndarray, slack: np.ndarray | float, bound: np.ndarray,
               cost: Callable[[np.ndarray, np.ndarray], np.ndarray], tie: Callable[[np.ndarray, np.ndarray], np.ndarray],
               ids: np.ndarray, values: np.ndarray) -> None:
        """Rows ``at`` meet the partners ``ids``.  ``bound`` is what their best so far allows on the scale of ``rough``,
        ``slack`` the error of ``rough``; ``cost`` measures pairs (rows, columns) of the tile."""
        limit = np.minimum(np.minimum(bound, rough.min(1)) * (1 + 1e-12) + 2 * slack, LARGEST)
        rows, cols = np.nonzero(rough <= limit[:, None])
        if not len(rows):
            return
        self.offer(at, len(rough), rows, cols, cost(rows, cols), tie, ids, values)

    def offer(self, at: slice, n: int, rows: np.ndarray, cols: np.ndarray, exact: np.ndarray,
              tie: Callable[[np.ndarray, np.ndarray], np.ndarray], ids: np.ndarray, values: np.ndarray) -> None:
        """The measured pairs (rows, columns) of a tile with ``n`` rows."""
        low = np.full(n, np.inf)
        np.minimum.at(low, rows, exact)
        # Ties are hashed only where they are the least.
        kept = (exact == low[rows]) & (exact <= self.cost[at][rows]) & np.isfinite(exact)
        rows, cols, exact = rows[kept], cols[kept], exact[kept]
        if not len(rows):
            return
        hashed = tie(rows, cols)
        order = np.lexsort((hashed, rows))
        first = order[_first_ranks(rows[order], 1)[0]]
        rows, cols, exact, hashed = rows[first], cols[first], exact[first], hashed[first]
        mine = (self.cost[at], self.tie[at], self.mate[at], self.value[at])
        better = (exact < mine[0][rows]) | (hashed < mine[1][rows])
        for old, new in zip(mine, (exact, hashed, ids[cols], values[cols])):
            old[rows[better]] = new[better]
