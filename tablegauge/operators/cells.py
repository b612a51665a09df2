"""Cells of near rows: space cut at medians of a bounded sample, so that rows visit near cells only."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablegauge.operators.blocks import _packed, _run
from tablegauge.session import broadcast_if_small, materialize

#: Rows from which cells are cut, the least of them in a cell, and most visitors that meet a block at once.
SAMPLE_ROWS, SAMPLE_SHARE, VISITORS = 20_000, 16, 16_384


class Cells(NamedTuple):
    """A tree of cuts ``x[axis] <= at`` (axis -1: a leaf) and, per leaf, its number and its box."""

    axis: np.ndarray
    at: np.ndarray
    below: np.ndarray
    above: np.ndarray
    leaf: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def locate(self, x: np.ndarray) -> np.ndarray:
        """The number of the cell of every row."""
        node, rows = np.zeros(len(x), dtype=np.int64), np.arange(len(x))
        while True:
            axis = self.axis[node]
            inner = axis >= 0
            if not inner.any():
                return self.leaf[node]
            under = x[rows, np.maximum(axis, 0)] <= self.at[node]
            node = np.where(inner, np.where(under, self.below[node], self.above[node]), node)


def _cut(x: np.ndarray) -> tuple[int, float] | None:
    """The axis of the widest extent and a value in its middle with rows on both sides."""
    low, high = x.min(0), x.max(0)
    axis = int((high - low).argmax())
    if not high[axis] > low[axis]:
        return None
    column = x[:, axis]
    at = np.partition(column, (len(column) - 1) // 2)[(len(column) - 1) // 2]
    if at == high[axis]:
        at = column[column < at].max()
    return axis, float(at)


def cut_cells(x: np.ndarray, wanted: int) -> Cells:
    """At most ``wanted`` cells of equally many rows of a sample; rows of equal values stay together."""
    d = x.shape[1]
    nodes, boxes = [[-1, 0.0, 0, 0, 0]], []
    open_ = [(0, np.arange(len(x)), np.full(d, -np.inf), np.full(d, np.inf), wanted)]
    while open_:
        node, rows, low, high, parts = open_.pop()
        found = _cut(x[rows]) if parts > 1 and len(rows) > 1 else None
        if found is None:
            nodes[node][4] = len(boxes)
            boxes.append((low, high))
            continue
        axis, at = found
        under = x[rows, axis] <= at
        nodes[node][:4] = axis, at, len(nodes), len(nodes) + 1
        nodes += [[-1, 0.0, 0, 0, 0], [-1, 0.0, 0, 0, 0]]
        top, bottom = high.copy(), low.copy()
        top[axis] = bottom[axis] = at
        open_ += [(len(nodes) - 2, rows[under], low, top, parts // 2),
                  (len(nodes) - 1, rows[~under], bottom, high, parts - parts // 2)]
    axis, at, below, above, leaf = (np.array(c) for c in zip(*nodes))
    return Cells(axis, at, below, above, leaf, *(np.array(side) for side in zip(*boxes)))


def near_order(x: np.ndarray, rows_of: int) -> list[np.ndarray]:
    """The rows in tiles of at most ``rows_of`` near ones."""
    done, open_ = [], [np.arange(len(x))]
    while open_:
        rows = open_.pop()
        if len(rows) <= rows_of:
            done.append(rows)
            continue
        own = x[rows]
        axis = int(np.ptp(own, axis=0).argmax())
        half = len(rows) // 2
        order = np.argpartition(own[:, axis], half)
        open_ += [rows[order[half:]], rows[order[:half]]]
    return done


def box_squares(low: np.ndarray, high: np.ndarray, lows: np.ndarray, highs: np.ndarray) -> np.ndarray:
    """Squared distances of boxes (a row is a box of its own), rounded down."""
    out = np.zeros((len(low), len(lows)))
    for f in range(low.shape[1]):
        gap = np.maximum(lows[None, :, f] - high[:, None, f], low[:, None, f] - highs[None, :, f])
        np.maximum(gap, 0.0, out=gap)
        gap *= gap
        out += gap
    out *= 1 - 1e-9
    return out


class Blocked(NamedTuple):
    """Boxes of blocks, the rows with the block they are in (``_cell``), and a function that sends other rows to blocks."""

    low: np.ndarray
    high: np.ndarray
    rows: DataFrame
    send: Callable[[DataFrame], DataFrame]


def cut_table(targets: DataFrame, n_rows: int, width: int, rows_of: int, row_id: str, features: str) -> Blocked:
    """Blocks of about ``rows_of`` near rows of ``targets``; a cell that holds many more is dealt into several."""
    size = max(1, min(SAMPLE_ROWS, 8_000_000 // (8 * width)))
    # A bounded sample, the same for the same rows whatever their partitions.
    head = targets.select(features).orderBy(F.xxhash64(row_id, features), features).limit(size).toPandas()
    sample = np.stack(head[features].to_numpy()).astype(float)
    cells = cut_cells(sample, max(1, min(-(-n_rows // rows_of), len(sample) // SAMPLE_SHARE)))
    shared = targets.sparkSession.sparkContext.broadcast(cells)

    @F.pandas_udf("int")
    def cell(x: pd.Series) -> pd.Series:
        return pd.Series(shared.value.locate(np.stack(x.to_numpy()).astype(float)) if len(x) else [], dtype=np.int32)

    counts = dict(targets.groupBy(cell(features)).count().collect())
    parts = np.array([-(-counts.get(c, 0) // (2 * rows_of)) or 1 for c in range(len(cells.low))])
    first = np.r_[0, np.cumsum(parts)[:-1]]

    def deal(rows: DataFrame, blocks: list[list[int]]) -> DataFrame:
        plan = rows.sparkSession.createDataFrame([*enumerate(blocks)], "_leaf int, _blocks array<int>")
        dealt = F.col("_blocks")[F.pmod(F.xxhash64(row_id, F.lit("cell")), F.size("_blocks")).cast("int")]
        # A row per cell of a bounded sample.
        return (rows.withColumn("_leaf", cell(features)).join(F.broadcast(plan), "_leaf")
                .withColumn("_cell", dealt).drop("_leaf", "_blocks"))

    dealt = materialize(deal(targets, [list(range(f, f + p)) for f, p in zip(first.tolist(), parts.tolist())]))
    # Equal ids can leave blocks empty; nobody is sent there.
    full = {r[0] for r in dealt.select("_cell").distinct().collect()}
    present = [[b for b in range(f, f + p) if b in full] or [min(full)] for f, p in zip(first.tolist(), parts.tolist())]
    return Blocked(np.repeat(cells.low, parts, axis=0), np.repeat(cells.high, parts, axis=0), dealt,
                   lambda rows: deal(rows, present))


def visit(queries: DataFrame, targets: DataFrame, kernel: Callable, schema: str, row_id: str, features: str,
          extra_queries: Sequence[str], extra_targets: Sequence[str]) -> DataFrame:
    """Results of ``kernel`` over the rows of ``queries`` and the block of ``targets`` that they name in ``_cell``.

    Many visitors of a block come in several parts.
    """
    counts = materialize(queries.groupBy("_cell").agg(F.ceil(F.count(F.lit(1)) / VISITORS).cast("int").alias("_n")))
    total = counts.agg(F.sum("_n")).first()[0] or 0
    part = F.pmod(F.xxhash64(row_id, F.lit("part")), F.col("_n")).cast("int")
    counts = broadcast_if_small(counts, 2)
    left = _packed(queries.join(counts, "_cell").withColumn("_part", part), ["_cell", "_part"], row_id, features, extra_queries, "l")
    right = _packed(targets.join(counts, "_cell"), ["_cell", "_n"], row_id, features, extra_targets, "r")
    right = right.select("*", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("_part")).drop("_n")
    # More tasks than pairs: pairs that fall into one task wait for each other.
    met = left.repartition(max(1, min(2 * total, 20_000)), "_cell", "_part").hint("merge").join(right, ["_cell", "_part"])
    return _run(met.withColumn("same", F.lit(False)), [], list(extra_queries), list(extra_targets), ["_cell"], kernel, schema, False)
