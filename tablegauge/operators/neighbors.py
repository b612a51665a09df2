"""Nearest-neighbour votes by block scans; rows of few features visit near cells only."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablegauge.operators.blocks import BLOCK_ROWS, WIDE, Block, rough_squares, scan_cross, scan_pairs, tiles
from tablegauge.operators.cells import box_squares, cut_table, near_order, visit
from tablegauge.operators.nearest import Nearest, square_bound
from tablegauge.session import materialize

NEIGHBOR = "row_id bigint, neighbor bigint, distance double, label double"
#: Pairs of rows from which cells pay, bounds of the rows of a cell's block, and rows of a tile of it.
MANY_PAIRS, CELL_ROWS, NEAR_ROWS = 200_000_000, (1024, 8192), 256


def _frame(found: Nearest, ids: np.ndarray) -> pd.DataFrame:
    out = pd.DataFrame({"row_id": np.repeat(ids, found.k), "neighbor": found.id.ravel(),
                        "distance": found.distance.ravel(), "label": found.value.ravel()})
    return out[np.isfinite(out["distance"])]


def _keep_nearest(candidates: DataFrame, k: int) -> DataFrame:
    """Best k per row; a row has k candidates per block, so its window is short."""
    window = Window.partitionBy("row_id").orderBy("distance", "neighbor")
    return candidates.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k)


def _in_tiles(queries: Block, targets: Block, k: int, label: str, fold: str | None, bound: np.ndarray | None) -> Nearest:
    """The k nearest targets of every query: tiles of near rows meet in the order of their distance, far ones never.

    ``bound`` is a distance that the k nearest do not exceed.
    """
    out = Nearest(len(queries.ids), k)
    far = near_order(targets.x, NEAR_ROWS)
    lows, highs = (np.stack([f(targets.x[t], axis=0) for t in far]) for f in (np.min, np.max))
    for rows in near_order(queries.x, NEAR_ROWS):
        x, found = queries.x[rows], Nearest(len(rows), k)
        square = box_squares(x.min(0)[None], x.max(0)[None], lows, highs)[0]
        least = np.inf if bound is None else square_bound(bound[rows]).max()
        for t in np.argsort(square):
            if square[t] > min(least, square_bound(found.distance[:, -1]).max()):
                break
            cols = far[t]
            y = targets.x[cols]
            rough, slack = rough_squares(x, y)
            if fold:
                rough[queries.extra[fold][rows][:, None] == targets.extra[fold][cols][None, :]] = np.inf
            if bound is not None:
                rough[rough > square_bound(bound[rows])[:, None] + slack] = np.inf
            found.update(slice(None), rough, slack, x, y, targets.ids[cols], targets.extra[label][cols])
        out.distance[rows], out.value[rows] = found.distance, found.value
        out.id = out.id.astype(found.id.dtype) if found.id.dtype.kind == "f" else out.id
        out.id[rows] = found.id
    return out


def _by_cells(queries: DataFrame, targets: DataFrame, n_targets: int, width: int, k: int, label: str, row_id: str,
              features: str, fold: str | None = None) -> DataFrame:
    """Candidates among which the k nearest are: every row searches a block of its own cell, then the blocks that lie
    within the distance found there."""
    finite = F.forall(features, lambda v: F.coalesce(F.abs(v) < float("inf"), F.lit(False)))
    folds = [fold] if fold else []
    chosen = {c: F.col(c) for c in (row_id, label, *folds)} | {features: F.col(features).cast("array<double>")}
    # What is not finite is no one's neighbour.
    targets = targets.where(finite).select(*[v.alias(c) for c, v in chosen.items()])
    asked = queries.where(finite).select(*[chosen[c].alias(c) for c in (row_id, features, *folds)])
    cores = targets.sparkSession.sparkContext.defaultParallelism
    rows_of = min(max(n_targets // (4 * cores), CELL_ROWS[0]), CELL_ROWS[1])
    if targets.isEmpty():
        return targets.sparkSession.createDataFrame([], NEIGHBOR)
    blocks = cut_table(targets, n_targets, width, rows_of, row_id, features)
    low, high, targets = blocks.low, blocks.high, blocks.rows

    def first(left: Block, right: Block, same: bool) -> pd.DataFrame:
        found = _in_tiles(left, right, k, label, fold, None)
        bound, others = found.distance[:, -1], []
        for at in range(0, len(bound), 256):
            x = left.x[at:at + 256]
            near = box_squares(x, x, low, high) <= square_bound(bound[at:at + 256])[:, None]
            near[:, left.params["_cell"]] = False
            others += [np.flatnonzero(row) for row in near]
        ids = found.id.tolist() if found.id.dtype.kind == "i" else [[None if np.isnan(i) else int(i) for i in row] for row in found.id]
        return pd.DataFrame({"row_id": left.ids, "features": list(left.x), **{"fold": left.extra[c] for c in folds}, "bound": bound,
                             "others": others, "neighbor": ids, "distance": list(found.distance), "label": list(found.value)})

    def later(left: Block, right: Block, same: bool) -> pd.DataFrame:
        return _frame(_in_tiles(left, right, k, label, fold and "fold", left.extra["bound"]), left.ids)

    schema = ("row_id bigint, features array<double>, " + "fold int, " * len(folds)
              + "bound double, others array<int>, neighbor array<bigint>, distance array<double>, label array<double>")
    begun = materialize(visit(blocks.send(asked), targets, first, schema, row_id, features, folds, [label, *folds]))
    own = begun.select("row_id", F.inline(F.arrays_zip("neighbor", "distance", "label"))).where(F.col("distance") < float("inf"))
    rest = begun.select(F.col("row_id").alias(row_id), F.col("features").alias(features), *[F.col("fold") for _ in folds], "bound",
                        F.explode("others").alias("_cell"))
    partners = targets.withColumnRenamed(fold, "fold") if fold else targets
    more = visit(rest, partners, later, NEIGHBOR, row_id, features, [*["fold" for _ in folds], "bound"], [label, *["fold" for _ in folds]])
    return own.unionByName(more)


def _extent(df: DataFrame, features: str) -> tuple[int, int]:
    """(rows, features)."""
    n, width = df.agg(F.count(F.lit(1)), F.max(F.size(features))).first()
    return n, width or 1


def nearest_neighbors(test: DataFrame, train: DataFrame, k: int, label: str = "label",
                      row_id: str = "row_id", features: str = "features",
                      block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``(row_id, neighbor, distance, label, rank)``: the exact k nearest training rows."""
    def kernel(left: Block, right: Block, same: bool) -> pd.DataFrame:
        found = Nearest(len(left.ids), k)
        for a, b, _ in tiles(left, right, same):
            rough, slack = rough_squares(left.x[a], right.x[b])
            found.update(a, rough, slack, left.x[a], right.x[b], right.ids[b], right.extra[label][b])
        return _frame(found, left.ids)

    (n_test, _), (n_train, width) = _extent(test, features), _extent(train, features)
    if width <= WIDE and n_test * n_train >= MANY_PAIRS:
        return _keep_nearest(_by_cells(test, train, n_train, width, k, label, row_id, features), k)
    scanned = scan_cross(test, train, kernel, NEIGHBOR, row_id, features, extra_right=[label],
                         block_rows=block_rows, extent=(n_test, n_train, width))
    return _keep_nearest(scanned, k)


def fold_neighbors(train: DataFrame, k: int, fold: str = "fold", label: str = "label",
                   row_id: str = "row_id", features: str = "features",
                   block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The k nearest rows of the *other* folds for every row: all folds in one scan."""
    def kernel(left: Block, right: Block, same: bool) -> pd.DataFrame:
        mine, other = Nearest(len(left.ids), k), Nearest(len(right.ids), k)
        for a, b, alike in tiles(left, right, same):
            x, y = left.x[a], right.x[b]
            rough, slack = rough_squares(x, y)
            rough[left.extra[fold][a][:, None] == right.extra[fold][b][None, :]] = np.inf
            mine.update(a, rough, slack, x, y, right.ids[b], right.extra[label][b])
            if not alike:
                (mine if same else other).update(b, rough.T, slack, y, x, left.ids[a], left.extra[label][a])
        return _frame(mine, left.ids) if same else pd.concat([_frame(mine, left.ids), _frame(other, right.ids)])

    n_rows, width = _extent(train, features)
    if width <= WIDE and n_rows * n_rows / 2 >= MANY_PAIRS:
        return _keep_nearest(_by_cells(train, train, n_rows, width, k, label, row_id, features, fold), k)
    scanned = scan_pairs(train, kernel, NEIGHBOR, id_col=row_id, features=features,
                         extra=[label, fold], block_rows=block_rows, extent=(1, n_rows))
    return _keep_nearest(scanned, k)


def vote(neighbors: DataFrame, ks: Sequence[int], weights: Sequence[str] = ("uniform", "distance"),
         positive: float = 1.0, threshold: float | None = None, other: float = 0.0) -> DataFrame:
    """``(row_id, k, weights, share, prediction)`` for every k and weighting, in one aggregation.

    ``share`` is the vote share of ``positive``.  Neighbours at distance 0 outvote all
    others under ``'distance'``.  Without a threshold the larger share wins, the smaller
    label on a tie; with one, ``positive`` wins if its share is above it.
    """
    settings = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(w).alias("weights")) for k in ks for w in weights])
    rows = (neighbors.withColumn("_s", F.explode(settings))
            .select("row_id", "distance", "label", "rank", "_s.k", "_s.weights").where("rank <= k"))
    by_distance, exact = F.col("weights") == "distance", F.col("distance") == 0
    weight = F.when(by_distance & ~exact, 1 / F.col("distance")).when(~by_distance, 1.0).otherwise(0.0)
    hit = F.col("label") == positive
    sums = rows.groupBy("row_id", "k", "weights").agg(
        F.sum(weight).alias("all"), F.sum(F.when(hit, weight).otherwise(0.0)).alias("pos"),
        F.sum(F.when(by_distance & exact, 1.0).otherwise(0.0)).alias("all0"),
        F.sum(F.when(by_distance & exact & hit, 1.0).otherwise(0.0)).alias("pos0"))
    share = F.when(F.col("all0") > 0, F.col("pos0") / F.col("all0")).otherwise(F.col("pos") / F.col("all"))
    low = min(positive, other)
    wins = (F.col("share") > threshold) if threshold is not None else (
        F.col("share") >= 0.5 if positive == low else F.col("share") > 0.5)
    return (sums.withColumn("share", share)
            .withColumn("prediction", F.when(wins, float(positive)).otherwise(float(other)))
            .select("row_id", "k", "weights", "share", "prediction"))
