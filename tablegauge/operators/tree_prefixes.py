"""Every grid point of a tree or forest search from one deep fit per fold.

A greedy tree that is cut at depth d is the tree fitted with depth d, and the first m trees of a
forest are a forest of m trees.  So a search over depths and numbers of trees needs one fit per
fold: a walk over flat node arrays meets the answers of all depths on its way down.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
from pyspark.ml.classification import DecisionTreeClassificationModel, RandomForestClassificationModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablegauge.session import scratch_path

#: Fits that run side by side.
PARALLEL_FITS = 4


@dataclass(frozen=True)
class FlatTrees:
    """The nodes of all trees of a model: split, children, class shares; leaves have feature -1."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    share: np.ndarray

    def depth(self) -> int:
        """The depth of the deepest tree."""
        level, n = self.roots, -1
        while len(level):
            n += 1
            inner = level[self.feature[level] >= 0]
            level = np.concatenate([self.left[inner], self.right[inner]])
        return n

    def answers(self, x: np.ndarray, depths: Sequence[int], sizes: Sequence[int]) -> np.ndarray:
        """Classes ``(depths, sizes, rows)``: what the first trees say, cut at each depth.

        A forest adds up the class shares of its trees; of equal classes the first is taken.
        """
        n, place = len(x), {d: i for i, d in enumerate(depths)}
        total = np.zeros((len(depths), n, self.share.shape[1]))
        out = np.zeros((len(depths), len(sizes), n), dtype=np.int64)
        rows = np.arange(n)
        for tree, root in enumerate(self.roots[: max(sizes)], 1):
            at = np.full(n, root)
            for level in range(max(depths) + 1):
                if level in place:
                    total[place[level]] += self.share[at]
                inner = self.feature[at] >= 0
                if level == max(depths):
                    break
                if not inner.any():
                    # All rows are in leaves: the deeper cuts say the same.
                    for d, i in place.items():
                        if d > level:
                            total[i] += self.share[at]
                    break
                goes_left = x[rows, np.maximum(self.feature[at], 0)] <= self.threshold[at]
                at = np.where(inner, np.where(goes_left, self.left[at], self.right[at]), at)
            for j, size in enumerate(sizes):
                if size == tree or (size > tree == len(self.roots)):
                    out[:, j] = total.argmax(2)
        return out


def flatten(model: DecisionTreeClassificationModel | RandomForestClassificationModel) -> FlatTrees:
    """The nodes of a fitted model, read from its saved table."""
    spark = SparkSession.active()
    path = scratch_path(spark, "trees")
    model.write().save(path)
    nodes = spark.read.parquet(f"{path}/data")
    if "nodeData" in nodes.columns:
        nodes = nodes.select("treeID", "nodeData.*")
    else:
        nodes = nodes.withColumn("treeID", F.lit(0))
    # As many rows as the model has nodes, which the fit holds on the driver anyway.
    table = nodes.select("treeID", "id", "impurityStats", "leftChild", "rightChild", F.col("split.featureIndex").alias("feature"),
                         F.get("split.leftCategoriesOrThreshold", F.lit(0)).alias("threshold"),
                         F.col("split.numCategories").alias("categories")).toPandas()
    table = table.sort_values(["treeID", "id"], ignore_index=True)
    inner = table["leftChild"].to_numpy() >= 0
    if (table["categories"].to_numpy()[inner] != -1).any():
        raise ValueError("only numeric features are supported")
    first = table.groupby("treeID").cumcount().to_numpy() == 0
    roots = np.flatnonzero(first)
    # Ids count from 0 in every tree; trees are stored one behind the other.
    start = roots[np.cumsum(first) - 1]
    stats = np.stack(table["impurityStats"].to_numpy())
    child = lambda c: np.where(inner, table[c].to_numpy() + start, -1)
    return FlatTrees(roots, np.where(inner, table["feature"].to_numpy(), -1), table["threshold"].fillna(0.0).to_numpy(),
                     child("leftChild"), child("rightChild"), stats / stats.sum(1, keepdims=True))


def fit_folds(fit: Callable[[DataFrame], object], train: DataFrame, folds: int) -> dict[int, FlatTrees]:
    """One model per fold, from the rows outside it; -1 is the model of all rows."""
    def one(fold: int) -> tuple[int, FlatTrees]:
        return fold, flatten(fit(train if fold < 0 else train.where(F.col("fold") != fold)))

    with ThreadPool(PARALLEL_FITS) as pool:
        return dict(pool.map(one, range(-1, folds)))


COUNTS = "fold int, depth int, size int, label double, prediction double, n bigint"


def prefix_counts(rows: DataFrame, models: Mapping[int, FlatTrees], depths: Sequence[int], sizes: Sequence[int]) -> DataFrame:
    """``fold, depth, size, label, prediction, n``: confusion counts of every cut and prefix.

    ``rows`` has ``features, label, fold``; a row is judged by the model of its fold, once for all
    points.  A task emits a few rows per fold and point.
    """
    shared = rows.sparkSession.sparkContext.broadcast((dict(models), list(depths), list(sizes)))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        models_, depths_, sizes_ = shared.value
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for fold, part in batch.groupby("fold"):
                x, label = np.stack(part["features"].to_numpy()), part["label"].to_numpy().astype(np.int64)
                said = models_[fold].answers(x, depths_, sizes_)
                cell = (np.arange(said[..., 0].size).reshape(said.shape[:2])[..., None] * 2 + label) * 2 + said
                n = np.bincount(cell.ravel(), minlength=4 * said[..., 0].size)
                total[fold] = total.get(fold, 0) + n
        for fold, n in total.items():
            at = np.flatnonzero(n)
            point, pair = at // 4, at % 4
            yield pd.DataFrame({"fold": np.int32(fold), "depth": np.array(depths_, dtype=np.int32)[point // len(sizes_)],
                                "size": np.array(sizes_, dtype=np.int32)[point % len(sizes_)],
                                "label": (pair // 2).astype(float), "prediction": (pair % 2).astype(float), "n": n[at]})

    counted = rows.select("features", "label", "fold").mapInPandas(count, COUNTS)
    return counted.groupBy("fold", "depth", "size", "label", "prediction").agg(F.sum("n").alias("n"))
