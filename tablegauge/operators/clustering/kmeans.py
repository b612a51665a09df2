"""k-means of a whole table, or of every group."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablegauge.operators.clustering.groups import cluster_groups
from tablegauge.operators.clustering.lloyd import ROUNDS, TOLERANCE, first_centers, moved, sums
from tablegauge.operators.clustering.lloyd import nearest as lloyd_nearest
from tablegauge.operators.scans import Scanner, pack

#: Rows from which the first centres of all starts are drawn.
SEED_ROWS = 10_000


@dataclass(frozen=True)
class KMeansFit:
    """The cheapest of several starts: centres, rows of each, sum of squared distances."""

    centers: np.ndarray
    sizes: np.ndarray
    cost: float
    costs: tuple[float, ...]
    scans: int


def fit_kmeans(df: DataFrame, k: int, features: str = "features", seed: int = 42,
               n_init: int = 10, max_iter: int = ROUNDS, tol: float = TOLERANCE) -> KMeansFit:
    """The cheapest of ``n_init`` starts; every scan of the rows moves the centres of all of them.

    The first centres come from the ``SEED_ROWS`` rows with the least hashes (all rows of a table
    that has no more).  A start ends when
    no centre moves by more than ``tol``; a centre without rows stays where it is.
    """
    rows = df.select(F.col(features).cast("array<double>").alias("features"))
    # A bounded sample, the same for the same rows whatever their partitions.
    head = rows.orderBy(F.xxhash64("features"), "features").limit(SEED_ROWS).toPandas()
    if not len(head):
        raise ValueError("there are no rows to cluster")
    centers, middle = first_centers(np.stack(head["features"].to_numpy()).astype(np.float64), k, n_init, seed)
    scanner = Scanner(pack(rows))
    sizes, costs = np.zeros((n_init, k)), np.full(n_init, np.inf)
    active, scans = np.arange(n_init), 0
    while len(active):
        now = centers[active]
        found = scanner.sum(lambda x, now=now: sums(x - middle, now))
        scans += 1
        new, still = moved(found, now, tol)
        found = found.reshape(len(active), k, -1)
        sizes[active], costs[active] = found[..., -2], found[..., -1].sum(1)
        # A start that stands still keeps the centres whose cost was just measured.
        centers[active] = np.where(still[:, None, None], now, new)
        active = active[~still] if scans < max_iter else active[:0]
    best = int(costs.argmin())
    return KMeansFit(centers[best] + middle, sizes[best], float(costs[best]), tuple(costs.tolist()), scans)


def kmeans(df: DataFrame, k: int | None, features: str = "features", row_id: str = "row_id",
           by: Sequence[str] = (), seed: int = 42, n_init: int = 10,
           n_clusters_col: str | None = None) -> DataFrame:
    """``df`` with a ``cluster`` column; with ``by``, every (small) group is clustered alone."""
    if by:
        wanted = n_clusters_col or k
        return cluster_groups(df, ["kmeans"], wanted, by, features, standardize=False,
                              seed=seed).withColumnRenamed("kmeans", "cluster")
    shared = df.sparkSession.sparkContext.broadcast(fit_kmeans(df, k, features, seed, n_init).centers)

    @F.pandas_udf("int")
    def nearest(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        centers = shared.value
        for batch in batches:
            x = np.stack(batch.to_numpy()).astype(np.float64) if len(batch) else np.zeros((0, centers.shape[1]))
            yield pd.Series(lloyd_nearest(x, centers).astype(np.int32))

    return df.withColumn("cluster", nearest(F.col(features).cast("array<double>")))


def cluster_summary(df: DataFrame, features: str = "features", cluster: str = "cluster",
                    by: Sequence[str] = ()) -> DataFrame:
    """``(by..., cluster, size, centroid, inertia)`` of a clustering."""
    from tablegauge.operators.moments import cluster_moments
    return cluster_moments(df, features, cluster, by).withColumnRenamed("wgss", "inertia")
