"""Assignment to given centroids."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablegauge.functions.vectors import euclidean_distance
from tablegauge.operators.blocks import BLOCK_ROWS, Block, distances, scan_cross, tiles

#: Most centroid values that are laid out as literals in the plan.
LITERAL_CELLS = 100_000


def class_centroids(df: DataFrame, label: str, features: str = "features",
                    by: Sequence[str] = ()) -> DataFrame:
    """``(by..., cluster, centroid)``: the mean row of every class."""
    from tablegauge.operators.moments import cluster_moments
    return cluster_moments(df, features, label, by).select(*by, "cluster", "centroid")


def _nearest_kernel(left: Block, right: Block, same: bool) -> pd.DataFrame:
    n = len(left.ids)
    least, cluster = np.full(n, np.inf), np.full(n, np.iinfo(np.int64).max)
    for a, b, _ in tiles(left, right, same):
        d, ids = distances(left.x[a], right.x[b]), right.ids[b]
        order = np.argsort(ids)
        at = order[np.argmin(d[:, order], axis=1)]
        near = d[np.arange(len(at)), at]
        closer = (near < least[a]) | ((near == least[a]) & (ids[at] < cluster[a]))
        least[a], cluster[a] = np.where(closer, near, least[a]), np.where(closer, ids[at], cluster[a])
    return pd.DataFrame({"row_id": left.ids, "cluster": cluster, "distance": least})


def assign_nearest(df: DataFrame, centroids: DataFrame, features: str = "features",
                   row_id: str = "row_id", out: str = "cluster") -> DataFrame:
    """Add the nearest centroid's ``cluster`` (BIGINT, the smaller on ties) and its ``distance``.

    A few centroids become literals of one projection; many meet the rows block by block.
    """
    head = centroids.select(F.col("cluster").cast("bigint").alias("cluster"),
                            F.col("centroid").alias("features"))
    width = len((head.first() or [None, []])[1])
    found = head.limit(LITERAL_CELLS // max(1, width) + 1).collect()
    if len(found) * width <= LITERAL_CELLS:
        options = [F.struct(euclidean_distance(F.col(features), F.lit(r["features"])).alias("distance"),
                            F.lit(r["cluster"]).alias("cluster"))
                   for r in found]
        best = F.array_min(F.array(*options))
        return (df.withColumn("_best", best).withColumn(out, F.col("_best.cluster"))
                .withColumn("distance", F.col("_best.distance")).drop("_best"))
    rows = df.select(F.col(row_id).alias("row_id"), F.col(features).alias("features"))
    scanned = scan_cross(rows, head.withColumnRenamed("cluster", "row_id"), _nearest_kernel,
                         "row_id bigint, cluster bigint, distance double", block_rows=BLOCK_ROWS)
    best = scanned.groupBy("row_id").agg(F.min(F.struct("distance", "cluster")).alias("_best"))
    best = best.select(F.col("row_id").alias(row_id), F.col("_best.cluster").alias(out), "_best.distance")
    return df.join(best, row_id)
