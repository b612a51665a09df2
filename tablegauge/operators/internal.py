"""Quality of a clustering by itself: 19 indices."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablegauge.operators.blocks import BLOCK_ROWS, Block, by_tiles, distances, scan_pairs
from tablegauge.operators.moments import (
    cluster_dispersion, cluster_moments, global_means, matrix_stats, moment_sums)
from tablegauge.operators.pairs import PAIR_INDICES, pair_indices
from tablegauge.session import fold, match_groups, materialize

#: Fixed value: what replaces a ratio with a non-positive determinant.
INSIGNIFICANT = 1e-20

#: From one pass over the rows (:func:`~tablegauge.operators.moments.moment_sums`).
MOMENT_INDICES = {
    "WGSS": "wgss",
    "BGSS": "bgss",
    "Ball-Hall": "mean_dispersions / k",
    "Banfeld-Raftery": "log_dispersions",
    "Log-SS-Ratio": "ln(try_divide(bgss, wgss))",
    "Calinski-Harabasz": "try_divide(n - k, k - 1) * try_divide(bgss, wgss)",
}

#: From the scatter matrices (:func:`~tablegauge.operators.moments.matrix_stats`).
MATRIX_INDICES = {
    "Det-Ratio": f"CASE WHEN det_w > 0 AND det_t > 0 THEN det_t / det_w ELSE {INSIGNIFICANT}D END",
    "Ksq-DetW": "k * k * det_w",
    "Log-Det-Ratio": f"CASE WHEN det_w > 0 AND det_t > 0 THEN n * ln(det_t / det_w) ELSE {INSIGNIFICANT}D END",
    "Scott-Symons": "nanvl(log_dets, CAST(NULL AS DOUBLE))",
    "Trace-WiB": f"CASE WHEN det_w > 0 THEN trace_wib ELSE {INSIGNIFICANT}D END",
}

#: From distances to centroids and between centroids (:func:`centroid_stats`).
CENTROID_INDICES = {
    "Davies-Bouldin": "worst_ratios / k",
    "Ray-Turi": "try_divide(wgss, least_square * n)",
    "PBM": f"CASE WHEN k * sum_to_centroid = 0 THEN {INSIGNIFICANT}D ELSE "
           "pow(sum_to_mean * greatest / (k * sum_to_centroid), 2) END",
    "Score": "1 - 1 / exp(exp(between_sum / (k * n) - within_sum))",
}

INTERNAL_INDICES = (*MOMENT_INDICES, *MATRIX_INDICES, *PAIR_INDICES, *CENTROID_INDICES, "Hartigan")


def _centroid_kernel(left: Block, right: Block, same: bool) -> pd.DataFrame:
    """Per centroid: worst (s_i + s_j) / d_ij, least squared and greatest distance to another."""
    square = distances(left.x, right.x, squared=True)

    def reduce(ids, mine, others, d2):
        d2 = d2.copy()
        if same:
            np.fill_diagonal(d2, np.nan)
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = (mine[:, None] + others[None, :]) / np.sqrt(d2)
        empty = d2.shape[1] - (1 if same else 0) == 0
        blank = np.full(len(ids), np.nan)
        return pd.DataFrame({"id": ids, "worst": blank if empty else np.nanmax(ratio, 1),
                             "least_square": blank if empty else np.nanmin(d2, 1),
                             "greatest": blank if empty else np.sqrt(np.nanmax(d2, 1))})

    s_left, s_right = left.extra["mean_to_centroid"], right.extra["mean_to_centroid"]
    out = reduce(left.ids, s_left, s_right, square)
    if not same:
        out = pd.concat([out, reduce(right.ids, s_right, s_left, square.T)])
    return out


def centroid_distances(dispersion: DataFrame, by: Sequence[str] = (),
                       block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Per group: sum of the worst ratios, least squared and greatest centroid distance."""
    by = list(by)
    rows = dispersion.withColumn("row_id", F.xxhash64(F.col("cluster").cast("string")))
    scanned = scan_pairs(rows, by_tiles(_centroid_kernel), "id bigint, worst double, least_square double, greatest double",
                         by, features="centroid", extra=["mean_to_centroid"], block_rows=block_rows)
    clean = scanned.withColumns({c: F.nanvl(c, F.lit(None).cast("double"))
                                 for c in ("worst", "least_square", "greatest")})
    per_cluster = clean.groupBy(*by, "id").agg(
        F.max("worst").alias("worst"), F.min("least_square").alias("least_square"),
        F.max("greatest").alias("greatest"))
    return per_cluster.groupBy(*by).agg(
        F.sum("worst").alias("worst_ratios"), F.min("least_square").alias("least_square"),
        F.max("greatest").alias("greatest"))


def centroid_stats(df: DataFrame, moments: DataFrame, features: str, cluster: str,
                   by: Sequence[str]) -> DataFrame:
    """One row per group with all inputs of :data:`CENTROID_INDICES`."""
    by = list(by)
    means = materialize(global_means(df, by, features))
    dispersion = materialize(cluster_dispersion(df, moments, means, features, cluster, by))
    sums = dispersion.groupBy(*by).agg(
        F.sum("size").alias("n"), F.count(F.lit(1)).alias("k"), F.sum("wgss").alias("wgss"),
        F.sum("sum_to_centroid").alias("sum_to_centroid"), F.sum("sum_to_mean").alias("sum_to_mean"),
        F.sum(F.col("size") * F.col("centroid_to_mean")).alias("between_sum"),
        F.sum("mean_to_centroid").alias("within_sum"))
    apart = centroid_distances(dispersion, by)
    if by:
        return match_groups(sums, apart, by)
    return fold([sums, apart])


def hartigan(df: DataFrame, moments: DataFrame, features: str = "features",
             by: Sequence[str] = (), row_id: str = "row_id", seed: int = 42,
             reference_mean: bool = False) -> DataFrame:
    """(n - K - 1)(WGSS - D) / D with D the dispersion of a fresh k-means with K + 1 clusters.

    ``reference_mean`` centres each new cluster on one mean over all its cells instead of
    one mean per feature.
    """
    from tablegauge.operators.clustering import kmeans

    by = list(by)
    sums = moment_sums(moments, by).select(*by, "n", "k", "wgss")
    if by:
        wanted = sums.select(*by, (F.col("k") + 1).cast("int").alias("n_clusters"))
        rows = match_groups(df.select(*by, row_id, features), wanted, by)
    else:
        rows = df.select(row_id, features)
    k = None if by else int(sums.first()["k"]) + 1
    again = kmeans(rows, k, features=features, row_id=row_id, by=by, seed=seed,
                   n_clusters_col="n_clusters" if by else None)
    fresh = cluster_moments(again, features, "cluster", by)
    cells = F.aggregate("centroid", F.lit(0.0), lambda acc, v: acc + v) / F.size("centroid")
    shift = F.aggregate("centroid", F.lit(0.0), lambda acc, v: acc + (v - cells) * (v - cells))
    part = F.col("wgss") + (F.col("size") * shift if reference_mean else F.lit(0.0))
    dispersion = fresh.groupBy(*by).agg(F.sum(part).alias("d"))
    both = match_groups(sums, dispersion, by) if by else fold([sums, dispersion])
    return both.select(*by, F.expr("try_divide((n - k - 1) * (wgss - d), d)").alias("Hartigan"))


def internal_indices(df: DataFrame, features: str = "features", cluster: str = "cluster",
                     names: Sequence[str] | None = None, by: Sequence[str] = (),
                     row_id: str = "row_id", seed: int = 42, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Long table ``(by..., index_name, value)`` of the named indices (default: all).

    Noise (cluster -1) counts as one more cluster.  ``df`` is read once per family of
    indices asked for, so cache it or read it from a file.
    """
    by = list(by)
    names = list(names or INTERNAL_INDICES)
    unknown = [x for x in names if x not in INTERNAL_INDICES]
    if unknown:
        raise KeyError(f"unknown internal indices: {unknown}")

    def long(wide: DataFrame, formulas: dict[str, str]) -> DataFrame:
        return (wide.select(*by, *[F.expr(f).cast("double").alias(x) for x, f in formulas.items()])
                .unpivot(by, list(formulas), "index_name", "value"))

    def wanted(formulas: dict[str, str]) -> dict[str, str]:
        return {x: f for x, f in formulas.items() if x in names}

    parts = []
    moments = None
    if wanted(MOMENT_INDICES) or wanted(CENTROID_INDICES) or "Hartigan" in names:
        moments = cluster_moments(df, features, cluster, by)
    if wanted(CENTROID_INDICES) or "Hartigan" in names:
        moments = materialize(moments)
    if wanted(MOMENT_INDICES):
        parts.append(long(moment_sums(moments, by), wanted(MOMENT_INDICES)))
    if wanted(CENTROID_INDICES):
        parts.append(long(centroid_stats(df, moments, features, cluster, by), wanted(CENTROID_INDICES)))
    if wanted(MATRIX_INDICES):
        parts.append(long(matrix_stats(df, features, cluster, by), wanted(MATRIX_INDICES)))
    pairs = {x: x for x in PAIR_INDICES if x in names}
    if pairs:
        parts.append(long(pair_indices(df, features, cluster, by, row_id, block_rows, list(pairs)), pairs))
    if "Hartigan" in names:
        parts.append(long(hartigan(df, moments, features, by, row_id, seed), {"Hartigan": "Hartigan"}))
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result
